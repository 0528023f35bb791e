"""Monoids and semirings: how values are combined by Spark aggregates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import settled
from ..errors import GraphError
from ..types import SPARK
from .scalar_ops import BinaryOp, binary

INT_MAX, INT_MIN = 2**63 - 1, -(2**63)


_AGGREGATES: dict[str, Callable[[Column, str], Column]] = {
    "plus": lambda v, t: F.sum(v),
    "times": lambda v, t: F.product(v),
    "min": lambda v, t: F.min(v),
    "max": lambda v, t: F.max(v),
    "land": lambda v, t: F.bool_and(v),
    "lor": lambda v, t: F.bool_or(v),
    "lxor": lambda v, t: F.bit_xor(v.cast("int")) == 1,
}


@dataclass(frozen=True)
class Monoid:
    """An associative and commutative operator with its identity.

    operator is the name of a built-in operator, which becomes a built-in
    aggregate, or any function of two Columns (see summed).
    """

    name: str
    operator: str | Callable[[Column, Column], Column]
    identity: Any
    type: str

    def combine(self, a: Column, b: Column) -> Column:
        return binary(self.operator)(a, b)

    def aggregate(self, v: Column, dtype: str | None = None) -> Column:
        """The built-in aggregate of a built-in operator; summed has the others."""
        dtype = dtype or self.type
        out = _AGGREGATES[self.operator](v, dtype)
        return out.cast(SPARK[dtype]) if dtype in SPARK else out


def summed(df: DataFrame, keys: list[str], monoid: Monoid, dtype: str | None = None) -> DataFrame:
    """(keys, v): the values of each key combined; of no keys, one row, null or the identity where df is empty.

    Built-in operators are one grouped aggregate. Whole-number products are
    exact: see _products. An own operator folds a key's values in parts of FOLD
    at most, and the parts' results again, so no task gathers a key.
    """
    dtype = dtype or monoid.type
    if not isinstance(monoid.operator, str):
        return _folded(df, keys, monoid.operator, dtype)
    if monoid.operator == "times" and dtype == "int64":
        return _products(df, keys)
    return df.groupBy(*keys).agg(monoid.aggregate(F.col("v"), dtype).alias("v"))


def _products(df: DataFrame, keys: list[str]) -> DataFrame:
    """Exact products of 64 bits, an overflow being an error.

    Equal values are counted first. A zero makes the product zero, ones and
    signs take no room, and more than 64 factors of two or more overflow, so of
    each key's distinct values the first 70 in this order tell the product.
    """
    rank = F.when(F.col("v") == 0, 0).when(F.col("v").isin(1, -1), 1).otherwise(2)
    counted = df.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    few = counted.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, "v"))).where("r <= 70")
    pairs = few.groupBy(*keys).agg(F.collect_list(F.struct("v", "n")).alias("x"))
    factors = "flatten(transform(x, p -> array_repeat(p.v, cast(case when p.v = 1 then 0 when p.v = -1 then p.n % 2 else least(p.n, 64) end as int))))"
    product = F.expr(f"if(exists(x, p -> p.v = 0), 0L, aggregate({factors}, 1L, (a, b) -> a * b))")
    return pairs.select(*keys, product.alias("v"))


#: Values of a key that are gathered in one place at most.
FOLD = 1024


def _folded(df: DataFrame, keys: list[str], operator: Callable[[Column, Column], Column], dtype: str) -> DataFrame:
    rows = df.select(*keys, "v")
    fold = F.aggregate(F.slice("x", F.lit(2), F.greatest(F.size("x") - 1, F.lit(0))), F.get("x", 0), operator)
    gathered = lambda df, by: df.groupBy(*by).agg(F.collect_list("v").alias("x")).select(*by, fold.cast(SPARK[dtype]).alias("v"))
    while True:
        parts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / FOLD).cast("int").alias("parts_"))
        if (parts.agg(F.max("parts_")).first()[0] or 0) <= 1:
            return gathered(rows, keys)
        cut = (rows.join(parts, keys) if keys else rows.crossJoin(parts)).withColumn("part_", F.floor(F.rand(7) * F.col("parts_")))
        rows = settled(gathered(cut, [*keys, "part_"])).select(*keys, "v")


@dataclass(frozen=True)
class Semiring:
    """multiply joins two values, add sums the products of a position."""

    name: str
    multiply: str | BinaryOp | Callable[[Column, Column], Column]
    add: str | Callable[[Column, Column], Column]
    add_identity: Any
    multiply_identity: Any
    type: str

    def times(self, a: Column, b: Column) -> Column:
        return binary(self.multiply)(a, b)

    @property
    def monoid(self) -> Monoid:
        return Monoid(f"{self.name}_add", self.add, self.add_identity, self.type)

    @property
    def idempotent(self) -> bool:
        """Whether adding a value twice changes nothing, as for a semi-naive closure."""
        return self.add in ("min", "max", "lor", "land")


# Monoids (name, operator, identity, type).
MONOIDS = {
    name: Monoid(name, operator, identity, dtype)
    for name, operator, identity, dtype in [
        ("plus", "plus", 0, "int64"),
        # containers have no 32-bit floats, so these combine 64-bit ones
        ("plus_fp32", "plus", 0.0, "fp64"),
        ("plus_fp64", "plus", 0.0, "fp64"),
        ("times", "times", 1, "int64"),
        ("times_fp32", "times", 1.0, "fp64"),
        ("times_fp64", "times", 1.0, "fp64"),
        ("min", "min", INT_MAX, "int64"),
        ("min_fp64", "min", float("inf"), "fp64"),
        ("max", "max", INT_MIN, "int64"),
        ("max_fp64", "max", float("-inf"), "fp64"),
        ("land", "land", True, "bool"),
        ("lor", "lor", False, "bool"),
        ("lxor", "lxor", False, "bool"),
    ]
}
# Semirings (name, multiply, add, identity of add, of multiply, type).
SEMIRINGS = {
    name: Semiring(name, times, plus, zero, one, dtype)
    for name, times, plus, zero, one, dtype in [
        ("plus_times", "times", "plus", 0, 1, "int64"),
        ("plus_times_fp64", "times", "plus", 0.0, 1.0, "fp64"),
        ("plus_min", "min", "plus", 0, None, "int64"),
        ("plus_min_fp64", "min", "plus", 0.0, None, "fp64"),
        ("max_plus", "plus", "max", None, 0, "int64"),
        ("max_plus_fp64", "plus", "max", None, 0.0, "fp64"),
        ("max_min", "min", "max", None, None, "int64"),
        ("max_min_fp64", "min", "max", None, None, "fp64"),
        ("min_plus", "plus", "min", None, 0, "int64"),
        ("min_plus_fp64", "plus", "min", None, 0.0, "fp64"),
        ("lor_land", "land", "lor", False, True, "bool"),
        ("land_lor", "lor", "land", True, False, "bool"),
    ]
}


def resolve_monoid(monoid: str | Monoid) -> Monoid:
    if isinstance(monoid, Monoid):
        return monoid
    if monoid not in MONOIDS:
        raise GraphError("unknown_monoid", monoid)
    return MONOIDS[monoid]


def resolve_semiring(semiring: str | Semiring) -> Semiring:
    if isinstance(semiring, Semiring):
        return semiring
    if semiring not in SEMIRINGS:
        raise GraphError("unknown_semiring", semiring)
    return SEMIRINGS[semiring]


def default_combine(dtype: str) -> Monoid:
    """How repeated positions are combined where nothing else is asked for."""
    return MONOIDS["lor" if dtype == "bool" else "plus" if dtype == "int64" else "plus_fp64"]
