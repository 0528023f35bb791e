"""Sparse matrices and vectors as DataFrames of positions and values."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce as fold
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import settled
from ..config import config
from ..errors import GraphError
from ..functions.algebra import Monoid, Semiring, default_combine, resolve_monoid, resolve_semiring, summed
from ..functions.scalar_ops import UnaryOp, unary
from ..types import DEFAULTS, SPARK, recast, validate_type
from .masks import Descriptor, EqualLabels, Mask, masked, positions
from .products import in_row_blocks, mask_first, spread, through_mask

PLAIN = Descriptor()


@dataclass(frozen=True)
class Scalar:
    """A value and its type."""

    value: Any
    type: str = "int64"

    @staticmethod
    def zero(monoid: str | Monoid) -> "Scalar":
        """The identity of a monoid; the largest finite numbers stand for infinities."""
        m = resolve_monoid(monoid)
        limit = 1.7976931348623157e308
        return Scalar(max(-limit, min(limit, m.identity)) if isinstance(m.identity, float) else m.identity, m.type)


def _schema(keys: list[str], dtype: str) -> T.StructType:
    return T.StructType([*[T.StructField(k, T.LongType(), False) for k in keys], T.StructField("v", SPARK[dtype], False)])


def _value(v: Any, dtype: str) -> Any:
    if dtype == "bool":
        return bool(v)
    return float(v) if dtype == "fp64" else int(v)


def _combined(df: DataFrame, keys: list[str], dtype: str, combine: str | Monoid | None) -> DataFrame:
    m = resolve_monoid(combine) if combine else default_combine(dtype)
    return summed(df, keys, m, dtype)


def _checked(df: DataFrame, sizes: dict[str, int], check: bool | None) -> DataFrame:
    """df whose positions lie within sizes and that has no nulls.

    With check=None every column is the row's value if the whole row is right,
    and else an error, so whatever reads a column of a wrong row fails, in any
    plan and without a job of its own.
    True tests by one aggregate at once and raises GraphError. False trusts df,
    and lets later filters be pushed below to its source.
    """
    if check is None:
        inside = [F.col("v").isNotNull(), *[F.col(k).isNotNull() & (F.col(k) >= 0) & (F.col(k) < n) for k, n in sizes.items()]]
        right = fold(lambda a, b: a & b, inside)
        wrong = F.raise_error(F.concat(F.lit(f"index_out_of_bounds: of size {tuple(sizes.values())}, or null: "), F.to_json(F.struct(*df.columns))))
        return df.select(*[F.when(right, F.col(c)).otherwise(wrong.cast(df.schema[c].dataType)).alias(c) for c in df.columns])
    if check:
        _check_bounds(df, sizes)
    return df


def _check_bounds(df: DataFrame, sizes: dict[str, int]) -> None:
    """Raise for a null, or the first row or column outside its size, by one aggregate."""
    nulls = F.count_if(fold(lambda a, b: a | b, [F.col(c).isNull() for c in df.columns]))
    ends = df.agg(nulls.alias("nulls"), *[f(k).alias(f"{k}{n}") for k in sizes for n, f in enumerate((F.min, F.max))]).first()
    if ends["nulls"]:
        raise GraphError("invalid_argument", f"{ends['nulls']} rows hold nulls")
    for k, size in sizes.items():
        for x in (ends[f"{k}0"], ends[f"{k}1"]):
            if x is not None and not 0 <= x < size:
                raise GraphError("index_out_of_bounds", x, {"i": "row" if len(sizes) > 1 else "index", "j": "col"}[k], size)


#: Single entries that wait to be merged; past so many they are, and the result is written.
PENDING = 50_000


class _Log:
    """Entries set one by one, in order; containers that follow each other share it, each as far as it goes."""

    def __init__(self, entries: list[tuple[tuple[int, ...], Any]]):
        self.entries = entries

    def then(self, length: int, at: tuple[int, ...], value: Any) -> "_Log":
        """The log whose first length entries are followed by (at, value)."""
        log = self if len(self.entries) == length else _Log(self.entries[:length])
        log.entries.append((at, value))
        return log


class _Container:
    """What matrices and vectors share.

    base has the entries but those of the log, of which the first pending ones
    overwrite it, later ones each other.
    """

    base: DataFrame
    dtype: str
    log: _Log | None
    pending: int
    kind: str
    keys: list[str]

    @cached_property
    def df(self) -> DataFrame:
        """The entries (keys, v): base, merged with the log by one anti join and a union."""
        if not self.pending:
            return self.base
        last = self._last()
        rows = self.spark.createDataFrame([(*at, v) for at, v in last.items()], _schema(self.keys, self.dtype))
        # PENDING rows at most
        return self.base.join(F.broadcast(rows.select(*self.keys)), self.keys, "left_anti").select(*self.keys, "v").union(rows)

    def _last(self) -> dict[tuple[int, ...], Any]:
        return dict(self.log.entries[: self.pending]) if self.pending else {}

    @property
    def spark(self) -> SparkSession:
        return self.base.sparkSession

    def nvals(self) -> int:
        """The number of stored entries, explicit zeros among them; reads positions, so that wrong ones are an error (see from_df)."""
        return self.df.agg(F.count("*"), F.bit_xor("i")).first()[0]

    def dup(self):
        """A copy; as DataFrames never change, the same plan."""
        return replace(self)

    def cast(self, dtype: str):
        """With values of another type; numbers other than 0 become true."""
        if dtype == self.dtype:
            return self
        return self._with_df(self.df.withColumn("v", recast(F.col("v"), self.dtype, validate_type(dtype))), dtype=dtype)

    def apply(self, op: str | UnaryOp | Callable[[Column], Column]):
        """Each value mapped by a unary operator."""
        return self._with_df(self.df.withColumn("v", unary(op)(F.col("v"))))

    def persist(self):
        """The same entries, kept by the executors once they are computed."""
        return self._with_df(self.df.persist())

    def unpersist(self):
        self.df.unpersist()
        return self

    def _with_df(self, df: DataFrame, **changes: Any):
        return replace(self, base=df, log=None, pending=0, **({"raw": None, "stored": None} if self.kind == "matrix" else {}), **changes)

    def _same_shape(self, other) -> None:
        if self.extent != other.extent:
            raise GraphError("dimension_mismatch", other.extent, self.extent)

    def _ewise_add(self, other, monoid: str | Monoid, mask: Mask | None, descriptor: Descriptor, parts: int | None = None):
        self._same_shape(other)
        m = resolve_monoid(monoid)
        rows = self.df.unionByName(other.cast(self.dtype).df)
        rows = rows.repartition(parts, *self.keys) if parts else rows
        # associative and commutative, so a union and one aggregation do without a full join
        df = summed(rows, self.keys, m, self.dtype)
        return self._with_df(masked(df, self.keys, mask, descriptor, self.kind))

    def _ewise_mult(self, other, monoid: str | Monoid, mask: Mask | None, descriptor: Descriptor):
        self._same_shape(other)
        m = resolve_monoid(monoid)
        b = other.cast(self.dtype).df.withColumnRenamed("v", "w")
        df = self.df.join(b, self.keys).select(*self.keys, m.combine(F.col("v"), F.col("w")).alias("v"))
        return self._with_df(masked(df, self.keys, mask, descriptor, self.kind))

    def _with(self, at: tuple[int, ...], value: Any):
        self._inside(at)
        log = (self.log or _Log([])).then(self.pending, at, _value(value, self.dtype))
        new = replace(self, log=log, pending=self.pending + 1, **({"raw": None, "stored": None} if self.kind == "matrix" else {}))
        return new if new.pending <= PENDING else self._with_df(settled(new.df))

    def _at(self, at: tuple[int, ...]) -> Any:
        self._inside(at)
        last = self._last()
        if at in last:
            return last[at]
        here = fold(lambda a, b: a & b, [F.col(k) == x for k, x in zip(self.keys, at)])
        return self.base.where(here).agg(F.coalesce(F.first("v"), F.lit(DEFAULTS[self.dtype]))).first()[0]

    def _inside(self, at: tuple[int, ...]) -> None:
        for x, size in zip(at, self.extent):
            if not 0 <= x < size:
                raise GraphError("index_out_of_bounds", x, "index", size)

    def set_many(self, entries: DataFrame):
        """Overwrite the positions of entries (keys and v), which are unique: an anti join and a union."""
        new = entries.select(*[F.col(k).cast("long").alias(k) for k in self.keys], F.col("v").cast(SPARK[self.dtype]).alias("v"))
        return self._with_df(self.df.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """The join of a product's sides on k."""
    return spread(left, right, config.heavy_index) if config.heavy_index else left.join(right, "k")


def _multiplied(pairs: DataFrame, sr: Semiring, *keys: str) -> DataFrame:
    """(keys, v) of pairs (keys, x, y)."""
    return pairs.select(*keys, sr.times(F.col("x"), F.col("y")).alias("v"))


@dataclass(frozen=True)
class Matrix(_Container):
    """df has i, j (long) and v, unique on (i, j) and never null."""

    base: DataFrame
    nrows: int
    ncols: int
    dtype: str = "int64"
    #: Rows whose combination df is, and how: a product may combine them where it joins them.
    raw: tuple[DataFrame, Monoid] | None = field(default=None, compare=False, repr=False)
    #: The same entries as tables that are bucketed by i and by j.
    stored: dict[str, DataFrame] | None = field(default=None, compare=False, repr=False)
    log: _Log | None = field(default=None, compare=False, repr=False)
    pending: int = 0
    kind = "matrix"
    keys = ["i", "j"]

    @property
    def shape(self) -> tuple[int, int]:
        return self.nrows, self.ncols

    extent = shape

    @staticmethod
    def new(spark: SparkSession, nrows: int, ncols: int, dtype: str = "int64") -> "Matrix":
        return Matrix.from_coo(spark, nrows, ncols, [], dtype)

    @staticmethod
    def from_coo(spark: SparkSession, nrows: int, ncols: int, entries: Iterable[tuple[int, int, Any]], dtype: str = "int64", combine: str | Monoid | None = None) -> "Matrix":
        """From (row, column, value) triples; repeated positions are combined (added, or or-ed for bool)."""
        validate_type(dtype)
        if nrows < 0 or ncols < 0:
            raise GraphError("invalid_argument", "dimensions must not be negative")
        rows = [(int(i), int(j), _value(v, dtype)) for i, j, v in entries]
        for i, j, _ in rows:
            for x, name, size in ((i, "row", nrows), (j, "col", ncols)):
                if not 0 <= x < size:
                    raise GraphError("index_out_of_bounds", x, name, size)
        df = spark.createDataFrame(rows, _schema(Matrix.keys, dtype))
        return Matrix(_combined(df, Matrix.keys, dtype, combine), nrows, ncols, dtype)

    @staticmethod
    def from_df(df: DataFrame, nrows: int, ncols: int, row: str = "i", col: str = "j", val: str | Column = "v", dtype: str = "int64", *, combine: str | Monoid | None = None, unique: bool = False, scattered: bool = False, check: bool | None = None, parts: int | None = None) -> "Matrix":
        """From a DataFrame without nulls; for check see _checked.

        unique skips the combining aggregation. scattered says that few
        positions repeat, so that a product shuffles the rows by its inner index
        at once and combines them there, instead of by position before. parts
        deals rows to so many tasks by position before they are combined, where
        Spark would take fewer and larger ones.
        """
        validate_type(dtype)
        if nrows < 0 or ncols < 0:
            raise GraphError("invalid_argument", "dimensions must not be negative")
        v = F.col(val) if isinstance(val, str) else val
        df = df.select(F.col(row).cast("long").alias("i"), F.col(col).cast("long").alias("j"), v.cast(SPARK[dtype]).alias("v"))
        df = _checked(df, {"i": nrows, "j": ncols}, check)
        if unique:
            return Matrix(df, nrows, ncols, dtype)
        df = df.repartition(parts, *Matrix.keys) if parts else df
        monoid = resolve_monoid(combine) if combine else default_combine(dtype)
        plain = isinstance(monoid.operator, str) and not (monoid.operator == "times" and dtype == "int64")
        return Matrix(summed(df, Matrix.keys, monoid, dtype), nrows, ncols, dtype, (df, monoid) if scattered and plain else None)

    def _by(self, index: str, dtype: str, parts: int | None = None) -> DataFrame:
        """The entries with values of dtype, for a join on index (see from_df's scattered, and write); parts deals those that aren't stored to so many tasks."""
        if self.stored is not None:
            return self._with_df(self.stored[index]).cast(dtype).df
        if self.raw is None:
            df = self.cast(dtype).df
            return df.repartition(parts, index) if parts else df
        rows, monoid = self.raw
        rows = rows.repartition(parts, index) if parts else rows.repartition(index)
        return self._with_df(summed(rows, self.keys, monoid, self.dtype)).cast(dtype).df

    def write(self, name: str, buckets: int = 200, path: str | None = None) -> "Matrix":
        """Store the matrix as two tables, name_i and name_j, and read it from there.

        The first is bucketed and sorted by row, the other by column, so a
        product of stored matrices with as many buckets joins them as they lie,
        without a shuffle of either; a product with another matrix shuffles that
        one alone. A bucket should have some hundred MB. path is a shared folder
        for the tables' files, else they lie in the warehouse. The tables'
        properties have the shape, the type and the number of entries.
        """
        rows = self._by("i", self.dtype, buckets)
        for index in self.keys:
            writer = rows.write.format("parquet").mode("overwrite").bucketBy(buckets, index).sortBy(index)
            (writer.option("path", f"{path}/{name}_{index}") if path else writer).saveAsTable(f"{name}_{index}")
            # a bucket is one task's and one file
            rows = self.spark.table(f"{name}_i").repartition(buckets, "j")
        facts = {"semiweave.nrows": self.nrows, "semiweave.ncols": self.ncols, "semiweave.type": self.dtype, "semiweave.nvals": self.spark.table(f"{name}_i").count()}
        listed = ", ".join(f"'{k}' = '{v}'" for k, v in facts.items())
        for index in self.keys:
            self.spark.sql(f"ALTER TABLE {name}_{index} SET TBLPROPERTIES ({listed})")
        return Matrix.read(self.spark, name)

    @staticmethod
    def read(spark: SparkSession, name: str) -> "Matrix":
        """A matrix that write has stored."""
        facts = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}_i").collect()}
        if "semiweave.type" not in facts:
            raise GraphError("invalid_argument", f"{name} is no stored matrix")
        stored = {index: spark.table(f"{name}_{index}") for index in Matrix.keys}
        return Matrix(stored["i"], int(facts["semiweave.nrows"]), int(facts["semiweave.ncols"]), facts["semiweave.type"], stored=stored)

    @staticmethod
    def drop(spark: SparkSession, name: str) -> None:
        """Delete a stored matrix; files outside the warehouse stay."""
        for index in Matrix.keys:
            spark.sql(f"DROP TABLE IF EXISTS {name}_{index}")

    def to_coo(self) -> DataFrame:
        """Entries in row-major order."""
        return self.df.orderBy("i", "j")

    def entries(self) -> list[tuple[int, int, Any]]:
        """to_coo as a list; for small matrices."""
        return [tuple(r) for r in self.to_coo().collect()]

    def to_dense(self) -> DataFrame:
        """(i, row): an array for each row with defaults where nothing is stored; for inspection.

        The entries of a row become a map that an array of ncols is filled from.
        """
        stored = self.df.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("m"))
        columns = F.sequence(F.lit(0).cast("long"), F.lit(self.ncols - 1).cast("long")) if self.ncols else F.array().cast("array<long>")
        zero = F.lit(DEFAULTS[self.dtype]).cast(SPARK[self.dtype])
        rows = self.spark.range(self.nrows).withColumnRenamed("id", "i").join(stored, "i", "left")
        return rows.select("i", F.transform(columns, lambda j: F.coalesce(F.element_at("m", j), zero)).alias("row"))

    def transpose(self, mask: Mask | None = None, descriptor: Descriptor = PLAIN) -> "Matrix":
        """Swap i and j: a projection that Catalyst merges into what follows."""
        swap = lambda df: df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
        # columns stay in their places, so that a matrix and its transpose are shuffled once where their indexes meet
        raw = (self.raw[0].select(F.col("i").alias("j"), F.col("j").alias("i"), "v"), self.raw[1]) if self.raw is not None and mask is None else None
        stored = {"i": swap(self.stored["j"]), "j": swap(self.stored["i"])} if self.stored is not None and mask is None else None
        return Matrix(masked(swap(self.df), self.keys, mask, descriptor, self.kind), self.ncols, self.nrows, self.dtype, raw, stored)

    T = property(transpose)

    def mxm(self, other: "Matrix", semiring: str | Semiring = "plus_times", mask: Mask | EqualLabels | None = None, descriptor: Descriptor = PLAIN, *, blocks: int | None = None) -> "Matrix":
        """The product: a join on the inner index and a grouped aggregate.

        A mask that is no complement is written once. Where its positions need
        far fewer rows than the product has terms (a job counts both), the join
        starts from them and forms no other term; else rows and columns that it
        leaves out are dropped before the join. Equal labels are joined on with
        the inner index, so no term is formed elsewhere. Spark cuts partitions of a heavy
        inner index itself; config.heavy_index has them counted and dealt to
        a grid of tasks (see spread). With blocks the rows are cut into so many
        stretches of equal length, each a task, which sum their terms where
        they make them (see in_row_blocks): for products of many terms, whose
        rows have columns in common with their neighbours.
        """
        sr = resolve_semiring(semiring)
        left, right = self._sides(other, sr, descriptor, blocks)
        nrows, ncols = self.ncols if descriptor.inp0 else self.nrows, other.nrows if descriptor.inp1 else other.ncols
        if isinstance(mask, EqualLabels):
            for side, size in ((mask.rows, nrows), (mask.cols, ncols)):
                if side.size != size:
                    raise GraphError("dimension_mismatch", side.size, size)
            left = left.join(mask.rows.df.select("i", F.col("v").alias("label_")), "i")
            right = right.join(mask.cols.df.select(F.col("i").alias("j"), F.col("v").alias("label_")), "j")
            terms = left.join(right, ["k", "label_"])
            return Matrix(summed(_multiplied(terms, sr, "i", "j"), self.keys, sr.monoid, sr.type), nrows, ncols, sr.type)
        if mask is not None and not mask.complement:
            at = settled(positions(mask, descriptor, self.kind).select("i", "j"))
            mask, descriptor = Mask(Matrix(at, nrows, ncols)), PLAIN
            if mask_first(left, right, at):
                return Matrix(summed(_multiplied(through_mask(left, right, at), sr, "i", "j"), self.keys, sr.monoid, sr.type), nrows, ncols, sr.type)
            left, right = left.join(at.select("i").distinct(), "i", "left_semi"), right.join(at.select("j").distinct(), "j", "left_semi")
        if blocks:
            terms = _multiplied(in_row_blocks(left, right, nrows, ncols, blocks), sr, "at_", "i", "j")
            sums = summed(terms, ["at_", *self.keys], sr.monoid, sr.type).drop("at_")
        else:
            sums = summed(_multiplied(_met(left, right), sr, "i", "j"), self.keys, sr.monoid, sr.type)
        return Matrix(masked(sums, self.keys, mask, descriptor, self.kind), nrows, ncols, sr.type)

    def _sides(self, other: "Matrix", sr: Semiring, descriptor: Descriptor = PLAIN, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(i, k, x) and (k, j, y): what a product joins on k, in so many parts."""
        a, b = self.transpose() if descriptor.inp0 else self, other.transpose() if descriptor.inp1 else other
        if a.ncols != b.nrows:
            raise GraphError("dimension_mismatch", a.ncols, b.nrows)
        return a._by("j", sr.type, parts).select("i", F.col("j").alias("k"), F.col("v").alias("x")), b._by("i", sr.type, parts).select(F.col("i").alias("k"), "j", F.col("v").alias("y"))

    def _terms(self, other: "Matrix", sr: Semiring) -> DataFrame:
        """(i, j, v): the terms that a product sums."""
        return _multiplied(_met(*self._sides(other, sr)), sr, "i", "j")

    def mxv(self, vector: "Vector", semiring: str | Semiring = "plus_times", mask: Mask | None = None, descriptor: Descriptor = PLAIN) -> "Vector":
        sr = resolve_semiring(semiring)
        a = self.transpose() if descriptor.inp0 else self
        if a.ncols != vector.size:
            raise GraphError("dimension_mismatch", a.ncols, vector.size)
        left = a._by("j", sr.type).select("i", F.col("j").alias("k"), F.col("v").alias("x"))
        right = vector.cast(sr.type).df.select(F.col("i").alias("k"), F.col("v").alias("y"))
        df = summed(_multiplied(_met(left, right), sr, "i"), Vector.keys, sr.monoid, sr.type)
        return Vector(masked(df, Vector.keys, mask, descriptor, Vector.kind), a.nrows, sr.type)

    def ewise_add(self, other: "Matrix", monoid: str | Monoid = "plus", mask: Mask | None = None, descriptor: Descriptor = PLAIN, *, parts: int | None = None) -> "Matrix":
        """Union of positions; values at common ones are combined. The type is this matrix's; for parts see from_df."""
        return self._ewise_add(other, monoid, mask, descriptor, parts)

    def ewise_mult(self, other: "Matrix", monoid: str | Monoid = "times", mask: Mask | None = None, descriptor: Descriptor = PLAIN) -> "Matrix":
        """Intersection of positions, values combined."""
        return self._ewise_mult(other, monoid, mask, descriptor)

    def reduce(self, monoid: str | Monoid = "plus", mask: Mask | None = None, descriptor: Descriptor = PLAIN) -> "Vector":
        """Rows (columns with descriptor.inp0) summed; empty ones are absent."""
        m = resolve_monoid(monoid)
        a = self.transpose() if descriptor.inp0 else self
        df = summed(a.df.select("i", "v"), Vector.keys, m, self.dtype)
        return Vector(masked(df, Vector.keys, mask, descriptor, Vector.kind), a.nrows, self.dtype)

    def set(self, row: int, col: int, value: Any) -> "Matrix":
        """A new matrix with one entry overwritten."""
        return self._with((row, col), value)

    def extract(self, row: int, col: int) -> Any:
        """The value at a position, or the type's default."""
        return self._at((row, col))


@dataclass(frozen=True)
class Vector(_Container):
    """df has i (long) and v, unique on i and never null."""

    base: DataFrame
    size: int
    dtype: str = "int64"
    log: _Log | None = field(default=None, compare=False, repr=False)
    pending: int = 0
    kind = "vector"
    keys = ["i"]

    @property
    def extent(self) -> tuple[int]:
        return (self.size,)

    @staticmethod
    def new(spark: SparkSession, size: int, dtype: str = "int64") -> "Vector":
        return Vector.from_entries(spark, size, [], dtype)

    @staticmethod
    def from_entries(spark: SparkSession, size: int, entries: Iterable[tuple[int, Any]], dtype: str = "int64", combine: str | Monoid | None = None) -> "Vector":
        validate_type(dtype)
        if size < 0:
            raise GraphError("invalid_argument", "size must not be negative")
        rows = [(int(i), _value(v, dtype)) for i, v in entries]
        for i, _ in rows:
            if not 0 <= i < size:
                raise GraphError("index_out_of_bounds", i, "index", size)
        return Vector(_combined(spark.createDataFrame(rows, _schema(Vector.keys, dtype)), Vector.keys, dtype, combine), size, dtype)

    @staticmethod
    def from_df(df: DataFrame, size: int, index: str = "i", val: str | Column = "v", dtype: str = "int64", *, combine: str | Monoid | None = None, unique: bool = False, check: bool | None = None) -> "Vector":
        validate_type(dtype)
        v = F.col(val) if isinstance(val, str) else val
        df = df.select(F.col(index).cast("long").alias("i"), v.cast(SPARK[dtype]).alias("v"))
        df = _checked(df, {"i": size}, check)
        return Vector(df if unique else _combined(df, Vector.keys, dtype, combine), size, dtype)

    @staticmethod
    def full(spark: SparkSession, size: int, value: Column, dtype: str) -> "Vector":
        """An entry at every index; value may use the column i."""
        return Vector(spark.range(size).withColumnRenamed("id", "i").select("i", value.cast(SPARK[dtype]).alias("v")), size, dtype)

    def to_entries(self) -> DataFrame:
        return self.df.orderBy("i")

    def entries(self) -> list[tuple[int, Any]]:
        """to_entries as a list; for small vectors."""
        return [tuple(r) for r in self.to_entries().collect()]

    def dense(self) -> "Vector":
        """With defaults where nothing is stored."""
        zero = F.lit(DEFAULTS[self.dtype]).cast(SPARK[self.dtype])
        df = self.spark.range(self.size).withColumnRenamed("id", "i").join(self.df, "i", "left").select("i", F.coalesce("v", zero).alias("v"))
        return self._with_df(df)

    def to_list(self) -> list[Any]:
        """All values with defaults; for small vectors."""
        return [v for _, v in self.dense().entries()]

    def vxm(self, matrix: Matrix, semiring: str | Semiring = "plus_times", mask: Mask | None = None, descriptor: Descriptor = PLAIN) -> "Vector":
        """Row vector times matrix; products keep their order, vector first."""
        sr = resolve_semiring(semiring)
        b = matrix.transpose() if descriptor.inp1 else matrix
        if self.size != b.nrows:
            raise GraphError("dimension_mismatch", self.size, b.nrows)
        left = self.cast(sr.type).df.select(F.col("i").alias("k"), F.col("v").alias("x"))
        right = b._by("i", sr.type).select(F.col("i").alias("k"), F.col("j").alias("i"), F.col("v").alias("y"))
        df = summed(_multiplied(_met(left, right), sr, "i"), self.keys, sr.monoid, sr.type)
        return Vector(masked(df, self.keys, mask, descriptor, self.kind), b.ncols, sr.type)

    def ewise_add(self, other: "Vector", monoid: str | Monoid = "plus", mask: Mask | None = None, descriptor: Descriptor = PLAIN) -> "Vector":
        return self._ewise_add(other, monoid, mask, descriptor)

    def ewise_mult(self, other: "Vector", monoid: str | Monoid = "times", mask: Mask | None = None, descriptor: Descriptor = PLAIN) -> "Vector":
        return self._ewise_mult(other, monoid, mask, descriptor)

    def reduce_df(self, monoid: str | Monoid = "plus") -> DataFrame:
        """One row with the column v: all values summed, the identity if there are none."""
        m = resolve_monoid(monoid)
        return summed(self.df.select("v"), [], m, self.dtype).select(F.coalesce("v", F.lit(m.identity).cast(SPARK[self.dtype])).alias("v"))

    def reduce(self, monoid: str | Monoid = "plus") -> Scalar:
        return Scalar(self.reduce_df(monoid).first()[0], self.dtype)

    def set(self, index: int, value: Any) -> "Vector":
        return self._with((index,), value)

    def extract(self, index: int) -> Any:
        return self._at((index,))
