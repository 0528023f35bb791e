"""Scalar types of matrices and vectors."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import GraphError

# Bytes of each declared type.
SIZES = {"bool": 1, "int8": 1, "int16": 2, "int32": 4, "int64": 8, "uint8": 1, "uint16": 2, "uint32": 4, "uint64": 8, "fp32": 4, "fp64": 8}
#: Types that containers may have.
SPARK = {"bool": T.BooleanType(), "int64": T.LongType(), "fp64": T.DoubleType()}
#: What a position without an entry reads as.
DEFAULTS: dict[str, Any] = {"bool": False, "int64": 0, "fp64": 0.0}


def validate_type(dtype: str) -> str:
    if dtype not in SPARK:
        raise GraphError("unsupported_type", dtype)
    return dtype


def type_size(dtype: str) -> int:
    if dtype not in SIZES:
        raise GraphError("unsupported_type", dtype)
    return SIZES[dtype]


def infer_type(values: Iterable[Any]) -> str:
    """bool if all values are booleans, fp64 if any is a float, else int64."""
    seen = list(values)
    if seen and all(isinstance(v, bool) for v in seen):
        return "bool"
    return "fp64" if any(isinstance(v, float) for v in seen) else "int64"


def recast(value: Column, old: str, new: str) -> Column:
    """value of type old as new; numbers other than 0 are true."""
    if old == new:
        return value
    if new == "bool":
        return value != F.lit(DEFAULTS[old])
    return value.cast(SPARK[new])


def truthy(value: Column, dtype: str) -> Column:
    return value if dtype == "bool" else value != F.lit(DEFAULTS[dtype])
