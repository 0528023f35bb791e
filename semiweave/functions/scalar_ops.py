"""Binary and unary operators as Column functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import GraphError


@dataclass(frozen=True)
class BinaryOp:
    """A named function of two columns; type is "numeric", "ordered" or "bool"."""

    name: str
    fn: Callable[[Column, Column], Column]
    type: str = "numeric"

    def __call__(self, a: Column, b: Column) -> Column:
        return self.fn(a, b)


@dataclass(frozen=True)
class UnaryOp:
    name: str
    fn: Callable[[Column], Column]
    type: str = "numeric"

    def __call__(self, a: Column) -> Column:
        return self.fn(a)


BINARY = {
    op.name: op
    for op in (
        BinaryOp("plus", lambda a, b: a + b),
        BinaryOp("times", lambda a, b: a * b),
        BinaryOp("minus", lambda a, b: a - b),
        BinaryOp("min", lambda a, b: F.least(a, b), "ordered"),
        BinaryOp("max", lambda a, b: F.greatest(a, b), "ordered"),
        BinaryOp("land", lambda a, b: a & b, "bool"),
        BinaryOp("lor", lambda a, b: a | b, "bool"),
        BinaryOp("lxor", lambda a, b: a != b, "bool"),
    )
}
UNARY = {
    op.name: op
    for op in (
        UnaryOp("identity", lambda a: a, "any"),
        UnaryOp("negate_int", lambda a: -a),
        UnaryOp("negate_fp", lambda a: -a),
        UnaryOp("abs_val", lambda a: F.abs(a)),
        UnaryOp("l_not", lambda a: ~a, "bool"),
    )
}


def binary(op: str | BinaryOp | Callable[[Column, Column], Column]) -> BinaryOp:
    if isinstance(op, BinaryOp):
        return op
    if callable(op):
        return BinaryOp("custom", op)
    if op not in BINARY:
        raise GraphError("unknown_operator", op)
    return BINARY[op]


def unary(op: str | UnaryOp | Callable[[Column], Column]) -> UnaryOp:
    if isinstance(op, UnaryOp):
        return op
    if callable(op):
        return UnaryOp("custom", op)
    if op not in UNARY:
        raise GraphError("unknown_operator", op)
    return UNARY[op]
