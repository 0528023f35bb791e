"""Masks and descriptors: which positions an operation writes, and how it reads its inputs."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Union

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError
from ..types import truthy

if TYPE_CHECKING:
    from .containers import Matrix, Vector


@dataclass(frozen=True)
class Mask:
    """Keep the output at the positions of source, or at all others if complement."""

    source: Union["Matrix", "Vector"]
    complement: bool = False

    @staticmethod
    def of_complement(source: Union["Matrix", "Vector"]) -> "Mask":
        return Mask(source, True)


@dataclass(frozen=True)
class EqualLabels:
    """A mask of a product: keep the positions whose row and column have equal labels.

    rows and cols are vectors of labels; a row or column without one is left
    out. The positions, as many as the squares of the groups, are never listed.
    """

    rows: "Vector"
    cols: "Vector"


@dataclass(frozen=True)
class Descriptor:
    """inp0 and inp1 transpose inputs; mask "value" drops a mask's zeros.

    Outputs are always new, so output "replace" is what "merge" is.
    """

    inp0: bool = False
    inp1: bool = False
    output: str = "merge"
    mask: str = "structural"

    def inp0_transpose(self) -> "Descriptor":
        return replace(self, inp0=True)

    def inp1_transpose(self) -> "Descriptor":
        return replace(self, inp1=True)

    def replace_output(self) -> "Descriptor":
        return replace(self, output="replace")


def positions(mask: Mask, descriptor: Descriptor, kind: str) -> DataFrame:
    """Rows of the mask's source that count as set."""
    if mask.source.kind != kind:
        raise GraphError("mask_type_mismatch", mask.source.kind, kind)
    at = mask.source.df
    return at.where(truthy(F.col("v"), mask.source.dtype)) if descriptor.mask == "value" else at


def masked(df: DataFrame, keys: list[str], mask: Mask | None, descriptor: Descriptor, kind: str) -> DataFrame:
    """df at the mask's positions: a semi or anti join on its keys.

    It comes after the aggregation, whose partitioning it shares: the products
    are summed map-side before they are shuffled once, and only the mask is
    shuffled to them, or broadcast if it is small.
    """
    if mask is None:
        return df
    at = positions(mask, descriptor, kind)
    return df.join(at.select(*keys), keys, "left_anti" if mask.complement else "left_semi")
