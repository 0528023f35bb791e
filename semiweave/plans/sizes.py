"""Sizes of matrices, and the order of products that joins the fewest rows."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache, reduce as fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.containers import Matrix

#: Indexes in a sample.
SAMPLE = 2048
#: Hashes are numbers below this.
SPAN = 1 << 62


@dataclass(frozen=True)
class Sample:
    """How many entries indexes have: of those with the smallest hashes, up to SAMPLE.

    Samples of two matrices hold the same indexes as far as both reach, so they
    tell how the counts of an inner index go together; samples of parts of a
    matrix merge by adding counts and keeping the smallest hashes.
    """

    counts: dict[int, int]
    reach: float

    @staticmethod
    def of(counts: dict[int, int]) -> "Sample":
        few = dict(sorted(counts.items())[:SAMPLE])
        return Sample(few, 1.0 if len(counts) <= SAMPLE else max(few) / SPAN)

    def merge(self, other: "Sample") -> "Sample":
        reach = min(self.reach, other.reach)
        both = {h: self.counts.get(h, 0) + other.counts.get(h, 0) for h in self.counts.keys() | other.counts.keys() if h <= reach * SPAN}
        merged = Sample.of(both)
        return Sample(merged.counts, min(reach, merged.reach))

    def distinct(self) -> float:
        """About how many indexes there are."""
        return len(self.counts) / self.reach

    def joined(self, other: "Sample") -> float:
        """About how many rows a join on the index makes."""
        reach = min(self.reach, other.reach)
        return sum(n * other.counts.get(h, 0) for h, n in self.counts.items() if h <= reach * SPAN) / reach


@dataclass(frozen=True)
class Sizes:
    """The entries of a matrix and samples of its rows and columns."""

    nvals: int
    rows: Sample
    cols: Sample


def _smallest(df: DataFrame, index: str) -> DataFrame:
    """(side, h, n) of the SAMPLE + 1 indexes with the smallest hashes."""
    hashed = df.groupBy(index).agg(F.count("*").alias("n")).select(F.lit(index).alias("side"), F.shiftrightunsigned(F.xxhash64(index), 2).alias("h"), "n")
    return hashed.orderBy("h").limit(SAMPLE + 1)


def measure(matrix: Matrix) -> Sizes:
    """The sizes of matrix, by one job; SAMPLE + 1 numbers a side reach the driver."""
    df = matrix.df
    total = df.agg(F.lit("all").alias("side"), F.lit(0).cast("long").alias("h"), F.count("*").alias("n"))
    found: dict[str, dict[int, int]] = {"i": {}, "j": {}, "all": {}}
    for side, h, n in fold(DataFrame.union, [_smallest(df, "i"), _smallest(df, "j"), total]).collect():
        found[side][h] = found[side].get(h, 0) + n
    return Sizes(found["all"].get(0, 0), Sample.of(found["i"]), Sample.of(found["j"]))


def best_order(sizes: list[Sizes]) -> int | tuple:
    """The cheapest brackets of a product: a number is a matrix, a pair a product.

    A join of two products has as many rows as that of the matrices beside the
    cut, times how much each product is larger than its matrix. A product has
    fewer entries than terms where these fall on the same positions, as if they
    fell anywhere in its rows and columns.
    """
    beside = [a.cols.joined(b.rows) for a, b in zip(sizes, sizes[1:])]

    @cache
    def best(first: int, last: int) -> tuple[float, float, int | tuple]:
        """(rows joined so far, entries, order) of the product from first to last."""
        if first == last:
            return 0.0, float(sizes[first].nvals), first
        found = []
        for cut in range(first, last):
            (cost_a, size_a, order_a), (cost_b, size_b, order_b) = best(first, cut), best(cut + 1, last)
            rows = beside[cut] * size_a / max(1, sizes[cut].nvals) * size_b / max(1, sizes[cut + 1].nvals)
            room = max(1.0, sizes[first].rows.distinct() * sizes[last].cols.distinct())
            found.append((cost_a + cost_b + rows, -room * math.expm1(-rows / room), (order_a, order_b)))
        return min(found, key=lambda f: f[0])

    return best(0, len(sizes) - 1)[2]
