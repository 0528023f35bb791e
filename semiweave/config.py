"""Defaults of a session."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class Config:
    """Types that constructors take by default, rounds that loops run at most, and how products treat heavy inner indexes.

    heavy_index is the number of rows of one inner index from which a product
    deals them to several tasks by counts of its own; None leaves it to Spark.
    """

    default_int_type: str = "int64"
    default_fp_type: str = "fp64"
    max_iter: int = 100
    tol: float = 1e-6
    heavy_index: int | None = None


config = Config()
