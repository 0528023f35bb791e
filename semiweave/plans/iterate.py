"""Loops: when one has settled."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import settled
from ..config import config
from ..operators.containers import Matrix, Vector


def changed(old: DataFrame, new: DataFrame, keys: list[str], dtype: str, tol: float) -> bool:
    """Whether any position differs: by tol or more for numbers if tol > 0 (absent reads as 0), else at all."""
    a, b = old.withColumnRenamed("v", "x"), new.withColumnRenamed("v", "y")
    both = a.join(b, keys, "full")
    if tol > 0 and dtype != "bool":
        differs = F.abs(F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0))) >= tol
    else:
        differs = ~F.col("x").eqNullSafe(F.col("y"))
    return bool(both.where(differs).limit(1).count())


def fixed_point(start: Any, step: Callable[[Any], Any], *, max_iter: int | None = None, tol: float | None = None, converged: Callable[[Any, Any], bool] | None = None) -> tuple[Any, dict]:
    """Apply step until nothing changes: (result, {"iterations", "converged"}).

    Matrices must agree exactly; vectors within tol (bool ones exactly). A
    result of another kind than its argument never agrees. With max_iter of 0
    or less, start comes back.
    """
    max_iter, tol = config.max_iter if max_iter is None else max_iter, config.tol if tol is None else tol

    def same(a: Any, b: Any) -> bool:
        if type(a) is not type(b) or not isinstance(a, Matrix | Vector):
            return False
        return not changed(a.df, b.df, a.keys, a.dtype, tol if isinstance(a, Vector) else 0.0)

    now = start
    for k in range(max_iter):
        new = step(now)
        if isinstance(new, Matrix | Vector):
            new = type(new)(settled(new.df), *((new.nrows, new.ncols) if isinstance(new, Matrix) else (new.size,)), new.dtype)
        if (converged or same)(now, new):
            return new, {"iterations": k + 1, "converged": True}
        now = new
    return now, {"iterations": max(0, max_iter), "converged": False}
