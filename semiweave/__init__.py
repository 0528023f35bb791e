"""Sparse linear algebra over semirings, and graph queries on it, as Spark DataFrames."""

from .checkpoints import forget_run
from .config import config
from .errors import GraphError
from .functions.algebra import MONOIDS, SEMIRINGS, Monoid, Semiring, resolve_monoid, resolve_semiring
from .functions.scalar_ops import BINARY, UNARY, BinaryOp, UnaryOp
from .operators.containers import Matrix, Scalar, Vector
from .operators.masks import Descriptor, Mask
from .plans.algorithms import bfs_levels, bfs_reach, connected_components, degree, pagerank, sssp, triangle_count
from .plans.iterate import fixed_point
from .plans.relations import Relation

__version__ = "0.1.0"


def info() -> dict[str, str]:
    """Versions of the library and of Spark."""
    import pyspark

    return {"version": __version__, "engine": "spark", "spark": pyspark.__version__}


__all__ = [
    "BINARY", "MONOIDS", "SEMIRINGS", "UNARY", "BinaryOp", "Descriptor", "GraphError", "Mask", "Matrix", "Monoid", "Relation", "Scalar", "Semiring", "UnaryOp", "Vector",
    "bfs_levels", "bfs_reach", "config", "connected_components", "degree", "fixed_point", "forget_run", "info", "pagerank", "resolve_monoid", "resolve_semiring", "sssp", "triangle_count",
]
