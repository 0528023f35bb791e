"""Several predicates over one set of entities: paths and closures."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import config
from ..errors import GraphError
from ..functions.algebra import SEMIRINGS, Semiring, resolve_semiring, summed
from ..operators.containers import Matrix
from ..checkpoints import Layers, Rounds
from .iterate import changed
from .sizes import Sizes, best_order, measure


#: Names of the built-in semirings whose products may be bracketed anyhow.
DISTRIBUTIVE = {"plus_times", "plus_times_fp64", "max_plus", "max_plus_fp64", "min_plus", "min_plus_fp64", "max_min", "max_min_fp64", "lor_land", "land_lor"}


@dataclass(frozen=True)
class Relation:
    """size entities, and an adjacency matrix for each predicate."""

    size: int
    predicates_: dict[str, Matrix] = field(default_factory=dict)
    #: What measured() has found; a predicate that changes loses it.
    sizes: dict[str, Sizes] = field(default_factory=dict, compare=False, repr=False)

    @staticmethod
    def new(size: int) -> "Relation":
        return Relation(size)

    def predicates(self) -> list[str]:
        return sorted(self.predicates_)

    def matrix(self, predicate: str) -> Matrix:
        if predicate not in self.predicates_:
            raise GraphError("unknown_predicate", predicate)
        return self.predicates_[predicate]

    def with_matrix(self, predicate: str, matrix: Matrix) -> "Relation":
        return Relation(self.size, self.predicates_ | {predicate: matrix}, {p: s for p, s in self.sizes.items() if p != predicate})

    def add_triples(self, spark: SparkSession, predicate: str, pairs: Iterable[tuple[int, int]]) -> "Relation":
        """Add (subject, object) edges; adding one twice changes nothing."""
        return self._add(predicate, Matrix.from_coo(spark, self.size, self.size, [(s, o, True) for s, o in pairs], "bool"))

    def add_weighted_triples(self, spark: SparkSession, predicate: str, triples: Iterable[tuple[int, int, Any]], dtype: str = "int64") -> "Relation":
        """Add weighted edges; weights of one edge are summed, in the type of this call."""
        return self._add(predicate, Matrix.from_coo(spark, self.size, self.size, triples, dtype))

    def add_df(self, predicate: str, df: DataFrame, subject: str, object_: str, value: str | None = None, dtype: str = "bool", *, scattered: bool = False, parts: int | None = None) -> "Relation":
        """Add edges of a DataFrame, bool ones without a value column; for scattered and parts see Matrix.from_df."""
        v = F.lit(True) if value is None else F.col(value)
        return self._add(predicate, Matrix.from_df(df, self.size, self.size, subject, object_, v, dtype, scattered=scattered, parts=parts), parts)

    def _add(self, predicate: str, new: Matrix, parts: int | None = None) -> "Relation":
        old = self.predicates_.get(predicate)
        if old is not None:
            new = old.cast(new.dtype).ewise_add(new, "lor" if new.dtype == "bool" else "plus", parts=parts)
        return self.with_matrix(predicate, new)

    def measured(self, *predicates: str) -> "Relation":
        """The same relation with the sizes of its matrices (see Sizes), or of those named, a job for each that has none yet."""
        sizes = {p: self.sizes.get(p) or measure(self.matrix(p)) for p in predicates or self.predicates_}
        return Relation(self.size, self.predicates_, self.sizes | sizes)

    def traverse(self, path: list[str], semiring: str | Semiring = "lor_land", *, blocks: int | None = None) -> Matrix:
        """The product of the path's matrices, as one plan, without a job.

        A single predicate gives its matrix; bool becomes 0 and 1 where the
        semiring counts. If multiply distributes over add, so that brackets
        change nothing but rounding, and measured() knows all sizes, dynamic
        programming over all ways to bracket the path picks the one that joins
        the fewest rows; else products are made from the left. blocks is
        that of the last product (see Matrix.mxm).
        """
        if not path:
            raise GraphError("empty_predicate_path")
        sr = resolve_semiring(semiring)
        matrices = [self.matrix(p) for p in path]
        sizes = [self.sizes.get(p) for p in path]
        if len(path) < 3 or None in sizes or sr.name not in DISTRIBUTIVE or sr != SEMIRINGS[sr.name]:
            out = matrices[0]
            for k, m in enumerate(matrices[1:], 2):
                out = out.mxm(m, sr, blocks=blocks if k == len(matrices) else None)
            return out

        def product(order, blocks: int | None = None) -> Matrix:
            return matrices[order] if isinstance(order, int) else product(order[0]).mxm(product(order[1]), sr, blocks=blocks)

        return product(best_order(sizes), blocks)

    def closure(self, predicate: str, semiring: str | Semiring = "lor_land", *, max_iter: int | None = None, run: str | None = None) -> tuple[Matrix, dict]:
        """All paths of one edge and more, summed: (P, {"iterations", "converged"}).

        The identity is not part of it. Where add is idempotent, multiply
        distributes over it and max_iter is not given, paths double in length
        each round (_doubled), until nothing changes. Else P <- P + P * A is
        repeated from P = A, max_iter times at most: an idempotent sum only
        multiplies what the last round changed; any other sums anew each round,
        so counts grow until max_iter unless A * A is empty, and may overflow.
        run names a loop that goes on where it was cut off (see Rounds).
        """
        sr = resolve_semiring(semiring)
        a = self.matrix(predicate).cast(sr.type)
        if max_iter is None and sr.idempotent and sr.name in DISTRIBUTIVE and sr == SEMIRINGS[sr.name]:
            return _doubled(a, sr, run)
        a = a.persist()
        limit = config.max_iter if max_iter is None else max_iter
        rounds = Rounds(a.spark, run)
        now, info = rounds.last(), {"iterations": limit, "converged": False}
        if now is None:
            now = rounds.settled(a.df.withColumn("old", F.lit(None).cast(a.df.schema["v"].dataType)))
        fresh = ~F.col("v").eqNullSafe(F.col("old"))
        for k in range(rounds.number, limit):
            part = now.where(fresh) if sr.idempotent else now
            terms = Matrix(part.select("i", "j", "v"), a.nrows, a.ncols, sr.type)._terms(a, sr)
            none = F.lit(None).cast(now.schema["v"].dataType)
            if isinstance(sr.add, str):
                rows = now.select("i", "j", "v", F.col("v").alias("old")).unionByName(terms.withColumn("old", none))
                # old has one value a position, the greatest of it and nulls
                now = rounds.settled(rows.groupBy("i", "j").agg(sr.monoid.aggregate(F.col("v")).alias("v"), F.max("old").alias("old")))
                stays = not now.where(fresh).limit(1).count()
            else:
                new = rounds.settled(summed(now.select("i", "j", "v").unionByName(terms), ["i", "j"], sr.monoid, sr.type))
                stays, now = not changed(now, new, ["i", "j"], sr.type, 0.0), new
            if stays:
                info = {"iterations": k + 1, "converged": True}
                break
        a.unpersist()
        return Matrix(now.select("i", "j", "v"), a.nrows, a.ncols, sr.type), info


#: Vertices for each part of a closure, and parts at least and at most.
PART_VERTICES, LEAST_PARTS, MOST_PARTS = 100_000, 8, 2000


def _doubled(a: Matrix, sr: Semiring, run: str | None) -> tuple[Matrix, dict]:
    """The closure of a where add picks one of two values, by paths of 1, 2, 4 ... edges.

    h is the number of edges of a path that gives v. After a round that reaches
    k edges, all best paths of up to k are known. A best path of more, as short
    as one can be, starts with k edges that are a best path, too, for which
    none shorter is: the front, what the round found with h = k. So the front
    alone is joined with all that is known; on a chain each pair is met once.
    h may be too large where paths of different values meet in a round, which
    only adds to the front. Rounds are the logarithm of the longest best path.

    A round writes what it found as a layer of its own. What is known is dealt
    to parts by i once, where the front and then the terms come to it; values that a later layer improves are
    carried along, which does no harm to such sums, until they are a third of
    all rows and layers are put together. A best path has fewer edges than
    there are vertices, so what still changes then never settles.
    """
    spark, limit = a.spark, max(1, a.nrows).bit_length() + 1
    parts = min(MOST_PARTS, max(LEAST_PARTS, a.nrows // PART_VERTICES))
    layers = Layers(spark, run, ("i", "j", "v", "h"))
    if not layers.count:
        layers.append(a.df.select("i", "j", "v", F.lit(1).cast("long").alias("h")))
    dealt = lambda df, by: df.withColumn("at_", F.pmod(F.hash(by), F.lit(parts))).repartitionById(parts, "at_")
    together = lambda df, *by: df.groupBy(*by, "i", "j").agg(sr.monoid.aggregate(F.col("v")).alias("v"), F.max("h").alias("h"))
    better = {"min": F.col("v") < F.col("old"), "max": F.col("v") > F.col("old"), "lor": F.col("v") & ~F.col("old"), "land": ~F.col("v") & F.col("old")}[sr.add]
    info = {"iterations": limit, "converged": False}
    while layers.rounds <= limit:
        reach, known = 1 << (layers.rounds - 1), layers.all()
        front = layers.last().where(F.col("h") == reach).select("i", F.col("j").alias("k"), F.col("v").alias("x"))
        if front.limit(1).count():
            # the same rows and columns for both joins, which share one shuffle
            known = dealt(known.where("i is not null and j is not null"), "i")
            pairs = dealt(front, "k").join(known.select("at_", F.col("i").alias("k"), "j", "v", "h"), ["at_", "k"])
            terms = dealt(pairs.select("i", "j", sr.times(F.col("x"), F.col("v")).alias("v"), (F.col("h") + reach).alias("h")), "i")
            old = (together(known, "at_") if layers.stale else known).select("at_", "i", "j", F.col("v").alias("old"), F.col("h").alias("old_h"))
            found = together(terms, "at_").join(old, ["at_", "i", "j"], "left").where(F.col("old_h").isNull() | better)
            found = found.select("i", "j", "v", "h", F.col("old_h").isNotNull().alias("improved"))
        else:
            found = known.where("false").withColumn("improved", F.lit(False))
        rows, improved = layers.append(found)
        if not rows:
            info = {"iterations": layers.rounds - 1, "converged": True}
            break
        layers.stale += improved
        if 3 * layers.stale > layers.rows:
            layers.compact(together)
    out = layers.all()
    if layers.stale:
        out = together(out)
    return Matrix(out.select("i", "j", "v"), a.nrows, a.ncols, sr.type), info
