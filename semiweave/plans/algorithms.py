"""Graph algorithms on adjacency matrices: an entry (i, j) is an edge from i to j."""

from __future__ import annotations

import math
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import Layers, Rounds, settled
from ..config import config
from ..errors import GraphError
from ..operators.containers import Matrix, Vector
from ..operators.masks import Descriptor
from ..operators.products import joined_rows, sent_to_blocks, spread
from ..types import recast


def _source(adj: Matrix, source: int) -> None:
    if not 0 <= source < adj.nrows:
        raise GraphError("index_out_of_bounds", source, "source", adj.nrows)


#: Edges of one vertex that share a partition; a vertex with more is dealt to several.
HEAVY = 1_000_000


class _Edges:
    """Edges laid out by their start and kept for a loop, so that its rounds shuffle the frontier alone.

    A vertex of more than HEAVY edges has several parts, and what it sends is
    copied to each.
    """

    def __init__(self, df: DataFrame, heavy: int | None = None):
        heavy = HEAVY if heavy is None else heavy
        self.by, self.df, self.parts = ["i"], df.repartition("i").persist(), None
        # counted as they lie, without a shuffle
        parts = self.df.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("i", F.ceil(F.col("n") / heavy).alias("parts"))
        if parts.isEmpty():
            return
        parts = settled(parts)
        self.parts = F.broadcast(parts) if parts.count() <= 200_000 else parts
        salted = self.df.join(self.parts, "i", "left").withColumn("part", F.pmod(F.xxhash64("j"), F.coalesce("parts", F.lit(1))))
        whole, self.by = self.df, ["i", "part"]
        self.df = salted.drop("parts").repartition("i", "part").persist()
        self.df.count()
        whole.unpersist()

    def ahead(self, frontier: DataFrame) -> DataFrame:
        """frontier (with i) joined to the edges that start there."""
        if self.parts is not None:
            copies = frontier.join(self.parts, "i", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
            frontier = copies.drop("parts")
        return frontier.join(self.df, self.by)


def bfs_levels(adj: Matrix, source: int, *, max_iter: int | None = None) -> Vector:
    """Hops from source (0) to each vertex within max_iter hops, or all; others are absent.

    Edges count by being stored, whatever their value. A round joins the last
    level to the edges and drops vertices seen before by an anti join; levels
    are put together every few rounds.
    """
    _source(adj, source)
    edges = _Edges(adj.df.select("i", "j"))
    levels = [settled(adj.spark.range(source, source + 1).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("v")))]
    last, k = levels[0], 0
    while max_iter is None or k < max_iter:
        k += 1
        seen = fold(DataFrame.union, levels)
        ahead = edges.ahead(last.select("i")).select(F.col("j").alias("i")).distinct()
        last = settled(ahead.join(seen.select("i"), "i", "left_anti").select("i", F.lit(k).cast("long").alias("v")))
        if last.isEmpty():
            break
        levels = [settled(fold(DataFrame.union, [*levels, last]))] if len(levels) >= 8 else [*levels, last]
    edges.df.unpersist()
    return Vector(fold(DataFrame.union, levels), adj.nrows, "int64")


def bfs_reach(adj: Matrix, source: int, *, max_iter: int | None = None) -> Vector:
    """true at source and every vertex within max_iter hops, or at all that it reaches."""
    found = bfs_levels(adj, source, max_iter=max_iter)
    return Vector(found.df.select("i", F.lit(True).alias("v")), adj.nrows, "bool")


def _least(start: DataFrame, edges: _Edges, offer: Column, limit: int, run: str | None = None) -> tuple[DataFrame, bool]:
    """start (i, v) with each vertex's least offer over its in-edges, and whether it settled in limit rounds.

    Only vertices improved in the last round make offers. One aggregate gives
    a round's values and what they replace. run names a loop that goes on where
    it was cut off.
    """
    rounds = Rounds(edges.df.sparkSession, run)
    none = F.lit(None).cast(start.schema["v"].dataType)
    known = rounds.last()
    if known is None:
        known = rounds.settled(start.select("i", "v", none.alias("old")))
    better = F.col("old").isNull() | (F.col("v") < F.col("old"))
    done = False
    for _ in range(rounds.number, limit):
        offers = edges.ahead(known.where(better).select("i", "v")).select(F.col("j").alias("i"), offer.alias("v"), none.alias("old"))
        known = rounds.settled(known.select("i", "v", F.col("v").alias("old")).union(offers).groupBy("i").agg(F.min("v").alias("v"), F.min("old").alias("old")))
        if not known.where(better).limit(1).count():
            done = True
            break
    edges.df.unpersist()
    return known.select("i", "v"), done


def _circles(parents: DataFrame) -> bool:
    """Whether following parents (i, parent), one a vertex at most, leads in a circle: by pointers that double their steps.

    A pointer that has passed a vertex without parent ends. After more steps
    than there are pointers, those that are left go round.
    """
    ahead, limit = settled(parents.where("parent is not null").select("i", F.col("parent").alias("to"))), 0
    count = ahead.count()
    while count and 1 << limit <= count:
        ahead = settled(ahead.join(ahead.select(F.col("i").alias("to"), F.col("to").alias("next")), "to").select("i", F.col("next").alias("to")))
        left = ahead.count()
        limit, count = limit + 1, count if left else 0
        if not left:
            return False
    return bool(count)


def sssp(adj: Matrix, source: int, *, max_iter: int | None = None, delta: float | None = None, run: str | None = None) -> Vector:
    """Least path weights from source; unreachable vertices are absent.

    Only vertices that improved since they last offered paths over their edges
    do so, until none has. With delta they go by buckets of so much weight: of
    the lowest bucket with such vertices these offer their light edges, of delta
    at most, until it has settled, and then once their heavy ones; that offers
    fewer paths that are improved later, in more rounds. Each vertex keeps the
    one that its path comes from; a cycle of negative weight makes these go in
    a circle, which is looked for after 8, 16, 32 ... rounds where any weight is
    negative, and is an error.
    With max_iter, which excludes delta, paths have so many edges at most, and
    cycles may be part of them. run names a loop that goes on where it was cut
    off (see Rounds).
    """
    _source(adj, source)
    if delta is not None and (max_iter is not None or delta <= 0):
        raise GraphError("invalid_argument", "delta is positive and goes without max_iter")
    spark, limit = adj.spark, max_iter
    edges = _Edges(adj.cast("fp64").df.select("i", "j", F.col("v").alias("w")))
    rounds = Rounds(spark, run)
    none = F.lit(None).cast("double")
    known = rounds.last()
    if known is None:
        known = rounds.settled(spark.range(source, source + 1).select(F.col("id").alias("i"), F.lit(0.0).alias("v"), F.lit(None).cast("long").alias("parent"), none.alias("light"), none.alias("heavy")))
    waits = {kind: F.col(kind).isNull() | (F.col("v") < F.col(kind)) for kind in ("light", "heavy")}
    look = 8 if max_iter is None and edges.df.where("w < 0").limit(1).count() else None
    while limit is None or rounds.number < limit:
        least = known.agg(*[F.min(F.when(waits[kind], F.col("v"))).alias(kind) for kind in (("light",) if delta is None else waits)]).first()
        if all(x is None for x in least):
            break
        if look and rounds.number >= look:
            look = 2 * rounds.number
            if _circles(known.select("i", "parent")):
                raise GraphError("invalid_argument", "a cycle of negative weight has no least path")
        kind, sends, usable = "light", waits["light"], F.lit(True)
        if delta is not None:
            end = (math.floor(min(x for x in least if x is not None) / delta) + 1) * delta
            kind = "light" if least["light"] is not None and least["light"] < end else "heavy"
            sends, usable = waits[kind] & (F.col("v") < end), F.col("w") <= delta if kind == "light" else F.col("w") > delta
        offers = edges.ahead(known.where(sends).select("i", "v")).where(usable).select(F.col("j").alias("i"), (F.col("v") + F.col("w")).alias("v"), F.col("i").alias("parent"), none.alias("light"), none.alias("heavy"), F.lit(True).alias("new"))
        stay = known.withColumn(kind, F.when(sends, F.col("v")).otherwise(F.col(kind))).withColumn("new", F.lit(False))
        # of equal paths the one that is there stays
        best = stay.unionByName(offers).groupBy("i").agg(F.min(F.struct("v", "new", "parent")).alias("best"), F.min("light").alias("light"), F.min("heavy").alias("heavy"))
        known = rounds.settled(best.select("i", "best.v", "best.parent", "light", "heavy"))
    edges.df.unpersist()
    return Vector(known.select("i", "v"), adj.nrows, "fp64")


def _oriented(edges: DataFrame) -> DataFrame:
    """edges (a > b, with flags) from the end of lower degree to the other: (u, w, flags).

    Equal degrees go by number. No vertex then has more than the square root of
    twice the edges ahead of it, so pairs of edges with one start number
    edges^1.5 at most, however many edges a hub has.
    """
    ends = edges.select(F.explode(F.array("a", "b")).alias("u")).groupBy("u").agg(F.count("*").alias("d"))
    with_a = edges.join(ends.select(F.col("u").alias("a"), F.col("d").alias("da")), "a")
    both = with_a.join(ends.select(F.col("u").alias("b"), F.col("d").alias("db")), "b")
    a_first = F.struct("da", "a") < F.struct("db", "b")
    return both.select(F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("w"), "low", "up")


def _wedges(oriented: DataFrame, heavy: int) -> DataFrame:
    """(u, v, w, flags of both edges) for v < w: pairs of edges with one start; starts with many are dealt to a grid of tasks."""
    first = oriented.select(F.col("u").alias("k"), F.col("w").alias("v"), F.col("low").alias("low_v"), F.col("up").alias("up_v"))
    second = oriented.select(F.col("u").alias("k"), "w", F.col("low").alias("low_w"), F.col("up").alias("up_w"))
    return spread(first, second, heavy).where("v < w").withColumnRenamed("k", "u")


#: Edges of one start from which its pairs are dealt to several tasks.
WEDGES = 10_000
#: Edges that a block of starts has, and paths of two edges from there, about: what a task keeps and goes through.
BLOCK_EDGES, BLOCK_PATHS = 1_000_000, 40_000_000
#: Blocks at least.
BLOCKS = 8


def _third_edges(oriented: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, v, w, flags of u's edges to v and w, and of v's to w) of each triangle: wedges are joined to edges by both ends."""
    third = edges.select(F.greatest("a", "b").alias("w"), F.least("a", "b").alias("v"), F.col("low").alias("low_x"), F.col("up").alias("up_x"))
    return _wedges(oriented, WEDGES).join(third, ["v", "w"])


def _closed_paths(oriented: DataFrame, blocks: int) -> DataFrame:
    """The same rows, from paths u -> v -> w that an edge u -> w closes.

    A block of neighbouring starts u is one task. It keeps its edges in two hash
    tables, by end and by start and end, and gets those that lead on from its
    ends, once each; so no path is shuffled, sorted or kept. An edge v -> w goes
    to as many blocks as have v for an end: few where neighbours share their
    ends, and no more than it has paths where they don't. Blocks have about as
    many edges each, however vertices are numbered.
    """
    own = settled(oriented.repartitionByRange(blocks, "u").withColumn("at_", F.spark_partition_id())).select("at_", "u", F.col("w").alias("k"), "low", "up")
    ahead = sent_to_blocks(own, oriented.select(F.col("u").alias("k"), "w", F.col("low").alias("low_x"), F.col("up").alias("up_x")))
    own = own.repartitionById(blocks, "at_")
    first = own.withColumnsRenamed({"low": "low_v", "up": "up_v"}).hint("shuffle_hash")
    closing = own.withColumnsRenamed({"k": "w", "low": "low_w", "up": "up_w"}).hint("shuffle_hash")
    paths = ahead.repartitionById(blocks, "at_").join(first, ["at_", "k"])
    return paths.join(closing, ["at_", "u", "w"]).withColumnRenamed("k", "v").drop("at_")


def triangle_count_df(adj: Matrix) -> DataFrame:
    """One row with the column triangles: half the sum of L * A at the positions of L.

    L is the part below the diagonal. For a symmetric matrix without loops
    that counts each triangle once; loops add what they add to the product: a
    term for every entry of L in their column. All other terms lie on triangles
    of the graph without directions, i > k > j: where (i, k) and (i, j) are
    stored, one each for (k, j) and (j, k). Triangles are found from their
    vertex of least degree (_oriented): where there are no more wedges than
    edges, by shuffling these, else in blocks, which shuffle edges alone.
    """
    entries = adj.df.select("i", "j")
    edges = entries.where("i <> j").groupBy(F.greatest("i", "j").alias("a"), F.least("i", "j").alias("b")).agg(F.bool_or(F.col("i") > F.col("j")).alias("low"), F.bool_or(F.col("i") < F.col("j")).alias("up"))
    edges = settled(edges)
    loops = entries.where("i = j").select(F.col("i").alias("b"))
    on_loops = edges.where("low").join(loops, "b").agg(F.count("*").alias("n"))
    oriented = settled(_oriented(edges))
    starts = oriented.groupBy("u").agg(F.count("*").alias("n"))
    many, wedges = starts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0))).first()
    if wedges <= many:
        found = _third_edges(oriented, edges)
    else:
        paths = joined_rows(oriented.select(F.col("w").alias("k")), oriented.select(F.col("u").alias("k"))).first()["n"]
        found = _closed_paths(oriented, max(BLOCKS, -(-many // BLOCK_EDGES), int(-(-paths // BLOCK_PATHS))))
    low = lambda c: F.col(f"low_{c}")
    both = lambda c: low(c).cast("int") + F.col(f"up_{c}").cast("int")
    top = F.greatest("u", "v", "w")
    # the greatest vertex has two of the edges, and the third's entries count
    terms = F.when(top == F.col("u"), F.when(low("v") & low("w"), both("x"))).when(top == F.col("v"), F.when(low("v") & low("x"), both("w"))).otherwise(F.when(low("w") & low("x"), both("v")))
    on_triangles = found.agg(F.coalesce(F.sum(terms), F.lit(0)).alias("t"))
    return on_triangles.crossJoin(F.broadcast(on_loops)).select(F.expr("(t + n) div 2").cast("long").alias("triangles"))


def triangle_count(adj: Matrix) -> int:
    return triangle_count_df(adj).first()[0]


def _stars(edges: DataFrame) -> DataFrame:
    """(a, b) for every vertex a of edges: b is the least vertex that a is connected to.

    Alternates two steps that hang each vertex's neighbours on their least one,
    so long paths shrink by half and more in a round.
    """
    sign = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = up.groupBy("a").agg(F.min("b").alias("m"))
        hung = up.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = settled(hung.union(down.select("a", F.col("m").alias("b"))).distinct())
        found = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if found == sign:
            return edges
        sign = found


def connected_components(adj: Matrix, *, undirected: bool = True) -> Vector:
    """The least vertex of each vertex's component; vertices without edges are their own.

    With undirected=False edges are followed one way, and a vertex gets the
    least of itself and the vertices that reach it (see _reached).
    """
    n, spark = adj.nrows, adj.spark
    ids = Vector.full(spark, n, F.col("i"), "int64")
    if undirected:
        edges = adj.df.where("i <> j").select(F.greatest("i", "j").alias("a"), F.least("i", "j").alias("b")).distinct()
        stars = _stars(settled(edges))
        labels = ids.df.select("i").join(stars.select(F.col("a").alias("i"), "b"), "i", "left").select("i", F.coalesce("b", "i").alias("v"))
        return Vector(labels, n, "int64")
    return Vector(_reached(ids.df, adj.df.where("i <> j").select("i", "j").distinct(), n), n, "int64")


def _reached(own: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """(i, v): the least v of own (i, v) over i and all vertices that reach it along edges.

    Vertices of one in-edge are taken out first: chains, branches and circles of
    them lead back to their heads by pointers that double their steps and carry
    the least value on the way. Their out-edges start at the heads then, with
    that value on the edge. Heads that so get one in-edge left are taken out
    in turn, while that makes the graph smaller by a tenth. Along what is left,
    where every vertex has several in-edges or none, values spread from all at
    once; then the chains get those of their heads.
    """
    edges = settled(edges.select("i", "j", F.lit(None).cast("long").alias("w")))
    own, taken, count = settled(own), [], edges.count()
    while count:
        single = edges.groupBy("j").agg(F.count("*").alias("d"), F.first("i").alias("to"), F.first("w").alias("w")).where("d = 1").select(F.col("j").alias("i"), "to", "w")
        lone = single.join(own, "i").select("i", "to", F.least("v", "w").alias("v"))
        heads = _heads(settled(lone))
        left = edges.join(heads.select(F.col("i").alias("j")), "j", "left_anti")
        start = heads.select(F.col("i").alias("i"), F.col("to").alias("head"), F.col("v").alias("carried"))
        moved = left.join(start, "i", "left").select(F.coalesce("head", "i").alias("i"), "j", F.least("w", "carried").alias("w"))
        # a head that is in a circle of its own carries its least value itself
        edges_now = settled(moved.where("i <> j").groupBy("i", "j").agg(F.min("w").alias("w")))
        fewer = edges_now.count()
        taken.append(heads)
        own = settled(own.join(heads.where("i = to").select("i", F.col("v").alias("least")), "i", "left").select("i", F.least("v", "least").alias("v")))
        own = settled(own.join(moved.where("i = j").groupBy("i").agg(F.min("w").alias("least")), "i", "left").select("i", F.least("v", "least").alias("v")))
        if 10 * fewer > 9 * count:
            edges = edges_now
            break
        edges, count = edges_now, fewer
    labels, _ = _least(own, _Edges(edges), F.least("v", "w"), max(1, n))
    for heads in reversed(taken):
        at_heads = heads.where("i <> to").select("i", "to", F.col("v").alias("carried")).join(labels.select(F.col("i").alias("to"), F.col("v").alias("top")), "to")
        labels = settled(labels.join(at_heads.select("i", F.least("carried", "top").alias("least")), "i", "left").select("i", F.least("v", "least").alias("v")))
    return labels


def _heads(pointers: DataFrame) -> DataFrame:
    """(i, to, v): where following pointers (i, to, v) ends, and the least v on the way, i's among them.

    Ends have no pointer. As each doubling ends some pointers of every chain, a
    round that ends none has only pointers into circles left, and if it changed
    no least value either, each has that of its whole way; these vertices are
    their own heads.
    """
    pointers, left = pointers.withColumn("ended", F.lit(False)), None
    while True:
        ahead = pointers.select(F.col("i").alias("to"), F.col("to").alias("next"), F.col("v").alias("more"), F.col("ended").alias("over"))
        ended = F.col("next").isNull() | F.col("ended") | F.coalesce("over", F.lit(True))
        pointers = settled(pointers.join(ahead, "to", "left").select("i", F.coalesce("next", "to").alias("to"), F.least("v", "more").alias("v"), ended.alias("ended"), (F.col("more") < F.col("v")).alias("moved")))
        open_, moved = pointers.agg(F.count_if(~F.col("ended")), F.count_if(~F.col("ended") & F.col("moved"))).first()
        if not open_ or open_ == left and not moved:
            return pointers.select("i", F.when(F.col("ended"), F.col("to")).otherwise(F.col("i")).alias("to"), "v")
        left, pointers = open_, pointers.drop("moved")


def _counted(adj: Matrix) -> Matrix:
    """adj with whole numbers: true is 1, fractions are cut off."""
    return adj if adj.dtype == "int64" else Matrix(adj.df.withColumn("v", recast(F.col("v"), adj.dtype, "int64")), adj.nrows, adj.ncols, "int64")


def degree(adj: Matrix) -> dict[str, Vector]:
    """in_degree and out_degree: summed weights, vertices without edges absent."""
    whole = _counted(adj)
    return {"in_degree": whole.reduce("plus", descriptor=Descriptor(inp0=True)), "out_degree": whole.reduce("plus")}


def pagerank(adj: Matrix, *, damping: float = 0.85, max_iter: int | None = None, tol: float | None = None, teleport: str = "dense") -> Vector:
    """PageRank by power iteration until no rank moves by tol.

    Where every vertex has out-edges and the teleport is dense, a round's moves
    are those of the last one sent along the edges, so only vertices that moved
    by tol send, and a round shuffles and writes no others (_moves).

    teleport="dense" gives every vertex its share of the teleport and of the
    rank of vertices without out-edges. "stored" gives them only to vertices
    that get rank over an edge in the round; others drop out, and so does
    their rank.
    """
    max_iter, tol = config.max_iter if max_iter is None else max_iter, config.tol if tol is None else tol
    n, spark = adj.nrows, adj.spark
    if n == 0:
        return Vector.new(spark, 0, "fp64")
    whole = _counted(adj)
    out = whole.df.groupBy("i").agg(F.sum("v").alias("d")).where("d <> 0")
    edges = _Edges(whole.df.join(out, "i").select("i", "j", (F.col("v") / F.col("d")).alias("w")))
    first = Vector.full(spark, n, F.lit(1.0 / n), "fp64").df
    if teleport == "dense" and tol > 0 and out.count() == n:
        return Vector(_moves(first, edges, n, damping, max_iter, tol), n, "fp64")
    # a vertex without out-edges loses its rank, which a sum over the last round's rows gathers
    ranks = settled(first.join(out.select("i", F.lit(False).alias("ends")), "i", "left").select("i", "v", F.coalesce("ends", F.lit(True)).alias("ends"), F.lit(None).cast("double").alias("old")))
    for _ in range(max_iter):
        lost = ranks.where("ends").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("lost"))
        moved = edges.ahead(ranks.select("i", "v")).select(F.col("j").alias("i"), (F.col("v") * F.col("w")).alias("s"), F.lit(None).cast("boolean").alias("ends"), F.lit(None).cast("double").alias("old"))
        stay = ranks.select("i", F.lit(None).cast("double").alias("s"), "ends", F.col("v").alias("old"))
        sums = moved.union(stay).groupBy("i").agg(F.sum("s").alias("s"), F.max("ends").alias("ends"), F.max("old").alias("old"))
        shift = F.lit((1 - damping) / n) + F.lit(damping / n) * F.col("lost")
        value = F.coalesce("s", F.lit(0.0)) * damping + shift
        if teleport != "dense":
            # dropped vertices stay as rows without a rank, for where they end
            value = F.when(F.col("s").isNotNull(), F.col("s") * damping + shift)
        ranks = settled(sums.crossJoin(F.broadcast(lost)).select("i", value.alias("v"), "ends", "old"))
        moves = F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))) >= tol
        if tol > 0 and not ranks.where(moves).limit(1).count():
            break
    edges.df.unpersist()
    return Vector(ranks.where("v is not null").select("i", "v"), n, "fp64")


#: Layers of moves that are put together at once.
LAYERS = 16


def _moves(first: DataFrame, edges: _Edges, n: int, damping: float, max_iter: int, tol: float) -> DataFrame:
    """(i, v): first with the moves of all rounds added, which are written as layers."""
    if max_iter <= 0:
        return first
    layers, added = Layers(first.sparkSession, columns=("i", "v")), lambda df: df.groupBy("i").agg(F.sum("v").alias("v"))
    layers.append(first)
    sent = lambda df: edges.ahead(df).select(F.col("j").alias("i"), (F.col("v") * F.col("w") * damping).alias("v"))
    # the first round's ranks less those before it
    layers.append(added(sent(first).union(first.select("i", F.lit((1 - damping) / n - 1 / n).alias("v")))))
    for _ in range(1, max_iter):
        moved = layers.last().where(F.abs("v") >= tol)
        if moved.isEmpty():
            break
        layers.append(added(sent(moved)))
        if layers.count > LAYERS:
            layers.compact(added)
    edges.df.unpersist()
    return added(layers.all())
