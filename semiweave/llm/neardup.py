"""Near-duplicate vectors by NN-descent."""

from __future__ import annotations

import logging
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, written

LOG = logging.getLogger(__name__)

#: Length of a neighbour list, and members of a group that is compared at once.
NEIGHBOURS = 8
GROUP = 64
#: Hash tables that seed the graph, at least; a bucket has about so many vectors.
TABLES, BUCKET = 6, 24
#: Vectors of a block, of which large components are compared two at a time.
BLOCK = 256
#: Vectors that the audit compares with all others, of those with full lists of links and of the rest.
AUDIT = 256
#: Of these with links as many should be judged; until then the audit takes four times as many vectors, up to AUDIT_MOST of a sort.
LINKED, AUDIT_MOST = 300, 8192
#: Local joins between two looks at the components.
DESCENTS = 2
FOUND = "v long, u long, sim double"
#: kind: a neighbour, a neighbour outside v's component, a link between components
NEAR, FAR, LINK = 0, 1, 2
JOINED = FOUND + ", kind int"
#: Rows of results that are sent together.
SENT = 50_000


def _matrix(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(vectors.tolist(), dtype=np.float64)
    return x, np.sqrt((x * x).sum(axis=1))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Cut a stream of Arrow batches that is sorted by keys into groups: their columns and vectors, a row each.

    Vectors are views of Arrow's own memory, as the groups are too many and
    too small for a frame each.
    """

    def whole(parts: list) -> tuple[dict[str, np.ndarray], np.ndarray]:
        if len(parts) == 1:
            return parts[0]
        return {c: np.concatenate([p[0][c] for p in parts]) for c in parts[0][0]}, np.concatenate([p[1] for p in parts])

    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "vec"}
        vectors = batch.column("vec")
        flat, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
        change = np.zeros(batch.num_rows, dtype=bool)
        change[0] = True
        for k in keys:
            change[1:] |= columns[k][1:] != columns[k][:-1]
        starts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(columns[k][a] for k in keys)
            if held and key != last:
                yield whole(held)
                held = []
            held.append(({c: x[a:b] for c, x in columns.items()}, flat[offsets[a] : offsets[b]].reshape(b - a, -1)))
            last = key
    if held:
        yield whole(held)


def _sent(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def cosines(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    return (x @ y.T) / (nx[:, None] * ny[None, :])


def _forest(alike: np.ndarray, known: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the pairs in alike, as few as connect what all of them and the known connections connect."""
    a, b, left = [], [], np.ones(len(alike), dtype=bool)
    near = alike | known
    for start in np.flatnonzero((alike & ~known).any(axis=1)).tolist():
        stack = [start] if left[start] else []
        left[start] = False
        while stack:
            p = stack.pop()
            new = np.flatnonzero(near[p] & left)
            left[new] = False
            stack += new.tolist()
            new = new[~known[p, new]]
            a += [p] * len(new)
            b += new.tolist()
    return a, b


def _local_join(threshold: float):
    """Compare the members of each group; each member's better partners, and links.

    A partner counts if it is more similar than the worst of the member's list.
    All pairs of the group that reach threshold count as links, whether lists
    have place for them or not; of these, a forest that connects the same
    components is returned.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows, names = [], 0, ["v", "u", "sim", "kind"]
        for group, x in _groups(batches, ["g", "part"]):
            v, once = np.unique(group["v"], return_index=True)
            if len(v) < 2:
                continue
            x = x[once]
            n = _norms(x)
            sims = cosines(x, n, x, n)
            np.fill_diagonal(sims, -2.0)
            c, k = group["c"][once], min(NEIGHBOURS, len(v) - 1)
            own = c[:, None] == c[None, :]
            for kind, name in ((NEAR, "worst"), (FAR, "worst_far")):
                worst = group[name][once]
                if (worst >= 2.0).all():
                    continue
                s = sims if kind == NEAR else np.where(own, -2.0, sims)
                at = np.repeat(np.arange(len(v)), k)
                to = np.argpartition(-s, k - 1, axis=1)[:, :k].ravel()
                better = s[at, to] > worst[at]
                at, to = at[better], to[better]
                out.append((v[at], v[to], s[at, to], np.full(len(at), kind, dtype=np.int32)))
                rows += len(at)
            a, b = _forest(sims >= threshold, own)
            if a:
                out.append((v[a], v[b], sims[a, b], np.full(len(a), LINK, dtype=np.int32)))
                rows += len(a)
            if rows >= SENT:
                yield _sent(out, names)
                out, rows = [], 0
        if rows:
            yield _sent(out, names)

    return compare


def _joined(members: DataFrame, lists: DataFrame | None, at: DataFrame, threshold: float) -> DataFrame:
    """members (g, v) with vectors, groups cut at random into parts of GROUP or so, compared.

    at has v, vec and the component c. Only vectors whose list is saturated, so
    that its worst entry reaches threshold, look for neighbours outside c.
    """
    parts = members.groupBy("g").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    cut = members.join(parts, "g").select("g", "v", F.pmod(F.xxhash64("v", "g"), F.col("parts")).cast("int").alias("part"))
    if lists is None:
        at = at.withColumns({"worst": F.lit(-2.0), "worst_far": F.lit(2.0)})
    else:
        worst = lists.groupBy("v").agg(*[F.max(F.when(F.col("kind") == k, F.col("worst"))).alias(name) for k, name in ((NEAR, "worst"), (FAR, "worst_far"))])
        far = F.when(F.col("searched") & (F.col("worst") >= threshold), F.coalesce("worst_far", F.lit(-2.0))).otherwise(2.0)
        at = at.join(worst, "v", "left").withColumns({"worst": F.coalesce("worst", F.lit(-2.0)), "worst_far": far})
    rows = cut.join(at.select("v", "vec", "c", "worst", "worst_far"), "v").repartition("g", "part").sortWithinPartitions("g", "part")
    return written(rows.mapInArrow(_local_join(threshold), JOINED), "near-found")


def _entries(lists: DataFrame) -> DataFrame:
    return lists.select("v", F.explode("nn").alias("n"), "kind").select("v", F.col("n.u").alias("u"), F.col("n.sim").alias("sim"), "kind")


def _merged(found: DataFrame) -> DataFrame:
    """(v, kind, nn, worst): the NEIGHBOURS best of each kind; worst is -2 while a list is not full.

    A vertex that is a neighbour of many has candidates without bound, so the
    best are picked by a ranking, whose first step keeps NEIGHBOURS of each
    partition, before any are put in a list.
    """
    once = found.where(F.col("kind") != LINK).groupBy("v", "kind", "u").agg(F.max("sim").alias("sim"))
    best = once.withColumn("r", F.row_number().over(Window.partitionBy("v", "kind").orderBy(F.desc("sim"), F.desc("u")))).where(F.col("r") <= NEIGHBOURS)
    worst = F.when(F.size("nn") == NEIGHBOURS, F.element_at("nn", -1).getField("sim")).otherwise(-2.0)
    lists = best.groupBy("v", "kind").agg(F.sort_array(F.collect_list(F.struct("sim", "u")), asc=False).alias("nn")).select("v", "kind", "nn", worst.alias("worst"))
    return written(lists, "near-lists")


def _outside(entries: DataFrame, at: DataFrame) -> DataFrame:
    """entries without neighbours of kind FAR that are in v's component by now."""
    of = lambda v, c: at.select(F.col("v").alias(v), F.col("c").alias(c))
    far = entries.where(F.col("kind") == FAR).join(of("v", "cv"), "v").join(of("u", "cu"), "u").where("cv <> cu")
    return entries.where(F.col("kind") == NEAR).union(far.select("v", "u", "sim", "kind"))


def _seeds(nodes: DataFrame, seed: int) -> DataFrame:
    """Groups of vectors with the same signs on random planes, TABLES times or more.

    A label's buckets use as many planes as leave about BUCKET vectors in each.
    Two vectors agree on all of these the more rarely the more they are, so a
    label has at least as many tables as planes.
    """
    counts = nodes.groupBy("kind").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / BUCKET))).cast("int").alias("bits"))

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["vec"].map(len)):
                x, _ = _matrix(part["vec"])
                bits = part["bits"].to_numpy()
                tables = np.maximum(TABLES, bits)
                for t in range(int(tables.max())):
                    planes = np.random.default_rng([seed, t, int(dim)]).normal(size=(int(dim), 40))
                    signs = (x @ planes[:, : max(1, int(bits.max()))] > 0).astype(np.int64)
                    use = np.arange(signs.shape[1])[None, :] < bits[:, None]
                    code = (np.where(use, signs, 0) << np.arange(signs.shape[1])).sum(axis=1)
                    yield pd.DataFrame({"v": part["v"], "kind": part["kind"], "t": t, "code": code})[t < tables]

    keys = nodes.join(F.broadcast(counts) if counts.count() <= 100_000 else counts, "kind").select("v", "kind", "vec", "bits").mapInPandas(coded, "v long, kind long, t int, code long")
    return keys.select(F.xxhash64("kind", "t", "code").alias("g"), "v")


def _audit(nodes: DataFrame, full: DataFrame, threshold: float, seed: int, size: int) -> DataFrame:
    """(v, u, sim, full): all links of vectors, found by comparing them with every vector.

    size of the vectors are from full, whose lists are saturated, and size are
    others, as groups too small to fill a list are lost more easily.
    """
    sample, kinds = [], nodes.select("v", "kind", "vec").join(full.select("v", F.lit(True).alias("full")), "v", "left").withColumn("full", F.coalesce("full", F.lit(False)))
    for which in (False, True):
        sample += kinds.where(F.col("full") == which).orderBy(F.xxhash64(F.lit(seed), "v")).limit(size).collect()
    by: dict[int, list] = {}
    for r in sample:
        by.setdefault(r.kind, []).append((r.v, r.vec, r.full))
    shipped = nodes.sparkSession.sparkContext.broadcast({k: (np.array([r[0] for r in x]), np.array([r[1] for r in x], dtype=np.float64), np.array([r[2] for r in x])) for k, x in by.items()})

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind, part in batch.groupby("kind"):
                if kind not in shipped.value:
                    continue
                ids, y, full = shipped.value[kind]
                x, n = _matrix(part["vec"])
                sims = cosines(y, np.sqrt((y * y).sum(axis=1)), x, n)
                v = part["v"].to_numpy()
                a, b = np.nonzero((sims >= threshold) & (ids[:, None] != v[None, :]))
                yield pd.DataFrame({"v": ids[a], "u": v[b], "sim": sims[a, b], "full": full[a]})

    return nodes.select("v", "kind", "vec").mapInPandas(compared, FOUND + ", full boolean")


def _connected(components: DataFrame, joins: DataFrame) -> DataFrame:
    """components (id, component) with those that joins (v, u) connect made one."""
    edges = components.select(F.col("id").alias("a"), F.col("component").alias("b")).union(joins.select("v", "u"))
    return written(connected_components(edges), "near-components")


def _placed(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """nodes with the component c; one without links is a component of its own."""
    rows = nodes.join(components.withColumnRenamed("id", "v"), "v", "left")
    return written(rows.select("v", "kind", "vec", F.coalesce("component", "v").alias("c"), F.lit(True).alias("searched")), "near-placed")


def _counted(threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows, names = [], 0, ["v", "links"]
        for group, x in _groups(batches, ["c", "i", "j"]):
            n = _norms(x)
            alike = cosines(x, n, x, n) >= threshold
            np.fill_diagonal(alike, False)
            if group["i"][0] != group["j"][0]:
                alike &= group["block"][:, None] != group["block"][None, :]
            out.append((group["v"], (alike @ group["copies"]).astype(np.int64)))
            rows += len(x)
            if rows >= SENT:
                yield _sent(out, names)
                out, rows = [], 0
        if rows:
            yield _sent(out, names)

    return compare


def _component_links(nodes: DataFrame, components: DataFrame, threshold: float) -> DataFrame:
    """(v, links): neighbour lists enlarged to whole components, which hold all of a vector's links.

    Components are cut into blocks of BLOCK, and each pair of blocks is a group
    of its own, so none is gathered in a task.
    """
    blocks = components.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = components.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(F.col("component").alias("c"), F.least("block", "other").cast("int").alias("i"), F.greatest("block", "other").cast("int").alias("j"), "block", F.col("id").alias("v"))
    rows = rows.join(nodes.select("v", "vec", "copies"), "v").repartition("c", "i", "j").sortWithinPartitions("c", "i", "j")
    return rows.mapInArrow(_counted(threshold), "v long, links long").groupBy("v").agg(F.sum("links").alias("links"))


def _usable() -> Column:
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & whole & F.exists("embedding", lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, *, recall: float = 0.999, max_rounds: int = 8, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label).

    Rows are linked if their labels are equal and not null and the cosine of
    their vectors, in double precision, is at least threshold. Equal vectors of
    a label are one node with a number of copies. In each round, groups of
    vectors with equal signs on random planes seed lists of NEIGHBOURS
    neighbours; then, DESCENTS times, a vector's neighbours, and those that have
    it as theirs, are compared with one another and the lists take what is
    better. Every compared pair that reaches the threshold joins components,
    whether or not it is in a list. A list that is saturated, as its worst entry
    reaches the threshold, is enlarged by the NEIGHBOURS best outside the
    vector's component, anew in each round. Rounds go on until saturated lists
    lead to no other component and an audit compares AUDIT vectors with
    saturated lists, and AUDIT others, with all; it takes more of them until
    LINKED have links, up to all or AUDIT_MOST of a sort, and warns where that
    gave fewer. Of either sort, recall of the
    vectors with links must have every link in their component, so large groups
    don't outweigh small ones; the links that an audit finds are kept too. If
    max_rounds rounds do not reach this, RuntimeError is raised. All of a
    vector's links then lie in its component, which is compared exactly block
    by block for n_links.

    component_id is the smallest vec_id that links reach, kept is vec_id =
    component_id. A null or empty vector, one of zeros, with a null or
    non-finite component, or with a null label links with nothing, as do
    vectors of different lengths; such a row has n_links 0, its own vec_id as
    component_id and is kept. Repeated rows are copies of one another; a null
    vec_id never names a component that has another; other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    good = rows.where(_usable())
    nodes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("v"), F.xxhash64("label", F.size("embedding")).alias("kind"), "label", F.col("embedding").alias("vec"), "first", "copies"), "near-nodes")

    at, count = nodes.select("v", "kind", "vec", F.col("v").alias("c"), F.lit(False).alias("searched")), nodes.count()
    lists, components = None, spark.createDataFrame([], "id long, component long")
    for turn in range(max_rounds):
        found = _joined(_seeds(nodes, seed + turn), lists, at, threshold)
        joins = found.where(F.col("kind") == LINK)
        lists = _merged(found if lists is None else _outside(_entries(lists), at).union(found))
        for _ in range(DESCENTS):
            edges = _entries(lists).select("v", "u")
            around = edges.select(F.col("v").alias("g"), F.col("u").alias("v")).union(edges.select(F.col("u").alias("g"), "v")).distinct()
            found = _joined(around, lists, at, threshold)
            joins = joins.union(found.where(F.col("kind") == LINK))
            lists = _merged(_entries(lists).union(found))
        more = joins.limit(1).count()
        if more:
            components = _connected(components, joins)
            at = _placed(nodes, components)
            if turn == 0:
                more = lists.where((F.col("kind") == NEAR) & (F.col("worst") >= threshold)).limit(1).count()
        if more and turn < max_rounds - 1:
            continue
        full = lists.where((F.col("kind") == NEAR) & (F.col("worst") >= threshold))
        size, of = AUDIT, lambda c, name: components.select(F.col("id").alias(c), F.col("component").alias(name))
        while True:
            audit = written(_audit(nodes, full, threshold, seed + turn, size), "near-audit")
            judged = audit.join(of("v", "cv"), "v", "left").join(of("u", "cu"), "u", "left").withColumn("missed", ~F.coalesce(F.col("cv") == F.col("cu"), F.lit(False)))
            sorts = judged.groupBy("full", "v").agg(F.bool_or("missed").alias("missed")).groupBy("full").agg(F.count("*").alias("every"), F.count_if("missed").alias("missed")).collect()
            linked = sum(r.every for r in sorts)
            if linked >= LINKED or size >= min(count, AUDIT_MOST):
                break
            size *= 4
        LOG.info("%d of %d audited vectors with links have all of them", linked - sum(r.missed for r in sorts), linked)
        if any(r.missed for r in sorts):
            components = _connected(components, judged.where("missed"))
            at = _placed(nodes, components)
        if all(r.missed <= (1 - recall) * r.every for r in sorts):
            if linked < LINKED and size < count:
                warnings.warn(f"recall is judged by {linked} vectors with links alone", stacklevel=2)
            break
    else:
        raise RuntimeError(f"vectors with all links found stayed below {recall} in {max_rounds} rounds")

    links = _component_links(nodes, components, threshold)
    state = nodes.select("v", "label", "vec", "first", "copies").join(components.withColumnRenamed("id", "v"), "v", "left").join(links, "v", "left").withColumn("root", F.coalesce("component", "v"))
    state = written(state.select("root", "label", "vec", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "near-state")
    least = state.groupBy("root").agg(F.min("first").alias("component_id"))
    state = state.join(least, "root").select(F.col("label").alias("own_label"), "vec", "n_links", "component_id")
    out = good.join(state, (F.col("label") == F.col("own_label")) & (F.col("embedding") == F.col("vec"))).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    rest = rows.where(~_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
