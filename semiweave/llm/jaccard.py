"""N-gram Jaccard self-join of documents by chosen paths."""

from __future__ import annotations

import logging
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, broadcast_if_few, connected_components, fresh_path, packed, sorted_groups, written

LOG = logging.getLogger(__name__)

#: Words of a shingle.
SHINGLE = 5
#: Expected chosen tokens of a set in a run, and of a member of a bucket that is split.
FIRST, LATER = 1.25, 4.0
#: Buckets of more sets are split on another token, MAX_DEPTH times at most.
BUCKET = 128
MAX_DEPTH = 4
#: Tokens of a set's sample, those of the smallest hashes, by which paths go on and pairs are judged first.
SAMPLE = 64
#: A bucket is not split if half of its sets or more are at least so similar to one of them;
#: else those of similarity ALIKE to it stay together, too, as they have few tokens to be split on.
DENSE, ALIKE = 0.4, 0.6
#: Of a pair at the threshold, the least share of the tokens which a split chooses from.
SHARED = 0.55
#: Sets of a block, and shingles of all its sets; larger groups are compared block by block.
BLOCK, BLOCK_SHINGLES = 512, 300_000
#: Texts whose links are counted against all texts, to measure recall: at random, and such as likely have links; longer ones aren't among them.
AUDIT, LIKELY, AUDIT_CHARS = 64, 300, 1_000_000
#: Shingles that are sent together to be shuffled.
SENT_SHINGLES = 200_000
#: Words whose hashes a task keeps.
CACHE_WORDS = 50_000
_MULTIPLY = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all bits, one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * _MULTIPLY
    x = x ^ (x >> np.uint64(32))
    x = x * _MULTIPLY
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """Hashes of words, made when they are asked for; a task's own, gone with it."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        self[word] = found
        return found


def shingle_hashes(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The distinct runs of SHINGLE words as sorted hashes of 63 bits.

    Words are cut at white space. A text of fewer words is one run.
    """
    words = text.split() if text else []
    if not words:
        return np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(SHINGLE, len(h))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = mix(out + h[k : len(h) - size + 1 + k])
    return np.unique((out >> np.uint64(1)).astype(np.int64))


def _draws(tokens: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token, a number in [0, 1) and a key; both depend on the salt and the token alone."""
    mixed = mix(tokens.astype(np.uint64) ^ mix(np.array([salt], dtype=np.int64).view(np.uint64)))
    return (mixed >> np.uint64(11)).astype(np.float64) / float(1 << 53), (mix(mixed) >> np.uint64(1)).astype(np.int64)


def choose(tokens: np.ndarray, salt: int, expected: float) -> np.ndarray:
    """Keys of the paths that extend salt by a chosen token.

    A token is chosen where its draw is below expected / (number of tokens), so
    two sets that share most tokens choose mostly alike. Of several runs, each
    takes the next stretch of [0, 1), and so other tokens than those before.
    """
    draws, keys = _draws(tokens, salt)
    return np.unique(keys[draws < expected / max(1, len(tokens))])


def sample(shingles: np.ndarray) -> np.ndarray:
    """The SAMPLE smallest of sorted hashes, cut to their first 31 bits."""
    return (shingles[:SAMPLE] >> np.int64(32)).astype(np.int32)


class _Audited:
    """Shingles of the texts that are counted against all others."""

    def __init__(self, texts: list[str]):
        sets = [shingle_hashes(t, WordHashes()) for t in texts]
        flat = np.concatenate([np.zeros(0, dtype=np.int64), *sets])
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)

    def links(self, shingles: np.ndarray, threshold: float) -> list[int]:
        """Which of the texts are at least so similar."""
        a, b = np.searchsorted(self.flat, shingles), np.searchsorted(self.flat, shingles, side="right")
        held = np.flatnonzero(b > a)
        if not len(held):
            return []
        at = np.concatenate([np.arange(x, y) for x, y in zip(a[held], b[held])])
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero((both > 0) & (both >= threshold * (self.sizes + len(shingles) - both) - 1e-9)).tolist()


def _first_paths(runs: int, threshold: float, shipped):
    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, audited = WordHashes(), shipped.value
        for batch in batches:
            out = []
            for v, text in zip(batch["v"], batch["text"]):
                if len(s := shingle_hashes(text, hashes)):
                    out.append((v, len(s), choose(s, 0, runs * FIRST), sample(s), audited.links(s, threshold)))
            yield pd.DataFrame(out, columns=["v", "n", "keys", "sample", "audited"])

    return paths


def _later_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Paths extended by tokens that the bucket's head has not."""
    for batch in batches:
        out = []
        for key, v, rest in zip(batch["key"], batch["v"], batch["rest"]):
            found = choose(np.asarray(rest, dtype=np.int64), key, LATER)
            out.append(pd.DataFrame({"key": found, "v": v}))
        if out:
            yield pd.concat(out, ignore_index=True)


def agreeing(threshold: float) -> np.ndarray:
    """For each size of a smaller sample, tokens that two samples at the threshold share, six deviations left out."""
    k = np.arange(SAMPLE + 1)
    return np.maximum(1, np.floor(k * threshold - 6 * np.sqrt(k * threshold * (1 - threshold)))).astype(np.int64)


def _hopeful(threshold: float):
    least = agreeing(threshold)

    def hopeful(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The members of a small bucket that may have a partner there.

        The partner's sample shares tokens enough, and no earlier common bucket
        compares the two.
        """
        out = []
        for group in sorted_groups(batches, ["key"]):
            key, group = int(group["key"].iloc[0]), group.drop_duplicates("v")
            if len(group) < 2:
                continue
            sets = group["sample"].tolist()
            size = np.array([len(x) for x in sets])
            near = np.triu(overlaps(sets) >= least[np.minimum(size[:, None], size[None, :])], 1)
            left, right = np.nonzero(near)
            if len(left):
                own = [set(k) for k in group["keys"]]
                chosen = sorted({x for a, b in zip(left.tolist(), right.tolist()) if min(own[a] & own[b]) == key for x in (a, b)})
                if chosen:
                    out.append(pd.DataFrame({"key": key, "v": group["v"].to_numpy()[chosen]}))
            if len(out) >= 500:
                yield pd.concat(out, ignore_index=True)
                out = []
        if out:
            yield pd.concat(out, ignore_index=True)

    return hopeful


BASE = "v long, n long, keys array<long>, sample array<int>, audited array<int>"
PATHS = "key long, v long"
ROWS = "key long, i int, j int, block int, v long, copies long, keys array<long>, guest_keys array<long>, shingles array<long>"
LINKS = "v long, head long, links long"


def _ship(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each set, once for each pair of blocks of its groups that it is part of.

    A group's members come in blocks 0, 1 and so on, its guests in those
    behind; guests meet members alone.
    """
    hashes = WordHashes()
    for batch in batches:
        out, held = [], 0
        for v, text, copies, own, visited, groups in zip(*(batch[c] for c in ("v", "text", "copies", "own", "visited", "groups"))):
            s = shingle_hashes(text, hashes)
            for g in groups:
                key, blocks, guests = g["key"], g["blocks"], g["guest_blocks"]
                drawn = int(mix(np.array([v], dtype=np.int64).view(np.uint64) ^ np.uint64(key & 0xFFFFFFFF))[0])
                mine = blocks + drawn % guests if g["guest"] else drawn % blocks
                for other in range(blocks if g["guest"] else blocks + guests):
                    out.append((key, min(mine, other), max(mine, other), mine, v, copies, own, visited, s))
                    held += len(s) + 20
                    if held > SENT_SHINGLES:
                        yield pd.DataFrame(out, columns=_SHIPPED)
                        out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=_SHIPPED)


_SHIPPED = ["key", "i", "j", "block", "v", "copies", "keys", "guest_keys", "shingles"]


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of a block's sets."""
    n = len(sets)
    if n == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), common], [common, len(sets[1])]], dtype=np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    place = np.cumsum(times > 1) - 1
    owner, column, width = owner[shared], place[column[shared]], int((times > 1).sum())
    out = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, width, 8192):
        a, b = np.searchsorted(column, (at, at + 8192))
        part = np.zeros((n, min(8192, width - at)), dtype=np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)


def _compare(threshold: float):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for group in sorted_groups(batches, ["key", "i", "j"]):
            key, i, j = (int(group[c].iloc[0]) for c in ("key", "i", "j"))
            group = group.drop_duplicates("v")
            if len(group) < 2:
                continue
            sets = group["shingles"].tolist()
            size = np.array([len(s) for s in sets])
            both = overlaps(sets)
            alike = np.triu(both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9, 1)
            if i != j:
                block = group["block"].to_numpy()
                alike &= block[:, None] != block[None, :]
            left, right = np.nonzero(alike)
            if not len(left):
                continue
            # two sets are compared wherever they meet and one at least is no guest; the first place counts
            own, visited = [set(k) for k in group["keys"]], [set(k) for k in group["guest_keys"]]
            first = np.fromiter((min(own[a] & own[b] | own[a] & visited[b] | visited[a] & own[b]) == key for a, b in zip(left.tolist(), right.tolist())), dtype=bool, count=len(left))
            left, right = left[first], right[first]
            if not len(left):
                continue
            copies, v = group["copies"].to_numpy(), group["v"].to_numpy()
            links = np.bincount(left, weights=copies[right], minlength=len(v)) + np.bincount(right, weights=copies[left], minlength=len(v))
            linked = np.flatnonzero(links)
            out.append(pd.DataFrame({"v": v[linked], "head": v[_heads(len(v), left, right)[linked]], "links": links[linked].astype(np.int64)}))
            if len(out) >= 500:
                yield pd.concat(out, ignore_index=True)
                out = []
        if out:
            yield pd.concat(out, ignore_index=True)

    return compare


def _heads(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least position that each is connected to."""
    head = np.arange(n)
    while True:
        least = np.minimum(head[left], head[right])
        new = head.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == head).all():
            return head
        head = new


def _number(text: str, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), text)


def _distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(docs with v, a number of each text), (v, first, copies, repeats), v's salt.

    v hashes the text; should two texts hash alike (MD5 tells), another salt is
    taken.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    for salt in range(20):
        numbered = plain.withColumn("v", _number("text", salt))
        texts = numbered.groupBy("v", F.md5("text").alias("m"), "doc_id").agg(F.count("*").alias("n")).groupBy("v", "m").agg(F.min("doc_id").alias("first"), F.sum("n").alias("copies"), F.max("n").alias("repeats"))
        path = fresh_path(spark, "jaccard-texts")
        texts.write.parquet(path)
        texts = spark.read.schema(texts.schema).parquet(path)
        if not texts.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            return numbered, texts.select("v", "first", "copies", "repeats"), salt
    raise RuntimeError("no salt keeps the texts apart")


def runs_for(recall: float, threshold: float) -> int:
    """Runs until a pair at the threshold is compared with a probability of recall.

    A pair shares threshold of the larger set at least, so the number of its
    common chosen tokens is about Poisson; deeper paths survive as in a
    branching process, whose members share SHARED of the tokens to choose from.
    """
    alive = 1.0
    for _ in range(MAX_DEPTH):
        alive = 1 - np.exp(-LATER * SHARED * alive)
    return int(np.ceil(np.log(1 - recall) / -(FIRST * threshold * alive)))


def _audited_texts(numbered: DataFrame, texts: DataFrame) -> tuple[list[int], _Audited]:
    """AUDIT texts at random (those of the least hashes) and LIKELY ones that may have links, as v and shingles.

    Such are one of each group of texts that have the same four words of the
    least hashes, which near copies mostly have; no path has a part in this.
    """
    ids = [r.v for r in texts.orderBy(F.xxhash64(F.lit(23), "v")).limit(AUDIT).select("v").collect()]
    words = F.transform(F.split("text", r"\s+"), lambda w: F.xxhash64(F.lit(29), w))
    groups = numbered.groupBy(F.xxhash64(F.slice(F.sort_array(F.array_distinct(words)), 1, 4)).alias("g")).agg(F.min("v").alias("v"), F.max("v").alias("other"))
    ids += [r.v for r in groups.where("v <> other").orderBy(F.xxhash64(F.lit(31), "g")).limit(LIKELY).select("v").collect()]
    rows = numbered.where(F.col("v").isin(ids) & (F.length("text") <= AUDIT_CHARS)).select("v", "text").dropDuplicates(["v"]).collect() if ids else []
    return [r.v for r in rows], _Audited([r.text for r in rows])


def _judged(paths: DataFrame, large: DataFrame, base: DataFrame) -> DataFrame:
    """Members of large buckets with their similarity to the bucket's head, and the tokens that it has not.

    The similarity is estimated from samples: of the smallest hashes of both
    sets, how many are in each.
    """
    heads = large.join(base.select(F.col("v").alias("head"), F.col("sample").alias("head_sample")), "head").select("key", "size", "head", "head_sample")
    rows = paths.join(heads, "key").join(base.select("v", "sample"), "v")
    least = F.slice(F.sort_array(F.array_union("sample", "head_sample")), 1, SAMPLE)
    alike = F.size(F.array_intersect(F.array_intersect("sample", "head_sample"), least)) / F.size(least)
    return written(rows.select("key", "v", "size", "head", alike.alias("alike"), F.array_except("sample", "head_sample").alias("rest")), "jaccard-judged")


def _members(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(small buckets as key, v), (larger groups as key, v, guest) with keys below 0.

    Where half or more of a large bucket is like its head, it is not split:
    these sets become star edges to the head, and the stars that meet one
    group; the bucket's other sets visit this group as guests, and go on as a
    bucket of their own. Any other large bucket is split on tokens that its
    head has not, and its sets that are like the head stay together, too. So
    a group of copies is compared once and splits nowhere, and a passage that
    many texts share is no token to split on. What is large after MAX_DEPTH
    steps is compared block by block.
    """
    paths = base.select(F.explode("keys").alias("key"), "v")
    ready: list[DataFrame] = []
    stars: list[DataFrame] = []
    guests: list[DataFrame] = []
    left: list[DataFrame] = []
    for depth in range(1, MAX_DEPTH + 1):
        sizes = paths.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.xxhash64("v").cast("decimal(38,0)")).alias("members"), F.min("v").alias("least"), F.min_by("v", F.xxhash64("v", "key")).alias("head")).where("size > 1")
        # of buckets with the same members one is enough
        buckets = written(sizes.groupBy("size", "members", "least").agg(F.min(F.struct("key", "head")).alias("k")).select("k.key", "size", "k.head"), "jaccard-buckets")
        count, many = buckets.agg(F.count("*"), F.count_if(F.col("size") > BUCKET)).first()
        small, large = buckets.where(F.col("size") <= BUCKET).select("key"), buckets.where(F.col("size") > BUCKET)
        ready.append(paths.join(F.broadcast(small) if count <= 200_000 else small, "key").select("key", "v"))
        if not many:
            break
        if depth == MAX_DEPTH:
            left.append(paths.join(F.broadcast(large.select("key")) if many <= 200_000 else large.select("key"), "key").select((-F.shiftrightunsigned("key", 1) - 1).alias("key"), "v", F.lit(False).alias("guest")))
            break
        judged = _judged(paths, F.broadcast(large) if many <= 200_000 else large, base)
        like = F.col("alike") >= DENSE
        dense = judged.groupBy("key").agg((F.count_if(like) * 2 >= F.first("size")).alias("dense"))
        judged = judged.join(F.broadcast(dense) if many <= 200_000 else dense, "key")
        stars.append(judged.where(F.col("dense") & like).select(F.col("v").alias("a"), F.col("head").alias("b")))
        others = judged.where(F.col("dense") & ~like)
        guests.append(others.select("head", "v"))
        further = others.select(F.xxhash64("key", F.lit(1)).alias("key"), "v")
        further = further.union(judged.where(~F.col("dense") & (F.col("alike") >= ALIKE)).select(F.xxhash64("key", F.lit(2)).alias("key"), "v"))
        split = judged.where(~F.col("dense") & (F.size("rest") > 0)).select("key", "v", "rest").mapInPandas(_later_paths, PATHS)
        paths = written(further.select(F.shiftrightunsigned("key", 1).alias("key"), "v").union(split), "jaccard-paths")

    union = lambda frames, schema: frames[0] if len(frames) == 1 else frames[0].union(union(frames[1:], schema)) if frames else base.sparkSession.createDataFrame([], schema)
    merged = written(connected_components(union(stars, "a long, b long")), "jaccard-groups")
    number = lambda c: (-F.shiftrightunsigned(F.xxhash64(c), 1) - 1).alias("key")
    groups = merged.select(number("component"), F.col("id").alias("v"), F.lit(False).alias("guest"))
    visits = union(guests, "head long, v long").join(merged, F.col("head") == F.col("id")).select(number("component"), "v", F.lit(True).alias("guest"))
    # a guest that is a member, too, is a member
    groups = groups.union(visits).union(union(left, "key long, v long, guest boolean")).groupBy("key", "v").agg(F.bool_and("guest").alias("guest"))
    return union(ready, "key long, v long").distinct(), groups


def link_texts(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999) -> tuple[DataFrame, DataFrame, int]:
    """(docs with v, classes, v's salt).

    classes has, for each text, v, class_id, head (the v of the class's first
    document), n_links and repeats (rows of one doc_id at most). The number of
    runs is doubled where the audit finds a text without all of its links.
    """
    bounded_batches(docs.sparkSession)
    numbered, texts, salt = _distinct_texts(docs)
    ids, audited = _audited_texts(numbered, texts)
    shipped, runs = docs.sparkSession.sparkContext.broadcast(audited), runs_for(recall, threshold)
    for _ in range(3):
        base = written(numbered.select("v", "text").mapInPandas(_first_paths(runs, threshold, shipped), BASE).dropDuplicates(["v"]), "jaccard-base")
        classes = _linked(numbered, texts, base, threshold)
        hits = base.where(F.size("audited") > 0).select("v", F.explode("audited").alias("k")).join(texts.select("v", "copies"), "v")
        sums = hits.groupBy("k").agg(F.sum("copies").alias("links"), F.count("*").alias("texts")).collect()
        exact, different = {ids[r.k]: r.links - 1 for r in sums}, sum(r.texts > 1 for r in sums)
        found = {r.v: r.n_links for r in classes.where(F.col("v").isin(list(exact))).select("v", "n_links").collect()} if exact else {}
        linked = [v for v, n in exact.items() if n]
        whole = sum(found[v] == exact[v] for v in linked)
        LOG.info("%d of %d audited texts with links have all of them; %d have links to different texts", whole, len(linked), different)
        if whole >= recall * len(linked):
            if not different:
                warnings.warn("recall is unmeasured: no audited text has a link to a different text", stacklevel=2)
            return numbered, classes, salt
        runs *= 2
    raise RuntimeError(f"fewer than {recall} of the audited texts have all links after {runs // 2} runs")


def _linked(numbered: DataFrame, texts: DataFrame, base: DataFrame, threshold: float) -> DataFrame:
    ready, groups = _members(base)
    members = written(ready.withColumn("guest", F.lit(False)).union(groups), "jaccard-members")
    # pairs in small buckets are first judged by their samples
    lists = members.groupBy("v").agg(F.collect_list(F.when(~F.col("guest"), F.col("key"))).alias("own"), F.collect_list(F.when(F.col("guest"), F.col("key"))).alias("visited"))
    lists = written(lists, "jaccard-lists")
    judged = lists.where(F.size("own") > 0).join(base.select("v", "sample"), "v").select("v", "sample", F.col("own").alias("keys"), F.explode("own").alias("key")).where("key >= 0")
    judged = judged.select("key", "v", "keys", "sample").repartition("key").sortWithinPartitions("key").mapInPandas(_hopeful(threshold), "key long, v long")
    pairs = written(judged.withColumn("guest", F.lit(False)).union(members.where("key < 0").select("key", "v", "guest")).join(base.select("v", "n"), "v"), "jaccard-pairs")

    needs = lambda guest: F.greatest(F.ceil(F.count_if(guest) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(guest, F.col("n"))), F.lit(0)) / BLOCK_SHINGLES)).cast("int")
    blocks = pairs.groupBy("key").agg(needs(~F.col("guest")).alias("blocks"), needs(F.col("guest")).alias("guest_blocks")).where("blocks > 0")
    sent = pairs.join(blocks, "key").groupBy("v").agg(F.collect_list(F.struct("key", "blocks", "guest_blocks", "guest")).alias("groups")).join(lists, "v").withColumnRenamed("v", "one_v")
    one = written(texts.select("v", "first", "copies").join(sent, F.col("v") == F.col("one_v")).drop("v"), "jaccard-sent")
    # if they are few, the texts that nobody needs aren't shuffled
    same = (F.col("v") == F.col("some_v")) & F.col("doc_id").eqNullSafe(F.col("some_first"))
    some = broadcast_if_few(one.select(F.col("one_v").alias("some_v"), F.col("first").alias("some_first")))
    needed = numbered.join(some, same, "left_semi")
    sets = needed.join(one, (F.col("v") == F.col("one_v")) & F.col("doc_id").eqNullSafe(F.col("first"))).select("v", "text", "copies", "own", "visited", "groups")
    shipped = sets.mapInPandas(_ship, ROWS).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    links = written(shipped.mapInPandas(_compare(threshold), LINKS), "jaccard-links")
    roots = connected_components(links.select(F.col("v").alias("a"), F.col("head").alias("b")))
    found = links.groupBy("v").agg(F.sum("links").alias("links")).join(roots, F.col("v") == F.col("id")).select("v", "links", F.col("component").alias("root"))
    return written(_classes(texts, found), "jaccard-classes")


def _classes(texts: DataFrame, groups: DataFrame) -> DataFrame:
    all_texts = texts.join(groups.withColumnRenamed("v", "g"), F.col("v") == F.col("g"), "left").withColumn("root", F.coalesce("root", "v"))
    heads = all_texts.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "v")).alias("h"))
    heads = heads.select(F.col("root").alias("r"), F.col("h.first").alias("class_id"), F.col("h.v").alias("head"))
    return all_texts.join(heads, F.col("root") == F.col("r")).select("v", "class_id", "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "repeats")


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """(doc_id, class_id, n_links) for each row of (doc_id, text).

    Two rows are linked if the Jaccard similarity of their sets of five-word
    shingles is at least threshold; classes are the connected components.
    class_id is the smallest doc_id of the class and n_links the number of
    other rows linked to this one, equal texts included.

    In each of runs_for(recall) runs every text chooses some of its shingles as
    tokens; texts that share one meet in a bucket, and buckets of more than
    BUCKET texts are split on further tokens, chosen from a sample of each
    text's shingles (see _members). Pairs in small buckets whose samples share
    all but improbably few tokens are compared by exact intersections; groups
    of copies that no token splits are compared block by block, so no task
    gets a whole bucket and nothing is capped. Pairs aren't emitted: a block
    returns each text's number of links and its least partner. Recall is
    audited: AUDIT texts at random and LIKELY ones that probably have links are
    compared with all, and where a share of them above 1 - recall misses links
    the runs are doubled, twice at most, before RuntimeError is raised; where
    none has a link to a different text, a warning says so.

    Equal texts are compared once, as one. A null text, and one without words,
    has no links and a class of its own (of its equals, if it is not null); a
    null doc_id counts as the largest and stays null; repeated rows are linked
    like other copies; other columns are ignored.
    """
    numbered, classes, _ = link_texts(docs, threshold, recall)
    found = numbered.select("doc_id", F.col("v").alias("own"), _worded("text").alias("worded")).join(classes, F.col("own") == F.col("v"))
    found = found.select("doc_id", F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("worded"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"))
    bare = docs.where("text is null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return found.union(bare)


def keep_one_of_each(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """docs with the first document of each class of jaccard_classes, all columns kept.

    Texts that are null or without words are kept.
    """
    _, classes, salt = link_texts(docs, threshold, recall)
    heads = classes.where("v = head").select("v", F.col("class_id").alias("first_"), "repeats")
    rows = packed(docs, {"id_": F.col("doc_id").cast("long"), "text_": F.col("text").cast("string")})
    worded = F.coalesce(_worded("text_"), F.lit(False))
    bare = rows.where(~worded).select("row_")
    ones = rows.where(worded).withColumn("v_", _number("text_", salt)).join(heads, (F.col("v_") == F.col("v")) & F.col("id_").eqNullSafe(F.col("first_")))
    once = ones.where("repeats = 1").select("row_")
    # the same row several times, or rows that differ in other columns alone
    again = ones.where("repeats > 1").groupBy("v_").agg(F.first("row_").alias("row_")).select("row_")
    return once.union(again).union(bare).select("row_.*")


def _worded(text: str) -> Column:
    return F.regexp_like(text, F.lit(r"[^\s\x1c-\x1f]"))
