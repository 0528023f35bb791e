"""Runs of repeated words: tandem repeats by the method of Gusfield and Stoye."""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches

#: Copies of its period that a run has at least, and words.
COPIES, SHORTEST = 4, 6

RUN = pa.struct([pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("period", pa.int64())])


class _Factors:
    """Ranks of a text's factors of 1, 2, 4 ... symbols, which give the length that two suffixes have in common."""

    def __init__(self, s: np.ndarray):
        self.n = len(s)
        rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
        self.ranks, size = [np.append(rank, -1)], 1
        while size < self.n and rank.max() + 1 < self.n:
            behind = np.full(self.n, -1, np.int64)
            behind[: self.n - size] = rank[size:]
            rank = np.unique(rank * (self.n + 1) + behind + 1, return_inverse=True)[1].astype(np.int64)
            self.ranks.append(np.append(rank, -1))
            size *= 2
        self.order = rank

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of different starts (the text's length is one, too), how many symbols are the same."""
        same = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.ranks))):
            same += (self.ranks[k][i + same] == self.ranks[k][j + same]).astype(np.int64) << k
        return same


class SuffixTree:
    """The suffix tree of s, which ends with a symbol of its own, as intervals of the suffix array.

    Nodes 0 to n - 1 are the leaves in suffix order, later ones inner nodes.
    The suffix link of the leaf of i is that of i + 1; of any other place it is
    the place of its depth less one above the linked leaf, found by steps of
    doubling length up the tree.
    """

    def __init__(self, s: np.ndarray):
        self.forward = _Factors(s)
        n = len(s)
        self.rank = self.forward.order
        self.suffixes = np.argsort(self.rank)
        lcp = self.forward.common(self.suffixes[:-1], self.suffixes[1:]).tolist()
        depth, low, high, parent, stack, leaf_parent = [0], [0], [n - 1], [n], [0], [0] * n
        for r, here in enumerate(lcp):
            top, left, last = stack[-1], r, -1
            if here <= depth[top]:
                leaf_parent[r] = top
            while depth[stack[-1]] > here:
                node = stack.pop()
                high[node], left = r, low[node]
                if depth[stack[-1]] >= here:
                    parent[node] = n + stack[-1]
                else:
                    last = node
            if depth[stack[-1]] < here:
                node = len(depth)
                depth.append(here)
                low.append(left)
                high.append(n - 1)
                parent.append(n + stack[-1])
                if last >= 0:
                    parent[last] = n + node
                else:
                    leaf_parent[r] = node
                stack.append(node)
        leaf_parent[n - 1] = stack[-1]
        while len(stack) > 1:
            node = stack.pop()
            parent[node] = n + stack[-1]
        up = np.array([n + p for p in leaf_parent] + parent, np.int64)
        self.low, self.high = np.concatenate([np.arange(n), low]), np.concatenate([np.arange(n), high])
        self.depths = np.concatenate([n - self.suffixes, depth])
        first = s[self.suffixes[self.low] + np.minimum(self.depths[up], n - 1 - self.suffixes[self.low])]
        self.base = int(s.max()) + 1
        keys = up * self.base + first
        self.child = dict(zip(keys.tolist(), range(len(keys))))
        self.up = [array("q", up.tobytes())]
        while (up != n).any():
            up = up[up]
            self.up.append(array("q", up.tobytes()))
        self.depth, self.start, self.at = array("q", self.depths.tobytes()), array("q", self.suffixes[self.low].tobytes()), array("q", self.rank.tobytes())
        self.s = s

    def locus(self, i: int, length: int) -> int:
        """The highest node that the first length symbols from i lead to or into the edge of."""
        node, depth = self.at[i], self.depth
        for up in reversed(self.up):
            above = up[node]
            if depth[above] >= length:
                node = above
        return node


def _blocks(tree: SuffixTree) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks: each is the longest factor that also starts earlier, or one new symbol."""
    order, n = tree.suffixes.tolist(), len(tree.suffixes)
    before, after, stack = [-1] * n, [-1] * n, []
    for i in order:
        while stack and stack[-1] > i:
            after[stack.pop()] = i
        before[i] = stack[-1] if stack else -1
        stack.append(i)
    at, longest = np.arange(n), np.zeros(n, np.int64)
    for other in (np.array(before), np.array(after)):
        has = other >= 0
        longest[has] = np.maximum(longest[has], tree.forward.common(at[has], other[has]))
    steps, starts, i = np.maximum(longest, 1).tolist(), [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    return np.array([*starts, n])


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 3): the owners (0, 0, 1, 1, 1) and the numbers (1, 2, 1, 2, 3)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + 1


def _covering(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """(starts, periods) of squares with primitive roots that cover the leftmost occurrence of every such square.

    The leftmost occurrence of a square has its centre in a block and ends there
    or in the next one. If it starts in the block too, it holds the block's end,
    and if not, the block's start; so for each period the common extension of
    two places to both sides tells a stretch of squares, of which the first is
    taken.
    """
    s, forward = tree.s, tree.forward
    n, backward = len(s), _Factors(s[::-1])
    cuts = _blocks(tree)
    size = np.diff(cuts)
    behind = np.append(size[1:], 0)
    starts, periods = [], []
    owner, k = _spread(size)
    anchor = cuts[1:][owner]
    keep = anchor < n
    a, q, k = anchor[keep], (anchor - k)[keep], k[keep]
    right, left = forward.common(a, q), backward.common(n - a, n - q)
    good = (right + left >= k) & (right > 0)
    starts.append(np.maximum(q - left, q - k + 1)[good])
    periods.append(k[good])
    owner, k = _spread(size + behind)
    a = cuts[:-1][owner]
    q, end = a + k, cuts[1:][owner]
    keep = (q < n) & (a > 0)
    a, q, k, end = a[keep], q[keep], k[keep], end[keep]
    right, left = forward.common(a, q), backward.common(n - a, n - q)
    first = np.maximum(a - left, a - k + 1)
    good = (right + left >= k) & (right > 0) & (left > 0) & (first + k <= end)
    starts.append(first[good])
    periods.append(k[good])
    found = np.unique(np.concatenate(starts) * (n + 1) + np.concatenate(periods))
    start, period = found // (n + 1), found % (n + 1)
    return _primitive(forward, start, period)


def _primitive(forward: _Factors, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The squares whose root is no power: none has a period that divides its own by a prime."""
    if not len(start):
        return start, period
    least = np.arange(int(period.max()) + 1)
    for p in range(2, int(len(least) ** 0.5) + 1):
        if least[p] == p:
            rest = least[p * p :: p]
            rest[rest > p] = np.minimum(rest[rest > p], p)
    left, power = period.copy(), np.zeros(len(period), bool)
    while (left > 1).any():
        prime = np.where(left > 1, least[left], 1)
        part = period // prime
        test = np.flatnonzero((left > 1) & ~power)
        power[test] = forward.common(start[test], start[test] + part[test]) >= 2 * period[test] - part[test]
        left = left // prime
    return start[~power], period[~power]


def _vocabulary(tree: SuffixTree, starts: np.ndarray, periods: np.ndarray) -> set[tuple[int, int]]:
    """(node, length) of the place of every square with a primitive root.

    From the place of each covering square, the suffix link and one more symbol,
    the square's first, lead to the square's rotation if that occurs; a walk
    ends where it doesn't or where another walk has been.
    """
    marked: set[tuple[int, int]] = set()
    s, child, base, depth, start = tree.s.tolist(), tree.child, tree.base, tree.depth, tree.start
    for i, period in zip(starts.tolist(), periods.tolist()):
        length = 2 * period
        node = tree.locus(i, length)
        while (node, length) not in marked:
            marked.add((node, length))
            head = s[i]
            node = tree.locus(i + 1, length - 1)
            if depth[node] > length - 1:
                if s[i + length] != head:
                    break
                i += 1
            else:
                node = child.get(node * base + head, -1)
                if node < 0:
                    break
                i = start[node]
    return marked


def repeats(s: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of s that holds a square, period being its smallest.

    s are numbers of 0 and more. Lempel-Ziv blocks give covering squares, walks
    in the suffix tree all others; the leaves below a square's place are its
    occurrences, and those of one period that follow each other are a run.
    Squares with primitive roots have at most n log n occurrences.
    """
    if len(s) < 2:
        return []
    tree = SuffixTree(np.append(s.astype(np.int64) + 1, 0))
    marked = _vocabulary(tree, *_covering(tree))
    if not marked:
        return []
    nodes, lengths = (np.array(x, np.int64) for x in zip(*marked))
    low, count = tree.low[nodes], tree.high[nodes] - tree.low[nodes] + 1
    owner, k = _spread(count)
    at = tree.suffixes[low[owner] + k - 1]
    period = lengths[owner] // 2
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    new = np.append(True, (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    runs = zip(at[first].tolist(), (at[last] - at[first] + 2 * period[first]).tolist(), period[first].tolist())
    return sorted(runs, key=lambda r: (r[0], r[2]))


def word_runs(ids: np.ndarray, copies: int = COPIES, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """The runs of ids with at least copies periods and shortest words, by start, then period.

    A word of such a run is there copies times at least, so the text is cut at
    words that are rarer, and the parts again until all their words are as
    frequent; most prose leaves nothing. What is left goes through repeats().
    """
    found, parts = [], [(0, len(ids))]
    least = max(shortest, copies)
    while parts:
        a, b = parts.pop()
        if b - a < least:
            continue
        inner = np.unique(ids[a:b], return_inverse=True)[1]
        often = np.bincount(inner)[inner] >= copies
        if often.all():
            found += [(a + start, length, q) for start, length, q in repeats(inner) if length >= max(shortest, copies * q)]
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], often, [False]]).astype(np.int8)))
        parts += [(a + x, a + y) for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()) if y - x >= least]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """words without those that a run holds after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [w for w, k in zip(words, kept.tolist()) if k]


def find_runs(docs: DataFrame, copies: int = COPIES, shortest: int = SHORTEST) -> DataFrame:
    """docs with n_words (long), runs (array of start, length, period) and collapsed (string).

    Words are cut at ASCII blanks and compared as they are. A run is a stretch
    of words with smallest period q, of copies * q words and shortest words at
    least, that no neighbouring word extends keeping q; runs come by start, then
    period. collapsed joins by one space the words that no run holds after its
    first q words. Whole texts are read, one row in a task at a time however
    long; the longest stretch of frequent words takes some hundred bytes a word.
    A null text has no words, as an empty or blank one, and "" as collapsed.
    Columns of these names are replaced; rows, ties and other columns pass
    through.
    """
    bounded_batches(docs.sparkSession)
    results = ("n_words", "runs", "collapsed")
    kept = [c for c in docs.columns if c not in results]
    run = T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")])
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])
    place = kept.index("text")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, offsets, short = [], [], [0], []
            for text in batch.column(place):
                words = (text.as_py() or "").encode().split()
                number: dict[bytes, int] = defaultdict()
                number.default_factory = number.__len__
                here = word_runs(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), copies, shortest) if len(words) > len(set(words)) else []
                counts.append(len(words))
                runs.append(here)
                offsets.append(offsets[-1] + len(here))
                short.append(b" ".join(collapsed(words, here)).decode())
            flat = list(chain.from_iterable(runs))
            values = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], fields=list(RUN))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), lists, pa.array(short, pa.string())], names=[*kept, *results])

    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(found, schema)
