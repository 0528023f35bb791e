"""Benchmark decontamination: a BM25 inverted index of test items, queried by block-max WAND."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACELESS, bounded_batches, written

K1, B = 1.2, 0.75
#: Words of a piece of an item at most. A passage has twice as many and starts
#: every so many, so a copied piece lies whole in one passage.
PIECE = 48
#: Pieces of one index or so, which is broadcast (150 MB at this size); a larger benchmark is queried in slices.
SLICE_PIECES = 100_000
#: Blocks of a frequent term, which is looked up only where others leave hope.
LONG = 256
#: Items whose shingles a Python worker keeps.
CACHE_ITEMS = 2000
#: Pieces of a block, which share one upper bound for each term.
BLOCK = 4
WORD = re.compile(rf"[^\W{SPACELESS}]+|(?=\w)[{SPACELESS}]")
#: Words of a shingle.
SHINGLE = 5
HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def words_of(text: str | None) -> list[str]:
    """Words in lower case, without punctuation."""
    return WORD.findall(text.lower()) if text else []


class Shingles:
    """All runs of n words of a text; all of a shorter text is one run.

    a & b are the runs of a that the text of b holds: b's runs are taken as
    long as those of a.
    """

    def __init__(self, words: list[str], n: int = SHINGLE):
        self.words, self.length = words, min(n, len(words))
        self.by_length = {self.length: self._cut(self.length)}

    def _cut(self, length: int) -> set[tuple[str, ...]]:
        return {tuple(self.words[k : k + length]) for k in range(len(self.words) - length + 1)} if length else set()

    def runs(self, length: int) -> set[tuple[str, ...]]:
        if length not in self.by_length:
            self.by_length[length] = self._cut(length)
        return self.by_length[length]

    def __len__(self) -> int:
        return len(self.runs(self.length))

    def __and__(self, other: Shingles) -> set[tuple[str, ...]]:
        return self.runs(self.length) & other.runs(self.length)


def shingles(words: list[str], n: int = SHINGLE) -> Shingles:
    return Shingles(words, n)


def halves(words: list[str]) -> tuple[list[str], list[str]]:
    """(question, answer): an item's first two thirds, and the rest; one shorter than a shingle is all question."""
    cut = math.ceil(len(words) * 2 / 3) if len(words) >= SHINGLE else len(words)
    return words[:cut], words[cut:]


def pieces_of(words: list[str]) -> list[list[str]]:
    """An item's words in pieces of equal size, PIECE at most."""
    n = max(1, math.ceil(len(words) / PIECE))
    return [words[len(words) * k // n : len(words) * (k + 1) // n] for k in range(n)]


class Index:
    """Postings of the pieces of items by term, with the maxima of blocks, in flat arrays.

    A piece's score for a passage is the sum of its BM25 weights of the
    passage's distinct terms, divided by the sum over all terms of the piece.
    Postings of a term, and its blocks, are a stretch of the arrays.
    """

    def __init__(self, items: list[tuple[int | None, str]], total: int, frequency: dict[str, int], mean: float):
        self.items, self.owner, self.full, self.term = [], [], [], {}
        terms, pieces, weights = [], [], []
        for item, text in items:
            if words := words_of(text):
                for p in pieces_of(words):
                    norm = K1 * (1 - B + B * len(p) / mean)
                    weight = {t: math.log(1 + (total - frequency[t] + 0.5) / (frequency[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in Counter(p).items()}
                    whole = sum(weight.values())
                    terms += [self.term.setdefault(t, len(self.term)) for t in weight]
                    weights += [w / whole for w in weight.values()]
                    pieces += [len(self.owner)] * len(weight)
                    self.owner.append(len(self.items))
                    self.full.append(whole)
                self.items.append((item, " ".join(words)))
        of, count = np.array(terms, dtype=np.int64), len(self.term)
        order = np.argsort(of, kind="stable")
        of, self.piece, self.weight = of[order], np.array(pieces, dtype=np.int64)[order], np.array(weights)[order]
        self.starts = np.searchsorted(of, np.arange(count + 1))
        cell, first = np.unique(of * (1 + len(self.owner) // BLOCK) + self.piece // BLOCK, return_index=True)
        self.block = self.piece[first] // BLOCK
        #: the largest weight of a term in a block
        self.top = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.block_starts = np.searchsorted(of[first], np.arange(count + 1))
        self.maxima = np.maximum.reduceat(self.weight, self.starts[:-1]) if count else np.zeros(0)
        # terms in more than LONG blocks are left aside first; 2 is more than any sum that is sought
        self.rank = np.where(np.diff(self.block_starts) > LONG, self.maxima, self.maxima + 2.0)
        self.halves: dict[int, tuple[Shingles, Shingles]] = {}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.starts[term], self.starts[term + 1])
        return self.piece[at], self.weight[at]

    def _hopeful(self, terms: np.ndarray, least: float) -> np.ndarray:
        """Blocks that may hold a piece of score least, in order.

        Terms of many blocks whose maxima together fall short of least can't
        make a piece on their own, so blocks are sought among those of the
        other terms; then the block maxima of all terms are added up.
        """
        if not len(terms):
            return terms
        terms = terms[np.argsort(self.rank[terms])]
        sums = np.cumsum(self.rank[terms])
        minor = int(np.searchsorted(sums, least))
        if minor == len(terms):
            return terms[:0]
        at = [(self.block_starts[t], self.block_starts[t + 1]) for t in terms[minor:].tolist()]
        blocks, place = np.unique(np.concatenate([self.block[a:b] for a, b in at]), return_inverse=True)
        bounds = np.bincount(place, weights=np.concatenate([self.top[a:b] for a, b in at]))
        near = bounds + (sums[minor - 1] if minor else 0.0) >= least
        blocks, bounds = blocks[near], bounds[near]
        for t in terms[:minor].tolist() if len(blocks) else ():
            a, b = self.block_starts[t], self.block_starts[t + 1]
            here = np.minimum(np.searchsorted(self.block[a:b], blocks), b - a - 1)
            bounds += np.where(self.block[a:b][here] == blocks, self.top[a:b][here], 0.0)
        return blocks[bounds >= least]

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """(piece, score) of all pieces that score least or more, by block-max WAND.

        The sums of the terms' block maxima tell which blocks can hold such a
        piece; mostly none can, and the passage is done. In the others, the
        pivot is the first cursor at which the maxima of the lists up to it
        reach least, as no piece before it can; cursors jump over blocks whose
        sum falls short.
        """
        hopeful = self._hopeful(np.array(terms, dtype=np.int64), least - 1e-5).tolist()
        if not hopeful:
            return []
        least, out = least - 1e-9, []
        lists = {t: self.postings(t) for t in terms}
        cursors = sorted([int(lists[t][0][0]), 0, t] for t in terms)
        while True:
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.maxima[c[2]]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                return out
            piece = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == piece:
                pivot += 1
            before = cursors[: pivot + 1]
            block = bisect_left(hopeful, piece // BLOCK)
            if block == len(hopeful):
                return out
            if hopeful[block] * BLOCK > piece:
                target = hopeful[block] * BLOCK
            elif before[0][0] == piece:
                score = math.fsum(lists[c[2]][1][c[1]] for c in before)
                if score >= least:
                    out.append((piece, score))
                target = piece + 1
            else:
                target = piece
            for c in before:
                if c[0] < target:
                    own = lists[c[2]][0]
                    c[1] = int(np.searchsorted(own, target))
                    c[0] = int(own[c[1]]) if c[1] < len(own) else -1
            cursors = sorted(c for c in cursors if c[0] >= 0)

    def _halves(self, owner: int) -> tuple[Shingles, Shingles]:
        """Shingles of an item's question and answer, those of the CACHE_ITEMS last asked for kept."""
        if owner not in self.halves:
            if len(self.halves) >= CACHE_ITEMS:
                self.halves.clear()
            question, answer = halves(self.items[owner][1].split(" "))
            self.halves[owner] = shingles(question), shingles(answer)
        return self.halves[owner]

    def _worth_a_search(self, passages: list[np.ndarray], least: float) -> np.ndarray:
        """Which passages (terms, -1 for unknown ones) have a block that may hold a piece of score least.

        The first part of _hopeful for many passages at once.
        """
        blocks = 1 + len(self.owner) // BLOCK
        n, flat = len(passages), np.concatenate(passages)
        code = np.repeat(np.arange(n), [len(x) for x in passages])[flat >= 0] * len(self.term) + flat[flat >= 0]
        if not len(code):
            return np.zeros(n, dtype=bool)
        code = np.unique(code)
        passage, term = code // len(self.term), code % len(self.term)
        order = np.lexsort((self.rank[term], passage))
        passage, term = passage[order], term[order]
        sums = np.cumsum(self.rank[term])
        first = np.searchsorted(passage, np.arange(n + 1))
        sums -= np.concatenate([[0.0], sums])[first[:-1]][passage]
        major, slack = sums >= least, np.zeros(n)
        np.maximum.at(slack, passage[~major], sums[~major])
        passage, term = passage[major], term[major]
        start, size = self.block_starts[term], self.block_starts[term + 1] - self.block_starts[term]
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        bounds = np.bincount(np.repeat(passage, size) * blocks + self.block[at], weights=self.top[at], minlength=n * blocks)
        return (bounds.reshape(n, blocks).max(axis=1) + slack >= least) & (bounds.reshape(n, blocks).max(axis=1) > 0)

    def leaks(self, texts: Iterable[str | None], least: float, overlap: float) -> Iterator[list[tuple[int | None, float, float, float]]]:
        """For each whole text, its [(item, score, question and answer overlap)]."""
        together = max(8, min(1024, 2_000_000 // (1 + len(self.owner) // BLOCK)))
        held: list[tuple[list[str], list[np.ndarray]]] = []
        count = 0
        for text in texts:
            words = words_of(text) if self.items else []
            ids = np.fromiter((self.term.get(w, -1) for w in words), dtype=np.int64, count=len(words))
            held.append((words, [ids[k : k + 2 * PIECE] for k in range(0, max(1, len(ids) - PIECE), PIECE)] if len(ids) else []))
            count += len(held[-1][1])
            if count >= together:
                yield from self._judged(held, together, least, overlap)
                held, count = [], 0
        yield from self._judged(held, together, least, overlap)

    def _judged(self, held: list[tuple[list[str], list[np.ndarray]]], together: int, least: float, overlap: float) -> Iterator[list]:
        flat = [x for _, passages in held for x in passages]
        worth = np.concatenate([np.zeros(0, dtype=bool), *(self._worth_a_search(flat[k : k + together], least - 1e-5) for k in range(0, len(flat), together))])
        done = 0
        for words, passages in held:
            best: dict[int, float] = {}
            for k in np.flatnonzero(worth[done : done + len(passages)]).tolist():
                for piece, score in self.search(list(set(passages[k].tolist()) - {-1}), least):
                    owner = self.owner[piece]
                    best[owner] = max(best.get(owner, 0.0), score * self.full[piece])
            done += len(passages)
            yield self._verified(words, best, overlap) if best else []

    def _verified(self, words: list[str], best: dict[int, float], overlap: float) -> list[tuple[int | None, float, float, float]]:
        own, found = shingles(words), {}
        for owner, score in best.items():
            item, (question, answer) = self.items[owner][0], self._halves(owner)
            q = len(question & own) / len(question)
            a = len(answer & own) / len(answer) if answer else q
            if q >= overlap and a >= overlap:
                found[item] = max(found.get(item, (0.0, 0.0, 0.0)), (score, q, a))
        return [(item, *x) for item, x in found.items()]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _piece_terms(texts: pd.Series) -> pd.Series:
    """The distinct words of each piece, one after the other."""
    return texts.map(lambda text: [w for p in pieces_of(words_of(text)) for w in set(p)])


@F.pandas_udf(T.IntegerType())
def _n_words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: len(words_of(text))).astype("int32")


def build_indexes(benchmark: DataFrame) -> Iterator[Index]:
    """An index for each slice of the benchmark; frequencies are of all its pieces.

    All rows of an item_id are in one slice, so slicing changes no result.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = written(items.withColumn("n", _n_words("text")).where("n > 0"), "benchmark-items")
    total, words = items.agg(F.sum(F.ceil(F.col("n") / PIECE)), F.sum("n")).first()
    if not total:
        return
    slices = math.ceil(total / SLICE_PIECES)
    frequency = items.select(F.explode(_piece_terms("text")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    frequency = written(frequency, "benchmark-terms") if slices > 1 else frequency
    for k in range(slices):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k)
        terms = own.select(F.explode(F.array_distinct(_piece_terms("text"))).alias("t")).distinct()
        found = frequency.join(terms, "t") if slices > 1 else frequency
        yield Index([(r[0], r[1]) for r in own.select("item_id", "text").sort("item_id", "text").collect()], total, dict(map(tuple, found.collect())), words / total)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.6, overlap: float = 0.6) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of test items in docs.

    Every passage of every document (2 * PIECE words, each PIECE words on) is
    a query to the index of benchmark (item_id, text), whose items are cut into
    pieces. Items with a piece that scores least of its own largest score or
    more are candidates. One is a leak if the document holds at least overlap
    of the five-word shingles of its question (the first two thirds of its
    words) and of its answer (the rest). A question or answer of fewer words
    is one run, looked for as it is; an item of fewer than five words is all
    question. score is the best piece's BM25.

    Words are compared in lower case without punctuation; in scripts without
    spaces each letter is a word. Null and empty texts
    and items match nothing; a null doc_id or item_id is reported as null;
    repeated rows give repeated results, items of one id one result; other
    columns are ignored. The broadcast index has SLICE_PIECES pieces or so; a
    larger benchmark takes a pass over docs for each slice, with equal results.
    """
    spark, out = docs.sparkSession, None
    bounded_batches(spark)
    for index in build_indexes(benchmark):
        shipped = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(doc, *hit) for doc, hits in zip(batch["doc_id"], shipped.value.leaks(batch["text"], least, overlap)) for hit in hits]
                found = pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
                yield found.astype({"doc_id": "Int64", "item_id": "Int64", "score": float, "question_overlap": float, "answer_overlap": float})

        hits = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(search, HITS)
        out = hits if out is None else out.union(hits)
    return out if out is not None else spark.createDataFrame([], HITS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.6, overlap: float = 0.6) -> DataFrame:
    """docs without the documents that find_leaks names, all columns kept.

    The test runs on each row itself, so no join is needed and rows of a null
    doc_id are judged by their own text.
    """
    bounded_batches(docs.sparkSession)
    for index in build_indexes(benchmark):
        docs = docs.where(_clean(docs.sparkSession.sparkContext.broadcast(index), least, overlap)(F.col("text")))
    return docs


def _clean(shipped, least: float, overlap: float):
    @F.pandas_udf(T.BooleanType())
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not hits for hits in shipped.value.leaks(texts, least, overlap)], dtype=bool)

    return clean
