"""Language-model scores: a weighted backoff automaton of smoothed n-grams."""

from __future__ import annotations

import math
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Bytes of text in a block of documents, which one task counts and scores.
BLOCK_BYTES = 12 << 20
#: Tokens of a block whose arcs a worker holds at once.
SLICE = 1 << 16
#: The numbers of the token that ends a text, and of the place before its first.
END, START = 0, 1
NAMES = (b"\x00end", b"\x00start")
#: Blocks whose n-grams a task adds up at once, where there are many.
SHARE = 16

COUNTS = "bucket int, block int, keys array<long>, n array<int>, token array<boolean>"
#: A sum is low + high * HIGH: few are as large, so high packs to nothing.
HIGH = 1 << 31
TOTALS = "block int, bucket int, low array<int>, high array<int>, tokens long, kinds long"
SCORES = "doc_id {id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of 64 bits of two such hashes, for each pair."""
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


class _Block:
    """The n-grams of a block of texts.

    Tokens are numbered as they appear; a text is START, its words and END.
    For sizes 1 to order, at[size - 1] has the number of the n-gram that ends
    at each place (-1: the text has begun since), keys its hash, and words of
    size 1 are the tokens themselves. tails are the numbers of the n-gram's
    last size - 1 tokens, heads of its first, last of its last token.
    """

    def __init__(self, texts: list[str | None], order: int):
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        for name in NAMES:
            number[name]
        parts, lengths = [], []
        for text in texts:
            words = (text or "").encode().lower().split()
            lengths.append(len(words) + 2)
            parts += [np.array([START], np.int32), np.fromiter(map(number.__getitem__, words), np.int32, len(words)), np.array([END], np.int32)]
        self.lengths = np.array(lengths, np.int64)
        self.tokens = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        words = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number)).view(np.int64)
        self.keys, self.heads, self.tails, self.last = [words], [None], [None], [None]
        self.at = [self.tokens.astype(np.int64)]
        first = self.tokens == START
        for _ in range(1, order):
            shorter = self.at[-1]
            before = np.append(-1, shorter[:-1])
            before[first] = -1
            here = np.flatnonzero(before >= 0)
            found, where = np.unique(before[here] << 32 | self.at[0][here], return_inverse=True)
            places = np.full(len(shorter), -1, np.int64)
            places[here] = where
            tails = np.zeros(len(found), np.int64)
            tails[where] = shorter[here]
            self.heads.append(found >> 32)
            self.last.append(found & 0xFFFFFFFF)
            self.tails.append(tails)
            self.keys.append(_mixed(self.keys[-1][found >> 32], words[found & 0xFFFFFFFF]))
            self.at.append(places)


def _dealt(block: _Block, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(by, keys, starts): the block's n-grams of all sizes by key, whose first bits tell the bucket, and where each bucket starts."""
    keys = np.concatenate(block.keys).view(np.uint64)
    by = np.argsort(keys)
    keys = keys[by]
    bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return by, keys.view(np.int64), np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def _counts(order: int, buckets: int):
    def counted(docs: pa.Table) -> pa.Table:
        """A row for each bucket: the keys of the block's n-grams, their counts in the rows to learn from, and which are tokens."""
        block = _Block(docs.column("text").to_pylist(), order)
        learn = np.repeat(np.array(docs.column("learn").to_pylist(), bool), block.lengths)
        n = np.concatenate([np.bincount(at[(at >= 0) & learn], minlength=len(keys)) for at, keys in zip(block.at, block.keys)])
        by, keys, starts = _dealt(block, buckets)
        token = by < len(block.keys[0])
        token[by == START] = False
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, kind))
        number = pa.array(np.full(buckets, docs.column("block")[0].as_py()), pa.int32())
        columns = [pa.array(np.arange(buckets), pa.int32()), number, lists(keys, pa.int64()), lists(n[by], pa.int32()), lists(token, pa.bool_())]
        return pa.table(columns, names=["bucket", "block", "keys", "n", "token"])

    return counted


def _totals(rows: pa.Table) -> pa.Table:
    """For each row of a bucket the counts of its keys in all of them, in the row's order, and those of the bucket's tokens."""
    keys, n, token = (rows.column(c).combine_chunks() for c in ("keys", "n", "token"))
    ends = np.append(0, np.cumsum(keys.value_lengths().to_numpy()))
    _, first, where = np.unique(keys.flatten().to_numpy(), return_index=True, return_inverse=True)
    sums = np.bincount(where, n.flatten().to_numpy(), len(first)).astype(np.int64)
    of_tokens = sums[token.flatten().to_numpy(zero_copy_only=False)[first]]
    total = sums[where]
    lists = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32()))
    both = [pa.array(np.full(len(rows), x), pa.int64()) for x in (of_tokens.sum(), np.count_nonzero(of_tokens))]
    return pa.table([rows.column("block"), rows.column("bucket"), lists(total % HIGH), lists(total // HIGH), *both], names=["block", "bucket", "low", "high", "tokens", "kinds"])


class BackoffAutomaton:
    """States are contexts, the learned n-grams of less than order tokens; state 0 has none.

    An arc leads from a state by a token that followed it in learning to the
    longest state that ends the two together, with the token's probability.
    Where a state has no arc for a token, its failure arc takes the weight that
    the state leaves to shorter contexts and leads to that of its own last
    tokens; state 0 has an arc for all tokens. counts are those of each size's
    n-grams in learning, total and kinds the tokens and distinct ones. enter()
    lays out the arcs that some of the block's texts can take.
    """

    def __init__(self, block: _Block, counts: list[np.ndarray], prior: float, discount: float, total: int, kinds: int):
        self.block, order = block, len(counts)
        self.counts = counts[0].copy()
        self.counts[START] = 0
        p = (np.maximum(self.counts - discount, 0) + discount * kinds / (kinds + 1)) / total if total else np.ones(len(self.counts))
        fail, leave, self.found = [np.zeros(1, np.int64)], [np.zeros(1)], []
        states, ends, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        for size, n in enumerate(counts, 1):
            seen = np.flatnonzero(n > 0)
            tails, heads = block.tails[size - 1], block.heads[size - 1]
            own = np.zeros(len(n), np.int64)
            if size < order:
                context = seen[(seen if size == 1 else block.last[size - 1][seen]) != END]
                own[context] = np.arange(at, at + len(context))
                at += len(context)
                fail.append(np.zeros(len(context), np.int64) if size == 1 else states[tails[context]])
                leave.append(np.log10(prior / (n[context] + prior)))
            # an n-gram that is no context leads to what its last tokens lead to
            into = own if size == 1 else np.where(own > 0, own, ends[tails])
            if size == 1:
                self.root, self.root_to = array("d", np.log10(p).tobytes()), array("q", into.tobytes())
            else:
                shorter, p = p, np.zeros(len(n))
                p[seen] = (n[seen] + prior * shorter[tails[seen]]) / (counts[size - 2][heads[seen]] + prior)
                self.found.append((n > 0, states[heads] << 32 | block.last[size - 1], p, into))
            states, ends = own, into
        self.fail, self.leave = array("q", np.concatenate(fail).tobytes()), array("d", np.concatenate(leave).tobytes())
        self.start = self.root_to[START]

    def enter(self, first: int, last: int) -> None:
        """Lay out the arcs of the n-grams at the block's places from first to last."""
        self.arcs: dict[int, tuple[float, int]] = {}
        for at, (learned, arcs, p, into) in zip(self.block.at[1:], self.found):
            here = at[first:last]
            here = np.unique(here[here >= 0])
            here = here[learned[here]]
            self.arcs.update(zip(arcs[here].tolist(), zip(np.log10(p[here]).tolist(), into[here].tolist())))

    def score(self, tokens: list[int]) -> float:
        """The log10 probability of tokens after START: one pass that carries the state."""
        get, fail, leave, root, root_to = self.arcs.get, self.fail, self.leave, self.root, self.root_to
        state, sums = self.start, []
        add = sums.append
        for token in tokens:
            while state:
                arc = get(state << 32 | token)
                if arc:
                    weight, state = arc
                    add(weight)
                    break
                add(leave[state])
                state = fail[state]
            else:
                add(root[token])
                state = root_to[token]
        return math.fsum(sums)


def _scores(order: int, buckets: int, prior: float, discount: float):
    def scored(docs: pa.Table, totals: pa.Table) -> pa.Table:
        texts = docs.column("text").to_pylist()
        block = _Block(texts, order)
        by, _, starts = _dealt(block, buckets)
        n = np.zeros(len(by), np.int64)
        # every bucket answers every block
        total, kinds = (sum(totals.column(c).to_pylist()) for c in ("tokens", "kinds"))
        for bucket, low, high in zip(totals.column("bucket").to_pylist(), totals.column("low"), totals.column("high")):
            n[by[starts[bucket] : starts[bucket + 1]]] = low.values.to_numpy() + high.values.to_numpy().astype(np.int64) * HIGH
        counts = np.split(n, np.cumsum([len(k) for k in block.keys])[:-1])
        automaton = BackoffAutomaton(block, counts, prior, discount, total, kinds)
        base = array("d", np.log10((automaton.counts + 1) / (total + kinds + 1)).tobytes())
        known = automaton.counts > 0
        out, at, entered = [], 0, 0
        ends = np.cumsum(block.lengths)
        for length in block.lengths.tolist():
            if at >= entered:
                # so many texts as have SLICE tokens together, one at least
                entered = int(ends[max(np.searchsorted(ends, at + SLICE, "right") - 1, np.searchsorted(ends, at, "right"))])
                automaton.enter(at, entered)
            tokens = block.tokens[at + 1 : at + length]
            numbers = tokens.tolist()
            out.append((length - 1, int(known[tokens].sum()), total, math.fsum(map(base.__getitem__, numbers)), automaton.score(numbers)))
            at += length
        kinds_of = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        columns = [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds_of)]
        learn = pa.array([not x for x in docs.column("learn").to_pylist()], pa.bool_())
        return pa.table([docs.column("doc_id"), learn, *columns], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return scored


def score_texts(docs: DataFrame, learn: Column, *, order: int = 2, prior: float = 100.0, discount: float = 0.75, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores of all whole texts by the n-grams of the rows where learn holds.

    Tokens are words cut at ASCII blanks, A to Z in lower case, and one end. The
    model mixes contexts by a Dirichlet prior: a token's probability after a
    context of count c is (n + prior * q) / (c + prior), n the count of both
    together and q the probability after the context without its first token.
    Single tokens have discount taken from their counts, which all kinds and one
    unknown token share alike. Probabilities after a context sum to 1. Every
    n-gram counts, none is cut off. base_score adds one to the tokens' counts.

    Documents are dealt to blocks of about block_bytes, whose number grows with
    the corpus while a task's memory doesn't (at terabytes, set it to hundreds
    of MB). A block sends the hashed keys of its distinct n-grams with their
    counts to buckets, each of which adds up its keys over all blocks and sends
    the sums back in the order they came; a frequent n-gram is one entry a
    block. With them a block builds the automaton of what its texts can meet,
    which scores them as the whole one would. Buckets tell all blocks the
    numbers of their tokens and distinct ones. Nothing of the corpus is
    broadcast or collected. N-grams are told apart by hashes of 64 bits.

    Returns doc_id, held_out (not learn), n_tokens, n_known (tokens seen in
    learning), train_tokens, base_score, score, a row for each row. A null or
    empty text is the end alone. A null learn is false. Null and repeated
    doc_ids are rows as others; rows alike in doc_id and text share a block.
    Without rows to learn from n_known is 0, and scores are 0, those of one
    unknown kind. Other columns are ignored.
    """
    if order < 2 or prior <= 0 or not 0 < discount < 1:
        raise ValueError("order is 2 or more, prior more than 0, discount between 0 and 1")
    bounded_batches(docs.sparkSession)
    learn = F.coalesce(learn, F.lit(False))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // block_bytes + 1
    buckets = max(min(blocks, 4 * SHARE), -(-blocks // SHARE))
    rows = docs.select("doc_id", "text", learn.alias("learn"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))
    counted = rows.groupBy("block").applyInArrow(_counts(order, buckets), COUNTS)
    totals = counted.groupBy("bucket").applyInArrow(_totals, TOTALS)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_scores(order, buckets, prior, discount), SCORES.format(id=id_type))
