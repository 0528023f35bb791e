"""Language of words and texts by a linear-chain conditional random field."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, packed

#: Documents that training takes at most, those of the smallest hashes; longer ones aren't among them, nor are
#: languages beyond the TRAIN_LANGS of most documents. And words of each run cut from them.
TRAIN_DOCS, TRAIN_CHARS, TRAIN_LANGS = 800, 100_000, 400
RUN_WORDS = 48
#: Words whose scores a task keeps; beyond it the store starts anew.
CACHE_WORDS = 50_000
#: Characters of texts that are labelled together, and words of a block of one text.
BATCH_CHARS = 300_000
BLOCK = 256
UNKNOWN = "und"


def letters(word: str) -> str:
    """A word's letters in lower case."""
    w = word.lower()
    return w if w.isalpha() else "".join(filter(str.isalpha, w))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, code) of the affixes and trigrams of words made of letters.

    "<" and ">" mark a word's ends. Trigrams, and the first and last two and
    four characters, are numbers of 16 bits a character.
    """
    c = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-16-le", "surrogatepass"), dtype=np.uint16).astype(np.uint64)
    first, last = c == ord("<"), c == ord(">")
    word = np.cumsum(first) - 1
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    code = lambda at, n: sum(c[at + k] << np.uint64(16 * (n - 1 - k)) for k in range(n))
    inside = np.flatnonzero(~last[:-2] & ~last[1:-1]) if len(c) > 2 else s[:0]
    long = e - s >= 3
    at = [inside, s, e - 1, s[long], e[long] - 3]
    return np.concatenate([word[x] for x in at]), np.concatenate([code(x, n) for x, n in zip(at, (3, 2, 2, 4, 4))])


def features(words: list[str], codes: np.ndarray, lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of words made of letters: their grams in codes, and themselves in the lexicon."""
    word_of, code = grams(words)
    at = np.searchsorted(codes, code)
    at[at == len(codes)] = 0
    known = codes[at] == code if len(codes) else np.zeros(len(at), dtype=bool)
    own = np.fromiter((lexicon.get(w, -1) for w in words), dtype=np.int64, count=len(words))
    listed = np.flatnonzero(own >= 0)
    return np.concatenate([word_of[known], listed]), np.concatenate([at[known], own[listed] + len(codes)])


class Crf:
    """weights[k] are the label scores of feature k, moves[a, b] that of label b after a.

    Features are the sorted codes of grams, then the words of the lexicon.
    Words without letters have none and take the labels around them. The
    scores of words met are kept, up to CACHE_WORDS and the words of a batch.
    """

    def __init__(self, labels: list[str], codes: np.ndarray, lexicon: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.labels, self.codes, self.lexicon, self.weights, self.moves = labels, codes, lexicon, weights, moves
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(labels)))
        self.heavy = np.zeros(0)

    def _look_up(self, words: list[str]) -> np.ndarray:
        """Rows of self.scores (and of self.heavy: 1 with letters) for words."""
        ids = list(map(self.known.get, words))
        if None in ids:
            if len(self.known) >= CACHE_WORDS:
                self.known, self.scores, self.heavy = {}, self.scores[:0], self.heavy[:0]
            new = [w for w in dict.fromkeys(words) if w not in self.known]
            bare = [letters(w) for w in new]
            heavy = np.fromiter(map(bool, bare), dtype=bool, count=len(bare))
            word_of, rows = features([w for w in bare if w], self.codes, self.lexicon)
            total, found = np.zeros((len(new), len(self.labels))), self.weights[rows]
            for k in range(len(self.labels)):
                total[heavy, k] = np.bincount(word_of, weights=found[:, k], minlength=int(heavy.sum()))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.scores = np.concatenate([self.scores, total])
            self.heavy = np.concatenate([self.heavy, heavy.astype(float)])
            ids = list(map(self.known.get, words))
        return np.array(ids, dtype=np.int64)

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text (a list of words), the probabilities of each word's labels."""
        flat = self._look_up([w for t in texts for w in t])
        cuts = np.cumsum([len(t) for t in texts])[:-1]
        return blockwise([self.scores[x] for x in np.split(flat, cuts)], self.moves)

    def shares(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """For each text, the mean label probabilities of its words with letters, and the mean of each word's largest."""
        out, sure = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        for k, (words, m) in enumerate(zip(texts, self.marginals(texts))):
            if len(words):
                heavy = self.heavy[self._look_up(words)]
                out[k] = heavy @ m / max(heavy.sum(), 1.0)
                sure[k] = heavy @ m.max(axis=1) / max(heavy.sum(), 1.0)
        return out, sure


def forward_backward(scores: list[np.ndarray], moves: np.ndarray, prior: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Marginals of each sequence, and expected moves.

    scores come longest first. All sequences advance together; at step t those
    longer than t are a leading slice of the state. prior weighs the labels of
    each first word, after those of each last; 1 if they are the text's ends.
    """
    if not scores:
        return [], np.zeros_like(moves)
    n, labels = len(scores), moves.shape[0]
    lengths = np.array([len(s) for s in scores])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.concatenate(scores)
    flat = np.exp(flat - flat.max(axis=1, keepdims=True))
    step = np.exp(moves)
    alive = n - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    alpha, gamma, scale = np.empty_like(flat), np.empty_like(flat), np.empty(len(flat))
    a = flat[starts] * (1.0 if prior is None else prior)
    for t in range(lengths[0]):
        at = starts[: alive[t]] + t
        if t:
            a = a[: alive[t]] @ step * flat[at]
        z = a.sum(axis=1)
        a = a / z[:, None]
        alpha[at], scale[at] = a, z
    expected = np.zeros_like(moves)
    b = np.ones((0, labels))
    for t in range(lengths[0] - 1, -1, -1):
        m = alive[t]
        now = np.ones((m, labels)) if after is None else after[:m].copy()
        if len(b):
            nxt = starts[: len(b)] + t + 1
            ahead = b * flat[nxt] / scale[nxt][:, None]
            now[: len(b)] = ahead @ step.T
            expected += step * (alpha[nxt - 1].T @ ahead)
        b = now
        at = starts[:m] + t
        gamma[at] = alpha[at] * b
    gamma /= gamma.sum(axis=1, keepdims=True)
    return np.split(gamma, starts[1:]), expected


def blockwise(scores: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """Marginals of sequences of any lengths, in any order, also empty.

    Each is cut into blocks of BLOCK words, which advance together. The
    product of a block's transfer matrices carries the forward and backward
    vectors over it, so the cut changes nothing but rounding.
    """
    blocks = [(k, s, scores[k][s : s + BLOCK]) for k in range(len(scores)) for s in range(0, len(scores[k]), BLOCK)]
    if not blocks:
        return [np.zeros((0, len(moves))) for _ in scores]
    order = sorted(range(len(blocks)), key=lambda j: -len(blocks[j][2]))
    labels, step = len(moves), np.exp(moves)
    prior, after = np.ones((len(blocks), labels)), np.ones((len(blocks), labels))
    several = {k for k, s, _ in blocks if s}
    inner = [j for j in order if blocks[j][0] in several]
    if inner:
        carry = dict(zip(inner, _transfers([blocks[j][2] for j in inner], step)))
        for j, (k, s, _) in enumerate(blocks):
            if s:
                out = prior[j - 1] @ carry[j - 1]
                prior[j] = out / out.sum() @ step
        for j in range(len(blocks) - 1, 0, -1):
            if blocks[j][1]:
                back = step @ (carry[j] @ after[j])
                after[j - 1] = back / back.sum()
    found, _ = forward_backward([blocks[j][2] for j in order], moves, prior[order], after[order])
    parts: list[list[np.ndarray]] = [[] for _ in scores]
    place = dict(zip(order, found))
    for j, (k, _, _) in enumerate(blocks):
        parts[k].append(place[j])
    return [np.concatenate(p) if p else np.zeros((0, labels)) for p in parts]


def _transfers(blocks: list[np.ndarray], step: np.ndarray) -> np.ndarray:
    """For each block, longest first, the matrix from the weights of its first labels to its last."""
    lengths = np.array([len(s) for s in blocks])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.concatenate(blocks)
    flat = np.exp(flat - flat.max(axis=1, keepdims=True))
    out = flat[starts][:, :, None] * np.eye(len(step))
    for t in range(1, lengths[0]):
        m = int((lengths > t).sum())
        s = out[:m] @ step * flat[starts[:m] + t][:, None, :]
        out[:m] = s / s.max(axis=(1, 2), keepdims=True)
    return out


def runs_of(docs: list[tuple[str, str]], seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """Training sequences (words, labels) that switch languages.

    Each text is cut into runs of RUN_WORDS words; runs of all texts are dealt
    at random into sequences of one to four, so that the learned moves tell how
    rarely a text changes its language and that it may.
    """
    rng = np.random.default_rng(seed)
    runs = [(words[k : k + RUN_WORDS], lang) for text, lang in docs if (words := text.split()) for k in range(0, len(words), RUN_WORDS)]
    order, out, at = rng.permutation(len(runs)), [], 0
    while at < len(runs):
        size = int(rng.integers(1, 5))
        part = [runs[k] for k in order[at : at + size]]
        at += size
        out.append(([w for words, _ in part for w in words], [lang for words, lang in part for _ in words]))
    return out


def train(docs: list[tuple[str, str]], *, rounds: int = 25, rate: float = 0.25, decay: float = 1e-4, least_count: int = 2) -> Crf:
    """Fit weights and moves to (text, label) by AdaGrad on the log-likelihood."""
    labels = sorted({lang for _, lang in docs})
    if not labels:
        return Crf([], np.zeros(0, dtype=np.uint64), {}, np.zeros((0, 0)), np.zeros((0, 0)))
    index = {x: k for k, x in enumerate(labels)}
    data = sorted(runs_of(docs), key=lambda x: -len(x[0]))
    vocabulary: dict[str, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words]) for words, _ in data]
    bare = [letters(w) for w in vocabulary]
    heavy = np.array([k for k, w in enumerate(bare) if w], dtype=np.int64)
    bare = [w for w in bare if w]
    codes, counts = np.unique(grams(bare)[1], return_counts=True)
    codes = codes[counts >= least_count]
    lexicon = {w: k for k, w in enumerate(sorted(set(bare)))}
    word_of, feature_of = features(bare, codes, lexicon)
    word_of, size = heavy[word_of], len(codes) + len(lexicon)
    flat = np.concatenate(ids)
    gold = np.array([index[x] for _, langs in data for x in langs])
    observed = np.zeros((len(vocabulary), len(labels)))
    np.add.at(observed, (flat, gold), 1.0)
    seen = np.zeros((len(labels), len(labels)))
    for _, langs in data:
        path = np.array([index[x] for x in langs])
        np.add.at(seen, (path[:-1], path[1:]), 1.0)
    w, m = np.zeros((size, len(labels))), np.zeros((len(labels), len(labels)))
    hw, hm = np.full_like(w, 1e-8), np.full_like(m, 1e-8)
    spread = lambda x: np.stack([np.bincount(word_of, weights=x[feature_of, k], minlength=len(vocabulary)) for k in range(len(labels))], axis=1)
    gather = lambda x: np.stack([np.bincount(feature_of, weights=x[word_of, k], minlength=size) for k in range(len(labels))], axis=1)
    for _ in range(rounds):
        scores = spread(w)
        gamma, moved = forward_backward([scores[x] for x in ids], m)
        gamma = np.concatenate(gamma)
        hoped = np.stack([np.bincount(flat, weights=gamma[:, k], minlength=len(vocabulary)) for k in range(len(labels))], axis=1)
        gw = gather(observed - hoped) / len(flat) - decay / size * w
        gm = (seen - moved) / len(flat) - decay * m
        hw += gw * gw
        hm += gm * gm
        w += rate * gw / np.sqrt(hw)
        m += rate * gm / np.sqrt(hm)
    return Crf(labels, codes, lexicon, w.astype(np.float32), m)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text is 1 modulo 3; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _train_there(rows: DataFrame, each: int, least: dict[str, int]) -> Crf | None:
    """train on the each documents of the least ranks of each language in rows, by one task; None if a language has too few.

    Only the model comes to the driver.
    """

    def trained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: dict[str, list[tuple[int, str, str]]] = {lang: [] for lang in sorted(least)}
        for batch in batches:
            for text, lang, rank, doc_id in zip(*(batch[c] for c in ("text", "lang", "rank", "doc_id"))):
                by[lang].append((rank, doc_id, text))
        by = {lang: sorted(x)[:each] for lang, x in by.items()}
        model = None
        if all(len(by[lang]) >= n for lang, n in least.items()):
            m = train([(text, lang) for lang, x in by.items() for _, _, text in x])
            model = pickle.dumps((m.labels, m.codes, m.lexicon, m.weights, m.moves))
        yield pd.DataFrame({"model": [model]})

    # the bounded sample is one task's, and an empty one still a task
    found = rows.repartition(1).mapInPandas(trained, "model binary").first()
    return None if found is None or found["model"] is None else Crf(*pickle.loads(found["model"]))


def train_on(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Crf:
    """Train on documents that aren't held out and have text and lang.

    Takes the train_docs of the smallest hash of doc_id, an equal part of it
    for each lang; a documented bound, which the model's size follows. Texts of
    more than TRAIN_CHARS are not learned from, and of more than TRAIN_LANGS
    languages those of most documents (of equal ones the first by name) are.
    A task trains, so the driver holds no text.
    """
    bounded_batches(docs.sparkSession)
    rank = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 40))
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.length("text").between(1, TRAIN_CHARS) & ~held_out(F.col("doc_id")))
    most_used = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(TRAIN_LANGS)
    counts = {r[0]: r[1] for r in most_used.collect()}
    if not counts:
        return train([])
    each, reach = max(1, train_docs // len(counts)), 2.0
    while True:
        # so low a rank that about reach * each documents have it
        most = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int((1 << 40) * min(1.0, reach * each / n + 1e-9)))])
        rows = usable.select("text", "lang", rank.alias("rank"), F.col("doc_id").cast("string").alias("doc_id")).where(F.col("rank") <= most[F.col("lang")])
        model = _train_there(rows, each, {lang: min(each, n) for lang, n in counts.items()})
        if model is not None:
            return model
        reach *= 2


def identify(docs: DataFrame, model: Crf) -> DataFrame:
    """docs with lang_pred (string) and score (double).

    lang_pred is the label with the most expected words of the whole text, by
    forward-backward over all its words, and score its share of them. Only the
    text is read. A null text, one without a letter, and any text where
    nothing was learned is "und" with score 0. Ties take the first label in
    alphabetical order. Rows and other columns pass through; input columns
    lang_pred and score are replaced.
    """
    return _identified(docs, model).drop("sure_")


def _identified(docs: DataFrame, model: Crf) -> DataFrame:
    """identify's columns and sure_, the mean probability of the likeliest label of each word."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast((model.labels, model.codes, model.lexicon, model.weights, model.moves))

    def predict(model: Crf, texts: list[str | None]) -> list[tuple[str, float, float]]:
        if not model.labels:
            return [(UNKNOWN, 0.0, 0.0)] * len(texts)
        out = []
        for share, sure in zip(*model.shares([t.split() if t else [] for t in texts])):
            best = int(share.argmax())
            out.append((model.labels[best], min(1.0, float(share[best])), min(1.0, float(sure))) if share[best] > 0 else (UNKNOWN, 0.0, 0.0))
        return out

    @F.pandas_udf(T.StructType([T.StructField("l", T.StringType()), T.StructField("s", T.DoubleType()), T.StructField("u", T.DoubleType())]))
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        # the model's store of words is the task's own and goes with it
        model = Crf(*shipped.value)
        for batch in batches:
            out: list[tuple[str, float, float]] = []
            part: list[str | None] = []
            size = 0
            for text in batch:
                part.append(text)
                size += len(text or "")
                if size > BATCH_CHARS:
                    out += predict(model, part)
                    part, size = [], 0
            yield pd.DataFrame(out + predict(model, part), columns=["l", "s", "u"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    found = docs.select(*kept, predicted(F.col("text")).alias("found_"))
    return found.select(*kept, F.col("found_.l").alias("lang_pred"), F.col("found_.s").alias("score"), F.col("found_.u").alias("sure_"))


def keep_identified(docs: DataFrame, model: Crf, least: float = 0.5) -> DataFrame:
    """docs without those that are "und" or whose words have no sure label (a mean probability below least).

    A text that shares its words among known languages is kept. All columns
    stay as they are; an empty table stays empty.
    """
    rows = packed(docs, {"text": F.col("text").cast("string")})
    return _identified(rows, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("sure_") >= least)).select("row_.*")
