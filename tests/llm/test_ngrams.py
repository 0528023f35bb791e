import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semiweave.llm import ngrams
from semiweave.llm.ngrams import score_texts


class Brute:
    """The smoothed n-grams by their definition, over dictionaries."""

    def __init__(self, texts, order, prior=100.0, discount=0.75):
        self.d, self.prior, self.order = discount, prior, order
        self.counts = Counter()
        for text in texts:
            words = ["<s>", *self.words(text), "</s>"]
            for size in range(1, order + 1):
                self.counts.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
        self.starts = self.counts.pop(("<s>",), 0)
        single = {g: c for g, c in self.counts.items() if len(g) == 1}
        self.n, self.v = sum(single.values()), len(single)

    @staticmethod
    def words(text):
        return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.split("[ \t-\r]+", text or "") if w]

    def p(self, h, w):
        if not h:
            return (max(self.counts.get((w,), 0) - self.d, 0) + self.d * self.v / (self.v + 1)) / self.n
        c = self.starts if h == ("<s>",) else self.counts[h]
        return (self.counts[(*h, w)] + self.prior * self.p(h[1:], w)) / (c + self.prior) if c else self.p(h[1:], w)

    def score(self, text):
        words, out = ["<s>", *self.words(text), "</s>"], []
        for i in range(1, len(words)):
            out.append(math.log10(self.p(tuple(words[max(0, i - self.order + 1) : i]), words[i])))
        return math.fsum(out)


def made(rng, n):
    return [" ".join(rng.choice("a b c d e f g H aa bb".split()) + rng.choice(("", "", "x")) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_equal_brute_force(spark, order):
    texts = made(random.Random(order), 80) + ["a b c d e f " * 9, "new words only"]
    learn = [k % 7 != 2 for k in range(len(texts))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # many blocks: what a text scores hangs on the corpus alone
    got = {r.doc_id: r for r in score_texts(df, F.col("doc_id") % 7 != 2, order=order, block_bytes=500).collect()}
    model = Brute([t for t, k in zip(texts, learn) if k], order)
    for k, text in enumerate(texts):
        words = [*model.words(text), "</s>"]
        assert got[k].held_out != learn[k] and got[k].train_tokens == model.n and got[k].n_tokens == len(words)
        assert got[k].n_known == sum((w,) in model.counts for w in words)
        assert got[k].base_score == pytest.approx(math.fsum(math.log10((model.counts.get((w,), 0) + 1) / (model.n + model.v + 1)) for w in words))
        assert got[k].score == pytest.approx(model.score(text))


def test_a_block_is_entered_in_slices(monkeypatch):
    monkeypatch.setattr(ngrams, "SLICE", 40)
    texts = made(random.Random(8), 60) + [None, "a b c " * 50]
    learn = [k % 5 != 0 for k in range(len(texts))]
    table = pa.table({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string()), "learn": learn, "block": [0] * len(texts)})
    model = Brute([t for t, k in zip(texts, learn) if k], 3)
    counts = ngrams._counts(3, 5)(table)
    rows = pa.concat_tables([ngrams._totals(counts.slice(k, 1)) for k in range(5)])
    got = ngrams._scores(3, 5, 100.0, 0.75)(table, rows).column("score").to_pylist()
    assert got == pytest.approx([model.score(t) for t in texts])


def test_probabilities_sum_to_one():
    model = Brute(made(random.Random(9), 60), 3)
    kinds = [g[0] for g in model.counts if len(g) == 1] + ["unseen"]
    for h in [(), ("a",), ("<s>",), ("a", "b"), ("never", "a")]:
        assert math.fsum(model.p(h, w) for w in kinds) == pytest.approx(1)


def test_held_out_texts_score_better_than_the_base(spark):
    rng = random.Random(4)
    follow = {w: rng.sample("abcdefghij", 2) for w in "abcdefghij"}

    def walk():
        out = [rng.choice("abcdefghij")]
        for _ in range(60):
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(out)

    df = spark.createDataFrame([(k, walk()) for k in range(60)], "doc_id long, text string")
    held = [r for r in score_texts(df, F.col("doc_id") >= 20, prior=2.0).collect() if r.held_out]
    assert len(held) == 20 and all(r.score > r.base_score * 0.6 for r in held)


def test_rows_of_every_kind(spark):
    rows = [(1, "a b\ta", "x"), (1, "a b\ta", "x"), (2, None, None), (None, "", "y"), (None, "A\x1cb   É", "z"), (3, "a b " * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = score_texts(df, F.col("doc_id") != 2, block_bytes=100).collect()
    seen = sorted(((r.doc_id, r.held_out, r.n_tokens) for r in got), key=str)
    # blanks of other kinds are letters of a word; a null condition holds out
    assert seen == sorted([(1, False, 4), (1, False, 4), (2, True, 1), (None, True, 1), (None, True, 4), (3, False, 100_001)], key=str)
    assert {r.train_tokens for r in got} == {100_009}
    assert score_texts(df.limit(0), F.lit(True)).count() == 0
    none = score_texts(df, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.score) for r in none} == {(0, 0, 0.0)}
