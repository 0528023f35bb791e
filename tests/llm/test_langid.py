import itertools
import zlib

import numpy as np
import pytest

from semiweave.llm import langid
from semiweave.llm.langid import blockwise, forward_backward, grams, held_out, identify, keep_identified, letters, train, train_on

WORDS = {"aa": ["the", "wharing", "andshed", "tionly", "with"], "bb": ["der", "schkeit", "ungen", "für", "pflich"]}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def exact(scores, moves):
    """Marginals by enumerating all label paths."""
    n, labels = scores.shape
    out = np.zeros((n, labels))
    for path in itertools.product(range(labels), repeat=n):
        p = np.exp(sum(scores[t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        for t, y in enumerate(path):
            out[t, y] += p
    return out / out.sum(axis=1, keepdims=True)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    moves = rng.normal(size=(3, 3))
    scores = [rng.normal(size=(n, 3)) * 2 for n in (7, 6, 4, 1)]
    for got, s in zip(forward_backward(scores, moves)[0], scores):
        assert np.allclose(got, exact(s, moves))


def test_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    moves = rng.normal(size=(4, 4))
    scores = [rng.normal(size=(n, 4)) * 3 for n in (0, 700, 3, 256, 1, 0, 257, 5000)]
    long = sorted((s for s in scores if len(s)), key=lambda s: -len(s))
    whole = {len(s): g for s, g in zip(long, forward_backward(long, moves)[0])}
    for got, s in zip(blockwise(scores, moves), scores):
        assert got.shape == s.shape
        assert not len(s) or np.allclose(got, whole[len(s)])


def test_grams():
    word, code = grams([letters("Äb!"), letters("x")])
    own = lambda t: sum(ord(c) << 16 * (len(t) - 1 - k) for k, c in enumerate(t))
    assert sorted(zip(word.tolist(), code.tolist())) == sorted([(0, own(t)) for t in ("<äb", "äb>", "<ä", "b>", "<äb>", "<äb>")] + [(1, own(t)) for t in ("<x>", "<x", "x>")])
    assert [len(x) for x in grams([])] == [0, 0]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    rows = [(k, text(rng, lang, int(rng.integers(3, 60))), lang, "s") for k in range(120) for lang in ("aa", "bb") if k % 2 == (lang == "bb")]
    rows += [(500, None, "aa", "s"), (501, "", "bb", None), (502, "12 34 !!", "aa", "s"), (None, text(rng, "bb", 9), None, "s"), (503, text(rng, "aa", 30000), None, "s"), (503, text(rng, "aa", 5), None, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_identify(docs):
    model = train_on(docs, train_docs=60)
    assert model.labels == ["aa", "bb"]
    found = identify(docs, model).withColumn("out", held_out(docs["doc_id"])).collect()
    assert len(found) == docs.count()
    for r in found:
        assert 0.0 <= r.score <= 1.0
        assert r.out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id in (500, 501, 502):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is None:
            assert r.lang_pred == "bb"
        else:
            assert r.lang_pred == ("aa" if r.doc_id % 2 == 0 or r.doc_id == 503 else "bb")


def test_code_switched_words():
    rng = np.random.default_rng(4)
    model = train([(text(rng, lang, 40), lang) for lang in ("aa", "bb") for _ in range(20)])
    words = (text(rng, "aa", 10) + " " + text(rng, "bb", 10)).split()
    assert [model.labels[k] for k in model.marginals([words])[0].argmax(axis=1)] == ["aa"] * 10 + ["bb"] * 10
    assert np.diag(model.moves).min() > model.moves[~np.eye(2, dtype=bool)].max()


def test_nothing_learned(spark, docs):
    model = train_on(docs.limit(0))
    assert model.labels == []
    assert {r.lang_pred for r in identify(docs, model).collect()} == {"und"}
    assert identify(docs.limit(0), train_on(docs)).count() == 0


def test_ties_take_the_first_label(spark):
    model = langid.Crf(["aa", "bb"], np.zeros(0, dtype=np.uint64), {}, np.zeros((0, 2)), np.zeros((2, 2)))
    docs = spark.createDataFrame([(1, "some words"), (1, "some words"), (2, "12 34")], "doc_id long, text string")
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in identify(docs, model).collect()) == [(1, "aa", 0.5), (1, "aa", 0.5), (2, "und", 0.0)]


def test_the_sample_is_bounded(spark, monkeypatch):
    """However many values lang has, and however long texts are."""
    monkeypatch.setattr(langid, "TRAIN_LANGS", 3)
    monkeypatch.setattr(langid, "TRAIN_CHARS", 100)
    rows = [(k, f"text {k} of language l{k % 9}", f"l{k % 9}") for k in range(180)] + [(1000 + k, "long " * 100, "l8") for k in range(60)]
    model = train_on(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_docs=12)
    assert len(model.labels) == 3 and "long" not in model.lexicon


def test_texts_of_several_languages_stay(spark):
    words = {"aa": "alpha beta gamma delta", "bb": "uno due tre quattro", "cc": "eins zwei drei vier"}
    train = [(k, " ".join([words[x]] * 12), x) for k, x in enumerate(list(words) * 20)]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    mixed = spark.createDataFrame([(1, " ".join(" ".join([words[x]] * 12) for x in words), "x"), (2, None, "x"), (3, "123 ...", "x"), (None, words["aa"] * 5, "x")], "doc_id long, text string, lang_pred string")
    kept = keep_identified(mixed, train_on(df))
    assert kept.columns == mixed.columns
    assert sorted(((r.doc_id or 0) for r in kept.collect())) == [0, 1]


def test_the_driver_trains_nothing(spark, monkeypatch):
    import os

    from semiweave.llm import langid

    driver, train = os.getpid(), langid.train

    def elsewhere(docs, **options):
        assert os.getpid() != driver
        return train(docs, **options)

    monkeypatch.setattr(langid, "train", elsewhere)
    rows = [(k, f"the {'cat' if k % 2 else 'dog'} sat number{k} here", "en") if k % 3 else (k, f"der hund sitzt nummer{k} hier", "de") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train_on(docs)
    assert model.labels == ["de", "en"]
    taken = sorted((lang, text) for k, text, lang in rows if zlib.crc32(str(k).encode()) % 3 != 1)
    assert set(model.lexicon) == {langid.letters(w) for _, text in taken for w in text.split()}
