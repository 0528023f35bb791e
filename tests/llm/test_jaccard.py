import random

import numpy as np
import pytest

from semiweave.llm import jaccard
from semiweave.llm.jaccard import jaccard_classes, keep_one_of_each, overlaps, runs_for


def shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows, threshold=0.8):
    sets = [shingles(t) if t else set() for _, t in rows]
    links, group = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                group[find(a)] = find(b)
    ids = {}
    for k, (doc, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(doc)
    least = {g: min((d for d in x if d is not None), default=None) for g, x in ids.items()}
    return sorted(((doc, least[find(k)], links[k]) for k, (doc, _) in enumerate(rows)), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    passage = [rng.choice(words) for _ in range(55)]
    out, doc = [], 0
    for size in [1] * 60 + [2] * 20 + [5] * 6 + [170]:
        base = [rng.choice(words) for _ in range(rng.choice((3, 30, 80, 150)))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.3:
                w = passage + w
            out.append((doc, " ".join(w)))
            doc += rng.randrange(1, 3)
    out += [(9000, None), (9001, ""), (9002, "  \n"), (9002, "  \n"), (None, out[0][1]), (None, "two words"), (9003, "two words"), (9004, " ".join(rng.choice(words) for _ in range(20000)))]
    out += [(9005, out[-1][1] + " more"), (9006, out[70][1]), (9006, out[70][1])]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("bucket, block", [(128, 128), (20, 16)])
def test_classes_equal_brute_force(spark, rows, monkeypatch, bucket, block):
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, key string, v int").repartition(4)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(df).collect()), key=str)
    assert got == brute(rows)


def test_one_of_each_group_stays(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, row_ string, repeats int")
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns
    classes = {c for _, c, _ in brute([(d, t) for d, t in rows if t and t.strip()])}
    bare = [d for d, t in rows if not t or not t.strip()]
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got, key=str) == sorted([*classes, *bare], key=str)


def test_one_lost_pair_among_many_texts_fails_the_audit(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate([*texts, texts[7] + " more"])), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(jaccard, "choose", lambda s, *a: s[:0])
    with pytest.raises(RuntimeError):
        jaccard_classes(df).count()


def test_a_recall_that_no_text_tells_is_said(spark):
    texts = [f"all of these {k} words are {k * 7} quite different" for k in range(50)]
    with pytest.warns(UserWarning, match="unmeasured"):
        assert jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("n_links > 0").count() == 0


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 90, size=rng.integers(1, 60)).astype(np.uint64)) for _ in range(30)]
    assert overlaps(sets).tolist() == [[len(np.intersect1d(a, b)) if a is not b else overlaps(sets)[k][k] for b in sets] for k, a in enumerate(sets)]
    assert runs_for(0.9999, 0.8) > runs_for(0.9, 0.8) > 0


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_classes(df).count() == 0
    assert keep_one_of_each(df).count() == 0
