import random

import numpy as np
import pytest

from semiweave.llm import decontaminate
from semiweave.llm.decontaminate import Index, build_indexes, drop_contaminated, find_leaks, halves, shingles, words_of


def corpus(rng, n):
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(n)]
    return " ".join(words)


@pytest.mark.parametrize("long", [decontaminate.LONG, 0])
def test_wand_finds_what_exhaustive_scoring_finds(monkeypatch, long):
    monkeypatch.setattr(decontaminate, "LONG", long)
    rng = random.Random(5)
    items = [(k, corpus(rng, rng.randrange(3, 90))) for k in range(300)]
    frequency = {}
    from semiweave.llm.decontaminate import pieces_of

    pieces = [p for _, t in items for p in pieces_of(words_of(t))]
    for p in pieces:
        for t in set(p):
            frequency[t] = frequency.get(t, 0) + 1
    index = Index(items, len(pieces), frequency, sum(map(len, pieces)) / len(pieces))
    for least in (0.2, 0.4, 0.7):
        for _ in range(60):
            terms = sorted({index.term[w] for w in corpus(rng, 60).split() if w in index.term})
            scores = {}
            for t in terms:
                for p, w in zip(*map(np.ndarray.tolist, index.postings(t))):
                    scores[p] = scores.get(p, 0.0) + w
            exact = sorted((p, round(s, 9)) for p, s in scores.items() if s >= least - 1e-9)
            assert sorted((p, round(s, 9)) for p, s in index.search(terms, least)) == exact


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(9)
    items = [(k, corpus(rng, rng.randrange(15, 60))) for k in range(30)] + [(None, "only five words are here"), (31, None), (32, ""), (7, "a second text of item seven with twelve words and no more")]
    docs = [(k, corpus(rng, rng.randrange(0, 300)), "x") for k in range(60)]
    docs += [(100, corpus(rng, 70) + " " + items[3][1].upper() + ". " + corpus(rng, 90), "x"), (101, items[5][1], "x"), (101, items[5][1], "x"), (102, None, "x"), (None, items[8][1], None), (103, "", "x"), (104, corpus(rng, 40000) + " " + items[9][1], "x"), (105, "Only five WORDS, are here", "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"), docs, items


def test_leaks_equal_brute_force(tables):
    docs, benchmark, d, i = tables
    expected = []
    for doc, text, _ in d:
        own = shingles(words_of(text))
        hits = set()
        for item, t in i:
            q, a = halves(words_of(t))
            if q and len(shingles(q) & own) >= 0.6 * len(shingles(q)) and (not a or len(shingles(a) & own) >= 0.6 * len(shingles(a))):
                hits.add(item)
        expected += [(doc, item) for item in hits]
    got = [(r.doc_id, r.item_id) for r in find_leaks(docs, benchmark).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert {(100, 3), (101, 5), (None, 8), (104, 9)} <= set(got)
    kept = drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert kept.count() == len(d) - len({(k, x[0]) for k, x in enumerate(d) if x[0] in {g[0] for g in got}})


def test_slices_change_nothing(spark, tables, monkeypatch):
    """Also with several rows of one item_id."""
    docs, benchmark, _, items = tables
    benchmark = benchmark.union(spark.createDataFrame([(3, items[4][1]), (3, items[5][1] + " and more"), (None, items[6][1])], "item_id long, text string"))
    whole = sorted(map(tuple, find_leaks(docs, benchmark).collect()), key=str)
    assert len({r[:2] for r in whole if r[0] is not None and r[0] != 101}) == sum(1 for r in whole if r[0] is not None and r[0] != 101)
    monkeypatch.setattr(decontaminate, "SLICE_PIECES", 12)
    assert sorted(map(tuple, find_leaks(docs, benchmark).collect()), key=str) == whole
    assert drop_contaminated(docs, benchmark).count() == docs.count() - len({(r[0], 0) for r in whole if r[0] not in (None, 101)}) - 2 - len({1 for r in whole if r[0] is None})


def test_empty_tables(spark, tables):
    docs, benchmark, _, _ = tables
    assert find_leaks(docs.limit(0), benchmark).count() == 0
    assert find_leaks(docs, benchmark.limit(0)).count() == 0
    assert list(build_indexes(benchmark.limit(0))) == []


def test_copies_of_short_items_are_found(spark):
    words = [f"k{k}" for k in range(14)]
    items = [(n, " ".join(words[:n])) for n in range(1, 15)] + [(20, "今天天气怎么样？很好。")]
    docs = [(n, f"Before it, {text} and after.") for n, text in items] + [(30, " ".join(reversed(words))), (31, "他问今天天气怎么样很好他说"), (32, "天气今天怎么样"), (33, "k0 and k1"), (34, " ".join([*words[:9], "and", *words[10:14]]))]
    expected = {(n, m) for n in range(1, 15) for m in range(1, n + 1)} | {(20, 20), (31, 20), (30, 1), (33, 1)}
    # of document 34, ten words and more lack their answer: 'k7 k8 k9', 'k8 k9 k10', ...; item 14 has its answer 'k10 k11 k12 k13' and five of six runs of its question
    expected |= {(34, m) for m in (*range(1, 10), 14)}
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    assert all((r.question_overlap, r.answer_overlap) == (1.0, 1.0) for r in found if r.doc_id == r.item_id)
