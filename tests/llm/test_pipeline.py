"""The pipeline against plain Python, stage by stage, on tables with planted cases."""

import hashlib
import math
import random

import numpy as np
import pytest

import corpus_pipeline
from semiweave.llm.decontaminate import halves, shingles, words_of
from semiweave.llm.langid import train_on

WORDS = {"aa": [f"tha{x}ing{y}" for x in "bdfgk" for y in "aeiou"], "bb": [f"sch{x}keit{y}" for x in "bdfgk" for y in "äöüei"]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    say = lambda lang, n: " ".join(rng.choice(WORDS[lang]) for _ in range(n))
    rows = [(k, say("aa" if k % 3 else "bb", rng.randrange(20, 90)), "aa" if k % 3 else "bb", f"s{k % 4}") for k in range(150)]
    rows += [(200 + k, rows[k][1], rows[k][2], "s0") for k in range(10)]
    near = say("aa", 80).split()
    rows += [(300 + k, " ".join(near[:20] + [rng.choice(WORDS["aa"])] + near[21:]), "aa", "s1") for k in range(30)]
    items = [(k, say("aa", 40)) for k in range(5)]
    rows += [(400 + k, say("aa", 30) + " " + items[k][1] + " " + say("aa", 20), "aa", "s2") for k in range(3)]
    rows += [(500, None, "aa", "s0"), (501, "", None, None), (502, "12 !!", "aa", "s0"), (503, say("bb", 60), None, None)]
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def identified(model, rows):
    """Forward-backward of each text by itself, in plain loops."""
    out = []
    moves, n = np.exp(model.moves), len(model.labels)
    for r in rows:
        words = (r[1] or "").split()
        if not any(c.isalpha() for w in words for c in w):
            continue
        ids = model._look_up(words)
        e = np.exp(model.scores[ids])
        alpha, beta = np.zeros((len(words), n)), np.ones((len(words), n))
        alpha[0] = e[0] / e[0].sum()
        for t in range(1, len(words)):
            alpha[t] = alpha[t - 1] @ moves * e[t]
            alpha[t] /= alpha[t].sum()
        for t in range(len(words) - 2, -1, -1):
            beta[t] = moves @ (e[t + 1] * beta[t + 1])
            beta[t] /= beta[t].sum()
        m = alpha * beta
        m /= m.sum(axis=1, keepdims=True)
        lettered = np.array([any(map(str.isalpha, w)) for w in words])
        if m[lettered].mean(axis=0).max() >= 0.5:
            out.append(r)
    return out


def without_copies(rows):
    sets = []
    for r in rows:
        w = r[1].split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    best = {}
    for k, r in enumerate(rows):
        best[find(k)] = min(best.get(find(k), r), r, key=lambda x: x[0])
    return list(best.values())


def clean(rows, items):
    def leaked(r, t):
        own, (q, a) = shingles(words_of(r[1])), halves(words_of(t))
        return len(shingles(q) & own) >= 0.6 * len(shingles(q)) and len(shingles(a) & own) >= 0.6 * len(shingles(a))

    return [r for r in rows if not any(leaked(r, t) for _, t in items)]


def mixed(rows):
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(r[1])
    whole, share = sum(size.values()), sum(x**0.7 for x in size.values())
    out = []
    for r in rows:
        rate = size[r[3]] ** 0.7 / share * whole / size[r[3]]
        u = int(hashlib.md5(f"17:{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        out += [r] * k
    return out


def sharded(rows, limit=1 << 20):
    h = [int(hashlib.md5(str(r[0]).encode()).hexdigest()[:15], 16) for r in rows]
    size = [len(r[1].encode()) for r in rows]
    out = []
    for r, x in zip(rows, h):
        d = next(d for d in range(61) if sum(n for y, n in zip(h, size) if y >> (60 - d) == x >> (60 - d)) <= limit)
        out.append((r[0], d, x >> (60 - d)))
    return sorted(out)


def test_every_stage_equals_plain_python(spark, folder):
    path, rows, items = folder
    model = train_on(spark.read.parquet(f"{path}/documents.parquet"))
    expected = rows
    plain = [lambda x: identified(model, x), without_copies, lambda x: clean(x, items), mixed]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for (name, stage), brute in zip(corpus_pipeline.STAGES, plain):
        docs = stage(spark, docs, path).cache()
        expected = brute(expected)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert sorted(map(tuple, docs.collect()), key=lambda r: r[0]) == sorted(expected, key=lambda r: r[0]), name
    got = sorted((r.doc_id, r.shard_depth, r.shard_prefix) for r in corpus_pipeline.run(spark, path).collect())
    assert got == sharded(expected)
    assert len({r[0] for r in got} & set(range(200, 210))) == 0
    assert not {400, 401, 402, 500, 501, 502} & {r[0] for r in got}


def test_odd_tables(spark, folder, tmp_path):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    # rows without id, rows that are there twice, and columns that stages have names of their own for
    odd = docs.where("doc_id < 150").selectExpr("nullif(doc_id % 5, 0) * 0 + doc_id as doc_id", "text", "lang", "source", "n_chars", "doc_id as v", "'x' as key", "1 as copy_no", "text as row_")
    spark.createDataFrame(odd.union(odd.where("doc_id % 7 = 1")).collect(), odd.schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path)).cache()
        if name != "sharding":
            assert kept.columns == [c for c in columns if name not in ("mixing", "sharding") or c != "copy_no"], name
        assert {r.text for r in kept.select("text").distinct().collect()} <= {r[1] for r in rows}
        if name == "jaccard_join":
            # one of each text stays, and those without id are among them
            texts = [r.text for r in kept.collect()]
            assert len(texts) == len(set(texts)) and kept.where("doc_id is null").count() > 20
    assert kept.where("doc_id is null").count() > 10
