import hashlib
import math

import pytest
from pyspark.sql import functions as F

from semiweave.llm import mixing
from semiweave.llm.mixing import mix_sources


def brute(rows, weights=None, alpha=0.7, repeat=1.0, seed=17):
    size = {}
    for _, text, source in rows:
        size[source] = size.get(source, 0) + len(text or "")
    whole = sum(size.values())
    share = {s: (weights.get(s, 0.0) if weights is not None else n**alpha if n else 0.0) for s, n in size.items()}
    total, out = sum(share.values()), []
    for doc, text, source in rows:
        n = size[source]
        rate = share[source] / total * whole * repeat / n if n else (1.0 if weights is None or share[source] else 0.0)
        own = f"null:{hashlib.md5((text or '').encode()).hexdigest()}" if doc is None else doc
        u = int(hashlib.md5(f"{seed}:{own}".encode()).hexdigest()[:13], 16) / 2**52
        k, log, c = 0, -rate, math.exp(-rate)
        while c <= u:
            k += 1
            log += math.log(rate / k)
            c += math.exp(log)
        out += [(doc, text, source, j + 1) for j in range(k)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    out = [(k, "x" * (k % 90), f"s{k % 3 * (k % 2)}") for k in range(400)]
    return out + [(500, None, "s0"), (501, "", "empty"), (502, "text", None), (None, "text", "s1"), (7, "again", "s1"), (7, "again", "s1"), (503, "y" * 10, "rare")]


@pytest.mark.parametrize("options", [{}, {"repeat": 2.5, "seed": 3}, {"weights": {"s0": 0.2, "rare": 0.7, None: 0.1, "missing": 1.0}}])
def test_equals_plain_inversion(spark, rows, options, monkeypatch):
    df = spark.createDataFrame([(*r, "k", 0.5) for r in rows], "doc_id long, text string, source string, copy_no string, rate double")
    got = sorted(((r.doc_id, r.text, r.source, r.copy_no) for r in mix_sources(df, **options).collect()), key=str)
    assert got == brute(rows, **options)
    monkeypatch.setattr(mixing, "BROADCAST_NUMBERS", 0)
    assert mix_sources(df, **options).count() == len(got)


def test_large_rates_keep_their_mean(spark):
    df = spark.createDataFrame([(k, "x", "small" if k < 40 else "large") for k in range(40040)], "doc_id long, text string, source string")
    counts = {r.source: r["count"] for r in mix_sources(df, {"small": 0.9, "large": 0.1}).groupBy("source").count().collect()}
    assert abs(counts["small"] / 40040 - 0.9) < 0.02 and abs(counts["large"] / 40040 - 0.1) < 0.02


def test_shuffled_and_empty(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    order = [r.doc_id for r in mix_sources(df).collect() if r.doc_id is not None]
    assert order != sorted(order)
    assert mix_sources(df.limit(0)).count() == 0


def test_weights_that_name_no_source(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mix_sources(df, {"elsewhere": 1.0}).count() == 0
    assert mix_sources(df, {"s0": 0.0}).count() == 0


def test_rows_without_id_have_counts_of_their_own(spark):
    df = spark.createDataFrame([(None, f"text {k}", "s") for k in range(1000)], "doc_id long, text string, source string")
    for seed in (1, 2, 3, 17):
        mixed = mix_sources(df, seed=seed).persist()
        assert 850 < mixed.count() < 1150 and 550 < mixed.select("text").distinct().count() < 720
        parts = [r["count"] for r in mixed.groupBy(F.spark_partition_id()).count().collect()]
        assert len(parts) > 1 and max(parts) < 700
        mixed.unpersist()
