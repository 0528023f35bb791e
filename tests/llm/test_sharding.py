import hashlib
import random
from collections import Counter

import pytest

from semiweave.llm import sharding
from semiweave.llm.sharding import assign_shards, write_shards


def brute(rows, limit):
    """Split oversized buckets on one more bit until each fits or has one hash."""
    h = [int(hashlib.md5(("null" if d is None else str(d)).encode()).hexdigest()[:15], 16) for d, _ in rows]
    out = {}

    def split(members, depth):
        if sum(len((rows[k][1] or "").encode()) for k in members) <= limit or len({h[k] for k in members}) == 1:
            for k in members:
                out[k] = (depth, h[k] >> (60 - depth) if depth else 0)
            return
        for bit in (0, 1):
            split([k for k in members if h[k] >> (59 - depth) & 1 == bit], depth + 1)

    split(range(len(rows)), 0)
    return sorted(((rows[k][0], *out[k]) for k in range(len(rows))), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = [(k, "é" * rng.randrange(0, 80)) for k in range(600)]
    return out + [(1000, "x" * 5000), (1001, None), (None, "abc"), (1002, "")]


@pytest.mark.parametrize("limit", [100, 1000, 10**6])
def test_equals_recursive_splitting(spark, rows, limit, monkeypatch):
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, h_ int, shard_page string").repartition(3)
    got = assign_shards(df, limit)
    assert got.columns == ["doc_id", "text", "h_", "n_bytes", "shard_depth", "shard_prefix", "shard_page"]
    got = got.collect()
    assert sorted(((r.doc_id, r.shard_depth, r.shard_prefix) for r in got), key=str) == brute(rows, limit)
    assert {r.shard_page for r in got} == {0}
    monkeypatch.setattr(sharding, "BROADCAST_ENTRIES", 0)
    assert assign_shards(df, limit).count() == len(rows)


def test_copies_of_one_document_go_to_pages(spark):
    rows = [(1, "x" * 40)] * 500 + [(1, "y" * 90)] * 7 + [(k, "z" * 30) for k in range(2, 200)]
    got = assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 100).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(rows)
    size = Counter()
    for r in got:
        size[(r.shard_depth, r.shard_prefix, r.shard_page)] += r.n_bytes
    assert max(size.values()) <= 100


def test_written_shards(spark, rows, tmp_path):
    path = f"file://{tmp_path}/shards"
    write_shards(assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 1000), path)
    assert spark.read.parquet(path).count() == len(rows)


def test_empty(spark):
    assert assign_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
