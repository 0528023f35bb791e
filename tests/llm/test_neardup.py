import numpy as np
import pytest

from semiweave.llm import neardup
from semiweave.llm.neardup import near_duplicates


def brute(rows, threshold=0.93):
    good = [k for k, (_, x, label) in enumerate(rows) if label is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    group, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for n, a in enumerate(good):
        for b in good[:n]:
            x, y = (np.array(rows[k][1], dtype=np.float32).astype(float) for k in (a, b))
            if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                links[a] += 1
                links[b] += 1
                group[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return sorted(((r[0], links[k], least.get(find(k)), r[0] == least.get(find(k))) for k, r in enumerate(rows)), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out, vec = [], 0
    for label, sizes in ((1, [1] * 150 + [2] * 15 + [3] * 5 + [160]), (2, [1] * 40 + [2] * 6), (3, [2])):
        for size in sizes:
            centre = rng.normal(size=24)
            for _ in range(size):
                out.append((vec, (centre + rng.normal(size=24) * 0.16 * rng.random()).astype(np.float32).tolist(), label))
                vec += int(rng.integers(1, 3))
    walk = rng.normal(size=24)
    for _ in range(25):
        out.append((vec, walk.astype(np.float32).tolist(), 2))
        walk = walk + rng.normal(size=24) * 0.25
        vec += 1
    x = out[0][1]
    out += [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 24, 1), (9003, [None, *x[1:]], 1), (9004, [float("nan"), *x[1:]], 1), (9005, [float("inf"), *x[1:]], 1)]
    out += [(9006, x, None), (9007, x, 1), (9007, x, 1), (9008, [2 * v for v in x], 1), (9009, x, 77), (9010, x[:5], 1), (9011, x[:5], 1), (None, x, 1), (None, [0.0], 1)]
    rng.shuffle(out)
    return [(None if v is None else int(v), x, None if c is None else int(c)) for v, x, c in out]


def test_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 40)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, v int").repartition(4)
    got = near_duplicates(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.vec_id is not None and r.kept) for r in got), key=str) == sorted(((a, b, c, bool(a is not None and d)) for a, b, c, d in brute(rows)), key=str)
    assert all(r.kept is not None for r in got)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_clumps_that_fill_their_lists_are_linked(spark):
    rng = np.random.default_rng(3)
    a, b, c = np.linalg.qr(rng.normal(size=(64, 3)))[0].T
    centres = (a, 0.94 * a + np.sqrt(1 - 0.94**2) * b, c)
    rows = [(20 * k + m, (x + rng.normal(size=64) * 0.001).tolist(), 1) for k, x in enumerate(centres) for m in range(20)]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(v, 39, 0) for v in range(40)} | {(v, 19, 40) for v in range(40, 60)}


def test_lost_pairs_fail_the_audit(spark, monkeypatch):
    rng = np.random.default_rng(4)
    big, small = rng.normal(size=(2, 16))
    rows = [(v, (x + rng.normal(size=16) * 0.001).tolist(), label) for v, (x, label) in enumerate([(big, 1)] * 60 + [(small, 2)] * 2)]
    seeds = neardup._seeds
    monkeypatch.setattr(neardup, "_seeds", lambda nodes, seed: seeds(nodes.where("label = 1"), seed))
    with pytest.raises(RuntimeError):
        near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), max_rounds=1)


def test_one_lost_pair_among_many_vectors_fails_the_audit(spark, monkeypatch):
    rng = np.random.default_rng(5)
    one = rng.normal(size=16)
    rows = [(v, rng.normal(size=16).tolist(), 1) for v in range(1500)] + [(1500 + k, (one + rng.normal(size=16) * 0.001).tolist(), 2) for k in range(2)]
    seeds = neardup._seeds
    monkeypatch.setattr(neardup, "_seeds", lambda nodes, seed: seeds(nodes.where("label = 1"), seed))
    monkeypatch.setattr(neardup, "AUDIT", 32)
    with pytest.raises(RuntimeError):
        near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), threshold=0.99, max_rounds=1)


def test_groups_over_several_batches():
    import pyarrow as pa

    from semiweave.llm.neardup import _groups

    def batch(keys, vectors):
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(vectors, type=pa.list_(pa.float64()))], names=["g", "vec"])

    # groups end with a batch, go on over three of them, and have vectors of their own length
    batches = [batch([1, 1, 2], [[1.0], [2.0], [3.0, 4.0]]), batch([], []), batch([2], [[5.0, 6.0]]), batch([9, 2, 3, 9], [[0.0], [7.0, 8.0], [9.0], [0.0]]).slice(1, 2)]
    found = [(group["g"].tolist(), x.tolist()) for group, x in _groups(iter(batches), ["g"])]
    assert found == [([1, 1], [[1.0], [2.0]]), ([2, 2, 2], [[3.0, 4.0], [5.0, 6.0], [7.0, 8.0]]), ([3], [[9.0]])]
    assert list(_groups(iter([]), ["g"])) == []
