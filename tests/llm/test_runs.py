import random

import numpy as np

from semiweave.llm.runs import SuffixTree, find_runs, repeats, word_runs


def brute(s, copies=2, shortest=2):
    """Every maximal stretch with smallest period q, by looking at each start and period."""
    n, found = len(s), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((a, m, q) for (a, m), q in found.items() if m >= max(shortest, copies * q)), key=lambda r: (r[0], r[2]))


def texts(rng):
    for n in range(9):
        yield [rng.randrange(2) for _ in range(n)]
    for _ in range(400):
        yield [rng.randrange(rng.choice((1, 2, 3, 5))) for _ in range(rng.randrange(1, 60))]
    for _ in range(150):
        word = [rng.randrange(4) for _ in range(rng.randrange(1, 9))]
        yield [rng.randrange(4) for _ in range(rng.randrange(6))] + word * rng.randrange(2, 9) + word[: rng.randrange(len(word))] + [rng.randrange(4) for _ in range(rng.randrange(6))]
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    yield b
    yield [0] * 200


def test_all_runs_equal_brute_force():
    for s in texts(random.Random(5)):
        assert repeats(np.array(s, np.int64)) == brute(s), s


def test_long_runs_equal_brute_force():
    for s in texts(random.Random(6)):
        assert word_runs(np.array(s, np.int64)) == brute(s, 4, 6), s


def test_the_tree_leads_to_every_factor():
    s = np.array([1, 2, 1, 2, 2, 1, 2, 1, 0])
    tree = SuffixTree(s)
    for i in range(len(s) - 1):
        for length in range(1, len(s) - i):
            node = tree.locus(i, length)
            at = {j for j in range(len(s)) if s[j : j + length].tolist() == s[i : i + length].tolist()}
            assert {int(tree.suffixes[r]) for r in range(tree.low[node], tree.high[node] + 1)} == at


def test_rows_of_every_kind(spark):
    rows = [(1, "a b a b a b a b c", 1.5), (1, "a b a b a b a b c", 1.5), (2, None, 0.0), (None, "", 0.0), (3, " \t\n", 0.0), (4, "x x " * 40_000, 0.0), (5, "no run here no run here no run here", 0.0), (6, "A a " * 9, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs double").withColumnRenamed("runs", "collapsed")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in find_runs(df).collect()]
    first = (1, 9, [(0, 8, 2)], "a b c")
    # four copies are needed, and case tells words apart
    want = [first, first, (2, 0, [], ""), (None, 0, [], ""), (3, 0, [], ""), (4, 40_000, [(0, 40_000, 1)], "x x"), (5, 9, [], "no run here no run here no run here"), (6, 18, [(0, 18, 2)], "A a")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert find_runs(df.limit(0)).count() == 0
