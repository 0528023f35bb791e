import random

import pytest

from semiweave.llm.spelling import count_words, group_spellings, near_words, word_runs


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def words_of(rng, count, letters, low=1, high=12):
    found = set()
    while len(found) < count:
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(low, high)))
        found.add(w)
        k = rng.randrange(len(w) + 1)
        found.add(rng.choice((w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :])) or w)
    return sorted(found)


@pytest.mark.parametrize("letters", ["ab", "abcdeé", "xyzÀÿ÷"])
def test_groups_equal_brute_force(spark, letters):
    rng = random.Random(letters)
    words = {w: rng.choice((2, 3, 20, 20, 30, 300, 5000)) for w in words_of(rng, 300, letters)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = sorted((a, b) if a < b else (b, a) for a, _, b, _ in near_words(df).collect())
    assert pairs == sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))
    form = {}
    for w, n in words.items():
        near = sorted((-m, v) for v, m in words.items() if one_edit(v, w))
        form[w] = (len(near), near[0][1] if near and -near[0][0] >= 10 * n else None)

    def root(w):
        return root(form[w][1]) if form[w][1] else w

    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in group_spellings(df).collect()}
    assert got == {w: (form[w][1], root(w), n, form[w][0], words.get(form[w][1])) for w, n in words.items()}


def test_chains_and_ties(spark):
    rows = [("abcdefg", 2), ("abcdefgh", 20), ("abcdefghi", 200), ("abcdefghij", 2000), ("bbcdefg", 20), ("zzzzzzz", 5)]
    got = {r.word: (r.form, r.root, r.n_near) for r in group_spellings(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got["abcdefg"] == ("abcdefgh", "abcdefghij", 2) and got["zzzzzzz"] == (None, "zzzzzzz", 0) and got["bbcdefg"] == (None, "bbcdefg", 1)


def test_rows_of_every_kind(spark):
    rows = [(1, "Überall ÜBERALL xyÿ×÷àñ", "u"), (1, "Überall ÜBERALL xyÿ×÷àñ", "u"), (2, None, None), (None, "", "v"), (None, "Überall", "w"), (3, "longword " * 20_000 + "a" * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    counts = {r.word: r.n for r in count_words(word_runs(df)).collect()}
    # only A to Z get small
    assert counts == {"Überall": 5, "xyÿ×÷àñ": 2, "longword": 20_000}
    assert word_runs(df.limit(0)).count() == 0 and count_words(word_runs(df.limit(0))).count() == 0
    assert group_spellings(spark.createDataFrame([], "word string, n long")).count() == 0
    odd = spark.createDataFrame([("abcdefg", 2, "f"), (None, 3, "f"), ("abcdefgh", None, "f"), ("", 5, "f"), ("a", 7, "f")], "word string, n long, form string")
    assert sorted((r.word, r.n_near) for r in group_spellings(odd).collect()) == [("", 1), ("a", 1), ("abcdefg", 0)]
