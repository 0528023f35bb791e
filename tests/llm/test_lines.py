import random

import pytest

from semiweave.llm import lines
from semiweave.llm.lines import dedup_lines, remove_lines


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def brute(rows, least=5):
    lines = sorted(((doc is None, doc or 0, no), line.split()) for doc, text in rows if text is not None for no, line in enumerate(text.split("\n")))
    out = {}
    for k, (at, words) in enumerate(lines):
        near = lambda w: words == w or len(words) >= least and len(w) >= least and one_edit(words, w)  # noqa: B023, E731
        first = next((other for other, w in lines[:k] if words and other < at and near(w)), None)
        out[(None if at[0] else at[1], at[2])] = (first is None, None if first is None or first[0] else first[1], None if first is None else first[2])
    return out


def got(df):
    return {(r.doc_id, r.line_no): (r.kept, r.first_doc_id, r.first_line_no) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    base = [[rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))] for _ in range(12)] + [[f"w{k}" for k in range(700)]]
    docs = []
    for doc in range(50):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            words = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 2))):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.choice((0, 1))] = [rng.choice("abxyz")] * rng.choice((0, 1))
            lines.append(rng.choice((" ", "  ", "\t")).join(words))
        docs.append((doc, "\n".join(lines)))
    return docs + [(60, None), (61, ""), (62, "\n\n"), (None, docs[3][1]), (63, "a b c d e"), (64, "a b c d x"), (65, "a b c d y")]


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_equals_brute_force(spark, rows, monkeypatch, broadcast):
    """By broadcast joins, and by shuffle joins alone."""
    monkeypatch.setattr(lines, "BROADCAST_ROWS", broadcast)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, k1 string, at int")
    assert got(dedup_lines(df)) == brute(rows)
    if broadcast:
        assert got(dedup_lines(df, min_words=3)) == brute(rows, 3)


def test_short_lines_are_compared_exactly(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["all rights reserved\nhome", "all rights  reserved\nabout", "all rights granted\nhome", "\n\n"])], "doc_id long, text string")
    kept = {(r.doc_id, r.line_no): (r.kept, r.first_doc_id, r.edits) for r in dedup_lines(df).collect()}
    assert {k for k, v in kept.items() if not v[0]} == {(1, 0), (2, 1)}
    assert kept[1, 0] == (False, 0, 0) and kept[2, 1] == (False, 0, 0)


def test_letters_of_scripts_without_blanks_are_words(spark):
    texts = ["这是一个很长的句子没有空格", "这是一个很长的句子没空格", "これはながい文です", "これはながい文でした", "ประโยคยาวไม่มีช่องว่าง", "ประโยคยาวไม่มีช่องวาง", "短い", "短く", "mixed 文 words and 字 here", "mixed 文 words and 空 here", "été à la mer bleue", "été à la mer verte"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.first_doc_id, r.edits) for r in dedup_lines(df).collect() if not r.kept}
    assert found == {1: (0, 1), 5: (4, 1), 9: (8, 1), 11: (10, 1)}


def test_removed_lines(spark):
    df = spark.createDataFrame([(1, "one two three four five\nkept", "k"), (2, "one two three four SIX\nkept", "k"), (None, "x", "k"), (3, None, "k")], "doc_id long, text string, gone string")
    left = {r.doc_id: r.text for r in remove_lines(df.drop("gone"), dedup_lines(df)).collect()}
    assert left == {1: "one two three four five\nkept", 2: "", None: "x", 3: None}


def test_empty(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
