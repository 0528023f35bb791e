"""Spelling variants: words one edit apart, by an even-partition pigeonhole join."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# Fixed value: the letters that words are made of.
LETTERS = "[A-Za-zÀ-ÿ]"


def word_runs(docs: DataFrame, min_length: int = 7) -> DataFrame:
    """(doc_id, word): each maximal run of at least min_length LETTERS of the whole texts, A to Z in lower case.

    A null or empty text has none; a text is read in one row however long.
    """
    found = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{LETTERS}{{{min_length},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run_")).select("doc_id", F.translate("run_", string.ascii_uppercase, string.ascii_lowercase).alias("word"))


def count_words(words: DataFrame, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n) of the words with at least min_length code points and min_count occurrences; null words don't count."""
    counted = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _keys(length: Column, longer: int) -> Column:
    """Hashed keys of the column word where words of length code points are indexed.

    An indexed word has two segments, length div 2 code points and the rest. One
    edit leaves one of them as it was, in its place or, behind an insertion, one
    to the right. The edit lies in the other segment, of which one half is as it
    was for the same reason; so a bucket is one segment with one half of the
    other, which keeps buckets of frequent beginnings and endings small. longer
    (0 or 1) is how much longer than an indexed word the probing one is.
    """
    first = F.floor(length / 2).cast("int")
    rest = length - first
    at = lambda start, size: F.substring(F.col("word"), start, size)
    half = lambda size: F.floor(size / 2).cast("int")
    key = lambda kind, *parts: F.xxhash64(F.lit(kind), length, *parts)
    front, back = at(F.lit(1), first), at(first + longer + 1, rest)
    behind, before = half(rest), half(first)
    return F.array(
        key(0, front, at(first + 1, behind)),
        key(1, front, at(length + longer - (rest - behind) + 1, rest - behind)),
        key(2, back, at(F.lit(1), before)),
        key(3, back, at(first + longer - (first - before) + 1, first - before)),
    )


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words (word, n), which are distinct, that one inserted, deleted or replaced code point parts, once.

    Words are indexed by their segments and probed by words of equal length and
    one longer. A pair that meets in several buckets is verified in each and
    kept once. Buckets are joined, not gathered, so Spark may split a large one.
    """
    length = F.length("word")
    own = words.select("word", "n", F.explode(_keys(length, 0)).alias("key"))
    longer = words.select("word", "n", F.explode(_keys(length - 1, 1)).alias("key"))
    probes = own.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.lit(False).alias("longer")).union(longer.select("key", "word", "n", F.lit(True)))
    index = own.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    once = F.when(F.col("longer"), F.length("b") == F.length("a") + 1).otherwise((F.col("a") < F.col("b")) & (F.length("a") == F.length("b")))
    one_edit = F.levenshtein("a", "b", 1) == 1
    return index.join(probes, "key").where(once & one_edit).select("a", "a_n", "b", "b_n").distinct()


def group_spellings(words: DataFrame, ratio: int = 10) -> DataFrame:
    """The form that each of the distinct words (word, n) is a variant of.

    A word's form is its near word (see near_words) of largest n, of these the
    smallest in code-point order, if that n is at least ratio times the word's
    own; else null. Returns word, form, root (the end of the chain of forms, the
    word itself without one), n, n_near (near words), form_n. As n grows by
    ratio with every form a chain is short, and pointers that double its steps
    end in a few rounds. Words of any length may be given; an empty table gives
    an empty one, null words and words with a null n are left out, columns
    other than word and n are ignored.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its variant")
    words = written(words.where("word is not null and n is not null").select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))))
    best = near_words(words).select(sides.alias("s")).groupBy("s.word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("s.other_n")).alias("less"), F.col("s.other").alias("other"))).alias("best"))
    found = words.join(best, "word", "left")
    has = -F.col("best.less") >= ratio * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"))
    found = written(found, "spelling-forms")
    roots = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
