"""Line dedup by a deletion-neighbourhood join, with SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACELESS, written

BLANKS = "\t\r\f\x0b\xa0"
#: Tables of more rows than this, of a few numbers each (20 MB or so), are joined by shuffle, not broadcast.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame) -> DataFrame:
    """df for a join: broadcast if its rows, a few numbers each, are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line_no", "line"))


def _words() -> Column:
    # few lines hold any letter behind those of the scripts with blanks, which one look tells
    others = (F.octet_length("line") > F.length("line")) & F.col("line").rlike("[\u0e00-\U0010ffff]")
    spaced = F.when(others, F.regexp_replace("line", f"([{SPACELESS}])", " $1 ")).otherwise(F.col("line"))
    return F.array_remove(F.split(F.translate(spaced, BLANKS, " " * len(BLANKS)), " "), "")


def _line_keys() -> list[Column]:
    """k1 and k2: two hashes of 64 bits that stand for a line's words."""
    return [F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(7), F.col("words")).alias("k2")]


def _halves() -> Column:
    """Keys of a line's first and last words, about half of it each.

    One edit leaves the first or the last half as it was. Of lines with n and
    n + 1 words these are floor(n / 2) words, so a line has keys of floor(n / 2)
    and of floor((n - 1) / 2) words, which for odd n are the same. The lowest
    bit of a key tells the first half (1) from the last (0).
    """
    n, words = F.col("n"), F.col("words")

    def keys(m: Column) -> list[Column]:
        front, back = F.xxhash64(m, F.slice(words, F.lit(1), m)), F.xxhash64(m, F.slice(words, n - m + 1, m))
        return [front.bitwiseOR(F.lit(1)), back.bitwiseAND(F.lit(-2))]

    m = F.expr("n div 2").cast("int")
    return F.when(n % 2 == 0, F.array(*keys(m), *keys(m - 1))).otherwise(F.array(*keys(m)))


def _variants() -> Column:
    """Keys of a line and of what is left when one word is deleted.

    a and b hash each word with its place and with the place before, d is
    a XOR b. What is left of a deletion at p hashes to the XOR of a before p
    and of b behind it. Running XORs of d come in two levels, chunks of about
    sqrt(n) words and words within a chunk. Kind 0 is the whole line, 1 a
    deletion (equal to a whole line of one word less), 2 a deletion with its
    place (equal among lines that differ in that word alone). Only deletions
    in the half that a partner may differ in are made.
    """
    part = "cast(ceil(sqrt(n)) as int)"
    return F.expr(
        f"""
        concat(
          array(struct(0 as kind, xxhash64(2, n, ta) as key)),
          flatten(transform(sequence(if(front, 0, (n - 1) div 2), if(back, n - 1, n - 1 - (n - 1) div 2)), p -> array(
            struct(1 as kind, xxhash64(2, n - 1, tb ^ b[cast(p as int)] ^ chunks[cast(p div {part} as int)]
              ^ aggregate(slice(d, cast(p div {part} as int) * {part} + 1, cast(p % {part} as int)), 0L, (x, y) -> x ^ y)) as key),
            struct(2 as kind, xxhash64(3, n, p, ta ^ a[cast(p as int)]) as key))))
        )"""
    )


def _hashed(lines: DataFrame) -> DataFrame:
    xor = "0L, (x, y) -> x ^ y"
    part = "cast(ceil(sqrt(n)) as int)"
    return (
        lines.withColumn("a", F.expr("transform(words, (w, i) -> xxhash64(w, i))"))
        .withColumn("b", F.expr("transform(words, (w, i) -> xxhash64(w, i - 1))"))
        .withColumn("d", F.expr("zip_with(a, b, (x, y) -> x ^ y)"))
        .withColumn("ta", F.expr(f"aggregate(a, {xor})"))
        .withColumn("tb", F.expr(f"aggregate(b, {xor})"))
        .withColumn("sums", F.expr(f"transform(sequence(0, (n - 1) div {part}), c -> aggregate(slice(d, cast(c as int) * {part} + 1, {part}), {xor}))"))
        .withColumn("chunks", F.expr(f"transform(sequence(0, (n - 1) div {part}), c -> aggregate(slice(sums, 1, cast(c as int)), {xor}))"))
    )


def _one_edit(a: str, b: str) -> tuple[Column, Column]:
    """The length of the common start (to be named same_) of word lists a and b,
    and whether they differ in one word, or one has a word more."""
    same = F.expr(f"coalesce(nullif(array_position(zip_with({a}, {b}, (x, y) -> x <=> y), false), 0) - 1, least(size({a}), size({b})))").cast("int")
    rest = lambda c, skip: F.slice(F.col(c), F.col("same_") + 1 + skip, F.greatest(F.size(c) - F.col("same_") - skip, F.lit(0)))
    equal = F.when(F.size(a) == F.size(b), rest(a, 1) == rest(b, 1)).when(F.size(a) < F.size(b), rest(a, 0) == rest(b, 1)).otherwise(rest(a, 1) == rest(b, 0))
    return same, equal


def dedup_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """Which lines of (doc_id, text) repeat an earlier one within one word edit.

    Lines are cut at newlines into words at blanks, and each letter of scripts
    that are written without them (SPACELESS) is a word; an edit inserts, deletes
    or replaces a word. Order is by (doc_id, line_no). A line is kept if no
    earlier line equals it or, for lines of min_words words and more, is one
    edit away from it; of a shorter line an edit leaves so little that it
    would not be a copy, so these are compared exactly. Equal lines become one
    line with its earliest place. Of these, lines with a half in common with
    another emit their variants with one word deleted, as hashed keys; a key's
    earliest line, taken by aggregation and not by pairs, is the candidate for
    all others, and the pair's words are compared.

    Returns doc_id, line_no (from 0), kept, first_doc_id, first_line_no and
    edits (0 or 1) for every line; the last three are null for kept lines and
    else name the earliest line within the bound. Blank lines are always kept.
    A null text has no lines, an empty text one
    blank line. A null doc_id comes after all others. Rows of one doc_id are
    one document: lines in one place of it are not repeats of each other. Any
    other columns are ignored.
    """
    lines = _texts(docs).withColumn("words", _words()).withColumn("n", F.size("words"))
    usable, worded = F.col("n") >= min_words, F.col("n") > 0
    lines = lines.select("doc_id", "line_no", "n", *[F.when(worded, k).alias(k_name) for k, k_name in zip(_line_keys(), ("k1", "k2"))], F.when(usable, _halves()).alias("halves"))
    lines = written(lines, "lines")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")
    unique = lines.where(worded).groupBy("k1", "k2").agg(F.min(place).alias("at"), F.count("*").alias("times"))
    unique = written(unique, "lines-unique")

    halves = lines.where(usable).select("k1", "k2", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("half")
    shared = written(shared, "lines-shared")
    # a front in common leaves the edit to the back, and the other way round
    front = F.col("half").bitwiseAND(F.lit(1)) == 1
    flagged = halves.join(_small(shared), "half").groupBy("k1", "k2").agg(F.bool_or(front).alias("back"), F.bool_or(~front).alias("front"))
    flagged = written(unique.select("k1", "k2", "at").join(flagged, ["k1", "k2"]), "lines-flagged")
    few = flagged.count() <= BROADCAST_ROWS
    texts_of = docs.join(F.broadcast(flagged.select(F.col("at.doc_id").alias("at_doc")).distinct()), F.col("doc_id").eqNullSafe(F.col("at_doc")), "left_semi") if few else docs
    wanted = _small(flagged.select("k1", "k2", "front", "back", "at", F.col("at.doc_id").alias("at_doc"), F.col("at.line_no").alias("at_line")))
    own = _texts(texts_of).join(wanted, F.col("doc_id").eqNullSafe(F.col("at_doc")) & (F.col("line_no") == F.col("at_line")))
    own = own.withColumn("words", _words()).withColumn("n", F.size("words")).withColumns(dict(zip(("l1", "l2"), _line_keys()))).where("l1 = k1 and l2 = k2")
    texts = written(own.select("k1", "k2", "at", "n", "words", "front", "back"), "lines-texts")

    keys = _hashed(texts).select("k1", "k2", "at", F.explode(_variants()).alias("v")).select("k1", "k2", "at", "v.kind", "v.key")
    twice = written(keys.groupBy("key").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("key"), "lines-variants")
    keys = written(keys.join(_small(twice), "key"), "lines-variants")
    who = F.struct("at", "k1", "k2")
    heads = keys.groupBy("key").agg(*[F.min(F.when(F.col("kind") == k, who)).alias(f"head{k}") for k in (0, 1, 2)])
    head = F.when(F.col("kind") == 0, F.col("head1")).when(F.col("kind") == 1, F.col("head0")).otherwise(F.col("head2"))
    pairs = keys.join(heads, "key").withColumn("head", head).where("head.at < at").select("k1", "k2", F.col("head.k1").alias("h1"), F.col("head.k2").alias("h2"), F.col("head.at").alias("head_at")).distinct()
    words = texts.select(F.col("k1").alias("w1"), F.col("k2").alias("w2"), "words")
    both = pairs.join(words.withColumnRenamed("words", "own"), (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))).drop("w1", "w2")
    both = both.join(words.withColumnRenamed("words", "others"), (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2")))
    same, equal = _one_edit("own", "others")
    near = written(both.withColumn("same_", same).where(equal).groupBy("k1", "k2").agg(F.min("head_at").alias("near")), "lines-near")

    firsts = unique.join(near, ["k1", "k2"], "left").where("times > 1 or near is not null")
    firsts = firsts.select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), F.least("at", F.coalesce("near", "at")).alias("first"), F.col("at").alias("exact"))
    out = lines.select("doc_id", "line_no", "k1", "k2").join(firsts, (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")), "left")
    repeat = F.coalesce(F.col("first") < place, F.lit(False))
    return out.select(
        "doc_id", "line_no", (~repeat).alias("kept"), F.when(repeat, F.col("first.doc_id")).alias("first_doc_id"), F.when(repeat, F.col("first.line_no")).alias("first_line_no"),
        F.when(repeat, F.when(F.col("first") == F.col("exact"), 0).otherwise(1)).alias("edits"),
    )


def remove_lines(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """docs without the lines that dedup_lines dropped.

    All rows and columns stay; a document whose lines are all dropped gets an
    empty text. Rows without doc_id keep their text.
    """
    gone = decisions.where("not kept and doc_id is not null").groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_set("line_no").alias("gone"))
    left = F.expr("filter(split(text, '\\n'), (l, i) -> not array_contains(gone, i))")
    joined = docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left")
    return joined.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))).drop("gone_id", "gone")
