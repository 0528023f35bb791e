"""Joins on the inner index of a product: through a mask, in blocks of rows, or spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import settled

#: A product starts from its mask if that joins so many times fewer rows.
MASK_GAIN = 4
#: Heavy indexes of more rows than this, of three numbers each, are joined by shuffle, not broadcast.
FEW = 200_000

#: A list of a row's or a column's entries covers so many indexes at least, and lists of one inner index are so many at most.
LIST_SPAN, LISTS = 1 << 16, 64

_WIDE = "decimal(38,0)"


def joined_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (n): the rows that left (with k) and right (with k) join to, from the counts of each k."""
    x = left.groupBy("k").agg(F.count("*").alias("x"))
    y = right.groupBy("k").agg(F.count("*").alias("y"))
    return x.join(y, "k").agg(F.coalesce(F.sum(F.col("x").cast(_WIDE) * F.col("y")), F.lit(0)).alias("n"))


def mask_first(left: DataFrame, right: DataFrame, at: DataFrame) -> bool:
    """Whether the positions at (i, j) with the rows of left (i, k) that they need are far fewer than the product's terms.

    One job of counts decides; at should be written.
    """
    rows = left.groupBy("i").agg(F.count("*").alias("n"))
    through = at.join(rows, "i").agg(F.coalesce(F.sum(F.col("n").cast(_WIDE)), F.lit(0)).alias("through"))
    found = through.crossJoin(joined_rows(left, right)).first()
    return MASK_GAIN * found["through"] <= found["n"]


def through_mask(left: DataFrame, right: DataFrame, at: DataFrame) -> DataFrame:
    """(i, j, x, y) of the terms at the positions at: left (i, k, x) by i, then right (k, j, y) by both k and j."""
    return at.select("i", "j").join(left, "i").join(right, ["k", "j"]).select("i", "j", "x", "y")


def sent_to_blocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """right (k, ...), a copy for each block at_ of left (at_, k, ...) that has the row's k."""
    return right.join(left.select("at_", "k").distinct(), "k")


def _listed(df: DataFrame, keys: list[str], index: str, value: str, size: int) -> DataFrame:
    """df (keys, index, value) with the entries of the same keys as two lists, of stretches of size indexes, so that none is long."""
    stretch = max(LIST_SPAN, -(-size // LISTS))
    number = F.col(index).cast("int" if size <= 1 << 31 else "long").alias(index)
    lists = df.groupBy(*keys, F.expr(f"{index} div {stretch}").alias("stretch_")).agg(F.collect_list(F.struct(number, value)).alias("l"))
    return lists.select(*keys, F.col(f"l.{index}").alias(f"{index}s"), F.col(f"l.{value}").alias(f"{value}s"))


def in_row_blocks(left: DataFrame, right: DataFrame, nrows: int, ncols: int, blocks: int) -> DataFrame:
    """left (i, k, x) joined to right (k, j, y) on k, with at_, the block of neighbouring rows that i lies in.

    A block is one task. It gets its rows of left, and of right those whose k
    it has, once each; so the terms come to lie where their sums are made (by
    at_, i and j), and no term is shuffled. A row of right goes to as many
    blocks as have its k: few where neighbouring rows share their columns, and
    no more than the terms it has where they don't. The entries of a k travel
    as lists, which take less room and are fewer to sort.
    """
    width = max(1, -(-nrows // blocks))
    # never null, else a test for it keeps one shuffle of a matrix from doing for both sides
    left = left.withColumn("at_", F.coalesce(F.expr(f"cast(i div {width} as int)"), F.lit(0)))
    # the same rows and columns as the lists of left are made of, which share one shuffle
    held = left.groupBy("at_", "k").agg(F.max("i").alias("i"), F.max("x").alias("x")).where("i is not null and x is not null")
    sent = sent_to_blocks(held, _listed(right, ["k"], "j", "y", ncols))
    lists = _listed(left, ["at_", "k"], "i", "x", nrows)
    met = lists.repartitionById(blocks, "at_").join(sent.repartitionById(blocks, "at_"), ["at_", "k"])
    rows = met.select("at_", F.posexplode("is").alias("p", "i"), "xs", "js", "ys").select("at_", F.col("i").cast("long").alias("i"), F.col("xs")[F.col("p")].alias("x"), "js", "ys")
    terms = rows.select("at_", "i", "x", F.posexplode("js").alias("p", "j"), "ys")
    return terms.select("at_", "i", F.col("j").cast("long").alias("j"), "x", F.col("ys")[F.col("p")].alias("y"))


def spread(left: DataFrame, right: DataFrame, rows: int) -> DataFrame:
    """left joined to right on k, such that no task need take more than about rows rows of one k from either side.

    The rows of a k that has more are dealt to parts by a hash, a on the left
    and b on the right; each part meets each of the other side in a grid of a *
    b tasks, for which the left is copied b times and the right a times. A side
    without many rows has one part, so the other is cut and it is copied. One
    job counts the rows of each k on both sides; only the heavy ones are kept.
    """
    x = left.groupBy("k").agg(F.count("*").alias("x")).where(F.col("x") > rows)
    y = right.groupBy("k").agg(F.count("*").alias("y")).where(F.col("y") > rows)
    parts = lambda n: F.greatest(F.ceil(F.coalesce(n, F.lit(0)) / rows), F.lit(1)).cast("int")
    heavy = settled(x.join(y, "k", "full").select("k", parts(F.col("x")).alias("a_"), parts(F.col("y")).alias("b_")))
    few = heavy.count()
    if not few:
        return left.join(right, "k")
    heavy = F.broadcast(heavy) if few <= FEW else heavy

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        columns = [c for c in df.columns if c != "k"]
        with_parts = df.join(heavy, "k", "left").withColumn(f"{own}at_", F.pmod(F.xxhash64(*columns), F.coalesce(f"{own}_", F.lit(1))).cast("int"))
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}_", F.lit(1)) - 1))
        return with_parts.withColumn(f"{other}at_", copies).drop("a_", "b_")

    return dealt(left, "a", "b").join(dealt(right, "b", "a"), ["k", "aat_", "bat_"]).drop("aat_", "bat_")
