"""Sharding by extendible hashing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, written

#: Bits of the hash. Beyond them rows of one key go to overflow pages.
BITS = 60
#: A directory of more entries than this is joined by shuffle, not broadcast.
BROADCAST_ENTRIES = 200_000


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, BITS - depth)


def _directory(cells: DataFrame, top: int, bottom: int, max_bytes: int) -> DataFrame:
    """(cell, depth): the shallowest prefix of each cell of bottom bits that fits.

    A bucket fits with at most max_bytes, or with a single hash, which no bit
    can split. depth is null where no prefix up to bottom bits does.
    """
    each = cells.select("cell", "bytes", "low", "high", F.explode(F.sequence(F.lit(top), F.lit(bottom))).alias("d"))
    each = each.withColumn("prefix", F.expr(f"cell div cast(pow(2, {bottom} - d) as bigint)"))
    fits = each.groupBy("d", "prefix").agg(F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
    fits = fits.where((F.col("bytes") <= max_bytes) | (F.col("low") == F.col("high"))).select("d", "prefix")
    found = each.select("cell", "d", "prefix").join(fits, ["d", "prefix"]).groupBy("cell").agg(F.min("d").alias("depth"))
    return cells.select("cell").join(found, "cell", "left")


def _overflow_pages(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Number the pages of buckets that hold one hash only and yet are too large.

    A running sum in two steps (within parts of the input, then over the
    parts), so no task gets a whole bucket. Rows over half the limit get a page
    each; the others share pages that start every half limit and so fit.
    """
    rows = written(rows.withColumn("seq_", F.monotonically_increasing_id()), "shard-overflow")
    rows = rows.withColumn("large_", F.col("bytes_") * 2 > max_bytes).withColumn("part_", F.shiftright("seq_", 12))
    unit = F.when(F.col("large_"), F.lit(1)).otherwise(F.col("bytes_"))
    rows = rows.withColumn("unit_", unit.cast("long"))
    parts = rows.groupBy("h_", "large_", "part_").agg(F.sum("unit_").alias("sum_"))
    before = Window.partitionBy("h_", "large_").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset_", F.coalesce(F.sum("sum_").over(before), F.lit(0))).drop("sum_")
    within = Window.partitionBy("h_", "large_", "part_").orderBy("seq_").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within_", F.coalesce(F.sum("unit_").over(within), F.lit(0))).join(parts, ["h_", "large_", "part_"])
    start = F.col("offset_") + F.col("within_")
    half = max(1, max_bytes // 2)
    page = F.when(F.col("large_"), start * 2 + 1).otherwise(F.floor(start / half) * 2)
    return rows.select("row_", "bytes_", "h_", "depth_", page.cast("long").alias("page_"))


def assign_shards(docs: DataFrame, max_bytes: int = 1 << 20) -> DataFrame:
    """Give each row its shard by extendible hashing on doc_id.

    A bucket is a prefix of the hash; only a bucket of more than max_bytes of
    text (UTF-8) splits on the next bit, until each fits. The directory comes
    from byte counts by cell, a cell being a prefix a few bits longer than the
    mean shard needs; cells that are still too large are counted again with
    more bits, and nothing else is. A document larger than the limit has a
    shard to itself. Rows of one doc_id that are too many for a shard, which no
    bit can part, go to numbered overflow pages of it.

    Returns docs' columns with n_bytes (long), shard_depth (int), shard_prefix
    (long) and shard_page (long, 0 without overflow); input columns of these
    names are replaced. Null text has 0 bytes; a null doc_id hashes as "null";
    an empty table gives an empty table.
    """
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = packed(docs, {"h_": h, "bytes_": size})
    counted = docs.select(h.alias("h"), size.alias("bytes"))
    total = counted.agg(F.sum("bytes")).first()[0] or 0
    bottom = min(BITS, max(0, math.ceil(math.log2(max(1, total) / max_bytes))) + 6)
    done: DataFrame | None = None
    top, left, chained = 0, rows, False
    while True:
        cells = counted.groupBy(_prefix(F.col("h"), bottom).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
        cells = written(cells, "shard-cells")
        entries = written(_directory(cells, top, bottom, max_bytes).join(cells.select("cell", (F.col("bytes") > max_bytes).alias("over"), "n", "low", "high"), "cell"), "shard-directory")
        chain = F.col("over") & (F.col("n") > 1) & (F.col("low") == F.col("high"))
        many, deep, chains = entries.agg(F.count("*"), F.count(F.when(F.col("depth").isNull(), 1)), F.count(F.when(chain, 1))).first()
        chained = chained or chains > 0
        found = left.withColumn("cell", _prefix(F.col("h_"), bottom)).join(F.broadcast(entries) if many <= BROADCAST_ENTRIES else entries, "cell")
        # a bucket of one hash: too large, and of several rows
        found = found.withColumn("chain_", chain)
        here = found.where("depth is not null").select("row_", "bytes_", "h_", F.col("depth").alias("depth_"), "chain_")
        done = here if done is None else done.union(here)
        if not deep or bottom >= BITS:
            break
        left = found.where("depth is null").select("row_", "h_", "bytes_")
        counted = left.select(F.col("h_").alias("h"), F.col("bytes_").alias("bytes"))
        top, bottom = bottom, min(BITS, bottom + 6)
    plain = done.where("not chain_").select("row_", "bytes_", "h_", "depth_", F.lit(0).cast("long").alias("page_"))
    out = plain.union(_overflow_pages(done.where("chain_").drop("chain_"), max_bytes)) if chained else plain
    own = {"n_bytes", "shard_depth", "shard_prefix", "shard_page"}
    return out.select(
        *[F.col("row_").getField(c).alias(c) for c in docs.columns if c not in own],
        F.col("bytes_").alias("n_bytes"), F.col("depth_").cast("int").alias("shard_depth"),
        F.expr(f"case when depth_ = 0 then 0L else shiftrightunsigned(h_, {BITS} - depth_) end").alias("shard_prefix"),
        F.col("page_").alias("shard_page"),
    )


def write_shards(assigned: DataFrame, path: str) -> None:
    """Write each shard's rows together, in doc_id order, under path."""
    at = ["shard_depth", "shard_prefix", "shard_page"]
    assigned.repartition(*at).sortWithinPartitions(*at, "doc_id").write.partitionBy(*at).parquet(path)
