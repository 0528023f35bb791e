"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import scratch

#: Thai, Lao, Burmese, Khmer, kana and Han, written without spaces: each letter is a word.
SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f"
#: Bytes of rows that go to a Python worker at once, where the session sets no limit of its own.
BATCH_BYTES = "16m"


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes too, as ten thousand rows of long texts may be gigabytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in (None, "-1", "0") or int(re.sub(r"\D", "", spark.conf.get(name)) or 0) >= 64 << 20:
        spark.conf.set(name, BATCH_BYTES)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's scratch folder, which is deleted when the driver ends."""
    return f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_few(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df as the side of a join: broadcast below so many rows of a few numbers each (20 MB or so).

    df should be a written table, as its rows are counted.
    """
    return F.broadcast(df) if df.count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_results(df: DataFrame, results: dict[str, Column]) -> DataFrame:
    """df with result columns; an input column of such a name is replaced."""
    return df.withColumns(results)


def packed(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """All of a row in one struct "row_", beside the named fields.

    Input columns can then have any names without clashing with the
    operator's own.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row_"), *[v.alias(k) for k, v in fields.items()])


def uniform(seed: int, *parts: Column) -> Column:
    """A number of 52 bits from MD5 over seed and parts, scaled to [0, 1)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def sorted_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Cut a stream of batches that is sorted by keys into one frame for each key.

    Holds one group at a time; callers bound the size of a group before.
    """
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        change = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
        change[0] = True
        starts = [*change.nonzero()[0], len(batch)]
        for a, b in zip(starts, starts[1:]):
            part = batch.iloc[a:b]
            key = tuple(part[keys].iloc[0])
            if held and key != last:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
            last = key
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every vertex of edges (a, b); component is its smallest id.

    Alternates large-star and small-star (Kiveris et al., 2014). A vertex with
    many edges is summed map-side and its join is one that Spark can split.
    """
    now = written(edges.select("a", "b").where("a <> b").distinct(), "components")
    sign = None
    for _ in range(max_rounds):
        now = written(_small_star(_large_star(now)), "components")
        found = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if found == sign:
            break
        sign = found
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
