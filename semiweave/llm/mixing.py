"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, uniform, written

#: Numbers of all sources' distributions that are broadcast at most (16 MB); more are joined through salted keys.
BROADCAST_NUMBERS = 2_000_000
SALTS = 64


@F.pandas_udf(T.StructType([T.StructField("least", T.LongType()), T.StructField("cdf", T.ArrayType(T.DoubleType()))]))
def _poisson_cdf(rate: pd.Series) -> pd.DataFrame:
    """The cumulative distribution over the counts that 52 bits can tell apart."""
    rows = []
    for r in rate:
        if not r or r <= 0 or r != r:
            rows.append((0, [1.0]))
            continue
        reach = 9 * math.sqrt(r) + 40
        low, high = max(0, int(r - reach)), int(r + reach)
        k = np.arange(low, high + 1)
        log_factorial = np.array([math.lgamma(x + 1.0) for x in k])
        rows.append((low, np.cumsum(np.exp(k * math.log(r) - r - log_factorial)).tolist()))
    return pd.DataFrame(rows, columns=["least", "cdf"])


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None, alpha: float, repeat: float) -> DataFrame:
    """(source, rate): how often a document of each source is repeated on average.

    A source's size is its number of characters over all documents. With
    weights, source s gets weights[s] of the output (sources not named get
    nothing, and if none that is named has documents, none gets anything);
    without, it gets size^alpha divided by the sum of these. The
    output has repeat times the characters of the input on average. A source
    without any characters keeps rate 1 when weights are derived.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).cast("double").alias("size"))
    if weights is None:
        sizes = sizes.withColumn("share", F.when(F.col("size") > 0, F.pow("size", F.lit(float(alpha)))).otherwise(0.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, share double")
        sizes = sizes.join(given.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")), "left").select("source", "size", F.coalesce("share", F.lit(0.0)).alias("share"))
    sizes = written(sizes, "mix-sizes")
    whole = sizes.agg(F.sum("size").alias("all_size"), F.sum("share").alias("all_share"))
    # where no named source has a document, nothing has a share
    rate = F.when(F.col("all_share") > 0, F.col("share") / F.col("all_share") * F.col("all_size") * F.lit(float(repeat)) / F.col("size")).otherwise(0.0)
    empty = F.lit(1.0) if weights is None else F.when(F.col("share") > 0, 1.0).otherwise(0.0)
    return sizes.crossJoin(F.broadcast(whole)).select("source", F.when(F.col("size") > 0, rate).otherwise(empty).alias("rate"))


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, *, alpha: float = 0.7, repeat: float = 1.0, seed: int = 17, shuffle: bool = True) -> DataFrame:
    """Repeat or drop documents so that each source gets its share, then shuffle.

    Each document's count is the inverse Poisson distribution, with its
    source's rate as mean, at a uniform number hashed from (seed, doc_id). The
    document is exploded by the count, and rows are dealt to partitions and
    sorted by a hash of (seed, doc_id, copy_no).

    Returns docs' columns and copy_no (int, from 1). A null source is a source
    of its own; null text counts as no characters; rows with one doc_id get one
    count, and of rows without one those of one text, whose MD5 stands for it; an input column copy_no is
    replaced; an empty table gives an empty table. Only the table of sources
    is broadcast, and only below BROADCAST_NUMBERS numbers; past that the join is
    salted, since one source may hold a third of all rows.
    """
    keyed = docs.select("source", "text")
    rates = source_rates(keyed, weights, alpha, repeat)
    rates = written(rates.select(F.col("source").alias("rate_source"), _poisson_cdf("rate").alias("p")).select("rate_source", "p.least", "p.cdf"), "mix-rates")
    # rows without id are told apart by their texts
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    rows = packed(docs, {"source_": F.col("source"), "u_": uniform(seed, own), "id_": own})
    same = F.col("source_").eqNullSafe(F.col("rate_source"))
    # a source's distribution has about 18 * sqrt(rate) + 80 numbers
    if (rates.agg(F.sum(F.size("cdf") + 10)).first()[0] or 0) <= BROADCAST_NUMBERS:
        joined = rows.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt_", F.pmod(F.xxhash64("id_"), F.lit(SALTS))).join(salted, same & (F.col("salt_") == F.col("salt")))
    count = (F.col("least") + F.size(F.filter("cdf", lambda c: c <= F.col("u_")))).cast("int")
    copies = joined.withColumn("n_", count).where("n_ > 0").select("row_", "id_", F.explode(F.sequence(F.lit(1), F.col("n_"))).alias("copy_no"))
    if shuffle:
        copies = copies.withColumn("at_", F.xxhash64(F.lit(seed), "id_", "copy_no")).repartition("at_").sortWithinPartitions("at_")
    names = [c for c in docs.columns if c != "copy_no"]
    return copies.select(*[F.col("row_").getField(c).alias(c) for c in names], "copy_no")
