"""Graphs: generators, and matrices of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.containers import Matrix, Vector
from ..plans.relations import Relation


def chain(spark: SparkSession, n: int) -> Matrix:
    """0 -> 1 -> ... -> n - 1."""
    return _arith(spark, n, n - 1, F.col("id") + 1)


def cycle(spark: SparkSession, n: int) -> Matrix:
    return _arith(spark, n, n, (F.col("id") + 1) % n)


def star(spark: SparkSession, n: int) -> Matrix:
    """0 to each other vertex."""
    edges = spark.range(1, max(1, n)).select(F.lit(0).alias("i"), F.col("id").alias("j"), F.lit(True).alias("v"))
    return Matrix.from_df(edges, n, n, dtype="bool", unique=True, check=False)


def _arith(spark: SparkSession, n: int, m: int, to) -> Matrix:
    edges = spark.range(max(0, m)).select(F.col("id").alias("i"), to.alias("j"), F.lit(True).alias("v"))
    return Matrix.from_df(edges, n, n, dtype="bool", unique=True, check=False)


def random_graph(spark: SparkSession, n: int, density: float, *, seed: int = 1, dtype: str = "bool", low: float = 1, high: float = 10, undirected: bool = False) -> Matrix:
    """About density * n * n positions drawn at random, repeated ones once; loops are left out."""
    draws = spark.range(int(n * n * density)).select(
        F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(0)), F.lit(n)).alias("i"),
        F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(1)), F.lit(n)).alias("j"),
        (low + F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(2)), F.lit(10_000)) / 10_000 * (high - low)).alias("v"),
    )
    draws = draws.where("i <> j")
    if undirected:
        draws = draws.union(draws.select("j", "i", "v"))
    value = F.lit(True) if dtype == "bool" else F.col("v")
    return Matrix.from_df(draws, n, n, val=value, dtype=dtype, combine="lor" if dtype == "bool" else "max", check=False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_trade(spark: SparkSession, sf_dir: str, dtype: str = "int64") -> Matrix:
    """customer's nation x supplier's nation: lines sold."""
    line, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer, supplier = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    sold = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return Matrix.from_df(sold, 25, 25, "c_nationkey", "s_nationkey", F.lit(1), dtype, check=False)


#: Events of a stretch of time, which one task sorts.
STRETCH = 100_000


def user_succession(spark: SparkSession, sf_dir: str, dtype: str = "bool") -> Matrix:
    """user -> user of the next event in time; fp64 values count how often, plus 1.

    Time is cut into equal stretches of about STRETCH events: within one, a
    window over its rows; the last event of a stretch is followed by the first
    of the next that has any, from a table of one row for each. So no task
    sorts all events.
    """
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    count, low, high = events.agg(F.count("*"), F.min(at), F.max(at)).first()
    width = max(1, ((high or 0) - (low or 0)) * STRETCH // max(1, count))
    events = events.withColumn("part", F.floor((at - (low or 0)) / width).cast("long"))
    within = events.withColumn("next", F.lead("user_id").over(Window.partitionBy("part").orderBy("ts", "event_id")))
    firsts = events.groupBy("part").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    bounds = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("after"))
    pairs = within.join(bounds, "part").select("user_id", F.coalesce("next", "after").alias("next")).where("next is not null")
    n = (events.agg(F.max("user_id")).first()[0] or -1) + 1
    return Matrix.from_df(pairs, n, n, "user_id", "next", F.lit(True) if dtype == "bool" else F.lit(1), dtype, check=False)


def supplier_part(spark: SparkSession, sf_dir: str, where: str | None = None, dtype: str = "int64", combine: str | None = None, parts: int | None = None) -> Matrix:
    """supplier x part: quantity sold; for parts see Matrix.from_df."""
    line = table(spark, sf_dir, "lineitem")
    line = line.where(where) if where else line
    nrows, ncols = table(spark, sf_dir, "supplier").count(), table(spark, sf_dir, "part").count()
    return Matrix.from_df(line, nrows, ncols, "l_suppkey", "l_partkey", "l_quantity", dtype, combine=combine, scattered=True, parts=parts)


def row_blocks(spark: SparkSession, sf_dir: str, lines: int) -> int:
    """Blocks of rows for a product of lines sold, or parts of a sum of them: one for each so many lines."""
    return max(1, -(-table(spark, sf_dir, "lineitem").count() // lines))


def undirected(matrix: Matrix) -> Matrix:
    """Both directions of each edge, without loops."""
    edges = matrix.df.where("i <> j").select("i", "j")
    edges = edges.union(edges.select("j", "i")).distinct().select("i", "j", F.lit(True).alias("v"))
    return Matrix(edges, matrix.nrows, matrix.ncols, "bool")


def part_pointer(spark: SparkSession, sf_dir: str) -> Matrix:
    """part -> the part whose key is its size."""
    part = table(spark, sf_dir, "part")
    n = part.count()
    return Matrix.from_df(part, n, n, "p_partkey", "p_size", F.lit(True), "bool", unique=True, check=False)


def event_chain(spark: SparkSession, sf_dir: str) -> Matrix:
    """event -> the same user's next event in time."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    n = (events.agg(F.max("event_id")).first()[0] or -1) + 1
    chained = events.withColumn("next", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("next is not null")
    return Matrix.from_df(chained, n, n, "event_id", "next", F.lit(True), "bool", unique=True)


def neighbours(spark: SparkSession, sf_dir: str) -> Matrix:
    """supplier x supplier: the pairs of one nation, as true."""
    supplier = table(spark, sf_dir, "supplier")
    n, other = supplier.count(), supplier.select(F.col("s_suppkey").alias("other"), "s_nationkey")
    pairs = supplier.select("s_suppkey", "s_nationkey").join(other, "s_nationkey")
    return Matrix.from_df(pairs, n, n, "s_suppkey", "other", F.lit(True), "bool", unique=True)


def trade_relation(spark: SparkSession, sf_dir: str, regions: bool = False) -> Relation:
    """bought: customer -> part, supplied_by: part -> supplier, located_in: supplier -> nation.

    quantity is bought, and shipped is supplied_by, weighted with quantities.
    With regions also part_of: nation -> region.

    Entities are numbered in one range: customers, then parts, suppliers, nations, regions.
    """
    sizes = [table(spark, sf_dir, t).count() for t in ("customer", "part", "supplier", "nation", *(["region"] if regions else []))]
    at_part, at_supplier, at_nation, at_region = (sum(sizes[:k]) for k in range(1, 5))
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    bought = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("s"), (F.col("l_partkey") + at_part).alias("o"), F.col("l_quantity").cast("long").alias("q"))
    supplied = line.select((F.col("l_partkey") + at_part).alias("s"), (F.col("l_suppkey") + at_supplier).alias("o"), F.col("l_quantity").cast("long").alias("q"))
    located = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + at_supplier).alias("s"), (F.col("s_nationkey") + at_nation).alias("o"))
    rel = Relation.new(sum(sizes)).add_df("bought", bought, "s", "o", scattered=True).add_df("supplied_by", supplied, "s", "o", scattered=True).add_df("located_in", located, "s", "o")
    if regions:
        rel = rel.add_df("part_of", table(spark, sf_dir, "nation").select((F.col("n_nationkey") + at_nation).alias("s"), (F.col("n_regionkey") + at_region).alias("o")), "s", "o")
    return rel.add_df("quantity", bought, "s", "o", "q", "int64", scattered=True).add_df("shipped", supplied, "s", "o", "q", "int64", scattered=True)


def account_balances(spark: SparkSession, sf_dir: str) -> Vector:
    customer = table(spark, sf_dir, "customer")
    return Vector.from_df(customer, customer.count(), "c_custkey", "c_acctbal", "fp64", unique=True, check=False)
