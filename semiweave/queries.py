"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import scratch
from .functions.algebra import MONOIDS, SEMIRINGS, Monoid, Semiring
from .functions.scalar_ops import UNARY
from .operators.containers import Matrix, Vector
from .operators.masks import Descriptor, EqualLabels, Mask
from .plans import algorithms, iterate
from .sources import graphs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# SQL of the graphs that sources.graphs makes.
G1 = "g1 AS (SELECT c_nationkey AS i, s_nationkey AS j, CAST(COUNT(*) AS BIGINT) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"
G2 = "s2 AS (SELECT user_id, LEAD(user_id) OVER (ORDER BY ts, event_id) AS nxt FROM events), g2 AS (SELECT user_id AS i, nxt AS j, CAST(COUNT(*) AS BIGINT) AS v FROM s2 WHERE nxt IS NOT NULL GROUP BY ALL)"
G3 = "g3 AS (SELECT l_suppkey AS i, l_partkey AS j, CAST(SUM(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY ALL)"
G4 = G2 + ", g4 AS (SELECT i, j FROM g2 WHERE i <> j UNION SELECT j, i FROM g2 WHERE i <> j)"
G5 = "g5 AS (SELECT p_partkey AS i, CAST(p_size AS BIGINT) AS j FROM part)"
A3 = "a3 AS (SELECT l_suppkey AS i, l_partkey AS j, CAST(SUM(l_quantity) AS BIGINT) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)"
R3 = "r3 AS (SELECT l_suppkey AS i, l_partkey AS j, CAST(SUM(l_quantity) AS BIGINT) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)"
U3 = "u3 AS (SELECT CAST(s_suppkey AS BIGINT) AS i, CAST(s_nationkey AS BIGINT) AS v FROM supplier WHERE s_acctbal > 0)"
W3 = "w3 AS (SELECT CAST(p_partkey AS BIGINT) AS i, CAST(p_size AS BIGINT) AS v FROM part WHERE p_size > 25)"

#: Lines sold a block of rows: customers are two fifths of a relation's entities.
SUPPLIER_LINES, CUSTOMER_LINES = 200_000, 80_000
#: Lines sold for each part of a sum by position, which bound the memory of a task.
PART_LINES = 500_000

# SQL of operators and of their aggregates.
PAIR = {"plus": "{a} + {b}", "times": "{a} * {b}", "min": "LEAST({a}, {b})", "max": "GREATEST({a}, {b})", "land": "({a} AND {b})", "lor": "({a} OR {b})", "lxor": "({a} <> {b})"}
SUMS = {"plus": "SUM({v})", "min": "MIN({v})", "max": "MAX({v})", "land": "BOOL_AND({v})", "lor": "BOOL_OR({v})", "lxor": "(BIT_XOR(CAST({v} AS INTEGER)) = 1)", "times": "PRODUCT({v})"}
CASTS = {"int64": "BIGINT", "fp64": "DOUBLE", "bool": "BOOLEAN"}


def register(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def _value(column: str, dtype: str) -> str:
    """An integer column as a value of dtype: bool ones are true where even."""
    return f"({column} % 2 = 0)" if dtype == "bool" else f"CAST({column} AS {CASTS[dtype]})"


def _as(container, dtype: str):
    """The same on Spark's side."""
    if dtype == "bool":
        return type(container)(container.df.withColumn("v", F.col("v") % 2 == 0), *container.extent, "bool")
    return container.cast(dtype)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[Vector, Vector]:
    """u3 over suppliers (nations of those with a positive balance) and w3 over parts (sizes of the large ones)."""
    supplier, part = graphs.table(spark, sf_dir, "supplier"), graphs.table(spark, sf_dir, "part")
    u = Vector.from_df(supplier.where("s_acctbal > 0"), supplier.count(), "s_suppkey", "s_nationkey", "int64", unique=True)
    w = Vector.from_df(part.where("p_size > 25"), part.count(), "p_partkey", "p_size", "int64", unique=True)
    return u, w


def _dense_source(spark: SparkSession, sf_dir: str) -> Matrix:
    return graphs.supplier_part(spark, sf_dir)


# --- products -----------------------------------------------------------------
def _products(name: str, sr: Semiring) -> None:
    t, add, times = CASTS[sr.type], SUMS[sr.add], PAIR[sr.multiply].format(a="a.v", b="b.v")
    typed = lambda src, alias: f"(SELECT i, {'j, ' if alias[0] == 'm' else ''}{_value('v', sr.type)} AS v FROM {src})"
    total = f"CAST({add.format(v=times)} AS {t}) AS v"

    @register(f"mxm_{name}", f"WITH {G1} SELECT a.i, b.j, {total} FROM {typed('g1', 'm')} a JOIN {typed('g1', 'm')} b ON a.j = b.i GROUP BY a.i, b.j")
    def mxm(spark, sf_dir):
        g = _as(graphs.nation_trade(spark, sf_dir), sr.type)
        return g.mxm(g, sr).df

    @register(f"mxv_{name}", f"WITH {G3}, {W3} SELECT a.i, {total} FROM {typed('g3', 'm')} a JOIN {typed('w3', 'v')} b ON a.j = b.i GROUP BY a.i")
    def mxv(spark, sf_dir):
        return _as(_dense_source(spark, sf_dir), sr.type).mxv(_as(_vectors(spark, sf_dir)[1], sr.type), sr).df

    @register(f"vxm_{name}", f"WITH {G3}, {U3} SELECT b.j AS i, {total} FROM {typed('u3', 'v')} a JOIN {typed('g3', 'm')} b ON a.i = b.i GROUP BY b.j")
    def vxm(spark, sf_dir):
        return _as(_vectors(spark, sf_dir)[0], sr.type).vxm(_as(_dense_source(spark, sf_dir), sr.type), sr).df


for _name, _sr in SEMIRINGS.items():
    _products(_name, _sr)


@register("supplier_similarity", f"WITH {G3} SELECT a.i, b.i AS j, CAST(SUM(a.v * b.v) AS BIGINT) AS v FROM g3 a JOIN g3 b ON a.j = b.j GROUP BY a.i, b.i")
def supplier_similarity(spark, sf_dir):
    """S * S^T over the parts that two suppliers both sell: the flagship product."""
    s = _dense_source(spark, sf_dir)
    return s.mxm(s, "plus_times", descriptor=Descriptor(inp1=True), blocks=graphs.row_blocks(spark, sf_dir, SUPPLIER_LINES)).df


@register("mxm_stored", f"WITH {G3} SELECT a.i, b.i AS j, CAST(SUM(a.v * b.v) AS BIGINT) AS v FROM g3 a JOIN g3 b ON a.j = b.j GROUP BY a.i, b.i")
def mxm_stored(spark, sf_dir):
    """S * S^T of the stored matrix, whose columns are read as they lie."""
    s = _dense_source(spark, sf_dir).write(f"supplier_part_{uuid.uuid4().hex}", buckets=graphs.row_blocks(spark, sf_dir, PART_LINES), path=scratch(spark))
    return s.mxm(s, descriptor=Descriptor(inp1=True), blocks=graphs.row_blocks(spark, sf_dir, SUPPLIER_LINES)).df


@register("matrix_set_log", f"WITH {G1} SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, v FROM g1 WHERE i <> 3 UNION ALL SELECT 3, k, 2 * k FROM range(25) t(k)")
def matrix_set_log(spark, sf_dir):
    """A row overwritten entry by entry, twice."""
    g = graphs.nation_trade(spark, sf_dir)
    for times in (1, 2):
        for k in range(25):
            g = g.set(3, k, times * k)
    return g.df


@register("mxm_t0", f"WITH {G1} SELECT a.j AS i, b.j, CAST(SUM(a.v * b.v) AS BIGINT) AS v FROM g1 a JOIN g1 b ON a.i = b.i GROUP BY a.j, b.j")
def mxm_t0(spark, sf_dir):
    g = graphs.nation_trade(spark, sf_dir)
    return g.mxm(g, descriptor=Descriptor().inp0_transpose()).df


@register("mxm_t0t1", f"WITH {G1} SELECT a.j AS i, b.i AS j, CAST(SUM(a.v * b.v) AS BIGINT) AS v FROM g1 a JOIN g1 b ON a.i = b.j GROUP BY a.j, b.i")
def mxm_t0t1(spark, sf_dir):
    g = graphs.nation_trade(spark, sf_dir)
    return g.mxm(g, descriptor=Descriptor().inp0_transpose().inp1_transpose()).df


@register("mxv_t0", f"WITH {G3}, {U3} SELECT a.j AS i, CAST(SUM(a.v * b.v) AS BIGINT) AS v FROM g3 a JOIN u3 b ON a.i = b.i GROUP BY a.j")
def mxv_t0(spark, sf_dir):
    return _dense_source(spark, sf_dir).mxv(_vectors(spark, sf_dir)[0], descriptor=Descriptor(inp0=True)).df


@register("vxm_t1", f"WITH {G3}, {W3} SELECT b.i, CAST(SUM(a.v * b.v) AS BIGINT) AS v FROM w3 a JOIN g3 b ON a.i = b.j GROUP BY b.i")
def vxm_t1(spark, sf_dir):
    return _vectors(spark, sf_dir)[1].vxm(_dense_source(spark, sf_dir), descriptor=Descriptor(inp1=True)).df


@register("mxm_custom_semiring", f"WITH {G1} SELECT a.i, b.j, CAST(MAX(a.v - b.v) AS BIGINT) AS v FROM g1 a JOIN g1 b ON a.j = b.i GROUP BY a.i, b.j")
def mxm_custom_semiring(spark, sf_dir):
    g = graphs.nation_trade(spark, sf_dir)
    return g.mxm(g, Semiring("max_minus", "minus", "max", None, None, "int64")).df


# --- masks --------------------------------------------------------------------
_PRODUCT = f"{G1}, p AS (SELECT a.i, b.j, CAST(SUM(a.v * b.v) AS BIGINT) AS v FROM g1 a JOIN g1 b ON a.j = b.i GROUP BY a.i, b.j), m AS (SELECT i, j, (v % 3) AS v FROM g1 WHERE v > (SELECT AVG(v) FROM g1))"


def _mask_query(name: str, complement: bool, by_value: bool) -> None:
    test = "NOT EXISTS" if complement else "EXISTS"

    @register(name, f"WITH {_PRODUCT} SELECT p.i, p.j, p.v FROM p WHERE {test} (SELECT 1 FROM m WHERE m.i = p.i AND m.j = p.j{' AND m.v <> 0' if by_value else ''})")
    def query(spark, sf_dir):
        g = graphs.nation_trade(spark, sf_dir).persist()
        mean = g.df.agg(F.avg("v").alias("mean"))
        at = Matrix(g.df.crossJoin(F.broadcast(mean)).where("v > mean").select("i", "j", (F.col("v") % 3).alias("v")), 25, 25, "int64")
        return g.mxm(g, mask=Mask(at, complement), descriptor=Descriptor(mask="value" if by_value else "structural")).df


for _suffix, _c, _v in (("struct", False, False), ("comp", True, False), ("value", False, True), ("value_comp", True, True)):
    _mask_query(f"mxm_mask_{_suffix}", _c, _v)


@register("mxm_mask_first", f"WITH {G3}, n AS (SELECT x.s_suppkey AS i, y.s_suppkey AS j FROM supplier x JOIN supplier y USING (s_nationkey)) SELECT n.i, n.j, CAST(SUM(a.v * b.v) AS BIGINT) AS v FROM n JOIN g3 a ON a.i = n.i JOIN g3 b ON b.i = n.j AND b.j = a.j GROUP BY n.i, n.j")
def mxm_mask_first(spark, sf_dir):
    """S * S^T for suppliers of one nation alone, whose pairs are too many to list, though a small part of all."""
    s = _dense_source(spark, sf_dir)
    nations = Vector.from_df(graphs.table(spark, sf_dir, "supplier"), s.nrows, "s_suppkey", "s_nationkey", "int64", unique=True)
    return s.mxm(s, mask=EqualLabels(nations, nations), descriptor=Descriptor(inp1=True)).df


def _wide_product(name: str, sr: Semiring) -> None:
    value, times = _value("v", sr.type), PAIR[sr.multiply].format(a="a.v", b="b.v")

    @register(f"mxm_nations_{name}", f"WITH {G3}, t AS (SELECT i, j, {value} AS v FROM g3), l AS (SELECT DISTINCT CAST(s_suppkey AS BIGINT) AS i, CAST(s_nationkey AS BIGINT) AS j, {_value('(1 + s_suppkey % 9)', sr.type)} AS v FROM supplier) SELECT a.j AS i, b.j, CAST({SUMS[sr.add].format(v=times)} AS {CASTS[sr.type]}) AS v FROM l a JOIN t b ON a.i = b.i GROUP BY a.j, b.j")
    def query(spark, sf_dir):
        """nation x part over the suppliers, whose matrix is read transposed."""
        supplier, s = graphs.table(spark, sf_dir, "supplier"), _dense_source(spark, sf_dir)
        at = Matrix.from_df(supplier, s.nrows, 25, "s_suppkey", "s_nationkey", F.col("s_suppkey") % 9 + 1, "int64", unique=True)
        return _as(at, sr.type).mxm(_as(s, sr.type), sr, descriptor=Descriptor(inp0=True)).df


for _name in ("min_plus", "max_min", "lor_land", "land_lor"):
    _wide_product(_name, SEMIRINGS[_name])


@register("reduce_mask", f"WITH {G3}, {U3} SELECT i, CAST(SUM(v) AS BIGINT) AS v FROM g3 WHERE i NOT IN (SELECT i FROM u3) GROUP BY i")
def reduce_mask(spark, sf_dir):
    return _dense_source(spark, sf_dir).reduce(mask=Mask.of_complement(_vectors(spark, sf_dir)[0])).df


@register("transpose_mask", f"WITH {G1} SELECT j AS i, i AS j, v FROM g1 WHERE j < i")
def transpose_mask(spark, sf_dir):
    g = graphs.nation_trade(spark, sf_dir)
    return g.transpose(mask=Mask(Matrix(g.df.where("i < j"), 25, 25, g.dtype))).df


# --- element-wise and reductions, for each monoid --------------------------------
def _monoid_queries(name: str, m: Monoid) -> None:
    t, pair, op = CASTS[m.type], PAIR[m.operator], m.operator
    value = _value("(1 + v % 3)", m.type) if op == "times" else _value("v", m.type)
    both = pair.format(a="a.v", b="b.v")
    sides = f"WITH {A3}, {R3}, a AS (SELECT i, j, {value} AS v FROM a3), b AS (SELECT i, j, {value} AS v FROM r3)"

    def prepared(matrix: Matrix) -> Matrix:
        return _as(Matrix(matrix.df.withColumn("v", 1 + F.col("v") % 3), *matrix.shape) if op == "times" else matrix, m.type)

    def parts(spark, sf_dir):
        n = graphs.row_blocks(spark, sf_dir, PART_LINES)
        return [prepared(graphs.supplier_part(spark, sf_dir, f"l_returnflag = '{flag}'", parts=n)) for flag in "AR"]

    @register(f"ewise_add_{name}", f"{sides} SELECT i, j, CASE WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL THEN a.v ELSE CAST({both} AS {t}) END AS v FROM a FULL JOIN b USING (i, j)")
    def ewise_add(spark, sf_dir):
        a, b = parts(spark, sf_dir)
        return a.ewise_add(b, m, parts=graphs.row_blocks(spark, sf_dir, PART_LINES)).df

    @register(f"ewise_mult_{name}", f"{sides} SELECT i, j, CAST({both} AS {t}) AS v FROM a JOIN b USING (i, j)")
    def ewise_mult(spark, sf_dir):
        a, b = parts(spark, sf_dir)
        return a.ewise_mult(b, m).df

    # products of hundreds of quantities overflow; these of signs and a few twos don't
    sign, part_sign = "CASE WHEN v % 50 = 0 THEN 2 WHEN v % 2 = 1 THEN -1 ELSE 1 END", "CASE WHEN p_partkey % 1000 = 7 THEN 2 WHEN p_size % 2 = 1 THEN -1 ELSE 1 END"
    total = f"CAST({SUMS[op].format(v='v')} AS {t})"

    @register(f"reduce_rows_{name}", f"WITH {G3}, s AS (SELECT i, {_value(f'({sign})' if op == 'times' else 'v', m.type)} AS v FROM g3) SELECT i, {total} AS v FROM s GROUP BY i")
    def reduce_rows(spark, sf_dir):
        g = _dense_source(spark, sf_dir)
        return _as(Matrix(g.df.withColumn("v", F.expr(sign).cast("long")), *g.shape) if op == "times" else g, m.type).reduce(m).df

    @register(f"vector_reduce_{name}", f"WITH s AS (SELECT {_value(f'({part_sign})' if op == 'times' else 'p_size', m.type)} AS v FROM part) SELECT {total} AS v FROM s")
    def vector_reduce(spark, sf_dir):
        part = graphs.table(spark, sf_dir, "part")
        sizes = Vector.from_df(part, part.count(), "p_partkey", F.expr(part_sign if op == "times" else "p_size"), "int64", unique=True)
        return _as(sizes, m.type).reduce_df(m)

    v = f"WITH x AS (SELECT CAST(s_suppkey AS BIGINT) AS i, {_value('s_nationkey', m.type)} AS v FROM supplier WHERE s_acctbal > 0), y AS (SELECT CAST(s_suppkey AS BIGINT) AS i, {_value('(1 + s_nationkey % 7)', m.type)} AS v FROM supplier WHERE s_acctbal < 5000)"
    vboth = pair.format(a="x.v", b="y.v")

    def vectors(spark, sf_dir):
        s = graphs.table(spark, sf_dir, "supplier")
        n = s.count()
        return [_as(Vector.from_df(s.where(rows), n, "s_suppkey", F.expr(value), "int64", unique=True), m.type) for rows, value in (("s_acctbal > 0", "s_nationkey"), ("s_acctbal < 5000", "1 + s_nationkey % 7"))]

    @register(f"vector_ewise_add_{name}", f"{v} SELECT i, CASE WHEN x.v IS NULL THEN y.v WHEN y.v IS NULL THEN x.v ELSE CAST({vboth} AS {t}) END AS v FROM x FULL JOIN y USING (i)")
    def vector_ewise_add(spark, sf_dir):
        a, b = vectors(spark, sf_dir)
        return a.ewise_add(b, m).df

    @register(f"vector_ewise_mult_{name}", f"{v} SELECT i, CAST({vboth} AS {t}) AS v FROM x JOIN y USING (i)")
    def vector_ewise_mult(spark, sf_dir):
        a, b = vectors(spark, sf_dir)
        return a.ewise_mult(b, m).df


for _name, _m in MONOIDS.items():
    if _m.type in CASTS:
        _monoid_queries(_name, _m)


@register("reduce_cols_plus", f"WITH {G3} SELECT j AS i, CAST(SUM(v) AS BIGINT) AS v FROM g3 GROUP BY j")
def reduce_cols_plus(spark, sf_dir):
    return _dense_source(spark, sf_dir).reduce(descriptor=Descriptor(inp0=True)).df


@register("vector_reduce_empty", "SELECT CAST(9223372036854775807 AS BIGINT) AS v")
def vector_reduce_empty(spark, sf_dir):
    return Vector.new(spark, 5).reduce_df("min")


@register("transpose", f"WITH {G3} SELECT j AS i, i AS j, v FROM g3")
def transpose(spark, sf_dir):
    return _dense_source(spark, sf_dir).transpose().df


# --- construction, inspection and point access ------------------------------------
def _combine_query(name: str, expression: str, combine: str, dtype: str, where: str) -> None:
    @register(f"from_coo_{name}", f"SELECT l_suppkey AS i, l_partkey AS j, CAST({expression} AS {CASTS[dtype]}) AS v FROM lineitem WHERE {where} GROUP BY ALL")
    def query(spark, sf_dir):
        line = graphs.table(spark, sf_dir, "lineitem").where(where)
        nrows, ncols = graphs.table(spark, sf_dir, "supplier").count(), graphs.table(spark, sf_dir, "part").count()
        value = F.col("l_quantity") > 25 if dtype == "bool" else F.col("l_linenumber" if combine == "times" else "l_quantity")
        return Matrix.from_df(line, nrows, ncols, "l_suppkey", "l_partkey", value, dtype, combine=combine, check=True).df


for _row in (
    ("plus", "SUM(l_quantity)", "plus", "int64", "true"),
    ("times", "PRODUCT(l_linenumber)", "times", "int64", "true"),
    ("min", "MIN(l_quantity)", "min", "int64", "true"),
    ("max", "MAX(l_quantity)", "max", "int64", "true"),
    ("lor", "BOOL_OR(l_quantity > 25)", "lor", "bool", "true"),
    ("lxor", "BIT_XOR(CAST(l_quantity > 25 AS INTEGER)) = 1", "lxor", "bool", "true"),
):
    _combine_query(*_row)


@register("nvals", f"WITH {G3} SELECT COUNT(*) AS nvals FROM g3")
def nvals(spark, sf_dir):
    return _dense_source(spark, sf_dir).df.agg(F.count("*").alias("nvals"))


@register("shape", "SELECT (SELECT COUNT(*) FROM supplier) AS nrows, (SELECT COUNT(*) FROM part) AS ncols")
def shape(spark, sf_dir):
    return spark.createDataFrame([_dense_source(spark, sf_dir).shape], "nrows long, ncols long")


@register("to_coo", f"WITH {G1} SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, v FROM g1 ORDER BY i, j")
def to_coo(spark, sf_dir):
    return graphs.nation_trade(spark, sf_dir).to_coo()


@register("to_dense", f"WITH {G1} SELECT r.k AS i, c.k AS j, COALESCE(g1.v, 0) AS v FROM range(25) r(k) CROSS JOIN range(30) c(k) LEFT JOIN g1 ON g1.i = r.k AND g1.j = c.k")
def to_dense(spark, sf_dir):
    """The trade of nations with five more columns, which nothing is stored in."""
    rows = Matrix(graphs.nation_trade(spark, sf_dir).df, 25, 30).to_dense()
    return rows.select("i", F.posexplode("row").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), "v")


@register("to_list", f"WITH {U3} SELECT CAST(s_suppkey AS BIGINT) AS i, COALESCE(u3.v, 0) AS v FROM supplier LEFT JOIN u3 ON s_suppkey = u3.i")
def to_list(spark, sf_dir):
    return _vectors(spark, sf_dir)[0].dense().df


@register("matrix_set", f"WITH {G1} SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, v FROM g1 WHERE NOT (i = 3 AND j = 4) UNION ALL SELECT 3, 4, -7")
def matrix_set(spark, sf_dir):
    return graphs.nation_trade(spark, sf_dir).set(3, 4, -7).df


@register("matrix_set_many", f"WITH {G1} SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, v FROM g1 WHERE i <> j UNION ALL SELECT k, k, k FROM range(25) t(k)")
def matrix_set_many(spark, sf_dir):
    return graphs.nation_trade(spark, sf_dir).set_many(spark.range(25).select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("id").alias("v"))).df


@register("matrix_extract", f"WITH {G1} SELECT (SELECT COALESCE(MAX(v), 0) FROM g1 WHERE i = 3 AND j = 4) AS stored, (SELECT COALESCE(MAX(v), 0) FROM g1 WHERE i = 3 AND j = 4 AND v < 0) AS absent")
def matrix_extract(spark, sf_dir):
    g = graphs.nation_trade(spark, sf_dir)
    none = Matrix(g.df.where("v < 0"), 25, 25)
    return spark.createDataFrame([(g.extract(3, 4), none.extract(3, 4))], "stored long, absent long")


@register("vector_set", f"WITH {U3} SELECT i, v FROM u3 WHERE i <> 4 UNION ALL SELECT 4, 99")
def vector_set(spark, sf_dir):
    return _vectors(spark, sf_dir)[0].set(4, 99).df


@register("vector_extract", f"WITH {U3} SELECT (SELECT COALESCE(MAX(v), 0) FROM u3 WHERE i = 4) AS first, (SELECT COALESCE(MAX(v), 0) FROM u3 WHERE i = 3) AS second")
def vector_extract(spark, sf_dir):
    u = _vectors(spark, sf_dir)[0]
    return spark.createDataFrame([(u.extract(4), u.extract(3))], "first long, second long")


@register("dup", f"WITH {G1} SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, v FROM g1")
def dup(spark, sf_dir):
    g = graphs.nation_trade(spark, sf_dir)
    copy = g.dup()
    g.set(0, 0, 1)
    return copy.df


for _name in UNARY:
    _expression = {"identity": "c_acctbal", "negate_int": "-CAST(TRUNC(c_acctbal) AS BIGINT)", "negate_fp": "-c_acctbal", "abs_val": "ABS(c_acctbal)", "l_not": "NOT (c_acctbal <> 0)"}[_name]

    @register(f"apply_{_name}", f"SELECT CAST(c_custkey AS BIGINT) AS i, {_expression} AS v FROM customer")
    def apply(spark, sf_dir, name=_name):
        v = graphs.account_balances(spark, sf_dir)
        v = v.cast("int64") if name == "negate_int" else v.cast("bool") if name == "l_not" else v
        return v.apply(name).df


# --- algorithms -----------------------------------------------------------------
_LEVELS = "lev(i, v) AS (SELECT {s}, CAST(0 AS BIGINT) UNION SELECT g.j, lev.v + 1 FROM lev JOIN {g} g ON lev.i = g.i WHERE lev.v < {n})"


@register("bfs_levels", f"WITH RECURSIVE {G2}, {_LEVELS.format(s='CAST(0 AS BIGINT)', g='g2', n=20)} SELECT i, MIN(v) AS v FROM lev GROUP BY i")
def bfs_levels(spark, sf_dir):
    return algorithms.bfs_levels(graphs.user_succession(spark, sf_dir), 0).df


@register("bfs_levels_sparse", f"WITH RECURSIVE {G5}, {_LEVELS.format(s='CAST(7 AS BIGINT)', g='g5', n=60)} SELECT i, MIN(v) AS v FROM lev GROUP BY i")
def bfs_levels_sparse(spark, sf_dir):
    return algorithms.bfs_levels(graphs.part_pointer(spark, sf_dir), 7).df


@register("bfs_reach", f"WITH RECURSIVE {G2}, r(i) AS (SELECT CAST(0 AS BIGINT) UNION SELECT g2.j FROM r JOIN g2 ON r.i = g2.i) SELECT i, TRUE AS v FROM r")
def bfs_reach(spark, sf_dir):
    return algorithms.bfs_reach(graphs.user_succession(spark, sf_dir), 0).df


_STEPS = ", ".join(f"d{k + 1} AS (SELECT i, MIN(v) AS v FROM (SELECT i, v FROM d{k} UNION ALL SELECT g.j, d{k}.v + g.w FROM d{k} JOIN e g ON d{k}.i = g.i) GROUP BY i)" for k in range(24))


_SSSP = f"WITH {G2}, e AS (SELECT i, j, CAST(1 + (i * 7 + j * 13) % 10 AS DOUBLE) AS w FROM g2), d0 AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS v), {_STEPS} SELECT i, v FROM d24"


for _name, _delta in (("sssp", None), ("sssp_buckets", 4.0)):

    @register(_name, _SSSP)
    def sssp(spark, sf_dir, delta=_delta):
        g = graphs.user_succession(spark, sf_dir)
        weighted = Matrix(g.df.select("i", "j", (1 + (F.col("i") * 7 + F.col("j") * 13) % 10).cast("double").alias("v")), *g.shape, "fp64")
        return algorithms.sssp(weighted, 0, delta=delta).df


@register("triangle_count", f"WITH {G4} SELECT COUNT(*) AS triangles FROM g4 a JOIN g4 b ON a.j = b.i JOIN g4 c ON b.j = c.j AND a.i = c.i WHERE a.i > a.j AND b.i > b.j")
def triangle_count(spark, sf_dir):
    return algorithms.triangle_count_df(graphs.undirected(graphs.user_succession(spark, sf_dir)))


@register("connected_components", f"WITH RECURSIVE {G5}, u AS (SELECT i, j FROM g5 UNION SELECT j, i FROM g5), hub AS (SELECT i, j FROM u WHERE j <= 50), r(s, i) AS (SELECT k, k FROM range(0, 51) t(k) WHERE k IN (SELECT i FROM u) UNION SELECT r.s, u.j FROM r JOIN u ON r.i = u.i) SELECT i, MIN(s) AS v FROM r GROUP BY i")
def connected_components(spark, sf_dir):
    """Each part points to one of the parts 1 to 50, so these (and 0) hold the least of every component."""
    return algorithms.connected_components(graphs.part_pointer(spark, sf_dir)).df


@register("connected_components_directed", f"WITH RECURSIVE {G5}, c(i, j) AS (SELECT i, i FROM g5 UNION SELECT c.i, g5.j FROM c JOIN g5 ON c.j = g5.i) SELECT j AS i, MIN(i) AS v FROM c GROUP BY j")
def connected_components_directed(spark, sf_dir):
    """The least part that reaches each part."""
    return algorithms.connected_components(graphs.part_pointer(spark, sf_dir), undirected=False).df


_CHAIN = "e AS (SELECT event_id, user_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)"


@register("connected_components_chains", f"WITH {_CHAIN}, n AS (SELECT MAX(event_id) + 1 AS n FROM events) SELECT k AS i, COALESCE(v, k) AS v FROM n, range(0, (SELECT n FROM n)) t(k) LEFT JOIN (SELECT event_id, MIN(event_id) OVER (PARTITION BY user_id ORDER BY r) AS v FROM e) ON event_id = k")
def connected_components_chains(spark, sf_dir):
    """The least event that leads to each event of a user."""
    return algorithms.connected_components(graphs.event_chain(spark, sf_dir), undirected=False).df


@register("degree_out", f"WITH {G2} SELECT i, CAST(SUM(v) AS BIGINT) AS v FROM g2 GROUP BY i")
def degree_out(spark, sf_dir):
    return algorithms.degree(graphs.user_succession(spark, sf_dir, "int64"))["out_degree"].df


@register("degree_in", f"WITH {G2} SELECT j AS i, CAST(COUNT(*) AS BIGINT) AS v FROM g2 GROUP BY j")
def degree_in(spark, sf_dir):
    return algorithms.degree(graphs.user_succession(spark, sf_dir))["in_degree"].df


def _ranks(rounds: int, dense: bool) -> str:
    out = f"WITH {G2}, n AS (SELECT CAST(MAX(user_id) + 1 AS BIGINT) AS n FROM events), o AS (SELECT i, SUM(v) AS d FROM g2 GROUP BY i), r0 AS (SELECT k AS i, 1.0 / n AS v FROM n, range(0, (SELECT n FROM n)) t(k))"
    for k in range(rounds):
        moved = f"SELECT g2.j AS i, SUM(r{k}.v * g2.v / o.d) AS s FROM r{k} JOIN g2 ON r{k}.i = g2.i JOIN o ON o.i = g2.i GROUP BY g2.j"
        lost = f"(SELECT COALESCE(SUM(v), 0.0) FROM r{k} WHERE i NOT IN (SELECT i FROM o))"
        source = f"(SELECT r0.i, COALESCE(s, 0.0) AS s FROM r0 LEFT JOIN ({moved}) USING (i))" if dense else f"({moved})"
        out += f", r{k + 1} AS MATERIALIZED (SELECT m.i, m.s * 0.85 + 0.15 / n + 0.85 / n * {lost} AS v FROM {source} m, n)"
    return out + f" SELECT i, ROUND(v, 9) AS v FROM r{rounds}"


for _mode in ("dense", "stored"):

    @register("pagerank" if _mode == "dense" else "pagerank_stored", _ranks(60, _mode == "dense"))
    def pagerank(spark, sf_dir, mode=_mode):
        """Until no rank moves by 10^-13."""
        found = algorithms.pagerank(graphs.user_succession(spark, sf_dir, "int64"), tol=1e-13, teleport=mode)
        return found.df.select("i", F.round("v", 9).alias("v"))


@register("fixed_point_info", f"WITH RECURSIVE {G5}, {_LEVELS.format(s='CAST(7 AS BIGINT)', g='g5', n=60)}, least AS (SELECT i, MIN(v) AS v FROM lev GROUP BY i) SELECT CAST(MAX(v) + 1 AS INTEGER) AS iterations, TRUE AS converged FROM least")
def fixed_point_info(spark, sf_dir):
    """Rounds until the reach of part 7 stays."""
    g = graphs.part_pointer(spark, sf_dir)
    start = Vector(spark.range(7, 8).select(F.col("id").alias("i"), F.lit(True).alias("v")), g.nrows, "bool")
    _, info = iterate.fixed_point(start, lambda v: v.ewise_add(v.vxm(g, "lor_land"), "lor"), max_iter=60)
    return spark.createDataFrame([(info["iterations"], info["converged"])], "iterations int, converged boolean")


# --- relations ------------------------------------------------------------------
_B = "nc AS (SELECT COUNT(*) AS c FROM customer), np AS (SELECT COUNT(*) AS p FROM part), ns AS (SELECT COUNT(*) AS s FROM supplier)"
_BOUGHT = "bought AS (SELECT o_custkey AS i, l_partkey AS j, SUM(CAST(l_quantity AS BIGINT)) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"
_SHIPPED = "shipped AS (SELECT l_partkey AS i, l_suppkey AS j, SUM(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY ALL)"
_SUPPLIED = "supplied AS (SELECT DISTINCT l_partkey AS i, l_suppkey AS j FROM lineitem)"
_END = "CAST(s.s_nationkey + c + p + s AS BIGINT)"


def _path_query(name: str, path: list[str], semiring: str, dtype_sql: str, expression: str, where: str = "") -> None:
    third = len(path) == 3
    join = f"FROM bought b JOIN {'shipped' if path[1] == 'shipped' else 'supplied'} u ON b.j = u.i" + (" JOIN supplier s ON u.j = s.s_suppkey" if third else "")
    end = "CAST(s.s_nationkey + nc.c + np.p + ns.s AS BIGINT)" if third else "CAST(u.j + nc.c + np.p AS BIGINT)"

    @register(name, f"WITH {_B}, {_BOUGHT}, {_SUPPLIED}, {_SHIPPED} SELECT b.i, {end} AS j, CAST({expression} AS {dtype_sql}) AS v {join}, nc, np, ns GROUP BY ALL")
    def query(spark, sf_dir):
        relation = graphs.trade_relation(spark, sf_dir)
        relation = relation.measured(*path) if third else relation
        return relation.traverse(path, semiring, blocks=graphs.row_blocks(spark, sf_dir, CUSTOMER_LINES)).df


_path_query("traverse_exists", ["bought", "supplied_by", "located_in"], "lor_land", "BOOLEAN", "TRUE")
_path_query("traverse_count", ["bought", "supplied_by", "located_in"], "plus_times", "BIGINT", "COUNT(*)")
_path_query("traverse_widest", ["quantity", "shipped"], "max_min", "BIGINT", "MAX(LEAST(b.q, u.q))")
_path_query("traverse_cheapest", ["quantity", "shipped"], "min_plus", "BIGINT", "MIN(b.q + u.q)")


@register("traverse_regions", f"WITH {_B}, nn AS (SELECT COUNT(*) AS m FROM nation), {_BOUGHT}, {_SUPPLIED} SELECT b.i, CAST(n.n_regionkey + c + p + s + m AS BIGINT) AS j, CAST(COUNT(*) AS BIGINT) AS v FROM bought b JOIN supplied u ON b.j = u.i JOIN supplier ON u.j = s_suppkey JOIN nation n ON s_nationkey = n_nationkey, nc, np, ns, nn GROUP BY ALL")
def traverse_regions(spark, sf_dir):
    """Four hops, bracketed by the sizes of their matrices."""
    return graphs.trade_relation(spark, sf_dir, regions=True).measured().traverse(["bought", "supplied_by", "located_in", "part_of"], "plus_times").df


@register("closure_lor_land", f"WITH RECURSIVE {G5}, c(i, j) AS (SELECT i, j FROM g5 UNION SELECT c.i, g5.j FROM c JOIN g5 ON c.j = g5.i) SELECT i, j, TRUE AS v FROM c")
def closure_lor_land(spark, sf_dir):
    g = graphs.part_pointer(spark, sf_dir)
    return graphs.Relation.new(g.nrows).with_matrix("p", g).closure("p", "lor_land")[0].df


@register("closure_events", f"WITH {_CHAIN} SELECT a.event_id AS i, b.event_id AS j, TRUE AS v FROM e a JOIN e b USING (user_id) WHERE a.r < b.r")
def closure_events(spark, sf_dir):
    """Which event comes before which, of one user: paths of up to a hundred hops."""
    g = graphs.event_chain(spark, sf_dir)
    return graphs.Relation.new(g.nrows).with_matrix("next", g).closure("next")[0].df


_PATHS = ", ".join(f"c{k + 1} AS (SELECT i, j, MIN(v) AS v FROM (SELECT * FROM c{k} UNION ALL SELECT a.i, b.j, a.v + b.v FROM c{k} a JOIN c0 b ON a.j = b.i) GROUP BY ALL)" for k in range(30))


@register("closure_min_plus", f"WITH {G5}, c0 AS (SELECT i, j, CAST(1 + i % 5 AS BIGINT) AS v FROM g5), {_PATHS} SELECT i, j, v FROM c30")
def closure_min_plus(spark, sf_dir):
    g = graphs.part_pointer(spark, sf_dir)
    w = Matrix(g.df.withColumn("v", 1 + F.col("i") % 5), *g.shape, "int64")
    return graphs.Relation.new(g.nrows).with_matrix("p", w).closure("p", "min_plus")[0].df


_COUNTED = ", ".join(f"c{k + 1} AS (SELECT i, j, CAST(SUM(v) AS BIGINT) AS v FROM (SELECT * FROM c{k} UNION ALL SELECT a.i, b.j, a.v * b.v FROM c{k} a JOIN c0 b ON a.j = b.i) GROUP BY ALL)" for k in range(5))


@register("closure_plus_times", f"WITH {G5}, c0 AS (SELECT i, j, CAST(1 AS BIGINT) AS v FROM g5), {_COUNTED} SELECT i, j, v FROM c5")
def closure_plus_times(spark, sf_dir):
    g = graphs.part_pointer(spark, sf_dir)
    return graphs.Relation.new(g.nrows).with_matrix("p", g).closure("p", "plus_times", max_iter=5)[0].df


@register("relation_add_triples", f"WITH {_SUPPLIED} SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, TRUE AS v FROM supplied")
def relation_add_triples(spark, sf_dir):
    """The same edges added twice are there once."""
    line = graphs.table(spark, sf_dir, "lineitem")
    rel = graphs.Relation.new(graphs.table(spark, sf_dir, "part").count())
    return rel.add_df("p", line, "l_partkey", "l_suppkey").add_df("p", line.where("l_quantity > 10"), "l_partkey", "l_suppkey").matrix("p").df


@register("relation_add_weighted", "SELECT CAST(l_partkey AS BIGINT) AS i, CAST(l_suppkey AS BIGINT) AS j, CAST(2 * SUM(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY ALL")
def relation_add_weighted(spark, sf_dir):
    line = graphs.table(spark, sf_dir, "lineitem")
    rel = graphs.Relation.new(graphs.table(spark, sf_dir, "part").count())
    for _ in range(2):
        rel = rel.add_df("p", line, "l_partkey", "l_suppkey", "l_quantity", "int64", parts=graphs.row_blocks(spark, sf_dir, PART_LINES))
    return rel.matrix("p").df


@register("relation_predicates", "SELECT * FROM (VALUES ('bought'), ('located_in'), ('quantity'), ('shipped'), ('supplied_by')) t(predicate)")
def relation_predicates(spark, sf_dir):
    return spark.createDataFrame([(p,) for p in graphs.trade_relation(spark, sf_dir).predicates()], "predicate string")


# --- the rest of vectors, an own monoid, generators ----------------------------------
@register("vector_nvals", f"WITH {U3} SELECT COUNT(*) AS nvals, (SELECT COUNT(*) FROM supplier) AS size FROM u3")
def vector_nvals(spark, sf_dir):
    u = _vectors(spark, sf_dir)[0]
    return spark.createDataFrame([(u.nvals(), u.size)], "nvals long, size long")


@register("vector_to_entries", f"WITH {W3} SELECT i, v FROM w3 ORDER BY i")
def vector_to_entries(spark, sf_dir):
    return _vectors(spark, sf_dir)[1].to_entries()


@register("vector_dup", f"WITH {U3} SELECT i, v FROM u3")
def vector_dup(spark, sf_dir):
    u = _vectors(spark, sf_dir)[0]
    copy = u.dup()
    u.set(1, -1)
    return copy.df


@register("reduce_rows_own_monoid", f"WITH {G3} SELECT i, BIT_OR(v) AS v FROM g3 GROUP BY i")
def reduce_rows_own_monoid(spark, sf_dir):
    return _dense_source(spark, sf_dir).reduce(Monoid("bits", lambda a, b: a.bitwiseOR(b), 0, "int64")).df


for _name, _edges in (("chain", "SELECT k AS i, k + 1 AS j FROM range(999) t(k)"), ("cycle", "SELECT k AS i, (k + 1) % 1000 AS j FROM range(1000) t(k)"), ("star", "SELECT 0 AS i, k AS j FROM range(1, 1000) t(k)")):

    @register(f"generate_{_name}", f"SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, TRUE AS v FROM ({_edges})")
    def generate(spark, sf_dir, name=_name):
        return getattr(graphs, name)(spark, 1000).df
