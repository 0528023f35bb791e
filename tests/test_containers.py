"""Matrices and vectors: literal cases, and random ones against dictionaries."""

import operator
import random

import pytest
from pyspark.sql import functions as F

import semiweave as sw
from semiweave import queries
from semiweave.functions import algebra
from semiweave import Descriptor, GraphError, Mask, Matrix, Monoid, Relation, Scalar, Semiring, Vector

PAIR = {"plus": operator.add, "times": operator.mul, "min": min, "max": max, "land": lambda a, b: a and b, "lor": lambda a, b: a or b, "lxor": operator.ne}


def fold(op, values):
    out = values[0]
    for v in values[1:]:
        out = PAIR[op](out, v)
    return out


def product(a, b, sr):
    out = {}
    for (i, k), x in a.items():
        for (k2, j), y in b.items():
            if k == k2:
                out.setdefault((i, j), []).append(PAIR[sr.multiply](x, y))
    return {p: fold(sr.add, v) for p, v in out.items()}


def draw(rng, n, m, dtype, count=14):
    value = {"bool": lambda: rng.random() < 0.6, "int64": lambda: rng.randrange(1, 9), "fp64": lambda: rng.randrange(1, 40) / 4}[dtype]
    return {(rng.randrange(n), rng.randrange(m)): value() for _ in range(count)}


def matrix(spark, entries, n, m, dtype):
    return Matrix.from_coo(spark, n, m, [(*p, v) for p, v in entries.items()], dtype)


def got(container):
    return {tuple(r[:-1]) if container.kind == "matrix" else r[0]: r[-1] for r in container.entries()}


@pytest.mark.parametrize("name", sorted(sw.SEMIRINGS))
def test_products(spark, name):
    sr, rng = sw.SEMIRINGS[name], random.Random(name)
    a, b = draw(rng, 5, 4, sr.type), draw(rng, 4, 6, sr.type)
    x, y = {(k, 0): v for (k, _), v in draw(rng, 4, 1, sr.type, 3).items()}, {(0, k): v for (k, _), v in draw(rng, 4, 1, sr.type, 3).items()}
    ma, mb = matrix(spark, a, 5, 4, sr.type), matrix(spark, b, 4, 6, sr.type)
    vx = Vector.from_entries(spark, 4, [(k, v) for (k, _), v in x.items()], sr.type)
    vy = Vector.from_entries(spark, 4, [(k, v) for (_, k), v in y.items()], sr.type)
    out = ma.mxm(mb, name)
    assert got(out) == product(a, b, sr) and out.shape == (5, 6) and out.dtype == sr.type
    assert got(ma.mxv(vx, name)) == {i: v for (i, _), v in product(a, x, sr).items()}
    assert got(vy.vxm(mb, name)) == {j: v for (_, j), v in product(y, b, sr).items()}


@pytest.mark.parametrize("name", sorted(n for n, m in sw.MONOIDS.items() if m.type != "fp32"))
def test_monoids(spark, name):
    m, rng = sw.MONOIDS[name], random.Random(name)
    a, b = draw(rng, 3, 4, m.type, 8), draw(rng, 3, 4, m.type, 8)
    ma, mb = matrix(spark, a, 3, 4, m.type), matrix(spark, b, 3, 4, m.type)
    both = {p: PAIR[m.operator](a[p], b[p]) for p in a.keys() & b.keys()}
    assert got(ma.ewise_add(mb, name)) == a | b | both
    assert got(ma.ewise_mult(mb, name)) == both
    rows = {}
    for (i, _), v in a.items():
        rows.setdefault(i, []).append(v)
    assert got(ma.reduce(name)) == {i: fold(m.operator, v) for i, v in rows.items()}
    v = Vector.from_entries(spark, 4, [(0, list(a.values())[0])], m.type)
    assert v.reduce(name) == Scalar(list(a.values())[0], m.type)
    assert Vector.new(spark, 3, m.type).reduce(name).value == m.identity


@pytest.mark.parametrize("combine, expected", [(None, 8), ("plus", 8), ("times", 15), ("max", 5), ("min", 3)])
def test_repeated_positions(spark, combine, expected):
    assert Matrix.from_coo(spark, 2, 2, [(0, 0, 3), (0, 0, 5)], combine=combine).entries() == [(0, 0, expected)]
    assert Vector.from_entries(spark, 2, [(1, 3), (1, 5)], combine=combine).entries() == [(1, expected)]


def test_repeated_positions_of_other_kinds(spark):
    assert Matrix.from_coo(spark, 1, 1, [(0, 0, True), (0, 0, True)], "bool").entries() == [(0, 0, True)]
    signs = [(0, 0, -1), (0, 0, -3), (0, 0, 1), (0, 1, 0), (0, 1, 2**62), (0, 1, 2**62), (0, 2, -1), (0, 2, -1)]
    assert Matrix.from_coo(spark, 1, 3, signs, combine="times").entries() == [(0, 0, 3), (0, 1, 0), (0, 2, 1)]
    custom = Monoid("first_larger", lambda a, b: a * 0 + b * 0 + 7, 0, "int64")
    assert Vector.from_entries(spark, 2, [(0, 1), (0, 2), (1, 5)], combine=custom).entries() == [(0, 7), (1, 5)]


def test_literal_products(spark):
    a = Matrix.from_coo(spark, 2, 3, [(0, 1, 1), (0, 2, 2), (1, 0, 3)])
    b = Matrix.from_coo(spark, 3, 2, [(0, 0, 1), (1, 1, 4), (2, 0, 5)])
    assert a.mxm(b).entries() == [(0, 0, 10), (0, 1, 4), (1, 0, 3)]
    assert a.T.entries() == [(0, 1, 3), (1, 0, 1), (2, 0, 2)] and a.T.shape == (3, 2)
    w = Matrix.from_coo(spark, 4, 4, [(0, 1, 2), (1, 2, 3), (2, 3, 1), (3, 0, 4)])
    assert w.mxm(w, "min_plus").entries() == [(0, 2, 5), (1, 3, 4), (2, 0, 5), (3, 1, 6)]
    g = Matrix.from_coo(spark, 1, 2, [(0, 0, 1), (0, 1, 7)])
    h = Matrix.from_coo(spark, 2, 1, [(0, 0, 3), (1, 0, 5)])
    assert [g.mxm(h, s).entries()[0][2] for s in ("max_plus", "max_min", "plus_min")] == [12, 5, 6]
    assert a.mxm(b, Semiring("largest_difference", "minus", "max", None, None, "int64")).entries() == [(0, 0, -3), (0, 1, -3), (1, 0, 2)]
    assert a.mxm(b, "lor_land").entries() == [(0, 0, True), (0, 1, True), (1, 0, True)]


def test_masks_and_descriptors(spark):
    a = Matrix.from_coo(spark, 3, 3, [(i, j, i * 3 + j + 1) for i in range(3) for j in range(3)])
    m = Matrix.from_coo(spark, 3, 3, [(0, 0, 1), (1, 1, 0), (2, 2, 5)])
    full = got(a.mxm(a))
    value = Descriptor(mask="value")
    assert got(a.mxm(a, mask=Mask(m))) == {p: full[p] for p in [(0, 0), (1, 1), (2, 2)]}
    assert got(a.mxm(a, mask=Mask(m), descriptor=value)) == {p: full[p] for p in [(0, 0), (2, 2)]}
    assert got(a.mxm(a, mask=Mask.of_complement(m))) == {p: v for p, v in full.items() if p[0] != p[1]}
    assert got(a.mxm(a, mask=Mask.of_complement(m), descriptor=value)) == {p: v for p, v in full.items() if p not in [(0, 0), (2, 2)]}
    assert got(a.mxm(a, descriptor=Descriptor().inp0_transpose())) == got(a.T.mxm(a))
    assert got(a.mxm(a, descriptor=Descriptor().inp1_transpose().replace_output())) == got(a.mxm(a.T))
    assert got(a.ewise_add(a, mask=Mask(m))) == {(k, k): 2 * (4 * k + 1) for k in range(3)}
    v = Vector.from_entries(spark, 3, [(0, 1), (1, 0)])
    assert got(a.mxv(v, mask=Mask(v))) == {0: 1, 1: 4}
    assert got(v.vxm(a, mask=Mask(v, True))) == {2: 3}
    assert got(a.mxv(v, descriptor=Descriptor(inp0=True))) == got(v.vxm(a)) and got(v.vxm(a, descriptor=Descriptor(inp1=True))) == got(a.mxv(v))
    assert got(a.reduce(descriptor=Descriptor(inp0=True))) == {0: 12, 1: 15, 2: 18} and got(a.reduce(mask=Mask(v))) == {0: 6, 1: 15}
    assert got(a.transpose(mask=Mask(m))) == {(0, 0): 1, (1, 1): 5, (2, 2): 9}
    bools = Matrix.from_coo(spark, 3, 3, [(0, 0, True), (0, 1, False)], "bool")
    assert got(a.ewise_mult(a, mask=Mask(bools), descriptor=value)) == {(0, 0): 1}
    with pytest.raises(GraphError) as e:
        a.mxm(a, mask=Mask(v))
    assert e.value.reason == ("mask_type_mismatch", "vector", "matrix")


def test_point_access_and_export(spark):
    a = Matrix.from_coo(spark, 2, 3, [(0, 1, 5), (1, 2, 0)])
    assert (a.nvals(), a.shape, a.extract(0, 1), a.extract(0, 0), a.extract(1, 2)) == (2, (2, 3), 5, 0, 0)
    assert a.set(0, 1, 7).set(1, 0, 2).entries() == [(0, 1, 7), (1, 0, 2), (1, 2, 0)] and a.extract(0, 1) == 5
    assert [r.row for r in a.to_dense().orderBy("i").collect()] == [[0, 5, 0], [0, 0, 0]]
    assert a.dup().entries() == a.entries()
    v = Vector.from_entries(spark, 4, [(2, 1.5)], "fp64")
    assert (v.to_list(), v.extract(2), v.extract(0), v.set(0, 2).to_list()) == ([0.0, 0.0, 1.5, 0.0], 1.5, 0.0, [2.0, 0.0, 1.5, 0.0])
    many = spark.createDataFrame([(0, 9), (3, 8)], "i long, v long")
    assert Vector.from_entries(spark, 4, [(0, 1), (1, 2)]).set_many(many).entries() == [(0, 9), (1, 2), (3, 8)]
    assert v.apply("negate_fp").to_list() == [0.0, 0.0, -1.5, 0.0] and v.apply(lambda x: x * 2).extract(2) == 3.0
    assert Vector.from_entries(spark, 2, [(0, True), (1, False)], "bool").apply("l_not").to_list() == [False, True]
    assert Vector.from_entries(spark, 2, [(0, -4)]).apply("abs_val").apply("negate_int").to_list() == [-4, 0]


def test_from_df(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (1, None, 1.0), (5, 0, 1.0)], "a long, b long, c double")
    assert Matrix.from_df(df.where("a < 1"), 2, 2, "a", "b", "c").entries() == [(0, 1, 5)]
    with pytest.raises(GraphError) as e:
        Matrix.from_df(df.where("b is not null"), 2, 2, "a", "b", "c", check=True)
    assert e.value.reason == ("index_out_of_bounds", 5, "row", 2)
    with pytest.raises(GraphError, match="nulls"):
        Matrix.from_df(df, 2, 2, "a", "b", "c", check=True)
    # without a job of its own, where rows are read
    for wrong in ("b is null", "a = 5", "a = 1"):
        with pytest.raises(Exception, match="index_out_of_bounds"):
            Matrix.from_df(df.where(wrong), 2, 2, "a", "b", "c").nvals()
    with pytest.raises(Exception, match="index_out_of_bounds"):
        Vector.from_df(df, 5, "a", "c", "fp64", unique=True).nvals()


def test_products_are_exact(spark):
    big = [3**20, -(2**31), 1, -1, 1]
    rows = [(0, k, v) for k, v in enumerate(big)] + [(1, k, 2) for k in range(62)] + [(2, 0, 0)] + [(2, k + 1, 10**9 + k) for k in range(300)] + [(3, k, -1) for k in range(301)]
    found = dict(Matrix.from_coo(spark, 5, 400, rows).reduce("times").entries())
    assert found == {0: 3**20 * 2**31, 1: 2**62, 2: 0, 3: -1}
    with pytest.raises(Exception, match="overflow"):
        Matrix.from_coo(spark, 1, 70, [(0, k, 2) for k in range(63)]).reduce("times").entries()
    assert Vector.new(spark, 3).reduce("times").value == 1
    assert Vector.from_entries(spark, 3, [(0, 2.0), (1, 4.0)], "fp64").reduce("times_fp32").value == 8.0
    assert Vector.from_entries(spark, 3, [(0, 2.0), (1, 4.0)], "fp64").reduce("plus_fp32").value == 6.0


def test_own_monoids_fold_in_parts(spark, monkeypatch):
    monkeypatch.setattr(algebra, "FOLD", 8)
    bits = Monoid("bits", lambda a, b: a.bitwiseXOR(b), 0, "int64")
    rows = [(k % 3, k, k * 7919) for k in range(700)]
    expected = {}
    for i, _, v in rows:
        expected[i] = expected.get(i, 0) ^ v
    assert dict(Matrix.from_coo(spark, 3, 700, rows).reduce(bits).entries()) == expected
    assert Vector.from_entries(spark, 700, [(k, v) for _, k, v in rows]).reduce(bits).value == expected[0] ^ expected[1] ^ expected[2]


def test_empty_extents(spark):
    a = Matrix.new(spark, 0, 0)
    assert (a.nvals(), a.to_dense().collect(), Vector.new(spark, 0).to_list(), a.mxm(a).entries()) == (0, [], [], [])
    assert Matrix.new(spark, 2, 0).to_dense().orderBy("i").first().row == []


@pytest.mark.parametrize(
    "make, reason",
    [
        (lambda s: Matrix.new(s, 2, 2, "int8"), ("unsupported_type", "int8")),
        (lambda s: Vector.new(s, 2, "fp32"), ("unsupported_type", "fp32")),
        (lambda s: Matrix.new(s, -1, 2), ("invalid_argument", "dimensions must not be negative")),
        (lambda s: Vector.new(s, -1), ("invalid_argument", "size must not be negative")),
        (lambda s: Matrix.from_coo(s, 2, 2, [(0, 2, 1)]), ("index_out_of_bounds", 2, "col", 2)),
        (lambda s: Matrix.from_coo(s, 2, 2, [(3, 5, 1)]), ("index_out_of_bounds", 3, "row", 2)),
        (lambda s: Vector.from_entries(s, 2, [(-1, 1)]), ("index_out_of_bounds", -1, "index", 2)),
        (lambda s: Matrix.new(s, 2, 3).mxm(Matrix.new(s, 2, 3)), ("dimension_mismatch", 3, 2)),
        (lambda s: Matrix.new(s, 2, 3).mxv(Vector.new(s, 2)), ("dimension_mismatch", 3, 2)),
        (lambda s: Vector.new(s, 3).vxm(Matrix.new(s, 2, 3)), ("dimension_mismatch", 3, 2)),
        (lambda s: Matrix.new(s, 2, 3).ewise_add(Matrix.new(s, 3, 2)), ("dimension_mismatch", (3, 2), (2, 3))),
        (lambda s: Vector.new(s, 3).set(3, 1), ("index_out_of_bounds", 3, "index", 3)),
        (lambda s: Matrix.new(s, 3, 3).extract(0, 9), ("index_out_of_bounds", 9, "index", 3)),
        (lambda s: Matrix.new(s, 2, 2).mxm(Matrix.new(s, 2, 2), "nope"), ("unknown_semiring", "nope")),
        (lambda s: Matrix.new(s, 2, 2).reduce("nope"), ("unknown_monoid", "nope")),
    ],
)
def test_errors(spark, make, reason):
    with pytest.raises(GraphError) as e:
        make(spark)
    assert e.value.reason == reason and reason[0].replace("_", " ") in str(e.value)


def test_overflow_is_an_error(spark):
    with pytest.raises(Exception, match="OVERFLOW"):
        Matrix.from_coo(spark, 1, 1, [(0, 0, 2**62)] * 2).entries()


def test_registries():
    from semiweave.types import infer_type, type_size

    assert (len(sw.SEMIRINGS), len(sw.MONOIDS), len(sw.BINARY), len(sw.UNARY)) == (12, 13, 8, 5)
    assert [infer_type(x) for x in ([True], [1, 2.0], [True, 1], [])] == ["bool", "fp64", "int64", "int64"]
    assert [type_size(t) for t in ("bool", "int16", "fp32", "uint64")] == [1, 2, 4, 8]
    assert Scalar.zero("min_fp64").value == 1.7976931348623157e308 and Scalar.zero("max").value == -(2**63)
    assert sw.info()["engine"] == "spark"


@pytest.mark.parametrize("row", [(None, 1, 1), (1, None, 1), (1, 1, None), (9, 1, 1), (1, -1, 1)])
@pytest.mark.parametrize("unique", [True, False])
def test_wrong_rows_fail_in_every_plan(spark, row, unique):
    df = spark.createDataFrame([(0, 0, 5), (0, 1, 6), row], "i long, j long, v long")
    bad = Matrix.from_df(df, 2, 2, unique=unique)
    good = Matrix.from_coo(spark, 2, 2, [(0, 0, 1), (1, 1, 1)])
    vector = Vector.from_entries(spark, 2, [(0, 2)])
    uses = [
        lambda: bad.mxv(vector).entries(), lambda: vector.vxm(bad).entries(), lambda: bad.mxm(good).entries(), lambda: good.ewise_mult(bad).entries(), lambda: bad.extract(0, 0), lambda: bad.nvals(),
        lambda: bad.df.where("v > 5").collect(), lambda: bad.df.where("i = 0 and j = 0").collect(), lambda: good.ewise_mult(good, mask=Mask(bad)).entries(), lambda: bad.reduce().entries(), lambda: bad.df.where("i = 1").select("j").collect(),
    ]
    for use in uses:
        with pytest.raises(Exception, match="index_out_of_bounds"):
            use()


@pytest.mark.parametrize("name", ["plus_times", "min_plus_fp64", "lor_land"])
def test_masked_products_form_no_other_term(spark, name, monkeypatch):
    from semiweave.operators import containers

    sr, rng = sw.SEMIRINGS[name], random.Random(name)
    a, b = draw(rng, 30, 30, sr.type, 300), draw(rng, 30, 30, sr.type, 300)
    at = {(rng.randrange(30), rng.randrange(30)): rng.randrange(2) for _ in range(25)}
    full, terms, through = product(a, b, sr), [], containers.through_mask
    monkeypatch.setattr(containers, "through_mask", lambda *x: terms.append(through(*x)) or terms[-1])
    m, ma, mb = matrix(spark, at, 30, 30, "int64"), matrix(spark, a, 30, 30, sr.type), matrix(spark, b, 30, 30, sr.type)
    assert got(ma.mxm(mb, name, mask=Mask(m))) == {p: v for p, v in full.items() if p in at}
    assert terms[0].count() == sum(k == k2 and (i, j) in at for i, k in a for k2, j in b)
    assert got(ma.mxm(mb, name, mask=Mask(m), descriptor=Descriptor(mask="value"))) == {p: v for p, v in full.items() if at.get(p)}
    # a mask of nearly all positions is no place to start from
    wide = matrix(spark, {(i, j): 1 for i in range(30) for j in range(29)}, 30, 30, "int64")
    assert got(ma.mxm(mb, name, mask=Mask(wide))) == {p: v for p, v in full.items() if p[1] < 29} and len(terms) == 2
    assert got(ma.mxm(mb, name, mask=Mask(Matrix.new(spark, 30, 30)))) == {}


def test_a_heavy_inner_index_is_dealt_to_a_grid(spark, monkeypatch):
    from pyspark.sql import functions as F

    from semiweave.operators.products import spread

    n, limit = 1_000_000, 100_000
    left = spark.range(n).select(F.col("id").alias("i"), F.when(F.col("id") % 10 == 0, F.col("id") % 1000).otherwise(7).alias("k"), F.lit(1).cast("long").alias("x"))
    right = spark.range(3000).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("j"), F.lit(1).cast("long").alias("y"))
    # equal rows of one part stay together, and a task's share of the index is about the limit
    spread_out = spread(left, right.where("k < 1000"), limit)
    shares = spread_out.where("k = 7").groupBy(F.pmod(F.xxhash64("i", "x"), F.lit(10))).count().collect()
    assert spread_out.count() == n and max(r["count"] for r in shares) < 1.1 * limit
    assert "aat_" in spread_out._jdf.queryExecution().optimizedPlan().toString()
    rng, few = random.Random(2), {}
    a = {(rng.randrange(60), 0 if rng.random() < 0.7 else rng.randrange(9)): rng.randrange(1, 9) for _ in range(90)}
    b = {(0 if rng.random() < 0.7 else rng.randrange(9), rng.randrange(60)): rng.randrange(1, 9) for _ in range(90)}
    sr = sw.SEMIRINGS["plus_times"]
    monkeypatch.setattr(sw.config, "heavy_index", 5)
    ma, mb = matrix(spark, a, 60, 9, "int64"), matrix(spark, b, 9, 60, "int64")
    assert got(ma.mxm(mb)) == product(a, b, sr)
    v = {k: 1 + k for k in range(9)}
    assert got(ma.mxv(Vector.from_entries(spark, 9, list(v.items())))) == {i: x for (i, _), x in product(a, {(k, 0): x for k, x in v.items()}, sr).items()}
    assert got(Vector.from_entries(spark, 9, list(v.items())).vxm(mb)) == {j: x for (_, j), x in product({(0, k): x for k, x in v.items()}, b, sr).items()}


def test_scattered_rows_are_combined_where_they_join(spark):
    rows = spark.createDataFrame([(k % 7, k % 5, k) for k in range(60)], "i long, j long, v long")
    a, plain = (Matrix.from_df(rows, 7, 5, scattered=s) for s in (True, False))
    for op in (lambda m: m.mxm(m, descriptor=Descriptor(inp1=True)), lambda m: m.mxm(m, "min_plus_fp64", descriptor=Descriptor(inp0=True)), lambda m: m.apply("negate_int").mxm(m.transpose()), lambda m: m.set(0, 0, 9).T.mxm(m)):
        assert got(op(a)) == got(op(plain))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = a.mxm(a, descriptor=Descriptor(inp1=True)).df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the sides' exchanges by the inner index, and that of the sum
    assert plan.count("Exchange hashpartitioning") == 3


def test_ten_thousand_entries_set_one_by_one(spark, monkeypatch):
    from semiweave.operators import containers

    rng, n = random.Random(3), 200
    a = matrix(spark, {(k, k): k for k in range(n)}, n, n, "int64")
    expected, before = {(k, k): k for k in range(n)}, None
    for k in range(10_000):
        i, j, v = rng.randrange(n), rng.randrange(n), rng.randrange(100)
        a = a.set(i, j, v)
        expected[(i, j)] = v
        if k == 5000:
            before, then = a, dict(expected)
    plan = a.df._jdf.queryExecution().optimizedPlan().toString()
    assert a.nvals() == len(expected) and plan.count("Join") == 1 and plan.count("Union") == 1
    assert got(a) == expected and got(before) == then
    assert a.extract(*next(iter(expected))) == expected[next(iter(expected))] and a.extract(0, 0) == expected[(0, 0)]
    # one that comes after an earlier one doesn't change the later one
    other = before.set(1, 1, -5)
    assert other.extract(1, 1) == -5 and got(other) == then | {(1, 1): -5} and got(a) == expected
    monkeypatch.setattr(containers, "PENDING", 3)
    v = Vector.new(spark, 9)
    for k in range(9):
        v = v.set(k % 5, k)
    assert v.entries() == [(0, 5), (1, 6), (2, 7), (3, 8), (4, 4)] and v.pending < 4
    assert got(a.set(0, 1, 7).T) == {(j, i): x for (i, j), x in (expected | {(0, 1): 7}).items()}


def test_stored_matrices_join_without_a_shuffle(spark, tmp_path):
    rng = random.Random(4)
    entries = {(rng.randrange(40), rng.randrange(30)): rng.randrange(1, 9) for _ in range(300)}
    a = matrix(spark, entries, 40, 30, "int64")
    name = f"kept_{rng.randrange(10**9)}"
    s = a.write(name, buckets=4, path=f"file://{tmp_path}")
    assert s.shape == (40, 30) and s.dtype == "int64" and got(s) == entries
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    products = [s.mxm(s, descriptor=Descriptor(inp1=True)), s.T.mxm(s), s.mxm(s.T)]
    for p in products:
        below = p.df._jdf.queryExecution().executedPlan().toString()
        # the one exchange is that of the sum, above the join
        assert below.count("Exchange hashpartitioning") == 1 and below.index("Exchange") < below.index("SortMergeJoin")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got(products[0]) == got(a.mxm(a.T)) and got(products[1]) == got(a.T.mxm(a))
    assert got(s.set(0, 0, 5).mxm(s.T)) == got(a.set(0, 0, 5).mxm(a.T)) and got(s.mxm(s.T, "min_plus_fp64")) == got(a.mxm(a.T, "min_plus_fp64"))
    assert dict(Relation.new(40).with_matrix("p", Matrix.read(spark, name)).matrix("p").reduce().entries()) == dict(a.reduce().entries())
    Matrix.drop(spark, name)
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        Matrix.read(spark, name)


def test_products_in_row_blocks_shuffle_no_term(spark):
    rng = random.Random(6)
    entries = {(rng.randrange(40), rng.randrange(30)): rng.randrange(1, 9) for _ in range(300)}
    a = matrix(spark, entries, 40, 30, "int64")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = a.mxm(a.T, blocks=7).df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # nothing is exchanged above the join of the blocks' sides
    assert "Exchange" not in plan[: plan.index("SortMergeJoin")]
    for blocks in (1, 7, 40, 99):
        assert got(a.mxm(a.T, blocks=blocks)) == got(a.mxm(a.T)) and got(a.T.mxm(a, "min_plus_fp64", blocks=blocks)) == got(a.T.mxm(a, "min_plus_fp64"))
    assert Matrix.new(spark, 0, 5).mxm(Matrix.new(spark, 5, 2), blocks=3).nvals() == 0
    rel = Relation.new(40).with_matrix("p", Matrix(a.df, 40, 40)).with_matrix("q", Matrix(a.T.df, 40, 40))
    for path in (["p", "q"], ["p", "q", "p"]):
        assert got(rel.measured(*path).traverse(path, "plus_times", blocks=5)) == got(rel.traverse(path, "plus_times"))


def sold_lines(spark, path, copies=1):
    """Lines of 12 customers that buy 20 parts of 8 suppliers, and so many copies with shifted keys; (customer, part, supplier, quantity)."""
    rng = random.Random(3)
    one = [(rng.randrange(12), rng.randrange(20), rng.randrange(8), rng.randrange(1, 50)) for _ in range(600)]
    lines = [(c + 12 * k, p + 20 * k, s + 8 * k, q) for k in range(copies) for c, p, s, q in one]
    rows = [(n, p, s, float(q)) for n, (_, p, s, q) in enumerate(lines)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(n, x[0]) for n, x in enumerate(lines)], "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")
    for table, key, n in (("customer", "c_custkey", 12), ("part", "p_partkey", 20), ("nation", "n_nationkey", 2)):
        spark.range(n * copies).toDF(key).write.parquet(f"{path}/{table}.parquet")
    spark.range(8 * copies).selectExpr("id AS s_suppkey", "id % 2 AS s_nationkey").write.parquet(f"{path}/supplier.parquet")
    return lines


def shuffled(df):
    """(rows, bytes) of each shuffle that df has made, once for those used again."""
    df.collect()
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "ReusedExchangeExec":
            return
        if name == "ShuffleExchangeExec":
            metrics = node.metrics()
            found.append((metrics.apply("shuffleRecordsWritten").value(), metrics.apply("shuffleBytesWritten").value()))
        inner = node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan() if name.endswith("QueryStageExec") else None
        for below in [inner] if inner is not None else [node.children().apply(k) for k in range(node.children().size())]:
            walk(below)

    walk(df._jdf.queryExecution().executedPlan())
    return found


def similar(lines):
    sold, out = {}, {}
    for _, p, s, q in lines:
        sold.setdefault(p, {})[s] = sold.setdefault(p, {}).get(s, 0) + q
    for entries in sold.values():
        for a, x in entries.items():
            for b, y in entries.items():
                out[a, b] = out.get((a, b), 0) + x * y
    return out


def passed_on(lines, pair, least):
    bought, shipped, out = {}, {}, {}
    for c, p, s, q in lines:
        bought[c, p] = bought.get((c, p), 0) + q
        shipped[p, s] = shipped.get((p, s), 0) + q
    for (c, p), x in bought.items():
        for (r, s), y in shipped.items():
            if p == r:
                at, v = (c, s), pair(x, y)
                out[at] = least(out[at], v) if at in out else v
    return out


def test_similarity_shuffles_lines_once_and_lists(spark, tmp_path, monkeypatch):
    lines = sold_lines(spark, tmp_path, 3)
    monkeypatch.setattr(queries, "SUPPLIER_LINES", 300)
    df = queries.QUERIES["supplier_similarity"](spark, str(tmp_path))
    made = [rows for rows, _ in shuffled(df)]
    # the lines once for both sides, all else as lists of a part's entries
    assert sum(rows >= len(lines) for rows in made) == 1 and sum(made) < 2 * len(lines)
    assert {(r.i, r.j): r.v for r in df.collect()} == similar(lines)


def test_stored_buckets_grow_with_the_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "PART_LINES", 200)
    made, write = [], Matrix.write
    monkeypatch.setattr(Matrix, "write", lambda self, *args, **named: made.append(named["buckets"]) or write(self, *args, **named))
    for copies in (1, 4):
        lines = sold_lines(spark, f"{tmp_path}/{copies}", copies)
        df = queries.QUERIES["mxm_stored"](spark, f"{tmp_path}/{copies}")
        assert {(r.i, r.j): r.v for r in df.collect()} == similar(lines)
    assert made == [3, 12]
    # one file for each bucket
    a = Matrix.from_coo(spark, 50, 50, [(k, k * k % 50, 1) for k in range(50)])
    name = f"files_{random.randrange(10**9)}"
    s = a.write(name, buckets=3, path=f"file://{tmp_path}/files")
    assert len(s.df.inputFiles()) <= 3 and len(s.stored["j"].inputFiles()) <= 3 and got(s) == got(a)
    Matrix.drop(spark, name)


@pytest.mark.parametrize("name, pair, least", [("widest", min, max), ("cheapest", lambda x, y: x + y, min)])
def test_traversed_lines_are_shuffled_once_and_as_lists(spark, tmp_path, monkeypatch, name, pair, least):
    lines = sold_lines(spark, tmp_path, 3)
    monkeypatch.setattr(queries, "CUSTOMER_LINES", 150)
    n = len(lines)
    df = queries.QUERIES[f"traverse_{name}"](spark, str(tmp_path))
    made = [rows for rows, _ in shuffled(df)]
    # bought and shipped lines by part, besides what the join to the orders takes; all else is lists
    assert sum(rows >= n for rows in made) <= 4 and sum(rows for rows in made if rows < n) < n
    at_supplier = (12 + 20) * 3
    assert {(r.i, r.j - at_supplier): r.v for r in df.collect()} == passed_on(lines, pair, least)


def test_lists_of_many_indexes_are_cut(spark, monkeypatch):
    from semiweave.operators import products

    monkeypatch.setattr(products, "LIST_SPAN", 4)
    rng = random.Random(16)
    a = matrix(spark, {(rng.randrange(400), rng.randrange(5)): rng.randrange(1, 9) for _ in range(900)}, 400, 5, "int64")
    lists = products._listed(a.df.select("i", F.col("j").alias("k"), F.col("v").alias("x")), ["k"], "i", "x", 400).collect()
    assert max(len(r["is"]) for r in lists) <= 7 and sum(len(r["is"]) for r in lists) == a.nvals() and all(len(r["is"]) == len(r["xs"]) for r in lists)
    for blocks in (1, 3):
        assert got(a.mxm(a.T, blocks=blocks)) == got(a.mxm(a.T))
    wide = Matrix(a.df.withColumn("i", F.col("i") * (1 << 32)), 400 << 32, 5)
    assert {(i >> 32, j >> 32): v for (i, j), v in got(wide.mxm(wide.T, blocks=3)).items()} == got(a.mxm(a.T))


def test_sums_in_parts_take_as_many_tasks(spark):
    rows = spark.createDataFrame([(k % 7, k % 5, k) for k in range(60)], "i long, j long, v long")
    a, plain = Matrix.from_df(rows, 7, 5, parts=9), Matrix.from_df(rows, 7, 5)
    added = a.ewise_add(a, "plus", parts=9)
    assert a.df.rdd.getNumPartitions() == added.df.rdd.getNumPartitions() == 9
    assert got(a) == got(plain) and got(added) == got(plain.ewise_add(plain))
    assert got(a.ewise_add(a, "times", parts=9)) == got(plain.ewise_add(plain, "times"))


@pytest.mark.parametrize("name", ["times_fp64", "land", "lor", "lxor", "max", "max_fp64", "min", "min_fp64"])
def test_queries_add_lines_in_parts(spark, tmp_path, monkeypatch, name):
    lines = [(k % 7, k * k % 5, k % 50, "AR"[k % 3 % 2]) for k in range(60)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    for table, n in (("supplier", 7), ("part", 5)):
        spark.range(n).write.parquet(f"{tmp_path}/{table}.parquet")
    monkeypatch.setattr(queries, "PART_LINES", 8)
    df = queries.QUERIES[f"ewise_add_{name}"](spark, str(tmp_path))
    # 60 lines in parts of 8, whatever the number of shuffle partitions
    assert df.rdd.getNumPartitions() == 8
    m, sides = algebra.MONOIDS[name], {"A": {}, "R": {}}
    for i, j, v, flag in lines:
        sides[flag][i, j] = sides[flag].get((i, j), 0) + v
    value = lambda v: 1 + v % 3 if m.operator == "times" else v % 2 == 0 if m.type == "bool" else v
    wanted = {p: fold(m.operator, [value(s[p]) for s in sides.values() if p in s]) for p in sides["A"] | sides["R"]}
    assert {(r.i, r.j): r.v for r in df.collect()} == wanted


@pytest.mark.parametrize("name", ["times_fp64", "land", "lor", "lxor", "max", "max_fp64", "min", "min_fp64"])
def test_rows_of_a_task_do_not_grow_with_the_lines(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(queries, "PART_LINES", 500)
    largest = []
    for copies in (1, 8):
        folder, n = f"{tmp_path}/{copies}", 2000 * copies
        # each supplier sells each of its parts once
        spark.range(n).selectExpr("id div 10 AS l_suppkey", "id AS l_partkey", "1.0D + id % 50 AS l_quantity", "if(id % 2 = 0, 'A', 'R') AS l_returnflag").write.parquet(f"{folder}/lineitem.parquet")
        spark.range(n // 10).write.parquet(f"{folder}/supplier.parquet")
        spark.range(n).write.parquet(f"{folder}/part.parquet")
        tasks = queries.QUERIES[f"ewise_add_{name}"](spark, folder).selectExpr("spark_partition_id() AS task").groupBy("task").count()
        rows = [r["count"] for r in tasks.collect()]
        assert sum(rows) == n
        largest.append(max(rows))
    assert largest[1] < 1.5 * largest[0]


def test_products_masked_by_equal_labels(spark):
    from semiweave.operators.masks import EqualLabels

    rng = random.Random(8)
    a = matrix(spark, {(rng.randrange(40), rng.randrange(30)): rng.randrange(1, 9) for _ in range(300)}, 40, 30, "int64")
    # rows from 35 on have no label
    labels = Vector.from_entries(spark, 40, [(k, k % 4) for k in range(35)])
    whole = got(a.mxm(a.T))
    assert got(a.mxm(a.T, mask=EqualLabels(labels, labels))) == {(i, j): v for (i, j), v in whole.items() if i < 35 and j < 35 and i % 4 == j % 4}
    with pytest.raises(GraphError):
        a.mxm(a.T, mask=EqualLabels(labels, Vector.new(spark, 30)))
