"""Algorithms and relations: literal graphs, and random ones against dictionaries."""

import random

import pytest

import semiweave as sw
from semiweave import GraphError, Matrix, Relation, Vector
from semiweave.plans import algorithms
from semiweave.sources import graphs


def bools(spark, n, edges):
    return Matrix.from_coo(spark, n, n, [(*e, True) for e in edges], "bool")


def both_ways(edges):
    return sorted({(a, b) for a, b in edges} | {(b, a) for a, b in edges})


def test_breadth_first(spark):
    chain = graphs.chain(spark, 5)
    assert sw.bfs_levels(chain, 0).entries() == [(k, k) for k in range(5)]
    assert sw.bfs_reach(chain, 3).entries() == [(3, True), (4, True)]
    assert sw.bfs_levels(chain, 0, max_iter=2).entries() == [(0, 0), (1, 1), (2, 2)]
    assert sw.bfs_reach(graphs.cycle(spark, 4), 2).nvals() == 4
    assert sw.bfs_levels(graphs.star(spark, 4), 0).entries() == [(0, 0), (1, 1), (2, 1), (3, 1)]
    stored_false = Matrix.from_coo(spark, 2, 2, [(0, 1, False)], "bool")
    assert sw.bfs_reach(stored_false, 0).nvals() == 2
    for f in (sw.bfs_reach, sw.bfs_levels, sw.sssp):
        with pytest.raises(GraphError) as e:
            f(chain, 5)
        assert e.value.reason[:3] == ("index_out_of_bounds", 5, "source")


def test_shortest_paths(spark):
    edges = [(0, 1, 2), (0, 2, 10), (1, 2, 3), (1, 3, 7), (2, 3, 1), (3, 4, 2)]
    assert sw.sssp(Matrix.from_coo(spark, 6, 6, edges, "fp64"), 0).entries() == [(0, 0.0), (1, 2.0), (2, 5.0), (3, 6.0), (4, 8.0)]
    negative = Matrix.from_coo(spark, 3, 3, [(0, 1, 5), (0, 2, 2), (2, 1, -4)], "fp64")
    assert sw.sssp(negative, 0).entries() == [(0, 0.0), (1, -2.0), (2, 2.0)]
    rng = random.Random(1)
    n, edges = 12, {}
    for _ in range(40):
        edges[(rng.randrange(12), rng.randrange(12))] = rng.randrange(1, 20)
    d = {0: 0.0}
    for _ in range(n):
        for (a, b), w in edges.items():
            if a in d:
                d[b] = min(d.get(b, 1e9), d[a] + w)
    assert sw.sssp(Matrix.from_coo(spark, n, n, [(*p, w) for p, w in edges.items()], "fp64"), 0).entries() == sorted(d.items())


def test_triangles(spark):
    assert sw.triangle_count(bools(spark, 4, both_ways([(a, b) for a in range(4) for b in range(a)]))) == 4
    assert sw.triangle_count(bools(spark, 3, both_ways([(0, 1), (1, 2), (2, 0)]))) == 1
    assert sw.triangle_count(bools(spark, 4, both_ways([(0, 1), (1, 2), (2, 3)]))) == 0
    assert sw.triangle_count(Matrix.new(spark, 3, 3, "bool")) == 0
    # what loops add to the product
    assert sw.triangle_count(bools(spark, 3, both_ways([(0, 1), (1, 2), (2, 0)]) + [(0, 0)])) == 2


def test_components(spark):
    assert sw.connected_components(bools(spark, 6, both_ways([(0, 1), (2, 3)]))).to_list() == [0, 0, 2, 2, 4, 5]
    assert sw.connected_components(graphs.undirected(graphs.chain(spark, 40))).to_list() == [0] * 40
    assert sw.connected_components(bools(spark, 3, [(2, 1), (1, 0)]), undirected=False).to_list() == [0, 1, 2]
    assert sw.connected_components(bools(spark, 3, [(0, 1), (2, 1)]), undirected=False).to_list() == [0, 0, 2]
    rng = random.Random(2)
    edges, group = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)], list(range(60))
    for _ in range(60):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    assert sw.connected_components(bools(spark, 60, both_ways(edges))).to_list() == group


def test_degrees(spark):
    d = sw.degree(graphs.star(spark, 5))
    assert d["out_degree"].entries() == [(0, 4)] and d["in_degree"].entries() == [(k, 1) for k in range(1, 5)]
    d = sw.degree(Matrix.from_coo(spark, 3, 3, [(0, 1, 2.9), (0, 2, 1.2)], "fp64"))
    assert d["out_degree"].entries() == [(0, 3)]


@pytest.mark.parametrize(
    "edges, n, teleport, expected",
    [
        ([(0, 1), (0, 2), (1, 2), (2, 0), (2, 3), (3, 2)], 4, "dense", [0.219914, 0.130964, 0.429209, 0.219914]),
        ([(0, 1), (0, 2), (1, 2), (2, 0), (2, 3), (3, 2)], 4, "stored", [0.219914, 0.130964, 0.429209, 0.219914]),
        ([(0, 1), (1, 2)], 3, "dense", [0.184417, 0.341171, 0.474413]),
        ([(0, 1), (1, 2)], 3, "stored", [0.0, 0.0, 0.0]),
        ([(0, k) for k in range(1, 5)], 5, "dense", [0.170940] + [0.207265] * 4),
        ([(0, k) for k in range(1, 5)], 5, "stored", [0.0] * 5),
    ],
)
def test_pagerank(spark, edges, n, teleport, expected):
    found = sw.pagerank(bools(spark, n, edges), max_iter=50, teleport=teleport)
    assert found.to_list() == pytest.approx(expected, abs=2e-6)
    assert teleport == "dense" or expected[0] or found.nvals() == 0


def test_fixed_point(spark):
    a = graphs.cycle(spark, 4)
    start = Vector.from_entries(spark, 4, [(0, True)], "bool")
    step = lambda v: v.ewise_add(v.vxm(a, "lor_land"), "lor")
    found, info = sw.fixed_point(start, step)
    assert found.nvals() == 4 and info == {"iterations": 4, "converged": True}
    assert sw.fixed_point(start, step, max_iter=1)[1] == {"iterations": 1, "converged": False}
    assert sw.fixed_point(start, step, max_iter=0) == (start, {"iterations": 0, "converged": False})
    halves = Vector.from_entries(spark, 2, [(0, 1.0)], "fp64")
    found, info = sw.fixed_point(halves, lambda v: v.apply(lambda x: x / 2), tol=0.1)
    assert info == {"iterations": 4, "converged": True} and found.extract(0) == 0.0625
    assert sw.fixed_point(1, lambda x: x + 1, max_iter=9, converged=lambda a, b: b == 4)[0] == 4
    assert not sw.fixed_point(start, lambda v: a, max_iter=1)[1]["converged"]


def test_traverse(spark):
    rel = Relation.new(4).add_triples(spark, "follows", [(0, 1), (0, 3)]).add_triples(spark, "likes", [(1, 2), (3, 2)]).add_weighted_triples(spark, "pays", [(0, 1, 5), (1, 2, 3), (0, 2, 10)])
    assert rel.predicates() == ["follows", "likes", "pays"]
    assert rel.traverse(["follows", "likes"], "lor_land").entries() == [(0, 2, True)]
    assert rel.traverse(["follows", "likes"], "plus_times").entries() == [(0, 2, 2)]
    assert rel.traverse(["pays", "pays"], "min_plus").entries() == [(0, 2, 8)]
    assert rel.traverse(["pays", "likes"], "max_min").entries() == [(0, 2, 1)]
    assert rel.traverse(["follows"], "plus_times").dtype == "bool"
    for path, reason in (([], ("empty_predicate_path",)), (["follows", "x"], ("unknown_predicate", "x")), (["x"], ("unknown_predicate", "x"))):
        with pytest.raises(GraphError) as e:
            rel.traverse(path)
        assert e.value.reason == reason
    again = rel.add_triples(spark, "follows", [(0, 1), (2, 2)]).add_weighted_triples(spark, "pays", [(0, 1, 4)])
    assert again.matrix("follows").entries() == [(0, 1, True), (0, 3, True), (2, 2, True)] and again.matrix("pays").extract(0, 1) == 9


def test_closure(spark):
    chain = Relation.new(4).add_triples(spark, "p", [(0, 1), (1, 2), (2, 3)])
    found, info = chain.closure("p")
    assert [e[:2] for e in found.entries()] == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)] and info == {"iterations": 3, "converged": True}
    assert Relation.new(3).add_triples(spark, "p", [(0, 1), (1, 2), (2, 0)]).closure("p")[0].nvals() == 9
    w = Relation.new(3).add_weighted_triples(spark, "p", [(0, 1, 5), (1, 2, 3), (0, 2, 10)])
    found, info = w.closure("p", "min_plus")
    assert found.entries() == [(0, 1, 5), (0, 2, 8), (1, 2, 3)] and info == {"iterations": 2, "converged": True}
    counts = Relation.new(3).add_triples(spark, "p", [(0, 1), (1, 2)])
    found, info = counts.closure("p", "plus_times", max_iter=8)
    assert found.entries() == [(0, 1, 1), (0, 2, 8), (1, 2, 1)] and not info["converged"]
    with pytest.raises(GraphError):
        counts.closure("q")


def test_generators(spark):
    assert graphs.random_graph(spark, 30, 0.1).nvals() > 40
    g = graphs.random_graph(spark, 20, 0.1, undirected=True, dtype="fp64")
    e = {(i, j): v for i, j, v in g.entries()}
    assert all(e[(j, i)] == v for (i, j), v in e.items())
    assert algorithms.degree(graphs.chain(spark, 0))["out_degree"].nvals() == 0


@pytest.mark.parametrize("semiring", ["plus_times", "min_plus", "lor_land", "plus_min"])
def test_long_paths_in_any_order(spark, semiring):
    rng = random.Random(semiring)
    rel = Relation.new(9)
    for name, count in (("a", 40), ("b", 30), ("c", 5)):
        rel = rel.add_weighted_triples(spark, name, [(rng.randrange(9), rng.randrange(9), rng.randrange(1, 6)) for _ in range(count)])
    a, b, c = (rel.matrix(x) for x in "abc")
    assert rel.traverse(["a", "b", "c"], semiring).entries() == a.mxm(b, semiring).mxm(c, semiring).entries()
    assert rel.traverse(["c", "b", "a"], semiring).entries() == c.mxm(b, semiring).mxm(a, semiring).entries()


def test_a_vertex_of_many_edges_is_dealt_to_several_parts(spark, monkeypatch):
    monkeypatch.setattr(algorithms, "HEAVY", 5)
    rng = random.Random(8)
    edges = {(0, k) for k in range(1, 40)} | {(rng.randrange(40), rng.randrange(40)) for _ in range(90)}
    a = bools(spark, 40, edges)
    levels = dict(sw.bfs_levels(a, 0).entries())
    assert levels == {0: 0} | {k: 1 for k in range(1, 40)}
    weights = Matrix.from_coo(spark, 40, 40, [(i, j, 1.0 + (i * j) % 7) for i, j in edges], "fp64")
    best = {0: 0.0}
    for _ in range(40):
        for i, j in edges:
            if i in best:
                best[j] = min(best.get(j, 1e9), best[i] + 1.0 + (i * j) % 7)
    assert dict(sw.sssp(weights, 0).entries()) == best


def test_least_vertex_that_reaches(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(35)}
    reach = {v: {v} for v in range(30)}
    for _ in range(30):
        for i, j in edges:
            reach[j] |= reach[i]
    assert dict(sw.connected_components(bools(spark, 30, edges), undirected=False).entries()) == {v: min(x) for v, x in reach.items()}


def test_cycles_of_negative_weight_are_an_error(spark):
    a = Matrix.from_coo(spark, 3, 3, [(0, 1, 1.0), (1, 2, -3.0), (2, 1, 1.0)], "fp64")
    with pytest.raises(GraphError, match="negative"):
        sw.sssp(a, 0)
    assert dict(sw.sssp(a, 0, max_iter=2).entries()) == {0: 0.0, 1: 1.0, 2: -2.0}


def closure_of(edges, add, times):
    """By trying all paths until nothing changes."""
    found = dict(edges)
    while True:
        new = dict(found)
        for (i, k), x in found.items():
            for (k2, j), y in edges.items():
                if k == k2:
                    v = times(x, y)
                    new[(i, j)] = add(new[(i, j)], v) if (i, j) in new else v
        if new == found:
            return found
        found = new


@pytest.mark.parametrize("semiring, add, times", [("min_plus", min, lambda a, b: a + b), ("max_min", max, min), ("lor_land", lambda a, b: a or b, lambda a, b: a and b), ("land_lor", lambda a, b: a and b, lambda a, b: a or b)])
def test_closures_by_doubling(spark, semiring, add, times):
    rng = random.Random(semiring)
    dtype = "bool" if semiring in ("lor_land", "land_lor") else "int64"
    edges = {(rng.randrange(14), rng.randrange(14)): rng.random() < 0.5 if dtype == "bool" else rng.randrange(1, 40) for _ in range(26)}
    rel = Relation.new(14).with_matrix("p", Matrix.from_coo(spark, 14, 14, [(*e, v) for e, v in edges.items()], dtype))
    found, info = rel.closure("p", semiring)
    assert {(i, j): v for i, j, v in found.entries()} == closure_of(edges, add, times) and info["converged"]


def test_closure_of_a_long_path_takes_few_rounds(spark):
    n = 150
    rel = Relation.new(n).with_matrix("p", graphs.chain(spark, n))
    found, info = rel.closure("p")
    assert found.nvals() == n * (n - 1) // 2 and info == {"iterations": 9, "converged": True}
    falling = Matrix.from_coo(spark, 3, 3, [(0, 1, 1), (1, 0, -3)], "int64")
    assert not Relation.new(3).with_matrix("p", falling).closure("p", "min_plus")[1]["converged"]


def test_closure_stops_when_the_front_is_empty(spark):
    from semiweave.plans import relations

    n, made, times = 40, [], relations.Semiring.times
    relations.Semiring.times = lambda self, a, b: made.append((a, b)) or times(self, a, b)
    try:
        found, info = Relation.new(n).with_matrix("p", graphs.chain(spark, n)).closure("p")
    finally:
        relations.Semiring.times = times
    # one product for each round that has a front: paths of 1, 2, 4 ... 32 edges
    assert found.nvals() == n * (n - 1) // 2 and info["converged"] and len(made) == 6


def test_closure_goes_on_where_it_was_cut_off(spark, monkeypatch):
    from semiweave import checkpoints

    n = 40
    rel = Relation.new(n).with_matrix("p", graphs.chain(spark, n))
    run, append, calls = f"cut-{random.random()}", checkpoints.Layers.append, []

    def failing(self, df):
        calls.append(1)
        if len(calls) == 4:
            raise KeyboardInterrupt
        return append(self, df)

    monkeypatch.setattr(checkpoints.Layers, "append", failing)
    with pytest.raises(KeyboardInterrupt):
        rel.closure("p", run=run)
    assert rel.closure("p", run=run)[0].nvals() == n * (n - 1) // 2
    # three rounds were there, and the rest was made once
    assert len(calls) == 4 + 5
    checkpoints.forget_run(spark, run)
    assert checkpoints.Layers(spark, run).count == 0


@pytest.mark.parametrize("semiring", ["plus_times", "min_plus", "lor_land"])
def test_brackets_by_sizes(spark, semiring, monkeypatch):
    from semiweave.plans import relations, sizes

    rng = random.Random(semiring)
    rel = Relation.new(30)
    for name, rows, cols in (("a", 30, 30), ("b", 30, 30), ("c", 30, 2), ("d", 2, 30)):
        rel = rel.add_weighted_triples(spark, name, {(rng.randrange(rows), rng.randrange(cols)): 0 for _ in range(150)} and [(i, j, 1 + (i + j) % 5) for i, j in {(rng.randrange(rows), rng.randrange(cols)) for _ in range(150)}])
    measured, orders = rel.measured(), []
    monkeypatch.setattr(relations, "best_order", lambda s: orders.append(sizes.best_order(s)) or orders[-1])
    for path in ("abcd", "dabc", "cda", "abab"):
        assert measured.traverse(list(path), semiring).entries() == rel.traverse(list(path), semiring).entries()
    # the narrow matrix is met first
    assert orders[0] == ((0, (1, 2)), 3) and len(orders) == 4
    s = measured.sizes["a"]
    assert s.nvals == rel.matrix("a").nvals() and s.rows.reach == 1 and sum(s.rows.counts.values()) == s.nvals
    assert round(s.cols.joined(measured.sizes["b"].rows)) == len([1 for _, j, _ in rel.matrix("a").entries() for i, _, _ in rel.matrix("b").entries() if i == j])


def test_samples_merge_and_estimate(monkeypatch):
    from semiweave.plans import sizes

    monkeypatch.setattr(sizes, "SAMPLE", 500)
    rng = random.Random(1)
    hashes = [rng.randrange(sizes.SPAN) for _ in range(20_000)]
    x, y = {h: rng.randrange(1, 9) for h in hashes}, {h: rng.randrange(1, 9) for h in hashes[5_000:]}
    a, b = sizes.Sample.of(x), sizes.Sample.of(y)
    halves = [sizes.Sample.of({h: n for h, n in x.items() if h % 2 == k}) for k in (0, 1)]
    merged = halves[0].merge(halves[1])
    assert all(x[h] == n for h, n in merged.counts.items())
    for sample in (a, merged):
        assert sample.distinct() == pytest.approx(20_000, rel=0.15)
        assert sample.joined(b) == pytest.approx(sum(n * y.get(h, 0) for h, n in x.items()), rel=0.2)


def test_triangles_of_any_matrix_equal_the_product(spark):
    rng = random.Random(12)
    for loops, symmetric in ((True, False), (False, True), (True, True)):
        edges = {(rng.randrange(18), rng.randrange(18)) for _ in range(110)}
        edges = {(i, j) for i, j in edges if loops or i != j}
        edges |= {(j, i) for i, j in edges} if symmetric else set()
        low = {(i, j) for i, j in edges if i > j}
        terms = sum((k, j) in edges and (i, j) in low for i, k in low for j in range(18))
        assert sw.triangle_count(bools(spark, 18, sorted(edges))) == terms // 2


def test_wedges_of_a_star_are_few(spark):
    n = 3000
    edges = [(0, k) for k in range(1, n)] + [(1, k) for k in range(2, n)]
    found = spark.createDataFrame([(max(e), min(e), True, True) for e in edges], "a long, b long, low boolean, up boolean")
    wedges = algorithms._wedges(algorithms._oriented(found), 10)
    assert wedges.count() == n - 2
    assert sw.triangle_count(bools(spark, n, both_ways(edges))) == n - 2


def test_triangles_in_blocks_shuffle_no_path(spark, monkeypatch):
    rng, n = random.Random(5), 40
    for block_edges in (1_000_000, 13):
        monkeypatch.setattr(algorithms, "BLOCK_EDGES", block_edges)
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(500)}
        low = {(i, j) for i, j in edges if i > j}
        terms = sum((k, j) in edges and (i, j) in low for i, k in low for j in range(n))
        counted = algorithms.triangle_count_df(bools(spark, n, sorted(edges)))
        plan = counted._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("shufflepartitionidpassthrough")]
        # two joins by the blocks' hash tables, and only the counts are exchanged above them
        assert above.count("ShuffledHashJoin") == 2 and above.count("Exchange") == above.count("Exchange SinglePartition") + 1 and "Sort" not in above
        assert counted.first()[0] == terms // 2


def test_triangles_of_few_wedges_join_these(spark):
    edges = [(k, k + 1) for k in range(60)] + [(0, 2), (30, 32)]
    counted = algorithms.triangle_count_df(bools(spark, 61, both_ways(edges)))
    assert "shufflepartitionidpassthrough" not in counted._jdf.queryExecution().executedPlan().toString()
    assert counted.first()[0] == 2


def test_directed_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    rounds, heads = [], algorithms.settled
    monkeypatch.setattr(algorithms, "settled", lambda df: rounds.append(1) or heads(df))
    n = 10_000
    back = Matrix(spark.range(1, n).selectExpr("id as i", "id - 1 as j", "true as v"), n, n, "bool")
    assert sw.connected_components(back, undirected=False).df.where("v <> i").count() == 0
    assert len(rounds) <= 30
    assert sw.connected_components(graphs.chain(spark, n), undirected=False).df.where("v <> 0").count() == 0


def test_circles_with_branches(spark):
    # a circle 5-6-7 with a branch from it, another circle through a vertex of two in-edges, and a loop
    edges = [(5, 6), (6, 7), (7, 5), (6, 1), (1, 8), (3, 2), (2, 4), (4, 3), (0, 4), (9, 9), (8, 4)]
    reach = {v: {v} for v in range(10)}
    for _ in range(10):
        for i, j in edges:
            reach[j] |= reach[i]
    assert dict(sw.connected_components(bools(spark, 10, edges), undirected=False).entries()) == {v: min(x) for v, x in reach.items()}


def test_a_negative_cycle_is_found_within_its_length(spark, monkeypatch):
    from semiweave import checkpoints

    rounds, settled = [], checkpoints.Rounds.settled
    monkeypatch.setattr(checkpoints.Rounds, "settled", lambda self, df: rounds.append(1) or settled(self, df))
    n = 400
    edges = [(k, k + 1, 1.0) for k in range(n - 1)] + [(4, 2, -9.0)]
    with pytest.raises(GraphError, match="negative"):
        sw.sssp(Matrix.from_coo(spark, n, n, edges, "fp64"), 0)
    assert len(rounds) < 20


def test_paths_by_buckets_offer_fewer_edges(spark, monkeypatch):
    rng, n = random.Random(7), 40
    edges = {(i, j): (j - i) ** 2 + rng.random() for i in range(n) for j in range(i + 1, min(n, i + 9))}
    best = {0: 0.0}
    for i in range(n):
        for j in range(i + 1, n):
            if (i, j) in edges:
                best[j] = min(best.get(j, 1e9), best[i] + edges[i, j])
    a, offered, ahead = Matrix.from_coo(spark, n, n, [(*e, w) for e, w in edges.items()], "fp64"), [], algorithms._Edges.ahead
    monkeypatch.setattr(algorithms._Edges, "ahead", lambda self, frontier: offered.append(frontier.count()) or ahead(self, frontier))
    counts = []
    for delta in (None, 3.0):
        offered.clear()
        assert dict(sw.sssp(a, 0, delta=delta).entries()) == pytest.approx(best)
        counts.append(sum(offered))
    # light edges and heavy ones once each, where all else offers again and again
    assert counts[1] < counts[0]
    with pytest.raises(GraphError):
        sw.sssp(a, 0, delta=1.0, max_iter=3)
    with pytest.raises(GraphError, match="negative"):
        sw.sssp(Matrix.from_coo(spark, 4, 4, [(0, 1, 1.0), (1, 2, 1.0), (2, 1, -2.0), (2, 3, 1.0)], "fp64"), 0, delta=2.0)


def test_paths_go_on_where_they_were_cut_off(spark, monkeypatch):
    from semiweave import checkpoints

    n, run = 12, f"cut-{random.random()}"
    a = Matrix.from_coo(spark, n, n, [(k, k + 1, 1.0) for k in range(n - 1)], "fp64")
    settled, calls, kept = checkpoints.Rounds.settled, [], []

    def failing(self, df):
        calls.append(1)
        if len(calls) == 4:
            raise KeyboardInterrupt
        out = settled(self, df)
        kept.append(len(checkpoints._complete(spark, self.folder)))
        return out

    monkeypatch.setattr(checkpoints.Rounds, "settled", failing)
    with pytest.raises(KeyboardInterrupt):
        sw.sssp(a, 0, run=run)
    assert sw.sssp(a, 0, run=run).entries() == [(k, float(k)) for k in range(n)]
    # the source, eleven rounds that found a vertex and one that found none, without those before the cut
    assert len(calls) == 4 + 13 - 3 and max(kept) == 2
    checkpoints.forget_run(spark, run)
    assert checkpoints.Rounds(spark, run).last() is None


def test_ranks_that_have_settled_send_no_more(spark, monkeypatch):
    from semiweave import checkpoints

    rows, append = [], checkpoints.Layers.append
    monkeypatch.setattr(checkpoints.Layers, "append", lambda self, df: rows.append(append(self, df)) or rows[-1])
    monkeypatch.setattr(algorithms, "LAYERS", 4)
    rng = random.Random(5)
    # a small knot that many vertices point to in a long row
    n = 300
    edges = {(rng.randrange(6), rng.randrange(6)) for _ in range(20)} | {(k, (k + 1) % 6) for k in range(6)} | {(k, k - 1) for k in range(6, n)}
    ranks, out = [1 / n] * n, {}
    for i, _ in edges:
        out[i] = out.get(i, 0) + 1
    for _ in range(100):
        new = [0.15 / n] * n
        for i, j in edges:
            new[j] += 0.85 * ranks[i] / out[i]
        ranks = new
    found = sw.pagerank(bools(spark, n, sorted(edges)), tol=1e-10)
    assert found.to_list() == pytest.approx(ranks, abs=1e-8)
    sizes = [r[0] for r in rows]
    assert sizes[0] == sizes[1] == n and max(sizes[3:]) < 10 and len(sizes) > 20


def test_scratch_goes_with_the_application(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.local.dir", {str(tmp_path / "local")!r}).config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
from semiweave import checkpoints
kept, named = checkpoints.Rounds(spark), checkpoints.Rounds(spark, "named")
for k in range(4):
    kept.settled(spark.range(k)), named.settled(spark.range(k))
assert checkpoints._complete(spark, kept.folder) == [2, 3] and kept.last().count() == 3
"""
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True, capture_output=True)
    left = [p.name for p in (tmp_path / "shared").rglob("*") if p.name.startswith(("run-", "rounds-"))]
    assert left == ["rounds-named"]
