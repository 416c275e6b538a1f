"""Graphs and generators: hand-computed cases, properties, and what is refused."""

import math
import random

import pytest

from pyspark.sql import functions as F

from sporeline.operators import analytics as A
from sporeline.sources import generators as G
from sporeline.sources import graphs

EDGES = "src long, dst long, weight double"


def pairs(df):
    return sorted((r.src, r.dst) for r in df.collect())


def test_from_edges_refuses_what_is_wrong(spark):
    ok = [(0, 1, 1.0), (1, 0, 2.0), (1, 0, 2.0), (1, 1, 3.0)]
    assert graphs.from_edges(spark.createDataFrame(ok, EDGES), 3).edges.count() == 4  # parallel edges and loops stay
    for bad in [(3, 0, 1.0), (0, -1, 1.0), (0, 1, -1.0), (0, 1, float("nan")), (0, 1, float("inf")), (None, 1, 1.0), (0, 1, None)]:
        with pytest.raises(ValueError):
            graphs.from_edges(spark.createDataFrame([*ok, bad], EDGES), 3)
    with pytest.raises(TypeError):
        graphs.from_edges(spark.createDataFrame([(0.0, 1.0)], "src double, dst double"), 3)
    for n in (-1, True, 2.0):
        with pytest.raises(ValueError):
            graphs.from_edges(spark.createDataFrame(ok, EDGES), n)
    assert graphs.from_edges(spark.createDataFrame([], "src long, dst long"), 2).nodes.count() == 2


def test_rows_and_columns_of_a_small_graph(spark):
    g = graphs.from_edges(spark.createDataFrame([(1, 0), (3, 0), (0, 1), (1, 2), (2, 2), (3, 2)], "src long, dst long"), 4)
    rows = sorted(map(tuple, graphs.csr_rows(g).collect()))
    assert rows == [(0, 0, 2), (1, 2, 3), (2, 3, 6), (3, 6, 6)]
    columns = graphs.numbered(g.edges, "dst", "src", name="pos").select("pos", "src")
    assert [r.src for r in columns.orderBy("pos").collect()] == [1, 3, 0, 1, 2, 3]
    assert pairs(graphs.from_csr(graphs.csr_rows(g), columns).edges) == pairs(g.edges)
    assert pairs(graphs.from_csr(graphs.csr_rows(g), columns, incoming=False).edges) == pairs(g.transpose().edges)
    # node `old` becomes `new`, in the order 2, 0, 3, 1
    order = spark.createDataFrame(list(enumerate([2, 0, 3, 1])), "new long, old long")
    assert A.is_permutation(order, 4) and not A.is_permutation(order, 5) and not A.is_permutation(order.where("new < 3"), 4)
    p = A.permuted(g, order)
    assert sorted(map(tuple, graphs.csr_rows(p).collect())) == [(0, 0, 3), (1, 3, 5), (2, 5, 5), (3, 5, 6)]
    lists = {r.node: r.sources for r in graphs.neighbour_lists(p).collect()}
    assert lists == {0: [0, 2, 3], 1: [2, 3], 2: [], 3: [1]}
    assert A.bandwidth(graphs.from_edges(spark.createDataFrame([(0, 1), (3, 1), (1, 3)], "src long, dst long"), 4)).first().bandwidth == 2
    with pytest.raises(ValueError):
        graphs.from_csr(spark.createDataFrame([(0, 1, 2)], "node long, row_start long, row_end long"), columns)


def test_edge_files(spark, tmp_path):
    (tmp_path / "edges.txt").write_text("0 1 2.5\n1\t0   4.0\n\n7\n 1 1\n")
    g = graphs.load_graph(spark, str(tmp_path / "edges.txt"))
    assert sorted(map(tuple, g.edges.collect())) == [(0, 1, 2.5), (1, 0, 4.0), (1, 1, 1.0)] and g.nodes.count() == 2
    graphs.save_edges(g, str(tmp_path / "out"), base=1)
    again = graphs.load_edges(spark, str(tmp_path / "out"), base=1, weights=False)
    assert pairs(again) == pairs(g.edges)


@pytest.mark.parametrize(("n", "d"), [(31, 8), (24, 5), (18, 1), (9, 0)])
def test_circulants_are_simple_symmetric_and_regular(spark, n, d):
    e = pairs(G.circulant(spark, n, d, 1).edges)
    assert len(e) == len(set(e)) == n * d and all(a != b for a, b in e) and {(b, a) for a, b in e} == set(e)
    assert all(sum(b == i for _, b in e) == d for i in range(n))


def test_circulant_refuses_odd_stubs():
    for n, d in ((9, 3), (5, 5), (0, 0)):
        with pytest.raises(ValueError):
            G.circulant_offsets(n, d, 1)
    assert G.circulant_components(12, [4, -4]) == 4


def simple(graph):
    e = pairs(graph.edges)
    assert len(e) == len(set(e)) and all(a != b for a, b in e) and {(b, a) for a, b in e} == set(e)
    return e


def test_random_graphs_have_their_degrees(spark):
    n = 600
    assert 7.3 <= len(simple(G.erdos_renyi(spark, n, 8, 1))) / n <= 8.7
    assert len(simple(G.erdos_renyi(spark, 5, 4, 1))) == 20 and simple(G.erdos_renyi(spark, 5, 0, 1)) == []
    for nodes, d in ((n, 6), (12, 9)):
        e = simple(G.random_regular(spark, nodes, d, 1))
        assert all(sum(b == i for _, b in e) == d for i in range(nodes))
    assert len(simple(G.watts_strogatz(spark, n, 6, 0.2, 1))) == 6 * n
    out = pairs(G.random_out(spark, n, 5, 1).edges)
    assert len(out) == 5 * n and all(a != b and 0 <= b < n for a, b in out) and all(sum(a == i for a, _ in out) == 5 for i in range(0, n, 50))
    hubs = A.in_degrees(G.barabasi_albert(spark, n, 3, 1)).agg({"degree": "max"}).first()[0]
    assert hubs > 25


def test_attachment_as_one_edge_at_a_time(spark):
    from sporeline.functions.rng import uniform

    n, m, seed = 150, 3, 4
    draw = lambda e, step: math.floor(uniform(e, seed, step) * 2 * m * (e // m))
    ends, step = [draw(e, 1) for e in range((n - m) * m)], 0
    while True:
        target = []
        for e, x in enumerate(ends):
            target.append(e if e < m else x // 2 // m + m if x % 2 == 0 else target[x // 2])
        again = [e for e in range(len(ends)) if target[e] in target[e // m * m : e]]
        if not again:
            break
        for e in again:
            ends[e] = draw(e, step + 2)
        step += 1
    want = {(e // m + m, t) for e, t in enumerate(target)}
    assert len(want) == (n - m) * m
    assert simple(G.barabasi_albert(spark, n, m, seed)) == sorted(want | {(b, a) for a, b in want})


def test_weights_of_parallel_edges(spark):
    g = graphs.from_edges(spark.createDataFrame([(0, 1, 1.0), (0, 1, 2.0), (1, 0, 3.0)], EDGES), 2)
    new = spark.createDataFrame([(0, 1, 0, 10.0), (0, 1, 1, 20.0), (1, 0, 0, 30.0)], "src long, dst long, nth int, weight double")
    assert sorted(map(tuple, g.with_weights(new).edges.collect())) == [(0, 1, 10.0), (0, 1, 20.0), (1, 0, 30.0)]
    both = spark.createDataFrame([(0, 1, 5.0), (1, 0, 6.0)], EDGES)
    assert sorted(map(tuple, g.with_weights(both).edges.collect())) == [(0, 1, 5.0), (0, 1, 5.0), (1, 0, 6.0)]
    for bad in (both.where("src = 0"), both.unionByName(both)):
        with pytest.raises(Exception, match="weight"):
            g.with_weights(bad).edges.collect()


def test_geometric_edges_as_all_pairs(spark):
    located = [(r.node, r.x, r.y) for r in G.points(spark, 200, 2).collect()]
    want = sorted((a, b) for a, x, y in located for b, u, v in located if a != b and (x - u) ** 2 + (y - v) ** 2 <= 0.15**2)
    assert pairs(G.geometric(spark, 200, 0.15, 2).edges) == want


def test_strategy_by_degrees(spark):
    star = graphs.Graph(graphs.node_range(spark, 200), spark.range(1, 200).selectExpr("id AS src", "0L AS dst"))
    assert A.degree_summary(star).first().strategy == "salted"
    assert A.degree_summary(G.circulant(spark, 20, 4, 1)).first().strategy == "plain"


@pytest.mark.parametrize("n, degree", [(6, 5), (9, 8), (10, 7), (7, 4)])
def test_dense_regular_graphs(spark, n, degree):
    edges = {(r.src, r.dst) for r in G.random_regular(spark, n, degree, 3).edges.collect()}
    assert len(edges) == n * degree and all(a != b and (b, a) in edges for a, b in edges)
    assert {sum(a == v for a, _ in edges) for v in range(n)} == {degree}


def cuthill_mckee(n, edges):
    """new -> old, by a queue that takes one node at a time, reversed."""
    near = [sorted({b for a, b in edges if a == v != b} | {a for a, b in edges if b == v != a}) for v in range(n)]
    place, order = (lambda v: (len(near[v]), v)), []
    for root in sorted(range(n), key=place):
        queue = [root] if root not in order else []
        order += queue
        while queue:
            new = sorted((v for v in near[queue.pop(0)] if v not in order), key=place)
            queue += new
            order += new
    return order[::-1]


@pytest.mark.parametrize("n, many, seed", [(40, 30, 1), (40, 70, 2), (12, 0, 3)])
def test_reverse_cuthill_mckee_as_a_queue(spark, n, many, seed):
    """Components, isolated nodes, loops, parallel edges and edges in one direction only."""
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(many)] + [(0, 0), (1, 0), (1, 0), (0, 1)]
    g = graphs.from_edges(spark.createDataFrame(edges, "src long, dst long"), n)
    order = A.reverse_cuthill_mckee(g)
    assert A.is_permutation(order, n)
    assert [r.old for r in sorted(order.collect())] == cuthill_mckee(n, edges)


def test_reverse_cuthill_mckee_reads_edges_by_source(spark, monkeypatch):
    """Edges of a large graph lie in buckets, so that no round shuffles or sorts them again; the order is that of a queue."""
    monkeypatch.setattr(graphs, "TASK_ROWS", 100)
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(420)]
    g = graphs.from_edges(spark.createDataFrame(edges, "src long, dst long"), 300)
    flat = graphs.Graph(g.nodes, graphs.symmetrised(g.edges), size=840).bucketed()
    side = g.nodes.select(F.col("node").alias("src"), F.lit(1).alias("x"))
    joined = flat.joined(side, "src")
    assert joined.count() == 840
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and plan.count("Exchange") == 1  # of the side alone
    got = {r.old: r.new for r in A.reverse_cuthill_mckee(g).collect()}
    assert [o for o, _ in sorted(got.items(), key=lambda x: x[1])] == cuthill_mckee(300, edges)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("edges_") and t.name not in flat.edges.inputFiles()[0]]


def test_reverse_cuthill_mckee_narrows_a_lattice(spark):
    side, names = 5, list(range(25))
    random.Random(4).shuffle(names)
    lattice = [(names[side * i + j], names[side * k + m]) for i in range(side) for j in range(side) for k, m in ((i + 1, j), (i, j + 1)) if k < side and m < side]
    g = graphs.from_edges(spark.createDataFrame(lattice, "src long, dst long"), 25)
    assert A.bandwidth(g).first().bandwidth > 15
    assert A.bandwidth(A.permuted(g, A.reverse_cuthill_mckee(g))).first().bandwidth <= side


def test_reverse_cuthill_mckee_without_edges_or_nodes(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert sorted(map(tuple, A.reverse_cuthill_mckee(graphs.from_edges(none, 3)).collect())) == [(0, 2), (1, 1), (2, 0)]
    assert A.reverse_cuthill_mckee(graphs.from_edges(none, 0)).count() == 0
