"""Gathers by measured skew, masks of many words, adjacency in blocks, frontiers, runs over ranges, apportioning, resampling, and replica streams."""

import math
import random

import pytest

from pyspark.sql import functions as F

from sporeline.functions import hazards as H
from sporeline.functions import rng
from sporeline.operators import influence as J
from sporeline.operators import models as M
from sporeline.operators import series as T
from sporeline.plans import steps
from sporeline.sources import graphs


def star(spark, n, extra=0):
    """Node 0 sends to all others and hears from all; extra edges of a ring between the others."""
    i = spark.range(1, n)
    out = i.select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    ring = spark.range(1, 1 + extra).select(F.col("id").alias("src"), (F.col("id") % (n - 1) + 1).alias("dst"))
    return graphs.Graph(graphs.node_range(spark, n), graphs.symmetrised(out).unionByName(ring))


def test_hubs_are_measured_and_dealt_out(spark):
    g = star(spark, 20_001, 20_000).measured(tasks=8)
    hubs = {r.node: (r.out_salts, r.in_salts) for r in g.hubs.collect()}
    assert hubs == {0: (6, 6)}  # a third of the edges on each side, in pieces of a sixteenth
    assert {r.node: (r.out_salts, r.in_salts) for r in g.transpose().hubs.collect()} == hubs
    states = g.nodes.select("node", (F.col("node") % 2).cast("int").alias("state"))
    for end in ("src", "dst"):
        side = states.select(F.col("node").alias(end))
        joined = g.joined(side, end)
        text = joined._jdf.queryExecution().toString()
        assert "_salt" in text
        assert joined.count() == g.edges.count()
    # What a task may get of one key: no more than a sixteenth of the edges, whatever the hub has.
    dealt = g.edges.join(g.hubs.withColumnRenamed("node", "src"), "src", "left").groupBy("src", F.pmod(F.xxhash64("dst"), F.coalesce("out_salts", F.lit(1)))).count()
    assert dealt.agg(F.max("count")).first()[0] <= 1.1 * 60_000 / 16
    plain = graphs.Graph(g.nodes, g.edges)
    for f in (lambda x: J.influence(x, states, [0]), lambda x: J.susceptible_pressure(x, states, 1, [0]), lambda x: J.pressure(x, states.select("node", F.lit(0.5).alias("infectivity")))):
        assert sorted(map(tuple, f(g).collect())) == sorted(map(tuple, f(plain).collect()))


def test_graphs_without_hubs_stay_as_they_are(spark):
    n = 1000
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    assert graphs.Graph(graphs.node_range(spark, n), ring).measured().hubs is None
    assert graphs.Graph(graphs.node_range(spark, 3), ring.where("false")).measured().hubs is None


def test_steps_on_a_hub_graph_are_those_of_plain_joins(spark):
    g = star(spark, 2001, 500).stored()
    assert g.hubs is not None
    plain = graphs.Graph(g.nodes, g.edges)
    states = g.nodes.select("node", (F.col("node") % 4).cast("int").alias("state"), (F.col("node") % 7).cast("double").alias("age"))
    for model in (M.seir(0.02, 5.0, 4.0, 7.5, 5.0), M.seir(0.02, 5.0, 4.0, 7.5, 5.0, age_dependent=True), M.sis(0.05, 1.0)):
        held = states if len(model.states) == 4 else states.withColumn("state", F.col("state") % 2)
        one, two = ({r.node: (r.state, round(r.age, 9), r.event) for r in steps.one_step(x, held, model, 3).collect()} for x in (g, plain))
        assert one == two and len(one) == 2001
    both = states.withColumn("replica", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = [sorted((r.node, r.replica, r.state, round(r.rate, 9)) for r in steps.ensemble_rates(x, both, M.sir(0.05, 0.5), 2).where("state < 3").collect()) for x in (g, plain)]
    assert rows[0] == rows[1] and all(r[3] == 0 for r in rows[0] if r[2] == 2)


@pytest.mark.parametrize("replicas", [1, 63, 64, 65, 100, 130])
def test_masks_of_any_width(spark, replicas):
    r = random.Random(replicas)
    edges = [(r.randrange(6), r.randrange(6), float(r.randint(1, 9))) for _ in range(20)]
    g = graphs.Graph(graphs.node_range(spark, 6), spark.createDataFrame(edges, "src long, dst long, weight double"))
    state = {(n, k): r.randrange(2) for n in range(6) for k in range(replicas)}
    states = spark.createDataFrame([(n, k, s) for (n, k), s in state.items()], "node long, replica int, state int")
    got = {(x.node, x.replica): x.influence for x in J.packed_influence(g, J.packed(states, [1], replicas), replicas).collect()}
    assert got == {(n, k): sum(w for a, b, w in edges if b == n and state[a, k] == 1) for n, k in state}


@pytest.mark.parametrize("replica", [-1, 70, None])
def test_replicas_out_of_range_are_an_error(spark, replica):
    states = spark.createDataFrame([(0, replica, 1)], "node long, replica int, state int")
    with pytest.raises(Exception, match="no such replica"):
        J.packed(states, [1], 70).collect()


def test_a_hub_spans_several_blocks(spark):
    edges = [(s, 2) for s in range(23)] + [(7, 1), (7, 1), (3, 0)]
    random.Random(1).shuffle(edges)
    g = graphs.Graph(graphs.node_range(spark, 25), spark.createDataFrame(edges, "src long, dst long"))
    rows = sorted(graphs.neighbour_blocks(g, 5).collect())
    assert all(len(r.sources) <= 5 for r in rows)
    of = {}
    for r in rows:
        assert r.block == sum(x.node == r.node for x in rows[: rows.index(r)])
        of.setdefault(r.node, []).extend(r.sources)
    assert of[2] == list(range(23)) and of[1] == [7, 7] and of[0] == [3] and of[24] == []
    assert {r.node: list(r.sources) for r in graphs.neighbour_lists(g).collect()} == of


def test_frontier_is_made_anew_after_so_many_steps(spark):
    edges = [(i, (i * 7 + k) % 60, float(k)) for i in range(60) for k in range(1, 4)]
    g = graphs.Graph(graphs.node_range(spark, 60), spark.createDataFrame(edges, "src long, dst long, weight double"))
    states = g.nodes.select("node", (F.col("node") % 2).cast("int").alias("state"))
    held, state = J.Frontier.started(g, states, [1], rebuild_after=3), {n: n % 2 for n in range(60)}
    seen = []
    for k in range(5):
        nodes = [k, k + 10] if k != 4 else list(range(30))
        changed = spark.createDataFrame([(n, state[n], 1 - state[n]) for n in nodes], "node long, before int, after int")
        for n in nodes:
            state[n] = 1 - state[n]
        held = held.after(changed)
        seen.append((held.steps, held.rebuilds))
        want = {n: sum(w for a, b, w in edges if b == n and state[a] == 1) for n in range(60)}
        assert {r.node: r.influence for r in held.influence.collect()} == want
        assert {r.node: r.state for r in held.states.collect()} == state
    assert seen == [(1, 0), (2, 0), (3, 0), (0, 1), (0, 2)]  # the fourth by its number, the last by its size
    with pytest.raises(ValueError):
        J.Frontier.started(g, states, [1], rebuild_after=0)


@pytest.mark.parametrize("linear", [False, True])
def test_runs_over_ranges_as_in_one_task(spark, linear):
    r = random.Random(3)
    samples = [(run, float(t), None if r.random() < 0.1 else r.random()) for run in (0, 1, 2, None) for t in r.sample(range(1000), 300 if run == 1 else 5)]
    samples = [s for s in samples if s[2] is not None]
    grid = [(run, t / 2) for run in (0, 1, 2, 3, None) for t in range(-4, 2100, 7)]
    a, b = spark.createDataFrame(samples, "run long, t double, infected double"), spark.createDataFrame(grid, "run long, t double")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        df = T.resampled_by_range(a, b, linear)
        got = sorted(map(tuple, df.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == sorted(map(tuple, T.resampled(a, b, linear).collect()), key=repr) and len(got) == len(grid)


def widest(df):
    """The most rows that a task has of df's result, and how many tasks have any."""
    per = df.groupBy(F.spark_partition_id()).count().collect()
    return max(r["count"] for r in per), len(per)


def test_edges_are_dealt_to_tasks_by_their_number(spark, monkeypatch, request):
    """Adaptive plans would merge all of these small rows into one task, whatever spark.sql.shuffle.partitions says."""
    monkeypatch.setattr(graphs, "TASK_ROWS", 1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    n, m = 500, 16_000
    edges = spark.range(m).select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("src"), (F.col("id") * 11 % n).alias("dst"), F.lit(2).cast("long").alias("weight"))
    g = graphs.from_edges(edges, n)
    assert g.size == m and g.transpose().size == m
    side = g.nodes.select(F.col("node").alias("src"))
    most, tasks = widest(g.joined(side, "src"))
    assert most < 3000 and tasks >= 8
    placed = graphs.numbered(edges.select("src", "dst"), "dst", "src", name="pos").select("pos", "src")
    back = graphs.from_csr(graphs.csr_rows(g), placed)
    most, tasks = widest(back.edges)
    assert most < 3000 and tasks >= 8 and back.size == m
    assert sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, edges.select("src", "dst").collect()))
    weights = edges.select("src", "dst").distinct().withColumn("weight", F.col("src") * 0.5)
    held = g.with_weights(weights).edges
    assert widest(held)[1] >= 8
    assert held.where("weight <> src * 0.5").count() == 0 and held.count() == m
    states = g.nodes.select("node", F.lit(0).alias("replica"), (F.col("node") % 2).cast("int").alias("state"))
    many = J.packed_influence(g, J.packed(states, [1], 70), 70)
    assert widest(many)[1] >= 8
    want = {r.node: r.influence for r in J.influence(graphs.Graph(g.nodes, g.edges), states, [1]).collect()}
    assert {r.node: r.influence for r in many.where("replica = 0").collect()} == want
    assert many.where("replica > 0 AND influence <> 0").count() == 0 and many.count() == 70 * n


def test_the_trade_graph_is_made_in_tasks_by_its_lines(spark, monkeypatch, sf_dir):
    from sporeline.operators import analytics as A
    from sporeline.queries import fixtures as X

    plain = {k: sorted(map(tuple, X.trade(spark, sf_dir, k).edges.collect())) for k in ("unit", "weighted", "multi", "directed")}
    lines = X.table(spark, sf_dir, "lineitem").count()
    degrees = sorted(map(tuple, A.in_degrees(X.trade(spark, sf_dir, "multi")).collect()))
    monkeypatch.setattr(graphs, "TASK_ROWS", 500)
    for kind, want in plain.items():
        g = X.trade(spark, sf_dir, kind)
        assert g.size == lines * (1 if kind == "directed" else 2)
        assert widest(g.edges)[0] < 2000 and sorted(map(tuple, g.edges.collect())) == want
    assert sorted(map(tuple, A.in_degrees(X.trade(spark, sf_dir, "multi")).collect())) == degrees


def test_no_row_reads_all_rows_after_it(spark):
    """A frame up to the last row is read anew for each row, so that a long run takes the square of its samples."""
    n = 20_000
    samples = spark.range(n).select(F.lit(0).alias("run"), F.col("id").cast("double").alias("t"), (F.col("id") % 7).alias("infected"))
    grid = spark.range(n + 1).select(F.lit(0).alias("run"), (F.col("id") - 0.5).alias("t"))
    want = [None] + [(k % 7 + (k + 1) % 7) / 2 for k in range(n - 1)] + [float((n - 1) % 7)]
    for f in (T.resampled, T.resampled_by_range):
        df = f(samples, grid, linear=True)
        assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()
        assert [r.infected for r in df.orderBy("t").collect()] == want


def test_work_over_very_many_buckets(spark):
    """Two pieces over a million buckets: eight rows before the sums, and every bucket's amount after."""
    work = spark.createDataFrame([(0.5, 1_000_000.5, 1e6), (10.0, 13.0, 6.0), (5.0, 5.0, 9.0), (-3.0, 1.0, 4.0), (2e6, 3e6, 1.0)], "begin double, end double, amount double")
    buckets = spark.range(1).select(F.lit(0.0).alias("origin"), F.lit(1.0).alias("width"), F.lit(1_000_000).cast("long").alias("n"))
    out = T.apportioned(work, buckets)
    x = out.agg(F.count("*").alias("n"), F.sum("amount").alias("total"), F.min("bucket").alias("low"), F.max("bucket").alias("high")).first()
    assert (x.n, x.low, x.high) == (1_000_000, 0, 999_999) and x.total == pytest.approx(999_999.5 + 6 + 1)
    some = {r.bucket: r.amount for r in out.where("bucket < 15 or bucket > 999997").collect()}
    assert some[0] == pytest.approx(1.5) and some[5] == pytest.approx(1.0) and some[10] == pytest.approx(3.0) and some[12] == pytest.approx(3.0) and some[13] == pytest.approx(1.0) and some[999_999] == pytest.approx(1.0)


def test_apportioning_as_pieces_one_by_one(spark):
    r = random.Random(5)
    work = [(b := round(r.uniform(-20, 120), 2), b + round(r.choice((0, 0.5, 3, 10, 60)) * r.random(), 2), r.uniform(1, 9)) for _ in range(300)] + [(10.0, 20.0, 2.0), (100.0, 110.0, 5.0)]
    want = {}
    for begin, end, amount in work:
        if end > begin:
            for k in range(max(math.floor(begin / 5), 0), min(math.floor(end / 5), 19) + 1):
                want[k] = want.get(k, 0) + amount * max(min(end, 5 * k + 5) - max(begin, 5 * k), 0) / (end - begin)
    buckets = spark.range(1).select(F.lit(0.0).alias("origin"), F.lit(5.0).alias("width"), F.lit(20).cast("long").alias("n"))
    got = {x.bucket: x.amount for x in T.apportioned(spark.createDataFrame(work, "begin double, end double, amount double"), buckets).collect()}
    assert got == pytest.approx(want)


def test_poisson_weights_give_the_interval_of_the_mean(spark):
    r = random.Random(2)
    xs = [r.gauss(10, 2) for _ in range(2000)]
    values = spark.createDataFrame(list(enumerate(xs)), "i long, x double")
    got, other = T.poisson_interval(values, 5, 500).first(), T.bootstrap_interval(values, 5, 500).first()
    mean, error = sum(xs) / 2000, 2 / math.sqrt(2000)
    assert got.low == pytest.approx(mean - 1.96 * error, abs=0.4 * error) and got.high == pytest.approx(mean + 1.96 * error, abs=0.4 * error)
    assert got.low == pytest.approx(other.low, abs=0.4 * error) and got.high == pytest.approx(other.high, abs=0.4 * error)
    chances = T.poisson_steps()
    assert chances[0] == math.exp(-1) and chances[2] == pytest.approx(2.5 * math.exp(-1)) and chances == sorted(chances)


def test_replicas_have_streams_of_their_own(spark):
    rows = spark.createDataFrame([(n, k) for n in range(50) for k in range(6)], "node long, replica int")
    got = {(r.node, r.replica): r.u for r in rng.with_replica_uniform(rows, "u", F.col("node"), F.col("replica"), 6, 7, 3).collect()}
    assert got == {(n, k): rng.uniform(n, rng.replica_seed(7, k), 3) for n, k in got} and len(set(got.values())) == 300
    fewer = rng.with_replica_uniform(rows.where("replica < 2"), "u", F.col("node"), F.col("replica"), 2, 7, 3).collect()
    assert all(got[r.node, r.replica] == r.u for r in fewer)  # whatever the number of replicas
    assert [rng.replica_seed(7, k) for k in range(3)] == GOLDEN == [plain_replica_seed(7, k) for k in range(3)]
    assert len({rng.replica_seed(s, k) for s in range(64) for k in range(64)} | {rng.episode_seed(s, k) for s in range(64) for k in range(1, 65)}) == 2 * 64 * 64


def plain_replica_seed(seed, replica):
    mask, word = (1 << 64) - 1, int.from_bytes(b"replicas", "big") ^ seed

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    return mixed(mixed(word + 0x9E3779B97F4A7C15 & mask) + replica * 0x9E3779B97F4A7C15 & mask)


GOLDEN = [9931984466970869533, 17916698906627599375, 2977084663377029514]


def test_erfcx_to_thirteen_digits(spark):
    xs = [x / 16 for x in range(-80, 81)] + [7.5, 12.0, 25.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", H.erfcx(F.col("x")).alias("y"))
    for r in df.collect():
        assert r.y == pytest.approx(math.exp(r.x * r.x) * math.erfc(r.x), rel=1e-13 if abs(r.x) < 8 else 5e-13)


def test_exact_times_from_edges_by_source(spark, monkeypatch):
    """Open edges of a large graph lie in buckets by source, are dropped at the end, and give the times of small graphs."""
    from sporeline.plans import exact

    g = star(spark, 400, 399)
    g, seeds = graphs.from_edges(g.edges, 400), spark.range(1, 4).select(F.col("id").alias("node"))
    run = lambda: sorted(map(tuple, exact.event_times(g, seeds, 0.8, ("exponential", 0.5), seed=3).collect()))
    want, made = run(), []
    monkeypatch.setattr(graphs, "TASK_ROWS", 200)
    kept = graphs.bucketed
    monkeypatch.setattr(graphs, "bucketed", lambda *a: made.append(kept(*a)) or made[-1])
    assert run() == want and len(made) == 1
    assert made[0].columns == ["src", "dst", "length"]
