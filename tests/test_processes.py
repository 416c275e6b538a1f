"""Random numbers, hazards, models, steps, runs and exact times: hand-computed cases and plain versions."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from sporeline.functions import hazards as H
from sporeline.functions import rng
from sporeline.operators import influence as J
from sporeline.operators import leaps as L
from sporeline.operators import models as M
from sporeline.plans import exact, steps
from sporeline.plans.simulator import Config, Simulator
from sporeline.sources import generators as G
from sporeline.sources import graphs

STATES = "node long, state int, age double"
DWELL = {"ei_mean": 5.0, "ei_median": 4.0, "ir_mean": 3.9, "ir_median": 1.5}


def table(spark, states, ages=None):
    return spark.createDataFrame([(i, s, float((ages or [0.0] * len(states))[i])) for i, s in enumerate(states)], STATES)


def graph(spark, n, edges):
    weighted = len(edges[0]) == 3 if edges else False
    return graphs.from_edges(spark.createDataFrame(edges, "src long, dst long" + ", weight double" * weighted), n)


def column(df, name):
    return [r[name] for r in df.orderBy("node").collect()]


def evaluate(spark, values, f):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_golden_words(spark):
    golden = [16294208416658607535, 10451216379200822465, 16490336266968443936]
    assert [rng.splitmix(x & rng.MASK) for x in (0, 1, -1)] == golden
    held = rng.with_finished(spark.createDataFrame([(rng.INCREMENT + x - (1 << 64),) for x in (0, 1, -1)], "w long"), "w")
    assert [r.w & rng.MASK for r in held.collect()] == golden


def test_columns_draw_as_plain_python(spark):
    lanes = [0, 1, 2**31, 2**40 + 7, 12345678901]
    df = rng.with_uniform(spark.createDataFrame([(x,) for x in lanes], "lane long"), "u", F.col("lane"), -5, 9)
    assert {r.lane: r.u for r in df.collect()} == {x: rng.uniform(x, -5, 9) for x in lanes}


def test_seeds_of_episodes_are_distinct():
    assert len({rng.episode_seed(s, e) for s in range(16) for e in range(64)}) == 16 * 64
    assert rng.episode_seed(7, 0) == rng.episode_seed(7, None) == 7
    for bad in (True, 1.0, "1"):
        with pytest.raises(TypeError):
            rng.checked_seed(bad)
    for bad in (1 << 64, -(1 << 63) - 1):
        with pytest.raises(ValueError):
            rng.checked_seed(bad)


def test_erfcx_against_erfc(spark):
    xs = [-5, -2.5, -1, -0.1, 0, 0.3, 1, 2, 3.5, 5, 9, 20]
    want = [math.exp(x * x) * math.erfc(x) for x in xs]
    assert evaluate(spark, xs, H.erfcx) == pytest.approx(want, rel=1e-12)


def test_hazards_have_their_values(spark):
    log = H.hazard("lognormal", mean=5.0, median=4.0)
    other = H.hazard("lognormal", mean=3.9, median=1.5)
    assert evaluate(spark, [2, 5], lambda x: log(x, x)) == pytest.approx([0.204996893, 0.305961092], rel=1e-6)
    assert evaluate(spark, [1.5, 50], lambda x: other(x, x)) == pytest.approx([0.384782984, 0.041320907], rel=1e-6)
    assert evaluate(spark, [0], lambda x: log(x, x))[0] < 1e-6
    ts = [0.5, 1, 2, 3, 5, 50, 1000]
    assert evaluate(spark, ts, lambda x: H.hazard("gamma", shape=2.0, scale=1.0)(x, x)) == pytest.approx([t / (1 + t) for t in ts], rel=1e-6)
    assert evaluate(spark, [15000], lambda x: H.hazard("gamma", shape=1e4, scale=1.0)(x, x)) == pytest.approx([0.33353314], rel=1e-5)
    assert evaluate(spark, [2, 8], lambda x: H.hazard("weibull", shape=2.0, scale=4.0)(x, x)) == pytest.approx([0.25, 1.0])
    assert evaluate(spark, [3], lambda x: H.hazard("constant", rate=0.7)(x, x)) == [0.7]
    assert evaluate(spark, [3], lambda x: H.hazard("network", beta=0.5)(x, x)) == [1.5]
    for bad in (("lognormal", {"mean": 1.0, "median": 2.0}), ("weibull", {"shape": 0.0, "scale": 1.0}), ("nope", {}), ("gamma", {"shape": 1.0})):
        with pytest.raises(ValueError):
            H.hazard(bad[0], **bad[1])


def test_influence_of_small_graphs(spark):
    g = graph(spark, 3, [(0, 1), (0, 2), (1, 2)])
    assert column(J.influence(g, table(spark, [1, 0, 0]), [1]), "influence") == [0, 1, 1]
    odd = graph(spark, 5, [(2, 0, 3.0), (0, 2, 5.0), (1, 2, 7.0), (2, 0, 11.0), (0, 2, 13.0), (3, 3, 17.0)])
    states = table(spark, [1, 0, 1, 1, 0])
    for f in (J.influence, J.salted_influence):
        assert column(f(odd, states, [1]), "influence") == [14, 0, 18, 17, 0]
    payload = spark.createDataFrame([(0, 0.5), (1, 0.25), (2, 0.0)], "node long, infectivity double")
    assert column(J.pressure(graph(spark, 3, [(0, 1, 2.0), (1, 2, 4.0)]), payload), "pressure") == [0, 1, 1]


def test_ensemble_influence_as_a_loop_over_edges(spark):
    edges = [(0, 2, 2.0), (2, 0, 3.0), (1, 2, 5.0), (0, 2, 7.0), (3, 1, 11.0), (0, 3, 13.0)]
    g, r = graph(spark, 4, edges), random.Random(1)
    state = {(n, k): r.randrange(3) for n in range(4) for k in range(5)}
    states = spark.createDataFrame([(n, k, s) for (n, k), s in state.items()], "node long, replica int, state int")
    want = {(n, k): sum(w for a, b, w in edges if b == n and state[a, k] in (1, 2)) for n, k in state}
    for got in (J.ensemble_influence(g, states, [1, 2], 5), J.packed_influence(g, J.packed(states, [1, 2], 5), 5)):
        assert {(x.node, x.replica): x.influence for x in got.collect()} == want


def rates(spark, model, states, ages, pressures):
    df = spark.createDataFrame([(i, s, float(a), float(p)) for i, (s, a, p) in enumerate(zip(states, ages, pressures, strict=True))], STATES + ", pressure double")
    return column(df.withColumn("rate", model.rate(F.col("state"), F.col("age"), F.col("pressure"))), "rate")


def test_rates_and_transitions_of_models(spark):
    assert rates(spark, M.sis(0.5, 1.0), [0, 0, 1, 1], [0] * 4, [1, 2, 0, 0]) == [0.5, 1, 1, 1]
    assert rates(spark, M.sir(0.4, 0.2), [0, 1, 2], [0] * 3, [3, 0, 0]) == pytest.approx([1.2, 0.2, 0])
    for age_dependent, first in ((False, 1.0), (True, 4.0)):
        got = rates(spark, M.seir(0.25, **DWELL, age_dependent=age_dependent), [0, 1, 2, 3], [0, 2, 1.5, 0], [4, 7, 9, 11])
        assert got == pytest.approx([first, 0.204996893, 0.384782984, 0], rel=1e-6)
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 2)], "node long, state int").withColumn("to", M.sir(1.0, 1.0).transition(F.col("state")))
    assert column(df, "to") == [1, 2, 2, 2]
    for bad in ({"inducers": ()}, {"inducers": (1, 1)}, {"inducers": (5,)}, {"next_state": (1,)}, {"markovian": 1}):
        with pytest.raises((ValueError, TypeError)):
            M.Model(**({"states": ("S", "I"), "inducers": (1,), "next_state": (1, 0), "rate": lambda s, a, p: p, "markovian": True} | bad))


def test_step_sizes(spark):
    g = graph(spark, 2, [(0, 1, 100.0)])
    rated = steps.rates(g, table(spark, [1, 0]), M.sis(1.0, 0.1))
    tau = steps.step_size(rated, M.sis(1.0, 0.1), {"theta": 1.0, "max_prob": 0.1, "tau_min": 1.0, "tau_max": 2.0}).first().tau
    assert 1 - math.exp(-100 * tau) <= 0.1 + 1e-12  # the chance holds even if the least step is longer
    slow = spark.createDataFrame([(5e-10,), (5e-10,)], "rate double")
    assert L.rate_summary(slow).select(L.renewal_tau(F.col("highest"), 0.03, 1e12)).first()[0] == pytest.approx(0.03 / 5e-10)
    still = spark.createDataFrame([(0.0,)], "rate double")
    assert L.rate_summary(still).select(L.renewal_tau(F.col("highest"), 0.03, 0.1), L.markov_tau(F.col("total"), F.col("highest"), F.col("n"), 0.1, 0.1, 1e-6, 2.0)).first()[:] == (0.1, 2.0)


def test_shares_and_ranks(spark):
    assert L.shares(10, [0.45, 0.15, 0.25, 0.15]) == [5, 1, 3, 1] or sum(L.shares(10, [0.45, 0.15, 0.25, 0.15])) == 10
    held = L.states_by_rank(spark.range(10).selectExpr("id AS node", "id AS number"), [4, 1, 3, 2], {1: 2.0, 2: 1.5})
    assert column(held, "state") == [0] * 4 + [1] + [2] * 3 + [3] * 2 and column(held, "age") == [0.0] * 4 + [2.0] + [1.5] * 3 + [0.0] * 2


def test_seeding_is_exact_and_unbiased(spark):
    nodes = spark.range(500).withColumnRenamed("id", "node")
    assert len({r.node for r in L.sampled_nodes(nodes, 40, 3).collect()}) == 40
    counts = spark.createDataFrame([(0, 0), (1, 7), (2, 500), (3, 30)], "replica int, k long")
    got = L.sampled_by_replica(nodes, counts, 4, 3).collect()
    assert {k: len({x.node for x in got if x.replica == k}) for k in range(4)} == {0: 0, 1: 7, 2: 500, 3: 30}
    mean = sum(r.node for s in range(8) for r in L.sampled_nodes(nodes, 40, s).collect()) / 320
    assert 200 < mean < 300


def test_simulator_runs_repeat_and_conserve(spark):
    g = G.erdos_renyi(spark, 200, 6, 1).stored()
    s = Simulator(g, M.sir(0.3, 0.4), 5, Config(theta=0.1, max_prob=0.3))
    curve = [tuple(r) for r in s.seed_infection(10).run(1.0, 0.2).collect()]
    assert curve[0][0] == 0 and curve[-1][0] >= 1.0 and all(sum(r[1:]) == 200 for r in curve) and all(a[0] < b[0] for a, b in zip(curve, curve[1:], strict=False))
    s.reset()
    assert [tuple(r) for r in s.seed_infection(10).run(1.0, 0.2).collect()] == curve
    s.reset(3)
    assert [tuple(r) for r in s.seed_infection(10).run(1.0, 0.2).collect()] != curve
    with pytest.raises(RuntimeError):
        s.seed_infection(1)
    with pytest.raises(ValueError):
        s.run(0.0)


def test_a_bad_rate_changes_nothing(spark):
    g = graph(spark, 3, [(0, 1), (1, 2)])
    bad = M.Model(("S", "I"), (1,), (1, 0), lambda state, age, pressure: F.when(state == 0, pressure - 2).otherwise(F.lit(1.0)), True)
    s = Simulator(g, bad, 1).set_states(spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "node long, state int"))
    before = column(s.states, "state")
    with pytest.raises(FloatingPointError):
        s.step()
    assert column(s.states, "state") == before and s.steps == 0 and s.times == [0.0]


def test_initial_states_are_checked(spark):
    s = Simulator(graph(spark, 3, [(0, 1)]), M.seir(0.3, **DWELL), 1)
    for rows in ([(0, 0), (1, 0)], [(0, 0), (1, 0), (1, 0)], [(0, 0), (1, 4), (2, 0)], [(0, 0), (1, 0), (3, 0)]):
        with pytest.raises(ValueError):
            s.set_states(spark.createDataFrame(rows, "node long, state int"))
    with pytest.raises(ValueError):
        s.set_states(spark.createDataFrame([(0, 0, -1.0), (1, 0, 0.0), (2, 0, 0.0)], STATES))
    with pytest.raises(ValueError):
        Simulator(s.graph, M.sis(1.0, 1.0)).set_states(spark.createDataFrame([(0, 0, 0.0), (1, 0, 0.0), (2, 0, 0.0)], STATES))
    for bad in ({"epsilon": 0}, {"theta": 2.0}, {"max_prob": 1.0}, {"tau_max": -1.0}, {"epsilon": True}):
        with pytest.raises(ValueError):
            Config(**bad)


def test_replicas_have_their_own_steps(spark):
    ring = graph(spark, 4, [(i, (i + d) % 4) for i in range(4) for d in (1, 3)])
    s = Simulator(ring, M.sis(0.8, 0.2), 3, replicas=2).seed_infection([1, 4])
    assert [c[1] for c in s.counts()] == [1, 4]
    taus = s.step()
    assert taus[0] != taus[1] and s.times == taus and all(sum(c) == 4 for c in s.counts())
    with pytest.raises(ValueError):
        s.run(1.0)


def test_exact_times_are_shortest_paths(spark):
    g = G.erdos_renyi(spark, 150, 5, 2)
    seeds = spark.createDataFrame([(0,), (7,)], "node long")
    got = {r.node: r for r in exact.event_times(g, seeds, 0.6, ("exponential", 0.5), ("lognormal", 2.0, 1.5), seed=4).collect()}
    latent_seed, infectious_seed, sending_seed = (rng.derived_seed(4, d) for d in (exact.LATENT, exact.INFECTIOUS, exact.SENDING))
    mu, sigma = H.lognormal_parameters(2.0, 1.5)
    latent = [math.exp(mu + sigma * math.sqrt(-2 * math.log(rng.uniform(i, latent_seed, 1))) * math.cos(2 * math.pi * rng.uniform(i, latent_seed, 2))) for i in range(150)]
    infectious = [-math.log(rng.uniform(i, infectious_seed, 1)) / 0.5 for i in range(150)]
    out = {}
    for r in g.edges.collect():
        send = -math.log(rng.uniform(r.src * 150 + r.dst, sending_seed, 1)) / 0.6
        if send < infectious[r.src]:
            out.setdefault(r.src, []).append((r.dst, latent[r.src] + send))
    best, queue = {0: 0.0, 7: 0.0}, [(0.0, 0), (0.0, 7)]
    while queue:
        t, i = heapq.heappop(queue)
        if t > best[i]:
            continue
        for j, d in out.get(i, []):
            if t + d < best.get(j, math.inf):
                best[j] = t + d
                heapq.heappush(queue, (t + d, j))
    assert {i for i, r in got.items() if r.infected_at is not None} == set(best)
    for i, t in best.items():
        assert got[i].infected_at == pytest.approx(t) and got[i].removed_at == pytest.approx(t + latent[i] + infectious[i])
    held = exact.curve(spark.createDataFrame([(r.node, r.infected_at, r.removed_at) for r in got.values()], "node long, infected_at double, removed_at double"), 0.5, 40).orderBy("t").collect()
    for r in held:
        assert r.removed == sum(t + latent[i] + infectious[i] <= r.t for i, t in best.items())
        assert r.infected == sum(t <= r.t for t in best.values()) - r.removed


def test_leaps_follow_exact_times_in_the_mean(spark):
    """Like with like: infected nodes at t = 2 over several seeds, leaps against shortest paths."""
    g = G.erdos_renyi(spark, 400, 6, 3).stored()
    ours, theirs = [], []
    for seed in range(3):
        s = Simulator(g, M.sir(0.3, 0.4), seed, Config(theta=0.05, max_prob=0.1)).seed_infection(40)
        start = s.states.where("state = 1").select("node")
        times = exact.event_times(g, start, 0.3, ("exponential", 0.4), seed=seed)
        theirs.append(times.where("infected_at <= 2").count())
        end = s.run(2.0, 1.0).orderBy(F.desc("t")).first()
        ours.append(400 - end.S)
    assert abs(sum(ours) - sum(theirs)) / sum(theirs) < 0.15
