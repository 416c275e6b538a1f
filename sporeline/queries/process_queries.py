"""Queries on processes: random numbers, hazards, rates, step sizes, transitions, steps and runs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sporeline.functions import hazards as H
from sporeline.functions import rng
from sporeline.operators import leaps as L
from sporeline.operators import models as M
from sporeline.plans import exact, steps
from sporeline.plans.simulator import Config, Simulator
from sporeline.queries import fixtures as X
from sporeline.queries.graph_queries import _ENSEMBLE
from sporeline.sources.graphs import numbered
from sporeline.sources.storage import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SIS, SIR = M.sis(0.05, 1.0), M.sir(0.05, 0.5)
#: Means and medians of the dwell times in E and I.
DWELL = {"ei_mean": 5.0, "ei_median": 4.0, "ir_mean": 7.5, "ir_median": 5.0}
SEIR, SEIR_AGE = M.seir(0.02, **DWELL), M.seir(0.02, **DWELL, age_dependent=True)
FRACTIONS = (0.45, 0.15, 0.25, 0.15)
K = 25


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(f"WITH {X.edges_sql()} SELECT node, (w::HUGEINT - CASE WHEN w >= 9223372036854775808::UBIGINT THEN 18446744073709551616::HUGEINT ELSE 0::HUGEINT END)::BIGINT AS word FROM (SELECT node, {X.word_sql('node', 42, 1)} AS w FROM nodes)")
def splitmix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rng.with_word(X.trade(spark, sf_dir).nodes, "word", F.col("node"), 42, 1)


@query(f"WITH {X.edges_sql()} SELECT node, {X.uniform_sql('node', 42, 3)} AS u FROM nodes")
def uniform_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rng.with_uniform(X.trade(spark, sf_dir).nodes, "u", F.col("node"), 42, 3)


@query(f"WITH {X.edges_sql()} SELECT node FROM nodes ORDER BY {X.uniform_sql('node', 9, 0)}, node LIMIT {K}")
def seed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sampled_nodes(X.trade(spark, sf_dir).nodes, K, 9)


@query(f"WITH {X.edges_sql()}, {X.EVERY}, r AS (SELECT replica, node, row_number() OVER (PARTITION BY replica ORDER BY {X.uniform_sql(f'node * {X.REPLICAS} + replica', 9, 0)}, node) AS i FROM every) SELECT replica, node FROM r WHERE i <= 5 * (replica + 1)")
def seed_topk_by_replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spark.range(X.REPLICAS).select(F.col("id").cast("int").alias("replica"), (5 * (F.col("id") + 1)).alias("k"))
    return L.sampled_by_replica(X.trade(spark, sf_dir).nodes, counts, X.REPLICAS, 9)


def _shares_sql(fractions: tuple[float, ...]) -> str:
    """One row for each state: its count by largest remainders, and where its ranks begin."""
    values = ", ".join(f"({q}, {f!r}::DOUBLE)" for q, f in enumerate(fractions))
    return (
        f"raw AS (SELECT q, n * f AS x, floor(n * f)::BIGINT AS c, n FROM (VALUES {values}) v(q, f), (SELECT count(*) AS n FROM nodes)), "
        "shares AS (SELECT q, c + (row_number() OVER (ORDER BY c - x, q) <= n - sum(c) OVER ())::BIGINT AS c FROM raw), "
        "begins AS (SELECT q, (sum(c) OVER (ORDER BY q) - c)::BIGINT AS b, (sum(c) OVER (ORDER BY q))::BIGINT AS e FROM shares)"
    )


@query(
    f"WITH {X.edges_sql()}, {_shares_sql(FRACTIONS)}, ranked AS (SELECT node, row_number() OVER (ORDER BY {X.uniform_sql('node', 13, 0)}, node) - 1 AS r FROM nodes) "
    "SELECT node, q AS state, CASE q WHEN 1 THEN 2.0 WHEN 2 THEN 1.5 ELSE 0.0 END::DOUBLE AS age FROM ranked JOIN begins ON r >= b AND r < e"
)
def checkpoint_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = X.trade(spark, sf_dir).nodes
    ranked = numbered(rng.with_uniform(nodes, "u", F.col("node"), 13, 0), "u", "node")
    return L.states_by_rank(ranked, L.shares(nodes.count(), list(FRACTIONS)), {1: 2.0, 2: 1.5})


_SEIR_STATES = f"WITH {X.edges_sql('weighted')}, {X.states_sql('seir')}"


@query(f"{_SEIR_STATES} SELECT q AS state, count(node) AS n FROM (SELECT unnest(range(4))::INTEGER AS q) LEFT JOIN states ON state = q GROUP BY q")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.state_counts(X.states(X.trade(spark, sf_dir).nodes, "seir"), 4)


@query(f"{_ENSEMBLE} SELECT replica, {', '.join(f'sum((state = {q})::BIGINT)::BIGINT AS {s}' for q, s in enumerate('SEIR'))}, sum((state = 2)::BIGINT)::BIGINT AS infected FROM states GROUP BY replica")
def replica_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.replica_counts(X.ensemble(X.trade(spark, sf_dir).nodes, "seir"), SEIR.states, SEIR.inducers)


def _transition(spark: SparkSession, sf_dir: str, kind: str, model: M.Model) -> DataFrame:
    df = rng.with_uniform(X.states(X.trade(spark, sf_dir).nodes, kind), "u", F.col("node"), 21, 1)
    return df.select("node", F.when(F.col("u") < 0.5, model.transition(F.col("state"))).otherwise(F.col("state")).alias("state"))


def _transition_sql(kind: str, following: tuple[int, ...]) -> str:
    case = " ".join(f"WHEN {q} THEN {to}" for q, to in enumerate(following))
    return f"WITH {X.edges_sql()}, {X.states_sql(kind)} SELECT node, CASE WHEN {X.uniform_sql('node', 21, 1)} < 0.5 THEN CASE state {case} END ELSE state END AS state FROM states"


@query(_transition_sql("sis", (1, 0)))
def sis_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transition(spark, sf_dir, "sis", SIS)


@query(_transition_sql("sir", (1, 2, 2)))
def sir_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transition(spark, sf_dir, "sir", SIR)


@query(_transition_sql("seir", (1, 2, 3, 3)))
def seir_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transition(spark, sf_dir, "seir", SEIR)


_EI = lambda age: X.lognormal_sql(age, DWELL["ei_mean"], DWELL["ei_median"])
_IR = lambda age: X.lognormal_sql(age, DWELL["ir_mean"], DWELL["ir_median"])
#: Rates in SQL from state, age and pressure p; what infectious nodes send; and each state's successor.
_RATES = {
    "sis": "CASE state WHEN 0 THEN 0.05::DOUBLE * p ELSE 1.0::DOUBLE END",
    "sir": "CASE state WHEN 0 THEN 0.05::DOUBLE * p WHEN 1 THEN 0.5::DOUBLE ELSE 0 END",
    "seir": f"CASE state WHEN 0 THEN 0.02::DOUBLE * p WHEN 1 THEN {_EI('age')} WHEN 2 THEN {_IR('age')} ELSE 0 END",
    "seir_age": f"CASE state WHEN 0 THEN p WHEN 1 THEN {_EI('age')} WHEN 2 THEN {_IR('age')} ELSE 0 END",
}
_INDUCER = {"sis": 1, "sir": 1, "seir": 2, "seir_age": 2}
_SENT = {"seir_age": f"0.02::DOUBLE * {_IR('age')}"}
_NEXT = {"sis": "1 - state", "sir": "least(state + 1, 2)", "seir": "least(state + 1, 3)", "seir_age": "least(state + 1, 3)"}


def _rated_sql(model: str, source: str = "states", keys: str = "node") -> str:
    """A table of source's rows with their rate. keys: node, or node and replica."""
    by = ["replica"] if "replica" in keys else []
    felt = f"SELECT dst, {''.join(f'{k} AS f_{k}, ' for k in by)}sum(weight * {_SENT.get(model, '1')})::DOUBLE AS w FROM edges JOIN {source} ON src = node WHERE state = {_INDUCER[model]} GROUP BY ALL"
    on = " AND ".join(["dst = node", *(f"f_{k} = {k}" for k in by)])
    return f"SELECT {keys}, state, age, {_RATES[model]} AS rate FROM (SELECT {keys}, state, age, coalesce(w, 0) AS p FROM {source} LEFT JOIN ({felt}) ON {on})"


_MODELS = {"sis": SIS, "sir": SIR, "seir": SEIR, "seir_age": SEIR_AGE}


def _rates(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "weighted")
    return steps.rates(g, X.states(g.nodes, model.split("_")[0]), _MODELS[model]).select("node", F.round("rate", 9).alias("rate"))


def _rates_sql(model: str) -> str:
    return f"WITH {X.edges_sql('weighted')}, {X.states_sql(model.split('_')[0])} SELECT node, round(rate, 9) AS rate FROM ({_rated_sql(model)})"


@query(_rates_sql("sis"))
def sis_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir, "sis")


@query(_rates_sql("sir"))
def sir_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir, "sir")


@query(_rates_sql("seir"))
def seir_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir, "seir")


@query(_rates_sql("seir_age"))
def seir_rates_nonmarkov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir, "seir_age")


@query(f"{_SEIR_STATES} SELECT node, round(CASE state WHEN 2 THEN 0.02::DOUBLE * {_IR('age')} ELSE 0 END, 9) AS infectivity FROM states")
def seir_infectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = X.states(X.trade(spark, sf_dir).nodes, "seir")
    return nodes.select("node", F.round(SEIR_AGE.infectivity(F.col("state"), F.col("age")), 9).alias("infectivity"))


_AGES = "(SELECT DISTINCT l_quantity::DOUBLE AS age FROM lineitem)"


def _ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("age")).distinct()


@query(f"SELECT age, round({_EI('age')}, 9) AS hazard FROM {_AGES}")
def hazard_lognormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = H.hazard("lognormal", mean=DWELL["ei_mean"], median=DWELL["ei_median"])
    return _ages(spark, sf_dir).select("age", F.round(h(F.col("age"), F.lit(0.0)), 9).alias("hazard"))


@query(f"SELECT age, round(1.5::DOUBLE / 6 * pow(age / 6, 0.5), 9) AS hazard FROM {_AGES}")
def hazard_weibull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ages(spark, sf_dir).select("age", F.round(H.hazard("weibull", shape=1.5, scale=6.0)(F.col("age"), F.lit(0.0)), 9).alias("hazard"))


@query(f"SELECT age, round(x * x * x / 6 / (1 + x + x * x / 2 + x * x * x / 6) / 2.5, 9) AS hazard FROM (SELECT age, age / 2.5::DOUBLE AS x FROM {_AGES})")
def hazard_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape 4, for which the survival is a finite sum."""
    return _ages(spark, sf_dir).select("age", F.round(H.hazard("gamma", shape=4.0, scale=2.5)(F.col("age"), F.lit(0.0)), 9).alias("hazard"))


#: The survival for shape 2.5 by erfc of the root and the finite sum that half-integer shapes leave.
_TAIL = f"sqrt(x) * {2 / math.sqrt(math.pi)!r}::DOUBLE * (1 + 2 * x / 3)"


@query(f"SELECT age, round(pow(x, 1.5) / {math.gamma(2.5)!r}::DOUBLE / ({X.erfcx_sql('sqrt(x)')} + {_TAIL}) / 4, 9) AS hazard FROM (SELECT age, age / 4.0::DOUBLE AS x FROM {_AGES})")
def hazard_gamma_fractional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shape that isn't a whole number."""
    return _ages(spark, sf_dir).select("age", F.round(H.hazard("gamma", shape=2.5, scale=4.0)(F.col("age"), F.lit(0.0)), 9).alias("hazard"))


def _markov_sql(rated: str, by: str = "") -> str:
    c = steps.MARKOV
    return f"SELECT {by}CASE WHEN sum(rate) <= 0 THEN {c['tau_max']} ELSE least(greatest({c['theta']}::DOUBLE * count(*) / sum(rate), {c['tau_min']}::DOUBLE), {-math.log1p(-c['max_prob'])!r}::DOUBLE / max(rate), {c['tau_max']}::DOUBLE) END AS tau FROM {rated}"


def _renewal_sql(rated: str, by: str = "") -> str:
    c = steps.RENEWAL
    return f"SELECT {by}CASE WHEN max(rate) = 0 THEN {c['tau_max']}::DOUBLE ELSE least({c['epsilon']}::DOUBLE / max(rate), {c['tau_max']}::DOUBLE) END AS tau FROM {rated}"


@query(f"WITH {X.edges_sql('weighted')}, {X.states_sql('sis')} SELECT round(tau, 12) AS tau FROM ({_markov_sql(f'({_rated_sql("sis")})')})")
def tau_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "weighted")
    return steps.step_size(steps.rates(g, X.states(g.nodes, "sis"), SIS), SIS, steps.MARKOV).select(F.round("tau", 12).alias("tau"))


@query(f"{_SEIR_STATES} SELECT round(tau, 12) AS tau FROM ({_renewal_sql(f'({_rated_sql("seir")})')})")
def tau_renewal(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "weighted")
    return steps.step_size(steps.rates(g, X.states(g.nodes, "seir"), SEIR), SEIR, steps.RENEWAL).select(F.round("tau", 12).alias("tau"))


@query(f"{_ENSEMBLE} SELECT replica, round(tau, 12) AS tau FROM ({_renewal_sql(f'({_rated_sql("seir", keys="node, replica")})', 'replica, ')} GROUP BY replica)")
def tau_by_replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "weighted")
    rated = steps.ensemble_rates(g, X.ensemble(g.nodes, "seir"), SEIR, X.REPLICAS)
    return steps.step_size(rated, SEIR, steps.RENEWAL, ("replica",)).select("replica", F.round("tau", 12).alias("tau"))


@query(f"WITH {X.edges_sql('weighted')}, {X.states_sql('sir')} SELECT node, round({X.expm1_sql('rate * 0.02::DOUBLE')}, 12) AS p FROM ({_rated_sql('sir')})")
def event_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "weighted")
    rated = steps.rates(g, X.states(g.nodes, "sir"), SIR)
    return rated.select("node", F.round(L.event_probability(F.col("rate"), F.lit(0.02)), 12).alias("p"))


def _step_sql(model: str, keys: str, rated: str, taus: str, lane: str, step: int, name: str) -> str:
    """CTEs for the states after a step, in table name: its rates are those of the select in rated."""
    sized = f"{name}_r JOIN {name}_t USING (replica)" if "replica" in keys else f"{name}_r, {name}_t"
    draw = X.replica_uniform_sql(X.EVENT_SEED, step) if "replica" in keys else X.uniform_sql(lane, X.EVENT_SEED, step)
    event = f"({draw}) < {X.expm1_sql('(rate * tau)')}"
    after = f"CASE WHEN event THEN {_NEXT[model]} ELSE state END"
    return (
        f"{name}_r AS MATERIALIZED ({rated}), {name}_t AS MATERIALIZED ({taus}), "
        f"{name} AS MATERIALIZED (SELECT {keys}, {after} AS state, CASE WHEN {after} <> state THEN 0 ELSE age + tau END AS age, tau FROM (SELECT *, {event} AS event FROM {sized}))"
    )


def _one_step_sql(model: str, kind: str = "weighted") -> str:
    tau = _markov_sql if model in ("sis", "sir") else _renewal_sql
    return f"WITH {X.edges_sql(kind)}, {X.states_sql(model.split('_')[0])}, {_step_sql(model, 'node', _rated_sql(model), tau('s1_r'), 'node', 1, 's1')} SELECT node, state, round(age, 9) AS age, round(tau, 12) AS tau FROM s1"


def _one_step(spark: SparkSession, sf_dir: str, model: str, kind: str = "weighted") -> DataFrame:
    g = X.trade(spark, sf_dir, kind)
    after = steps.one_step(g, X.states(g.nodes, model.split("_")[0]), _MODELS[model], X.EVENT_SEED)
    return after.select("node", "state", F.round("age", 9).alias("age"), F.round("tau", 12).alias("tau"))


@query(_one_step_sql("sis", "unit"))
def sis_one_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_step(spark, sf_dir, "sis", "unit")


@query(_one_step_sql("seir"))
def seir_one_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_step(spark, sf_dir, "seir")


@query(_one_step_sql("seir_age"))
def seir_agedep_one_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_step(spark, sf_dir, "seir_age")


@query(_one_step_sql("seir", "regional"))
def hub_seir_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step on a graph whose few hubs hold all edges, gathered by its measured skew."""
    g = X.regional(spark, sf_dir).stored()
    after = steps.one_step(g, X.states(g.nodes, "seir"), SEIR, X.EVENT_SEED)
    return after.select("node", "state", F.round("age", 9).alias("age"), F.round("tau", 12).alias("tau"))


def _run_sql(model: str, count: int) -> str:
    tau = _markov_sql if model in ("sis", "sir") else _renewal_sql
    ctes, before = [], "states"
    for k in range(1, count + 1):
        ctes.append(_step_sql(model, "node", _rated_sql(model, before), tau(f"s{k}_r"), "node", k, f"s{k}"))
        before = f"s{k}"
    total = " + ".join(f"(SELECT tau FROM s{k}_t)" for k in range(1, count + 1))
    return f"WITH {X.edges_sql('weighted')}, {X.states_sql(model.split('_')[0])}, {', '.join(ctes)} SELECT node, state, round(age, 9) AS age, round({total}, 9) AS t FROM {before}"


def _run(spark: SparkSession, sf_dir: str, model: str, count: int) -> DataFrame:
    g = X.trade(spark, sf_dir, "weighted").stored()
    states = X.states(g.nodes, model.split("_")[0])
    s = Simulator(g, _MODELS[model], X.EVENT_SEED)
    s.set_states(states.drop("age") if _MODELS[model].markovian else states)
    for _ in range(count):
        s.step()
    return s.states.select("node", "state", F.round("age", 9).alias("age"), F.lit(round(s.times[0], 9)).alias("t"))


@query(_run_sql("sir", 3))
def sir_three_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "sir", 3)


@query(_run_sql("seir", 3))
def seir_three_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "seir", 3)


@query(f"{_ENSEMBLE}, {_step_sql('seir', 'node, replica', _rated_sql('seir', keys='node, replica'), _renewal_sql('s1_r', 'replica, ') + ' GROUP BY replica', f'node * {X.REPLICAS} + replica', 1, 's1')} SELECT node, replica, state, round(age, 9) AS age, round(tau, 12) AS tau FROM s1")
def ensemble_seir_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "weighted")
    after = steps.ensemble_step(g, X.ensemble(g.nodes, "seir"), SEIR, X.REPLICAS, X.EVENT_SEED)
    return after.select("node", "replica", "state", F.round("age", 9).alias("age"), F.round("tau", 12).alias("tau"))


@query(f"WITH {X.edges_sql('weighted')}, {X.states_sql('seir')}, {_step_sql('seir', 'node', _rated_sql('seir'), _renewal_sql('s1_r'), 'node', 1, 's1')}, e AS (SELECT ({X.uniform_sql('node', X.EVENT_SEED, 1)}) < {X.expm1_sql('(rate * tau)')} AS event, {X.expm1_sql('(rate * tau)')} AS p FROM s1_r, s1_t) SELECT sum(event::BIGINT)::BIGINT AS accepted, round(sum(p), 9) AS expected, round((sum(event::BIGINT) - sum(p)) / greatest(sqrt(sum(p)), 1), 6) AS z, abs((sum(event::BIGINT) - sum(p)) / greatest(sqrt(sum(p)), 1)) < 6 AS passed FROM e")
def event_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sporeline.operators import series

    g = X.trade(spark, sf_dir, "weighted")
    rated = steps.rates(g, X.states(g.nodes, "seir"), SEIR)
    sized = rated.crossJoin(F.broadcast(steps.step_size(rated, SEIR, steps.RENEWAL).select("tau"))).withColumn("p", L.event_probability(F.col("rate"), F.col("tau")))
    drawn = L.leap(sized, SEIR, F.col("node"), X.EVENT_SEED, 1)
    return series.event_score(drawn).select("accepted", F.round("expected", 9).alias("expected"), F.round("z", 6).alias("z"), "passed")


@query()
def simulator_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of several steps through the facade, from random seeds."""
    s = Simulator(X.trade(spark, sf_dir, "unit").stored(), SIR, 1, Config(theta=0.05, max_prob=0.3))
    return s.seed_infection(K).run(0.5, record_every=0.1)


@query()
def exact_sir_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "unit").stored()
    return exact.event_times(g, L.sampled_nodes(g.nodes, K, 9), 0.05, ("exponential", 0.5), seed=1)


@query()
def exact_seir_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "unit").stored()
    times = exact.event_times(g, L.sampled_nodes(g.nodes, K, 9), 0.02, ("lognormal", DWELL["ir_mean"], DWELL["ir_median"]), ("lognormal", DWELL["ei_mean"], DWELL["ei_median"]), seed=1)
    return exact.curve(stored(times, "event-times"), 0.5, 81)
