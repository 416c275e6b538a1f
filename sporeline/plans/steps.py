"""One tau leap as a lazy plan: rates from pressure, a step size by aggregation, draws, states after the step.

The step size is a table of one row (one for each replica), joined to the rates; it never comes to the driver here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporeline.operators import influence as J
from sporeline.operators import leaps as L
from sporeline.operators.models import Model
from sporeline.sources.graphs import Graph
from sporeline.sources.storage import stored


def rates(graph: Graph, states: DataFrame, model: Model) -> DataFrame:
    """node, state, age, pressure, rate. Only susceptible nodes listen; nodes in absorbing states take no part in joins and have rate 0."""
    idle = F.col("state").isin(list(model.absorbing))
    settled, states = states.where(idle), states.where(~idle)
    if model.infectivity is None:
        felt = J.susceptible_pressure(graph, states, model.susceptible, list(model.inducers)).select("node", F.col("influence").alias("pressure"))
    else:
        listening = states.where(F.col("state") == model.susceptible).select("node")
        sent = states.where(F.col("state").isin(list(model.inducers))).select("node", model.infectivity(F.col("state"), F.col("age")).alias("infectivity"))
        felt = J.pressure(J.heard(graph, listening), sent)
    held = states.join(felt, "node", "left").select("node", "state", "age", F.coalesce("pressure", F.lit(0)).cast("double").alias("pressure"))
    rated = held.withColumn("rate", model.rate(F.col("state"), F.col("age"), F.col("pressure")).cast("double"))
    return rated.unionByName(settled.select("node", "state", "age", F.lit(0.0).alias("pressure"), F.lit(0.0).alias("rate"))) if model.absorbing else rated


def step_size(rated: DataFrame, model: Model, control: dict, by: tuple[str, ...] = ()) -> DataFrame:
    """tau (for each value of by's columns), n, invalid. control: epsilon and tau_max, or theta, max_prob, tau_min and tau_max."""
    found = L.rate_summary(rated, by)
    if model.markovian:
        tau = L.markov_tau(F.col("total"), F.col("highest"), F.col("n"), **control)
    else:
        tau = L.renewal_tau(F.col("highest"), **control)
    return found.select(*by, tau.alias("tau"), "n", "invalid")


MARKOV = {"theta": 0.01, "max_prob": 0.1, "tau_min": 1e-6, "tau_max": 1.0}
RENEWAL = {"epsilon": 0.03, "tau_max": 0.1}


def one_step(graph: Graph, states: DataFrame, model: Model, seed: int, step: int = 1, control: dict | None = None) -> DataFrame:
    """node, state, age, tau, event after one step of states(node, state, age)."""
    rated = stored(rates(graph, states, model), "rates")  # read twice: for the step size, and for the leap
    tau = step_size(rated, model, control or (MARKOV if model.markovian else RENEWAL)).select("tau")
    return L.leap(rated.crossJoin(F.broadcast(tau)), model, F.col("node"), seed, step).select("node", "state", "age", "tau", "event")  # one row


def ensemble_rates(graph: Graph, states: DataFrame, model: Model, replicas: int) -> DataFrame:
    """node, replica, state, age, pressure, rate for states(node, replica, state, age); the edges are joined once for all replicas.

    Only nodes that feel anything come back from the edges, and rows in absorbing states have rate 0 without a hazard.
    """
    idle = F.col("state").isin(list(model.absorbing))
    if model.infectivity is None:
        felt = J.ensemble_felt(graph, states, list(model.inducers), replicas).select("node", "replica", F.col("influence").alias("pressure"))
    else:
        felt = J.ensemble_pressure(graph, states.select("node", "replica", model.infectivity(F.col("state"), F.col("age")).alias("infectivity")))
    held = states.join(felt, ["node", "replica"], "left").select("node", "replica", "state", "age", F.coalesce("pressure", F.lit(0)).cast("double").alias("pressure"))
    rate = model.rate(F.col("state"), F.col("age"), F.col("pressure")).cast("double")
    return held.withColumn("rate", F.when(idle, F.lit(0.0)).otherwise(rate) if model.absorbing else rate)


def ensemble_step(graph: Graph, states: DataFrame, model: Model, replicas: int, seed: int, step: int = 1, control: dict | None = None) -> DataFrame:
    """node, replica, state, age, tau, event after one step in which every replica has its own tau."""
    rated = stored(ensemble_rates(graph, states, model, replicas), "rates")
    tau = step_size(rated, model, control or (MARKOV if model.markovian else RENEWAL), ("replica",)).select("replica", "tau")
    return L.leap(rated.join(F.broadcast(tau), "replica"), model, F.col("node"), seed, step, replicas=replicas).select("node", "replica", "state", "age", "tau", "event")  # a row for each replica
