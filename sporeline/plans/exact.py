"""Exact event times of SIR and SEIR epidemics with any dwell times, as shortest paths.

A node that is infected at t becomes infectious after a latent time L and stays so for D. It sends along an edge after an
exponential time T, if T < D. So the time a node is infected is the length of the shortest path from a seed, over edges
with T < D and length L + T. All times are drawn in advance from hashes; rounds of joins relax only the edges of nodes
whose time has just got earlier, and end when none has. (Where nodes can be infected again, times aren't shortest paths.)
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sporeline.functions.hazards import lognormal_parameters
from sporeline.functions.rng import derived_seed, with_uniform
from sporeline.sources.graphs import Graph, dealt
from sporeline.sources.storage import dropped, stored

# Domains of the draws of latent, infectious and sending times.
LATENT, INFECTIOUS, SENDING = 1, 2, 3


def exponential(u: Column, v: Column, rate: float) -> Column:
    return -F.log(u) / rate


def lognormal_time(u: Column, v: Column, mean: float, median: float) -> Column:
    mu, sigma = lognormal_parameters(mean, median)
    return F.exp(mu + sigma * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v))


def _with_time(df: DataFrame, name: str, lane: Column, seed: int, domain: int, dwell) -> DataFrame:
    """dwell: None for no time, ("exponential", rate) or ("lognormal", mean, median)."""
    if dwell is None:
        return df.withColumn(name, F.lit(0.0))
    own = derived_seed(seed, domain)
    df = with_uniform(with_uniform(df, "_u", lane, own, 1), "_v", lane, own, 2)
    kind, *p = dwell
    return df.withColumn(name, {"exponential": exponential, "lognormal": lognormal_time}[kind](F.col("_u"), F.col("_v"), *p)).drop("_u", "_v")


def event_times(graph: Graph, seeds: DataFrame, beta: float, infectious: tuple, latent: tuple | None = None, seed: int = 0, rounds: int = 10_000) -> DataFrame:
    """node, infected_at, infectious_at, removed_at (null for nodes that are never infected), for seeds(node) infected at 0."""
    n = graph.nodes.agg(F.count("*")).first()[0]
    dwell = _with_time(_with_time(graph.nodes.select("node"), "latent", F.col("node"), seed, LATENT, latent), "infectious", F.col("node"), seed, INFECTIOUS, infectious)
    dwell = stored(dwell, "dwell")
    by = ["src"] if graph.hubs is None else ["src", "dst"]  # by the source alone, so that the join with dwell times needs no other shuffle
    pairs = dealt(graph.edges, graph.size, *by).groupBy("src", "dst").agg(F.sum(graph.weight).cast("double").alias("w")).where("w > 0 AND src <> dst")
    sent = _with_time(pairs, "send", F.col("src") * n + F.col("dst"), seed, SENDING, ("exponential", 1.0)).withColumn("send", F.col("send") / (beta * F.col("w"))) if beta > 0 else pairs.withColumn("send", F.lit(float("inf")))
    open_edges = Graph(graph.nodes, sent.join(dwell, F.col("src") == F.col("node")).where("send < infectious").select("src", "dst", (F.col("latent") + F.col("send")).alias("length")), size=graph.size).bucketed()
    if not open_edges.by_source:
        open_edges = replace(open_edges, edges=stored(open_edges.edges, "open-edges"))
    best = stored(seeds.select("node").distinct().select("node", F.lit(0.0).alias("t"), F.lit(True).alias("fresh")), "times")
    for _ in range(rounds):
        reached = open_edges.joined(best.where("fresh").select(F.col("node").alias("src"), "t"), "src", few=True).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("t") + F.col("length")).alias("new"))
        after = best.select("node", "t").join(reached, "node", "full").select("node", F.least("t", "new").alias("t"), (F.col("new").isNotNull() & (F.col("t").isNull() | (F.col("new") < F.col("t")))).alias("fresh"))
        after = stored(after, "times")
        dropped(best)
        best = after
        if not best.where("fresh").take(1):
            break
    else:
        raise RuntimeError(f"times still change after {rounds} rounds")
    dropped(open_edges.edges)
    held = dwell.join(best.select("node", F.col("t").alias("infected_at")), "node", "left")
    return held.select("node", "infected_at", (F.col("infected_at") + F.col("latent")).alias("infectious_at"), (F.col("infected_at") + F.col("latent") + F.col("infectious")).alias("removed_at"))


def curve(times: DataFrame, width: float, points: int) -> DataFrame:
    """t = 0, width, .. and how many nodes are infected (and not yet removed) and removed then; points rows."""
    ticks = times.sparkSession.range(points).select(F.col("id").alias("k"))

    def since(column: str, name: str) -> DataFrame:
        at = F.greatest(F.ceil(F.col(column) / width), F.lit(0))  # the first tick that sees the event
        return times.where(F.col(column).isNotNull() & (F.col(column) <= width * (points - 1))).groupBy(at.alias("k")).agg(F.count("*").alias(name))

    w = Window.orderBy("k")  # points rows
    held = ticks.join(since("infected_at", "_i"), "k", "left").join(since("removed_at", "_r"), "k", "left").fillna(0)
    return held.select((F.col("k") * width).alias("t"), F.sum("_i").over(w).alias("_i"), F.sum("_r").over(w).alias("removed")).select("t", (F.col("_i") - F.col("removed")).alias("infected"), "removed")
