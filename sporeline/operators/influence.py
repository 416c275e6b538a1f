"""What sources send along edges: joins of edges with states, summed by target.

Filters go first: only sources in an inducing state (and, for pressure, only targets that listen) take part in the join,
and a target's partial sums are made before the shuffle. Targets without such a source get 0.

Every gather joins through Graph.joined, so that a graph whose skew was measured has its hubs' edges dealt to several tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sporeline.sources.graphs import Graph, dealt
from sporeline.sources.storage import dropped, stored


def _all_targets(graph: Graph, held: DataFrame, columns: list[str], zero: Column) -> DataFrame:
    return graph.nodes.join(held, "node", "left").select("node", *(F.coalesce(c, zero).alias(c) for c in columns))


def influence(graph: Graph, states: DataFrame, inducers: list[int]) -> DataFrame:
    """node, influence: the weights of edges from nodes in any inducing state."""
    sending = states.where(F.col("state").isin(inducers)).select(F.col("node").alias("src"))
    held = graph.joined(sending, "src").groupBy(F.col("dst").alias("node")).agg(F.sum(graph.weight).alias("influence"))
    return _all_targets(graph, held, ["influence"], F.lit(0))


def influence_by_state(graph: Graph, states: DataFrame, inducers: list[int]) -> DataFrame:
    """node, and influence_q for each inducing state q."""
    sending = states.where(F.col("state").isin(inducers)).select(F.col("node").alias("src"), F.col("state").alias("_q"))
    names = [f"influence_{q}" for q in inducers]
    sums = [F.sum(F.when(F.col("_q") == q, graph.weight).otherwise(0)).alias(n) for q, n in zip(inducers, names, strict=True)]
    return _all_targets(graph, graph.joined(sending, "src").groupBy(F.col("dst").alias("node")).agg(*sums), names, F.lit(0))


def pressure(graph: Graph, payload: DataFrame) -> DataFrame:
    """node, pressure: weights times the senders' infectivity, from payload(node, infectivity); zero payloads don't travel."""
    sending = payload.where(F.col("infectivity") != 0).select(F.col("node").alias("src"), "infectivity")
    held = graph.joined(sending, "src").groupBy(F.col("dst").alias("node")).agg(F.sum(graph.weight * F.col("infectivity")).alias("pressure"))
    return _all_targets(graph, held, ["pressure"], F.lit(0.0))


def susceptible_pressure(graph: Graph, states: DataFrame, susceptible: int, inducers: list[int]) -> DataFrame:
    """node, influence of the susceptible nodes only: edges to others are dropped before the join with sources."""
    listening = states.where(F.col("state") == susceptible).select("node")
    return influence(heard(graph, listening), states, inducers)


def heard(graph: Graph, listening: DataFrame) -> Graph:
    """The graph of the edges into listening(node) and of those nodes."""
    return replace(graph, nodes=listening, edges=graph.joined(listening.select(F.col("node").alias("dst")), "dst", "left_semi"))


def salted_influence(graph: Graph, states: DataFrame, inducers: list[int]) -> DataFrame:
    """As influence, after the graph's hubs are measured, if they weren't yet."""
    return influence(graph if graph.hubs is not None else graph.measured(), states, inducers)


def ensemble_felt(graph: Graph, states: DataFrame, inducers: list[int], replicas: int) -> DataFrame:
    """node, replica, influence of those with any, from states(node, replica, state). The edges are joined once: a source brings a list of its replicas."""
    sending = states.where(F.col("state").isin(inducers)).groupBy(F.col("node").alias("src")).agg(F.collect_list("replica").alias("_in"))
    sums = [F.sum(F.when(F.array_contains("_in", r), graph.weight).otherwise(0)).alias(str(r)) for r in range(replicas)]
    wide = graph.joined(sending, "src").groupBy(F.col("dst").alias("node")).agg(*sums)
    return wide.select("node", F.posexplode(F.array(*(F.col(str(r)) for r in range(replicas)))).alias("replica", "influence")).where("influence <> 0")


def ensemble_influence(graph: Graph, states: DataFrame, inducers: list[int], replicas: int) -> DataFrame:
    """node, replica, influence for every node and replica."""
    long = ensemble_felt(graph, states, inducers, replicas)
    every = graph.nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("replica"))
    return every.join(long, ["node", "replica"], "left").select("node", "replica", F.coalesce("influence", F.lit(0)).alias("influence"))


def ensemble_pressure(graph: Graph, payload: DataFrame) -> DataFrame:
    """node, replica, pressure (rows of targets with any) from payload(node, replica, infectivity)."""
    sending = payload.where(F.col("infectivity") != 0).select(F.col("node").alias("src"), "replica", "infectivity")
    return graph.joined(sending, "src").groupBy(F.col("dst").alias("node"), "replica").agg(F.sum(graph.weight * F.col("infectivity")).alias("pressure"))


#: Replicas in a word of a mask.
WORD = 64


def packed(states: DataFrame, inducers: list[int], replicas: int) -> DataFrame:
    """node, mask: an array of words; bit r % 64 of word r // 64 is set if the node is in an inducing state in replica r.

    A replica outside of 0..replicas - 1 is an error, which the task that meets it raises.
    """
    if replicas < 1:
        raise ValueError("one replica at least")
    r = F.col("replica")
    outside = F.raise_error(F.concat(F.lit("no such replica: "), F.coalesce(r.cast("string"), F.lit("null")))).cast("long")
    bit = F.when(r.isNull() | (r < 0) | (r >= replicas), outside).when(F.col("state").isin(inducers), F.expr(f"shiftleft(1L, cast(replica % {WORD} as int))")).otherwise(F.lit(0).cast("long"))
    held = states.select("node", F.floor(r / WORD).alias("_word"), bit.alias("_bit"))
    words = [F.bit_or(F.when(F.col("_word") == w, F.col("_bit")).otherwise(F.lit(0).cast("long"))) for w in range(-(-replicas // WORD))]
    return held.groupBy("node").agg(F.array(*words).alias("mask"))


def packed_influence(graph: Graph, masks: DataFrame, replicas: int) -> DataFrame:
    """node, replica, influence from masks(node, mask). Words without a bit don't travel; a target's sums are made a word of replicas at a time."""
    words = masks.select(F.col("node").alias("src"), F.posexplode("mask").alias("_word", "_bits")).where("_bits <> 0")
    sums = [F.sum(graph.weight * F.getbit("_bits", F.lit(k))).alias(str(k)) for k in range(min(WORD, replicas))]
    # A group is as wide as a word has replicas: rows are brought together before they are summed, not a group in each task.
    sent = graph.joined(words, "src").withColumnRenamed("dst", "node").drop("src")
    if graph.hubs is None:
        sent = dealt(sent, None if graph.size is None else graph.size * -(-replicas // WORD), "node", "_word")
    wide = sent.groupBy("node", "_word").agg(*sums)
    every = graph.nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(-(-replicas // WORD) - 1))).alias("_word")).join(wide, ["node", "_word"], "left")
    held = every.select("node", "_word", F.posexplode(F.array(*(F.coalesce(F.col(str(k)), F.lit(0)) for k in range(min(WORD, replicas))))).alias("_k", "influence"))
    return held.select("node", (F.col("_word") * WORD + F.col("_k")).alias("replica"), "influence").where(F.col("replica") < replicas)


def frontier_delta(graph: Graph, changed: DataFrame, inducers: list[int]) -> DataFrame:
    """node, delta: what influence gains as nodes change, from changed(node, before, after); only edges out of changed nodes are read."""
    step = F.col("after").isin(inducers).cast("int") - F.col("before").isin(inducers).cast("int")
    moved = changed.select(F.col("node").alias("src"), step.alias("_d")).where("_d <> 0")
    return graph.joined(moved, "src", few=True).groupBy(F.col("dst").alias("node")).agg(F.sum(graph.weight * F.col("_d")).alias("delta"))


def updated_influence(before: DataFrame, delta: DataFrame) -> DataFrame:
    """node, influence after a change, from that before and frontier_delta's."""
    return before.join(delta, "node", "left").select("node", (F.col("influence") + F.coalesce("delta", F.lit(0))).alias("influence"))


def frontier_edges(graph: Graph, changed: DataFrame) -> DataFrame:
    """frontier and total edges, and whether the whole influence should be rebuilt: from a fifth of all edges on."""
    out = graph.joined(changed.select(F.col("node").alias("src")), "src", "left_semi", few=True).agg(F.count("*").alias("frontier"))
    both = out.crossJoin(graph.edges.agg(F.count("*").alias("total")))  # one row each
    return both.withColumn("rebuild", 5 * F.col("frontier") >= F.col("total"))


#: Frontier steps after which the influence is made anew, so that what rounding adds up to stays small.
REBUILD_AFTER = 256


@dataclass(frozen=True)
class Frontier:
    """Stored states and influence of a graph, kept up as nodes change: steps counts frontier steps since the influence was last made anew."""

    graph: Graph
    inducers: tuple[int, ...]
    states: DataFrame
    influence: DataFrame
    steps: int = 0
    rebuilds: int = 0
    rebuild_after: int = REBUILD_AFTER

    @classmethod
    def started(cls, graph: Graph, states: DataFrame, inducers: list[int], rebuild_after: int = REBUILD_AFTER) -> Frontier:
        if rebuild_after < 1:
            raise ValueError("one step at least between rebuilds")
        held = stored(states, "states")
        return cls(graph, tuple(inducers), held, stored(influence(graph, held, inducers), "influence"), rebuild_after=rebuild_after)

    def after(self, changed: DataFrame) -> Frontier:
        """The frontier after the changes in changed(node, before, after), a row for each node that changes; the tables of this one are deleted.

        A change that touches a fifth of all edges, or one after rebuild_after frontier steps, makes the influence anew.
        """
        changed = stored(changed.select("node", "before", "after"), "changed")
        rest = [c for c in self.states.columns if c not in ("node", "state")]
        new = changed.select("node", F.col("after").alias("_after"))
        states = stored(self.states.join(new, "node", "left").select("node", F.coalesce("_after", "state").alias("state"), *rest), "states")
        rebuild = self.steps >= self.rebuild_after or frontier_edges(self.graph, changed).first().rebuild
        if rebuild:
            held = influence(self.graph, states, list(self.inducers))
        else:
            held = updated_influence(self.influence, frontier_delta(self.graph, changed, list(self.inducers)))
        held = stored(held, "influence")
        for old in (changed, self.states, self.influence):
            dropped(old)
        return replace(self, states=states, influence=held, steps=0 if rebuild else self.steps + 1, rebuilds=self.rebuilds + rebuild)
