"""Degrees, bandwidth, permutations and activity of graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporeline.sources.graphs import SKEWED, STRONGLY, Graph, numbered, symmetrised
from sporeline.sources.storage import dropped, shared_dir, stored


def in_degrees(graph: Graph) -> DataFrame:
    """node, degree; isolated nodes have degree 0."""
    held = graph.edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("degree"))
    return graph.nodes.join(held, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_summary(graph: Graph) -> DataFrame:
    """n_nodes, n_edges, mean_degree, max_degree, and the strategy for the gather: plain, skewed or salted."""
    d = in_degrees(graph).agg(F.count("*").alias("n_nodes"), F.sum("degree").alias("n_edges"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"))
    ratio = F.when(F.col("mean_degree") > 0, F.col("max_degree") / F.col("mean_degree")).otherwise(0.0)
    return d.withColumn("strategy", F.when(ratio >= STRONGLY, "salted").when(ratio >= SKEWED, "skewed").otherwise("plain"))


def bandwidth(graph: Graph) -> DataFrame:
    """The largest distance between the ids of an edge's ends, 0 without edges."""
    return graph.edges.agg(F.coalesce(F.max(F.abs(F.col("src") - F.col("dst"))), F.lit(0)).alias("bandwidth"))


def permutation_check(order: DataFrame, n: int) -> DataFrame:
    """One row, valid: whether order(new, old) is a bijection of 0..n-1."""
    x = order.agg(F.count("*").alias("n"), *(f(c).alias(f"{k}_{c}") for c in ("new", "old") for k, f in (("low", F.min), ("high", F.max), ("each", F.count_distinct))))
    valid = F.col("n") == n
    for c in ("new", "old") if n else ():
        valid = valid & (F.col(f"low_{c}") == 0) & (F.col(f"high_{c}") == n - 1) & (F.col(f"each_{c}") == n)
    return x.select(F.coalesce(valid, F.lit(False)).alias("valid"))


def is_permutation(order: DataFrame, n: int) -> bool:
    """Whether order(new, old) is a bijection of 0..n-1."""
    return permutation_check(order, n).first().valid


def levels_from_roots(graph: Graph, placed: DataFrame) -> DataFrame:
    """node, place, root, level from placed(node, place): the smallest place that edges lead from, and how many edges away it is.

    Pairs of root and level travel one edge a round, from nodes whose pair has changed; there are as many rounds as the most distant
    node is edges away. graph has both directions of each edge.
    """
    reached = stored(placed.select("node", "place", F.col("place").alias("root"), F.lit(0).cast("long").alias("level"), F.lit(True).alias("moved")), "levels")
    while not reached.where("moved").isEmpty():
        sending = reached.where("moved").select(F.col("node").alias("src"), F.struct("root", "level").alias("_at"))
        heard = graph.joined(sending, "src", few=True).groupBy(F.col("dst").alias("node")).agg(F.min("_at").alias("_at"))
        nearer = F.col("_at").isNotNull() & (F.struct(F.col("_at.root").alias("root"), (F.col("_at.level") + 1).alias("level")) < F.struct("root", "level"))
        held = reached.join(heard, "node", "left").withColumn("moved", nearer)
        at = lambda c, x: F.when(F.col("moved"), x).otherwise(F.col(c)).alias(c)
        before, reached = reached, stored(held.select("node", "place", at("root", F.col("_at.root")), at("level", F.col("_at.level") + 1), "moved"), "levels")
        dropped(before)
    return reached.drop("moved")


def reverse_cuthill_mckee(graph: Graph) -> DataFrame:
    """new, old: the reverse Cuthill-McKee order of the graph, without regard to directions, loops and parallel edges.

    Each component is searched from its node of lowest (degree, id), components in the order of those. A level is ranked at once:
    nodes follow the first neighbour that they have in the level before, and of one such neighbour the lowest (degree, id)
    first, which is the order of a queue that takes one node at a time. All components advance together; a level is one join and one
    sort by ranges, so the jobs are as many as the deepest component has levels: few in contact networks, many in long chains.
    """
    spark, n = graph.nodes.sparkSession, graph.nodes.count()
    both = stored(symmetrised(graph.edges.select("src", "dst").where("src <> dst")).distinct(), "neighbours")
    flat = Graph(graph.nodes, both).measured().bucketed()
    levels = levels_from_roots(flat, numbered(in_degrees(flat), "degree", "node", name="place"))
    sorted_levels = stored(levels.repartitionByRange("level", "node").sortWithinPartitions("level"), "levels")  # a level's nodes lie together
    dropped(levels)
    deepest = sorted_levels.agg(F.max("level").alias("level")).first().level or 0
    ranks, schema = f"{shared_dir(spark)}/ranks-{uuid.uuid4().hex}", "node long, root long, level long, rank long"
    at = lambda k: f"{ranks}/step={k}"
    sorted_levels.where("level = 0").select("node", "root", "level", F.col("root").alias("rank")).write.parquet(at(0))
    for k in range(1, deepest + 1):
        before = spark.read.schema(schema).parquet(at(k - 1)).select(F.col("node").alias("src"), "rank")
        first = flat.joined(before, "src", few=True).groupBy(F.col("dst").alias("node")).agg(F.min("rank").alias("_first"))
        here = numbered(sorted_levels.where(F.col("level") == k).join(first, "node"), "_first", "place", name="rank")
        here.select("node", "root", "level", "rank").write.parquet(at(k))
    for old in (both, sorted_levels, *([flat.edges] if flat.by_source else [])):
        dropped(old)
    order = numbered(spark.read.schema(schema).parquet(ranks), "root", "level", "rank", name="place")
    return order.select((F.lit(n - 1) - F.col("place")).alias("new"), F.col("node").alias("old"))


def permuted(graph: Graph, order: DataFrame) -> Graph:
    """The graph with node old renamed to new, for each row of order(new, old)."""
    rest = [c for c in graph.edges.columns if c not in ("src", "dst")]
    of = lambda c, to: order.select(F.col("old").alias(c), F.col("new").alias(to))
    edges = graph.edges.join(of("src", "_src"), "src").join(of("dst", "_dst"), "dst")
    return Graph(graph.nodes, edges.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), *rest), size=graph.size)


def activity(graph: Graph, states: DataFrame, susceptible: int, hazard: list[int]) -> DataFrame:
    """replica, susceptible_nodes, susceptible_edges (their incoming ones), hazard_nodes from states(node, replica, state)."""
    s, h = F.col("state") == susceptible, F.col("state").isin(hazard)
    held = states.join(in_degrees(graph), "node")
    return held.groupBy("replica").agg(F.sum(s.cast("long")).alias("susceptible_nodes"), F.sum(F.when(s, F.col("degree")).otherwise(0)).alias("susceptible_edges"), F.sum(h.cast("long")).alias("hazard_nodes"))


def tile_activity(graph: Graph, states: DataFrame, susceptible: int, tile: int) -> DataFrame:
    """tile, union_nodes, union_edges: nodes susceptible in any replica of a tile of neighbouring replicas, and their incoming edges."""
    any_of = states.where(F.col("state") == susceptible).select("node", F.floor(F.col("replica") / tile).cast("int").alias("tile")).distinct()
    return any_of.join(in_degrees(graph), "node").groupBy("tile").agg(F.count("*").alias("union_nodes"), F.sum("degree").alias("union_edges"))
