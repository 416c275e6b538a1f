"""Connected components of an edge table, as rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporeline.llm._shared import discarded_after, materialize, salted_join


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of edges (columns a and b, both long): root is the smallest node it reaches.

    Large-star and small-star rounds in turn (Kiveris et al., 2014), until a round leaves the edges as they were.
    Each round's edges go to the shared folder; only a count, a sum of hashes and a sketch of the nodes with most edges come
    to the driver. A node with a large share of all edges is dealt to many tasks.
    """
    state = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _mark(state)
    for _ in range(rounds):
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted_join(both.where("b > a"), lowest, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).distinct()
        down = discarded_after(materialize(large, "edges"), state)
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(down, least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = discarded_after(materialize(small.select("e.a", "e.b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), down)
        mark = _mark(new)
        state = new
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components aren't done after {rounds} rounds")
    rooted = state.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return rooted.unionByName(rooted.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
