"""Random graphs as Spark jobs: every edge is drawn from a hash of its number, so nothing passes through the driver."""

from __future__ import annotations

import math
import random
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sporeline.functions.rng import uniform, with_uniform
from sporeline.sources.graphs import Graph, node_range, numbered, symmetrised
from sporeline.sources.storage import dropped, stored


def _checked(n: int, **numbers: int) -> None:
    if n <= 0:
        raise ValueError("a graph has one node at least")
    for name, x in numbers.items():
        if isinstance(x, bool) or not isinstance(x, int) or x < 0:
            raise ValueError(f"{name} is an integer, 0 at least")


def circulant_offsets(n: int, degree: int, seed: int | None) -> list[int]:
    """Seeded offsets in both directions, and half the ring if the degree is odd: the first different ones that are drawn from lanes 0, 1, .."""
    _checked(n, degree=degree)
    if degree >= n or n * degree % 2:
        raise ValueError("a regular graph needs degree < n and an even n * degree")
    seed, half, lane = random.getrandbits(63) if seed is None else seed, (n - 1) // 2, 0
    drawn: dict[int, None] = {}
    while len(drawn) < degree // 2:
        drawn[1 + int(uniform(lane, seed, 1) * half)] = None
        lane += 1
    return [sign * o for o in drawn for sign in (1, -1)] + [n // 2] * (degree % 2)


def circulant(spark: SparkSession, n: int, degree: int, seed: int | None = None) -> Graph:
    """A simple symmetric graph in which node i has the neighbours i + offset modulo n."""
    offsets = circulant_offsets(n, degree, seed)
    nodes = node_range(spark, n)
    edges = nodes.select(F.explode(F.array(*(F.lit(o).cast("long") for o in offsets)) if offsets else F.array().cast("array<bigint>")).alias("o"), F.col("node").alias("dst"))
    return Graph(nodes, edges.select(F.pmod(F.col("dst") + F.col("o"), F.lit(n)).alias("src"), "dst"))


def circulant_components(n: int, offsets: list[int]) -> int:
    return math.gcd(n, *offsets)


def _drawn(spark: SparkSession, count: int, seed: int, draws: int) -> DataFrame:
    """id from 0 to count - 1, with uniform numbers u1, u2, .."""
    df = spark.range(count)
    for k in range(1, draws + 1):
        df = with_uniform(df, f"u{k}", F.col("id"), seed, k)
    return df


def erdos_renyi(spark: SparkSession, n: int, mean_degree: float, seed: int = 0) -> Graph:
    """Each pair of nodes is an edge with chance mean_degree / (n - 1), independently of all others.

    The pairs (a, b), a < b, are numbered row by row. A node draws how many numbers to skip to its next edge (a geometric
    variable) until its own row ends, so that the work is that of the edges and not of the pairs.
    """
    _checked(n)
    p = mean_degree / max(1, n - 1)
    if not 0 <= p <= 1:
        raise ValueError("the mean degree is from 0 to n - 1")
    if p in (0, 1) or n < 2:
        ahead = F.explode(F.sequence(F.col("node") + 1, F.lit(n - 1).cast("long")))
        pairs = node_range(spark, n).where((F.col("node") < n - 1) & F.lit(p == 1)).select(F.col("node").alias("src"), ahead.alias("dst"))
        return Graph(node_range(spark, n), symmetrised(pairs))
    state = node_range(spark, n).select("node", F.col("node").alias("at"))
    found, step = [], 0
    spread = max(1, math.ceil(mean_degree / 2 + 4 * math.sqrt(mean_degree / 2 + 1)))  # draws that end nearly all rows
    while True:
        draws = state.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        drawn = with_uniform(draws, "u", F.col("node") * spread + F.col("k"), seed, step + 1)
        skip = F.least(F.floor(F.log("u") / math.log1p(-p)), F.lit(n)) + 1
        row = Window.partitionBy("node").orderBy("k")
        met = stored(drawn.withColumn("b", F.col("at") + F.sum(skip).over(row)).select("node", "k", F.col("b").cast("long").alias("b")), "draws")
        found.append(met.where(F.col("b") < n).select(F.col("node").alias("src"), F.col("b").alias("dst")))
        state = met.where((F.col("k") == spread - 1) & (F.col("b") < n)).select("node", F.col("b").alias("at"))
        step += 1
        if not state.take(1):
            return Graph(node_range(spark, n), symmetrised(reduce(DataFrame.unionByName, found)))


def random_out(spark: SparkSession, n: int, k: int, seed: int = 0) -> Graph:
    """k random targets for each node, none of them itself; a target may repeat."""
    _checked(n, k=k)
    drawn = _drawn(spark, n * k, seed, 1).withColumn("src", F.floor(F.col("id") / k))
    target = F.floor(F.col("u1") * (n - 1))
    return Graph(node_range(spark, n), drawn.select("src", (target + (target >= F.col("src")).cast("long")).alias("dst")))


def _clashes(pairs: DataFrame) -> DataFrame:
    """pairs (id, a, b) with clash: whether the pair is a loop, or one of a lower id has the same ends."""
    ends = Window.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy("id")
    return pairs.withColumn("clash", (F.col("a") == F.col("b")) | (F.row_number().over(ends) > 1))


def random_regular(spark: SparkSession, n: int, degree: int, seed: int = 0, rounds: int = 500) -> Graph:
    """A simple graph in which every node has just degree neighbours.

    Stubs (degree for each node) in random order are paired as neighbours. Loops and repeated pairs are then mended in
    rounds: each is dealt to another pair at random and swaps an end with it; swaps that share a pair, or would make a new
    clash, are drawn anew in the next round, so degrees never change. A graph with more than half of all edges is the
    complement of one with fewer, as swaps hardly find room in it; it has n * degree edges of its own in any case.
    """
    _checked(n, degree=degree)
    if n * degree % 2 or degree >= n:
        raise ValueError("degree is less than n, and n * degree is even")
    if not degree:
        return Graph(node_range(spark, n), spark.createDataFrame([], "src long, dst long"))
    if 2 * degree > n - 1:
        few = random_regular(spark, n, n - 1 - degree, seed, rounds)
        ends = few.nodes.select(F.col("node").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("dst")).where("src <> dst")
        return Graph(few.nodes, ends.join(few.edges.select("src", "dst"), ["src", "dst"], "left_anti"))
    stubs = numbered(_drawn(spark, n * degree, seed, 1).select(F.floor(F.col("id") / degree).alias("node"), "u1", "id"), "u1", "id", name="place")
    ends = F.min_by("node", "place").alias("a"), F.max_by("node", "place").alias("b")
    pairs = stored(stubs.groupBy(F.floor(F.col("place") / 2).alias("id")).agg(*ends), "pairs")
    m = n * degree // 2
    for step in range(rounds):
        marked = stored(_clashes(pairs), "pairs")
        bad = marked.where("clash").select(F.col("id").alias("i"), F.col("a").alias("ia"), F.col("b").alias("ib"))
        if not bad.take(1):
            break
        dealt = with_uniform(bad, "u", F.col("i"), seed, step + 2).withColumn("j", F.floor(F.col("u") * m)).where("i <> j")
        met = dealt.join(marked.where("NOT clash").select(F.col("id").alias("j"), F.col("a").alias("ja"), F.col("b").alias("jb")), "j")
        alone = met.groupBy("j").agg(F.min_by(F.struct("i", "ia", "ib", "ja", "jb"), "i").alias("s")).select("j", "s.*")
        swaps = alone.select(F.explode(F.array(F.struct(F.col("i").alias("id"), F.col("ia").alias("a"), F.col("ja").alias("b")), F.struct(F.col("j").alias("id"), F.col("ib").alias("a"), F.col("jb").alias("b")))).alias("p"), F.col("i").alias("swap")).select("p.*", "swap")
        kept = marked.select("id", "a", "b").join(swaps.select("id"), "id", "left_anti").select(F.lit(-1).cast("long").alias("id"), "a", "b", F.lit(None).cast("long").alias("swap"))
        clashing = _clashes(kept.unionByName(swaps)).where("clash AND swap IS NOT NULL").select("swap").distinct()
        done = stored(swaps.join(clashing, "swap", "left_anti").select("id", "a", "b"), "swaps")
        new = stored(marked.select("id", "a", "b").join(done, "id", "left_anti").unionByName(done), "pairs")
        for x in (pairs, marked, done):
            dropped(x)
        pairs = new
    else:
        raise RuntimeError(f"clashes are left after {rounds} rounds; the degree may be too close to n")
    return Graph(node_range(spark, n), symmetrised(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))))


def watts_strogatz(spark: SparkSession, n: int, k: int, p: float, seed: int = 0, rounds: int = 500) -> Graph:
    """A ring whose nodes have k neighbours; each edge's far end moves to a random node with chance p.

    Ends that would make a loop or a repeated pair are drawn anew, so the graph has just n * (k div 2) edges.
    """
    _checked(n, k=k)
    if not 0 <= p <= 1 or k >= n:
        raise ValueError("p is a chance, and k is less than n")
    half = max(1, k // 2)
    drawn = _drawn(spark, n * (k // 2), seed, 2).withColumn("a", F.floor(F.col("id") / half))
    near = F.pmod(F.col("a") + 1 + F.col("id") % half, F.lit(n))
    moved = F.col("u1") < p
    # edges that stay come first where ends clash, as they can't be drawn anew
    return Graph(node_range(spark, n), symmetrised(_redrawn(drawn.select((F.col("id") + F.when(moved, n * k).otherwise(0)).alias("id"), "a", F.when(moved, F.floor(F.col("u2") * n)).otherwise(near).alias("b")), n, seed, rounds, lambda step: F.floor(F.col("u") * n))))


def _redrawn(pairs: DataFrame, n: int, seed: int, rounds: int, end, before: int = 3) -> DataFrame:
    """src, dst of pairs (id, a, b) after the ends b of clashing ones are drawn anew until none clashes; end(step) is b from u."""
    pairs = stored(pairs, "pairs")
    for step in range(rounds):
        marked = stored(_clashes(pairs), "pairs")
        bad = marked.where("clash")
        if not bad.take(1):
            return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        new = with_uniform(bad.select("id", "a"), "u", F.col("id"), seed, step + before).select("id", "a", end(step).alias("b"))
        new = stored(marked.where("NOT clash").select("id", "a", "b").unionByName(new), "pairs")
        dropped(pairs)
        dropped(marked)
        pairs = new
    raise RuntimeError(f"clashes are left after {rounds} rounds; the degree may be too close to n")


def barabasi_albert(spark: SparkSession, n: int, m: int, seed: int = 0, rounds: int = 200) -> Graph:
    """Preferential attachment without a sequential loop: each node from m on has m different lower neighbours.

    Node m has the nodes before it as its neighbours. Edge e of a later node draws one of the ends of the edges of earlier
    nodes: an even end is a node that is known at once, an odd one copies what edge e' drew. Such references are resolved by
    pointer jumping: each round every open edge takes over its reference's reference, so a chain of any length is done in
    the logarithm of its length. Edges that repeat a neighbour are then drawn anew, and all is resolved again.
    """
    _checked(n, m=m)
    if not m or n <= m:
        return Graph(node_range(spark, n), spark.createDataFrame([], "src long, dst long"))
    node = F.floor(F.col("id") / m) + m
    ends = with_uniform(spark.range((n - m) * m), "u", F.col("id"), seed, 1).select("id", node.alias("node"), F.floor(F.col("u") * 2 * m * (node - m)).alias("end"))
    ends = stored(ends, "ends")
    for step in range(rounds):
        known = (F.col("end") % 2 == 0) | (F.col("node") == m)
        target = F.when(F.col("node") == m, F.col("id")).when(known, F.floor(F.floor(F.col("end") / 2) / m) + m)
        state = _resolved(stored(ends.select("id", target.alias("target"), F.when(~known, F.floor(F.col("end") / 2)).alias("ref")), "attachment"))
        held = state.select("id", "target").withColumn("node", node)
        again = held.withColumn("nth", F.row_number().over(Window.partitionBy("node", "target").orderBy("id"))).where("nth > 1").select("id")
        if not again.take(1):
            return Graph(node_range(spark, n), symmetrised(held.select(F.col("node").alias("src"), F.col("target").alias("dst"))))
        drawn = with_uniform(ends.join(again, "id", "left_semi"), "u", F.col("id"), seed, step + 2).select("id", "node", F.floor(F.col("u") * 2 * m * (F.col("node") - m)).alias("end"))
        new = stored(ends.join(again, "id", "left_anti").unionByName(drawn), "ends")
        dropped(ends)
        dropped(state)
        ends = new
    raise RuntimeError(f"neighbours repeat after {rounds} rounds")


def _resolved(state: DataFrame) -> DataFrame:
    """state (id, target, ref: an id whose target an open edge takes) without open edges; refs are lower than ids, so 64 rounds do."""
    while state.where("ref IS NOT NULL").take(1):
        other = state.select(F.col("id").alias("ref"), F.col("target").alias("_target"), F.col("ref").alias("_ref"))
        jumped = state.where("ref IS NOT NULL").join(other, "ref").select("id", F.col("_target").alias("target"), F.col("_ref").alias("ref"))
        new = stored(state.where("ref IS NULL").unionByName(jumped), "attachment")
        dropped(state)
        state = new
    return state


def points(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """node, x, y: random points in the unit square."""
    return _drawn(spark, n, seed, 2).select(F.col("id").alias("node"), F.col("u1").alias("x"), F.col("u2").alias("y"))


def geometric_edges(located: DataFrame, radius: float) -> DataFrame:
    """Both directions of all pairs of points (node, x, y) within radius: points meet only those of their own and the 8 adjoining cells of that width."""
    if not radius > 0:
        raise ValueError("the radius is positive")
    cell = lambda c: F.floor(F.col(c) / radius).alias(f"c{c}")
    here = located.select("node", "x", "y", cell("x"), cell("y"))
    near = F.explode(F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("cell")
    around = here.select(F.col("node").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), near).select("other", "ox", "oy", "cell.cx", "cell.cy")
    apart = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    return here.join(around, ["cx", "cy"]).where((F.col("node") != F.col("other")) & (apart <= radius * radius)).select(F.col("node").alias("src"), F.col("other").alias("dst"))


def geometric(spark: SparkSession, n: int, radius: float, seed: int = 0) -> Graph:
    _checked(n)
    return Graph(node_range(spark, n), geometric_edges(points(spark, n, seed), radius))
