"""Graphs as two DataFrames: nodes(node) with ids 0..n-1 and directed edges(src, dst, weight), where src acts on dst.

Parallel edges and self-loops stay and add up. A graph without a weight column is a unit graph, whose sums are counts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sporeline.sources.storage import bucketed, dropped, stored

#: Largest over mean degree from which a graph counts as skewed, and as strongly skewed.
SKEWED, STRONGLY = 4.0, 50.0
#: Rows of a join or a grouping that a task gets on average. Spark's adaptive plans merge tasks by compressed bytes, of which sorted or
#: repeated ids have few, so that a task's memory would grow with the graph. Less than four such tasks are left to those plans.
TASK_ROWS = 500_000
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def dealt(df: DataFrame, rows: int | None, *by: str) -> DataFrame:
    """df by hashes of its columns by, in as many tasks as so many rows need; as it is, if these are few or not known."""
    tasks = -(-(rows or 0) // TASK_ROWS)
    return df.repartition(tasks, *by) if tasks >= 4 else df


@dataclass(frozen=True)
class Graph:
    """hubs(node, out_salts, in_salts), if the graph's skew was measured and any node has more edges than a task should hold.

    size: how many edges there are at most, if it is known; joins and groupings of edges have as many tasks as it needs.
    by_source: the edges lie in buckets by src.
    """

    nodes: DataFrame
    edges: DataFrame
    hubs: DataFrame | None = None
    size: int | None = None
    by_source: bool = False

    @property
    def weighted(self) -> bool:
        return "weight" in self.edges.columns

    @property
    def weight(self):
        return F.col("weight") if self.weighted else F.lit(1).cast("long")

    def transpose(self) -> Graph:
        """The same edges in the opposite direction, with their weights."""
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        hubs = None if self.hubs is None else self.hubs.select("node", F.col("in_salts").alias("out_salts"), F.col("out_salts").alias("in_salts"))
        return Graph(self.nodes, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest), hubs, self.size)

    def measured(self, tasks: int | None = None) -> Graph:
        """The graph with its hubs, from one count of edges by node: gathers deal a hub's edges to several tasks.

        A hub's edges on one side are more than half of what each of so many tasks would have; there are less than 4 * tasks of
        them, whatever the graph. A graph whose largest degree is near the mean has no hubs to look for.
        """
        n = tasks or int(self.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
        degrees = stored(self.edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.o").alias("o"), F.sum("e.i").alias("i")), "degrees")
        found = degrees.agg(F.sum("o").alias("edges"), F.max(F.greatest("o", "i")).alias("most"), F.count("*").alias("nodes")).first()
        if not found.edges or found.most < SKEWED * found.edges / found.nodes or 2 * n * found.most <= found.edges:
            dropped(degrees)
            return replace(self, hubs=None, size=found.edges or 0)
        salts = lambda c: F.greatest(F.ceil(2 * n * F.col(c) / found.edges), F.lit(1)).cast("int")
        hubs = stored(degrees.where(F.greatest("o", "i") * 2 * n > found.edges).select("node", salts("o").alias("out_salts"), salts("i").alias("in_salts")), "hubs")
        dropped(degrees)
        return replace(self, hubs=hubs, size=found.edges)

    def joined(self, side: DataFrame, end: str, how: str = "inner", few: bool = False) -> DataFrame:
        """The edges joined with side on its column named end (src or dst), of which side has a few rows for each node.

        Where the graph has hubs, their edges are dealt out by the other end, and side's rows for them are copied as often. few: side may
        be small enough to be sent to all tasks, so edges aren't dealt out beforehand.
        """
        if self.by_source and end == "src":
            return self.edges.join(side.hint("shuffle_hash"), end, how)  # neither shuffled nor sorted
        size = None if few else self.size
        if self.hubs is None:
            return dealt(self.edges, size, end).join(dealt(side, size, end), end, how)
        salts, other = ("out_salts", "dst") if end == "src" else ("in_salts", "src")
        hubs = F.broadcast(self.hubs.select(F.col("node").alias(end), F.col(salts).alias("_salts")))  # less than 4 * tasks rows
        salt = F.when(F.col("_salts") > 1, F.pmod(F.xxhash64(other), F.col("_salts"))).otherwise(0).cast("int")
        salted = self.edges.join(hubs, end, "left").withColumn("_salt", salt).drop("_salts")
        copies = side.join(hubs, end, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
        return dealt(salted, size, end, "_salt").join(dealt(copies, size, end, "_salt"), [end, "_salt"], how).drop("_salt")

    def with_weights(self, weights: DataFrame) -> Graph:
        """New weights from a table (src, dst, weight) or (src, dst, nth, weight).

        Parallel edges from src to dst are numbered from 0 by their old weights, and nth names one of them; without nth a row
        holds for all of them. An edge without a row, or with two, is an error, which a task raises when it meets the edge.
        """
        by = ["src", "dst", *(["nth"] if "nth" in weights.columns else [])]
        old = self.weight.alias("old")
        edges = self.edges.select("src", "dst", old)
        if "nth" in by:
            edges = dealt(edges, self.size, "src", "dst").withColumn("nth", F.row_number().over(Window.partitionBy("src", "dst").orderBy("old")) - 1)
        new = dealt(weights, self.size, *by).groupBy(*by).agg(F.min("weight").alias("weight"), F.count("*").alias("rows"))
        held = dealt(edges, self.size, *by).join(new, by, "left")
        edge = F.concat(F.col("src").cast("string"), F.lit(" to "), F.col("dst").cast("string"))
        checked = F.when(F.col("rows").isNull() | F.col("weight").isNull(), F.raise_error(F.concat(F.lit("no weight for the edge from "), edge)).cast("double")).when(F.col("rows") > 1, F.raise_error(F.concat(F.lit("two weights for the edge from "), edge)).cast("double")).otherwise(F.col("weight"))
        return replace(self, edges=held.select("src", "dst", checked.alias("weight")))

    def rounded_weights(self) -> Graph:
        """Weights with the 8 significant bits that a 16-bit brain float keeps, as doubles."""
        power = F.pow(F.lit(2.0), F.floor(F.log2(F.abs("weight"))) - 7)
        return replace(self, edges=self.edges.withColumn("weight", F.when(F.col("weight") == 0, F.col("weight")).otherwise(F.rint(F.col("weight") / power) * power)))

    def bucketed(self) -> Graph:
        """The graph with its edges stored by source, if they are many and it has no hubs: for many joins on src."""
        tasks = -(-(self.size or 0) // TASK_ROWS)
        if tasks < 4 or self.hubs is not None:
            return self
        n = max(tasks, int(self.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return replace(self, edges=bucketed(self.edges, "edges", "src", n), by_source=True)

    def stored(self) -> Graph:
        """The graph in the shared folder, with its hubs measured: for many steps over one graph."""
        return Graph(stored(self.nodes, "nodes"), stored(self.edges, "edges")).measured()


def node_range(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("node"))


def from_edges(edges: DataFrame, num_nodes: int) -> Graph:
    """A graph from a table (src, dst) or (src, dst, weight), after one pass that validates it."""
    if isinstance(num_nodes, bool) or not isinstance(num_nodes, int) or num_nodes < 0:
        raise ValueError("num_nodes is an integer, 0 at least")
    weighted = "weight" in edges.columns
    for c in ("src", "dst"):
        if not isinstance(edges.schema[c].dataType, INTEGERS):
            raise TypeError(f"{c} must be an integer column")
    bad = (F.col("src").isNull() | F.col("dst").isNull() | (F.least("src", "dst") < 0) | (F.greatest("src", "dst") >= num_nodes)).cast("long")
    w = F.col("weight").cast("double") if weighted else F.lit(1.0)
    bad_weight = (w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf"))).cast("long")
    found = edges.agg(F.sum(bad).alias("ids"), F.sum(bad_weight).alias("weights"), F.count("*").alias("edges")).first()
    if found.ids:
        raise ValueError(f"{found.ids} edges have an id outside of 0..{num_nodes - 1}")
    if found.weights:
        raise ValueError(f"{found.weights} edges have a weight that is negative or not finite")
    columns = [F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")] + ([F.col("weight")] if weighted else [])
    return Graph(node_range(edges.sparkSession, num_nodes), edges.select(*columns), size=found.edges)


def from_csr(rows: DataFrame, columns: DataFrame, incoming: bool = True) -> Graph:
    """A graph from rows(node, row_start, row_end) and columns(pos, src[, weight]); rows are targets if incoming, else sources.

    Each row's positions are generated and joined with the columns by position.
    """
    ok = rows.agg(F.min("row_start").alias("low"), F.max("row_end").alias("high"), F.sum((F.col("row_end") < F.col("row_start")).cast("long")).alias("bad"), F.sum(F.col("row_end") - F.col("row_start")).alias("n")).first()
    if ok.bad or (ok.low is not None and (ok.low != 0 or ok.high != ok.n)):
        raise ValueError("rows must start at 0, not decrease, and cover all columns")
    held = rows.where("row_end > row_start").select("node", F.explode(F.sequence("row_start", F.col("row_end") - 1)).alias("pos"))
    rest = ["weight"] if "weight" in columns.columns else []
    edges = dealt(held, ok.n, "pos").join(dealt(columns, ok.n, "pos"), "pos").select(F.col("src"), F.col("node").alias("dst"), *rest)
    graph = Graph(rows.select("node"), edges, size=ok.n or 0)
    return graph if incoming else graph.transpose()


def numbered(df: DataFrame, *order, name: str = "number", partitions: int | None = None) -> DataFrame:
    """df with each row's place (from 0) in the order of all rows, without bringing all rows to one task.

    Rows are sorted by ranges; a row's place is its place in its range plus the rows of the ranges before, of which there
    are as many as partitions. The sorted rows are stored first, so that both parts see the same ranges.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    ranged = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", at).select("*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_place")).drop("_at"), "numbered")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def ranged(df: DataFrame, name: str, *order, partitions: int | None = None) -> DataFrame:
    """df in the shared folder, dealt out to ranges of the order; _part numbers them in that order."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), name)


def csr_rows(graph: Graph) -> DataFrame:
    """node, row_start, row_end: each target's slice of the edges in order of (dst, src).

    The running sum over nodes is taken within ranges of ids, and over the ranges' sums.
    """
    degree = graph.nodes.join(graph.edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("degree")), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))
    ranges = ranged(degree, "degrees", "node")
    sums = ranges.groupBy("_part").agg(F.sum("degree").alias("_n"))
    before = sums.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    running = ranges.withColumn("row_end", F.sum("degree").over(Window.partitionBy("_part").orderBy("node")))
    placed = running.join(F.broadcast(before), "_part")
    return placed.select("node", (F.col("_before") + F.col("row_end") - F.col("degree")).alias("row_start"), (F.col("_before") + F.col("row_end")).alias("row_end"))


def neighbour_lists(graph: Graph) -> DataFrame:
    """node and its sorted sources (repeated for parallel edges; empty for isolated nodes)."""
    held = graph.edges.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_list("src")).alias("sources"))
    return graph.nodes.join(held, "node", "left").select("node", F.coalesce("sources", F.array().cast("array<bigint>")).alias("sources"))


def neighbour_blocks(graph: Graph, size: int = 4096) -> DataFrame:
    """node, block, sources: as neighbour_lists, but a row has at most size sources, so that a hub's list spans many rows.

    Edges are numbered in the order of (dst, src) over all ranges, and a block ends where a multiple of size is passed. Blocks of
    a node count from 0 and its sources go on from block to block in order; isolated nodes have one empty block.
    """
    if size < 1:
        raise ValueError("a block has room for one source at least")
    placed = numbered(graph.edges.select("dst", "src"), "dst", "src").select("dst", "src", F.expr(f"number div {int(size)}").alias("_stretch"))
    held = placed.groupBy(F.col("dst").alias("node"), "_stretch").agg(F.sort_array(F.collect_list("src")).alias("sources"))
    counted = held.withColumn("block", F.row_number().over(Window.partitionBy("node").orderBy("_stretch")) - 1)
    return graph.nodes.join(counted, "node", "left").select("node", F.coalesce("block", F.lit(0)).alias("block"), F.coalesce("sources", F.array().cast("array<bigint>")).alias("sources"))


def symmetrised(edges: DataFrame) -> DataFrame:
    """edges and each of them in the opposite direction."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def trade_graph(orders: DataFrame, lineitem: DataFrame, customer: DataFrame, supplier: DataFrame, kind: str = "unit") -> Graph:
    """Customers and suppliers that trade: customer ids, then supplier ids after them.

    kind: unit (each pair once, both ways), weighted (with the number of line items as weight), multi (an edge for each
    line item), directed (as weighted, customers to suppliers only), valued (weight: total quantity).
    """
    if kind not in ("unit", "weighted", "multi", "directed", "valued"):
        raise ValueError(f"no such kind of graph: {kind}")
    n_customers, lines = customer.count(), lineitem.count()  # counts come from the files' footers
    ordered = dealt(orders.select("o_orderkey", F.col("o_custkey").cast("long").alias("src")), lines, "o_orderkey")
    lined = dealt(lineitem.select("l_orderkey", F.col("l_suppkey").cast("long").alias("dst"), "l_quantity"), lines, "l_orderkey")
    sold = ordered.join(lined, F.col("o_orderkey") == F.col("l_orderkey")).select("src", "dst", "l_quantity")
    if kind == "unit":
        pairs = dealt(sold.select("src", "dst"), lines, "src", "dst").distinct()
    elif kind == "multi":
        pairs = sold.select("src", "dst")
    else:
        weight = F.sum(F.col("l_quantity").cast("double")) if kind == "valued" else F.count("*")
        pairs = dealt(sold, lines, "src", "dst").groupBy("src", "dst").agg(weight.alias("weight"))
    pairs = pairs.withColumn("dst", F.col("dst") + n_customers)
    both = kind != "directed"
    return Graph(node_range(orders.sparkSession, n_customers + supplier.count()), symmetrised(pairs) if both else pairs, size=lines * (1 + both))


def load_edges(spark: SparkSession, path: str, base: int = 0, weights: bool = True) -> DataFrame:
    """src, dst and weight from lines of two or three fields parted by white space.

    Lines with fewer than two fields are skipped, a missing weight is 1, and base is taken from the ids.
    """
    fields = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    held = spark.read.text(path).select(fields.alias("f")).where(F.size("f") >= 2)
    columns = [(F.get("f", i).cast("long") - base).alias(c) for i, c in ((0, "src"), (1, "dst"))]
    if weights:
        columns.append(F.coalesce(F.get("f", 2).cast("double"), F.lit(1.0)).alias("weight"))
    return held.select(*columns)


def load_graph(spark: SparkSession, path: str, num_nodes: int | None = None, base: int = 0) -> Graph:
    """A weighted graph from a file of edges; without num_nodes, the largest id is the last one."""
    edges = load_edges(spark, path, base)
    if num_nodes is None:
        top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
        num_nodes = 0 if top is None else top + 1
    return from_edges(edges, num_nodes)


def save_edges(graph: Graph, path: str, base: int = 0) -> None:
    """Lines "src dst", without weights, in as many files as the edges have partitions."""
    graph.edges.select(F.concat_ws(" ", F.col("src") + base, F.col("dst") + base).alias("value")).write.text(path)
