"""What queries share: tables, the trade graph, and states drawn from hashes; each as Spark plan and as SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sporeline.functions import rng
from sporeline.sources.graphs import Graph, node_range, symmetrised, trade_graph

REPLICAS = 4
STATE_SEED, EVENT_SEED = 7, 2024
#: Upper ends of the shares of nodes in each state but the last.
CUTS = {"sis": (0.75,), "sir": (0.6, 0.85), "seir": (0.45, 0.6, 0.85)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str, kind: str = "unit") -> Graph:
    return trade_graph(*(table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "supplier")), kind)


def regional(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and the regions that they live in, after them: few hubs that hold all edges."""
    customers, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "customer").count()
    home = customers.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    edges = home.select(F.col("c_custkey").cast("long").alias("src"), (F.col("n_regionkey") + n).cast("long").alias("dst"))
    return Graph(node_range(spark, n + table(spark, sf_dir, "region").count()), symmetrised(edges))


def states(nodes: DataFrame, kind: str, lane=None) -> DataFrame:
    """nodes with state and age: shares by CUTS; in seir's E and I an age below 8, else 0."""
    df = rng.with_uniform(nodes, "_a", F.col("node") if lane is None else lane, STATE_SEED, 1)
    df = rng.with_uniform(df, "_b", F.col("node") if lane is None else lane, STATE_SEED, 2)
    state = F.lit(len(CUTS[kind]))
    for q in range(len(CUTS[kind]) - 1, -1, -1):
        state = F.when(F.col("_a") < CUTS[kind][q], F.lit(q)).otherwise(state)
    age = F.when(F.col("state").isin(1, 2), 8 * F.col("_b")).otherwise(0.0) if kind == "seir" else F.lit(0.0)
    return df.withColumn("state", state).withColumn("age", age).drop("_a", "_b")


def ensemble(nodes: DataFrame, kind: str, replicas: int = REPLICAS) -> DataFrame:
    every = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("replica"))
    return states(every, kind, F.col("node") * replicas + F.col("replica"))


# The same in SQL.

N_CUSTOMERS, N_SUPPLIERS = "(SELECT count(*) FROM customer)", "(SELECT count(*) FROM supplier)"
N = f"({N_CUSTOMERS} + {N_SUPPLIERS})"
NODES = f"nodes AS (SELECT unnest(range({N})) AS node)"
_SOLD = f"SELECT o_custkey::BIGINT AS src, {N_CUSTOMERS} + l_suppkey AS dst, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
_PAIRS = {
    "unit": f"SELECT DISTINCT src, dst, 1 AS weight FROM ({_SOLD})",
    "weighted": f"SELECT src, dst, count(*) AS weight FROM ({_SOLD}) GROUP BY ALL",
    "multi": f"SELECT src, dst, 1 AS weight FROM ({_SOLD})",
    "directed": f"SELECT src, dst, count(*) AS weight FROM ({_SOLD}) GROUP BY ALL",
    "valued": f"SELECT src, dst, sum(l_quantity::DOUBLE) AS weight FROM ({_SOLD}) GROUP BY ALL",
}


def edges_sql(kind: str = "unit") -> str:
    if kind == "regional":
        home = f"SELECT c_custkey::BIGINT AS src, {N_CUSTOMERS} + n_regionkey AS dst, 1 AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey"
        return f"pairs AS MATERIALIZED ({home}), edges AS MATERIALIZED (SELECT * FROM pairs UNION ALL SELECT dst, src, weight FROM pairs), nodes AS (SELECT unnest(range({N_CUSTOMERS} + (SELECT count(*) FROM region))) AS node)"
    both = "SELECT * FROM pairs" + ("" if kind == "directed" else " UNION ALL SELECT dst, src, weight FROM pairs")
    return f"pairs AS MATERIALIZED ({_PAIRS[kind]}), edges AS MATERIALIZED ({both}), {NODES}"


_WRAP = "18446744073709551616::UHUGEINT"


def finish_sql(word: str) -> str:
    """The mixer of a UBIGINT."""
    for bits, k in ((30, rng.MULTIPLIER_1), (27, rng.MULTIPLIER_2)):
        word = f"((xor({word}, ({word}) >> {bits})::UHUGEINT * {k}::UHUGEINT) % {_WRAP})::UBIGINT"
    return f"xor({word}, ({word}) >> 31)"


def word_sql(lane: str, seed: int, step: int) -> str:
    return finish_sql(f"((({lane})::UHUGEINT * {rng.STRIDE}::UHUGEINT + {rng.offset(seed, step)}::UHUGEINT) % {_WRAP})::UBIGINT")


def uniform_sql(lane: str, seed: int, step: int) -> str:
    return f"((({word_sql(lane, seed, step)}) >> 12)::DOUBLE + 0.5) * {2.0**-52!r}::DOUBLE"


def states_sql(kind: str, name: str = "states", source: str = "nodes", lane: str = "node") -> str:
    columns = "node" if source == "nodes" else "node, replica"
    case = " ".join(f"WHEN a < {c!r}::DOUBLE THEN {q}" for q, c in enumerate(CUTS[kind]))
    age = "CASE WHEN state IN (1, 2) THEN 8 * b ELSE 0 END" if kind == "seir" else "0"
    drawn = f"SELECT {columns}, {uniform_sql(lane, STATE_SEED, 1)} AS a, {uniform_sql(lane, STATE_SEED, 2)} AS b FROM {source}"
    return f"{name} AS MATERIALIZED (SELECT {columns}, state, ({age})::DOUBLE AS age FROM (SELECT *, CASE {case} ELSE {len(CUTS[kind])} END AS state FROM ({drawn})))"


EVERY = f"every AS (SELECT node, r::INTEGER AS replica FROM nodes, (SELECT unnest(range({REPLICAS})) AS r))"


def ensemble_sql(kind: str, replicas: int = REPLICAS) -> str:
    every = f"every AS (SELECT node, r::INTEGER AS replica FROM nodes, (SELECT unnest(range({replicas})) AS r))"
    return f"{every}, {states_sql(kind, source='every', lane=f'node * {replicas} + replica')}"


def replica_uniform_sql(seed: int, step: int, replicas: int = REPLICAS) -> str:
    """The draw of node and replica, each replica with a stream of its own."""
    starts = "[" + ", ".join(f"{rng.offset(rng.replica_seed(seed, r), step)}::UHUGEINT" for r in range(replicas)) + "]"
    word = finish_sql(f"((node::UHUGEINT * {rng.STRIDE}::UHUGEINT + {starts}[replica + 1]) % {_WRAP})::UBIGINT")
    return f"((({word}) >> 12)::DOUBLE + 0.5) * {2.0**-52!r}::DOUBLE"


def erfcx_sql(z: str) -> str:
    """exp(z^2) erfc(z): a power series of erf up to 2.4, then the continued fraction of erfc."""
    down = "[1.0::DOUBLE] || list_reverse(range(1, {n}))::DOUBLE[]"
    series = f"exp(z * z) - {2 / math.sqrt(math.pi)!r}::DOUBLE * z * list_reduce({down.format(n=90)}, lambda a, k: 1 + a * 2 * z * z / (2 * k + 1))"
    fraction = f"{1 / math.sqrt(math.pi)!r}::DOUBLE / list_reduce([z] || list_reverse(range(1, 160))::DOUBLE[], lambda a, k: z + k / 2 / a)"
    return f"list_transform([({z})::DOUBLE], lambda z: CASE WHEN z < 2.4 AND z > -5.5 THEN {series} WHEN z < 0 THEN 2 * exp(z * z) ELSE {fraction} END)[1]"


def lognormal_sql(age: str, mean: float, median: float) -> str:
    mu, sigma = math.log(median), math.sqrt(2 * math.log(mean / median))
    return f"list_transform([greatest({age}, 1e-10::DOUBLE)], lambda x: {math.sqrt(2 / math.pi)!r}::DOUBLE / (x * {sigma!r}::DOUBLE * greatest({erfcx_sql(f'(ln(x) - {mu!r}::DOUBLE) / {sigma * math.sqrt(2)!r}::DOUBLE')}, 1e-30::DOUBLE)))[1]"


def expm1_sql(x: str) -> str:
    """1 - exp(-x)."""
    return f"(CASE WHEN {x} < 1e-5 THEN {x} - {x} * {x} / 2 + {x} * {x} * {x} / 6 ELSE 1 - exp(-({x})) END)"


def rounded(*columns: str, places: int = 9):
    return [F.round(c, places).alias(c) for c in columns]
