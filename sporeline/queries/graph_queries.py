"""Queries on graphs: construction, analytics, generators, and influence along edges."""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sporeline.functions.rng import with_uniform
from sporeline.operators import analytics as A
from sporeline.operators import influence as J
from sporeline.queries import fixtures as X
from sporeline.sources import generators as G
from sporeline.sources import graphs
from sporeline.sources.storage import shared_dir, stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Degrees and seeds of the generated graphs, which have as many nodes as the trade graph.
RING_DEGREE, RING_SEED, SEED = 8, 11, 5
#: Mean number of neighbours of a node of the geometric graph, times 1 / pi.
NEAR = 1.8
_SIZE = f"g AS MATERIALIZED (SELECT {X.N} AS n)"


def _nodes(spark: SparkSession, sf_dir: str) -> int:
    return X.table(spark, sf_dir, "customer").count() + X.table(spark, sf_dir, "supplier").count()


@query(f"WITH {X.edges_sql('weighted')} SELECT src, dst, weight FROM edges")
def edges_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "weighted")
    return graphs.from_edges(g.edges, g.nodes.count()).edges


@query(f"WITH {X.edges_sql()} SELECT node, coalesce(sum(d) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_start, (sum(d) OVER (ORDER BY node))::BIGINT AS row_end FROM (SELECT node, coalesce(d, 0) AS d FROM nodes LEFT JOIN (SELECT dst, count(*) AS d FROM edges GROUP BY dst) ON node = dst)")
def csr_row_ptr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.csr_rows(X.trade(spark, sf_dir))


@query(f"WITH {X.edges_sql('multi')} SELECT node, coalesce(s, []::BIGINT[]) AS sources FROM nodes LEFT JOIN (SELECT dst, list(src ORDER BY src) AS s FROM edges GROUP BY dst) ON node = dst")
def csr_neighbor_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.neighbour_lists(X.trade(spark, sf_dir, "multi"))


#: Sources in a row of an adjacency in blocks.
BLOCK = 64


@query(
    f"WITH {X.edges_sql('multi')}, p AS (SELECT dst, src, (row_number() OVER (ORDER BY dst, src) - 1) // {BLOCK} AS s FROM edges), b AS (SELECT dst, s, list(src ORDER BY src) AS l FROM p GROUP BY dst, s) "
    "SELECT node, (coalesce(row_number() OVER (PARTITION BY node ORDER BY s) - 1, 0))::INTEGER AS block, coalesce(l, []::BIGINT[]) AS sources FROM nodes LEFT JOIN b ON node = dst"
)
def csr_neighbor_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.neighbour_blocks(X.trade(spark, sf_dir, "multi"), BLOCK)


@query(f"WITH {X.edges_sql()} SELECT src, dst FROM edges")
def csr_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir)
    g = replace(g, edges=stored(g.edges, "edges"))  # read by both parts
    columns = graphs.numbered(g.edges.select("src", "dst"), "dst", "src", name="pos").select("pos", "src")
    return graphs.from_csr(graphs.csr_rows(g), columns).edges.select("src", "dst")


@query(f"WITH {X.edges_sql('directed')} SELECT dst AS src, src AS dst, weight FROM edges")
def transpose_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.trade(spark, sf_dir, "directed").transpose().edges


@query(f"WITH {X.edges_sql('directed')} SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges")
def edge_symmetrize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.symmetrised(X.trade(spark, sf_dir, "directed").edges)


@query(f"WITH {X.edges_sql('weighted')} SELECT src, dst, (weight * 2.5)::DOUBLE AS weight FROM edges")
def replaced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "weighted")
    return g.with_weights(g.edges.withColumn("weight", F.col("weight") * 2.5)).edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))


@query(f"WITH {X.edges_sql('valued')}, p AS (SELECT *, pow(2, floor(log2(weight)) - 7) AS u FROM edges) SELECT src, dst, round_even(weight / u, 0) * u AS weight FROM p")
def rounded_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.trade(spark, sf_dir, "valued").rounded_weights().edges


@query(f"WITH {X.edges_sql('weighted')} SELECT src, dst, 1.0::DOUBLE AS weight FROM edges")
def edge_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    g = X.trade(spark, sf_dir, "weighted")
    path = f"{shared_dir(spark)}/edge-file-{uuid.uuid4().hex}"
    graphs.save_edges(g, path, base=1)
    return graphs.load_graph(spark, path, g.nodes.count(), base=1).edges


@query(
    f"WITH {_SIZE}, d AS (SELECT k, 1 + floor({X.uniform_sql('k', RING_SEED, 1)} * ((n - 1) // 2))::BIGINT AS o FROM g, (SELECT unnest(range(64)) AS k)), o AS (SELECT o FROM d GROUP BY o ORDER BY min(k) LIMIT {RING_DEGREE // 2}), "
    "s AS (SELECT o FROM o UNION ALL SELECT -o FROM o) SELECT (i + o + n) % n AS src, i AS dst FROM g, (SELECT unnest(range(n)) AS i FROM g), s"
)
def circulant_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.circulant(spark, _nodes(spark, sf_dir), RING_DEGREE, RING_SEED).edges


def _drawn_sql(each: int, draws: int) -> str:
    return f"SELECT id, n, {', '.join(f'{X.uniform_sql("id", SEED, k)} AS u{k}' for k in range(1, draws + 1))} FROM g, (SELECT unnest(range(n * {each})) AS id FROM g)"


def _er_sql(mean_degree: int, spread: int, rounds: int = 3) -> str:
    """The draws of so many rounds; more are needed if a node has more than rounds * spread edges to higher ones."""
    skip = f"(least(floor(ln(u) / ln(1 - {mean_degree}::DOUBLE / (n - 1))), n) + 1)::BIGINT"
    parts, at = [_SIZE], "(SELECT unnest(range(n)) AS node, unnest(range(n)) AS low FROM g)"
    for r in range(1, rounds + 1):
        lanes = f"SELECT node, low, k, n, {X.uniform_sql(f'node * {spread} + k', SEED, r)} AS u FROM {at}, (SELECT unnest(range({spread})) AS k), g"
        parts.append(f"r{r} AS MATERIALIZED (SELECT node, k, n, low + sum({skip}) OVER (PARTITION BY node ORDER BY k) AS b FROM ({lanes}))")
        at = f"(SELECT node, b AS low FROM r{r} WHERE k = {spread - 1} AND b < n)"
    once = " UNION ALL ".join(f"SELECT node AS src, b::BIGINT AS dst FROM r{r} WHERE b < n" for r in range(1, rounds + 1))
    return f"WITH {', '.join(parts)}, once AS ({once}) SELECT src, dst FROM once UNION ALL SELECT dst, src FROM once"


@query(_er_sql(8, 13))
def er_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.erdos_renyi(spark, _nodes(spark, sf_dir), 8, SEED).edges


@query(f"WITH {_SIZE}, d AS ({_drawn_sql(8, 1)}) SELECT src, t + (t >= src)::BIGINT AS dst FROM (SELECT id // 8 AS src, floor(u1 * (n - 1))::BIGINT AS t FROM d)")
def random_out_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.random_out(spark, _nodes(spark, sf_dir), 8, SEED).edges


@query()
def random_regular_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.random_regular(spark, _nodes(spark, sf_dir), 8, SEED).edges


@query()
def ws_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.watts_strogatz(spark, _nodes(spark, sf_dir), 6, 0.1, SEED).edges


@query()
def ba_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.barabasi_albert(spark, _nodes(spark, sf_dir), 4, SEED).edges


def _shape(graph: graphs.Graph) -> DataFrame:
    """n_edges, loops, repeated: the counts that a simple graph's definition fixes."""
    e = graph.edges
    return e.agg(F.count("*").alias("n_edges"), F.sum((F.col("src") == F.col("dst")).cast("long")).alias("loops"), (F.count("*") - F.countDistinct("src", "dst")).alias("repeated"))


# What the definitions say of the graphs, without a draw.
@query(f"WITH {_SIZE} SELECT unnest(range(n)) AS node, 8::BIGINT AS degree, 8::BIGINT AS n_neighbours, 0::BIGINT AS loops FROM g")
def random_regular_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.random_regular(spark, _nodes(spark, sf_dir), 8, SEED).edges
    return e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("degree"), F.countDistinct("src").alias("n_neighbours"), F.sum((F.col("src") == F.col("dst")).cast("long")).alias("loops"))


@query(f"WITH {_SIZE} SELECT (n * 6)::BIGINT AS n_edges, 0::BIGINT AS loops, 0::BIGINT AS repeated FROM g")
def ws_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(G.watts_strogatz(spark, _nodes(spark, sf_dir), 6, 0.1, SEED))


@query(f"WITH {_SIZE} SELECT unnest(range(4, n)) AS node, 4::BIGINT AS n_lower FROM g")
def ba_lower_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.barabasi_albert(spark, _nodes(spark, sf_dir), 4, SEED).edges
    return e.where("dst < src").groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("n_lower"))


@query(f"WITH {_SIZE}, d AS ({_drawn_sql(1, 2)}) SELECT a.id AS src, b.id AS dst FROM d a JOIN d b ON a.id <> b.id AND (a.u1 - b.u1) * (a.u1 - b.u1) + (a.u2 - b.u2) * (a.u2 - b.u2) <= sqrt({NEAR!r}::DOUBLE / a.n) * sqrt({NEAR!r}::DOUBLE / a.n)")
def geometric_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nodes(spark, sf_dir)
    return G.geometric(spark, n, math.sqrt(NEAR / n), SEED).edges


_DEGREES = f"{X.edges_sql('multi')}, degrees AS (SELECT node, coalesce(d, 0) AS degree FROM nodes LEFT JOIN (SELECT dst, count(*) AS d FROM edges GROUP BY dst) ON node = dst)"


@query(f"WITH {_DEGREES} SELECT node, degree FROM degrees")
def degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.in_degrees(X.trade(spark, sf_dir, "multi"))


@query(f"WITH {_DEGREES}, s AS (SELECT count(*) AS n_nodes, sum(degree)::BIGINT AS n_edges, round(avg(degree), 9) AS mean_degree, max(degree) AS max_degree, max(degree) / avg(degree) AS r FROM degrees) SELECT n_nodes, n_edges, mean_degree, max_degree, CASE WHEN r >= 50 THEN 'salted' WHEN r >= 4 THEN 'skewed' ELSE 'plain' END AS strategy FROM s")
def degree_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.degree_summary(X.trade(spark, sf_dir, "multi")).withColumn("mean_degree", F.round("mean_degree", 9))


@query(f"WITH {X.edges_sql()} SELECT max(abs(src - dst)) AS bandwidth FROM edges")
def graph_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.bandwidth(X.trade(spark, sf_dir))


_ORDER = f"ord AS (SELECT node AS old, row_number() OVER (ORDER BY u, node) - 1 AS new FROM (SELECT node, {X.uniform_sql('node', 3, 1)} AS u FROM nodes))"


@query(f"WITH {X.edges_sql('weighted')}, {_ORDER} SELECT a.new AS src, b.new AS dst, weight FROM edges JOIN ord a ON a.old = src JOIN ord b ON b.old = dst")
def permute_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "weighted")
    order = graphs.numbered(with_uniform(g.nodes, "u", F.col("node"), 3, 1), "u", "node", name="new").select("new", F.col("node").alias("old"))
    return A.permuted(g, order).edges


@query(
    f"WITH {X.edges_sql('weighted')}, {_ORDER}, o AS (SELECT 'whole' AS part, * FROM ord UNION ALL SELECT 'one missing', * FROM ord WHERE new > 0 UNION ALL SELECT 'one twice', greatest(new, 1), old FROM ord) "
    f"SELECT part, count(*) = {X.N} AND count(DISTINCT new) = {X.N} AND count(DISTINCT old) = {X.N} AND min(new) = 0 AND min(old) = 0 AND max(new) = {X.N} - 1 AND max(old) = {X.N} - 1 AS valid FROM o GROUP BY part"
)
def permutation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, n = X.trade(spark, sf_dir, "weighted"), _nodes(spark, sf_dir)
    order = graphs.numbered(with_uniform(g.nodes, "u", F.col("node"), 3, 1), "u", "node", name="new").select("new", F.col("node").alias("old"))
    parts = {"whole": order, "one missing": order.where("new > 0"), "one twice": order.withColumn("new", F.greatest("new", F.lit(1)))}
    return reduce(DataFrame.unionByName, (A.permutation_check(o, n).select(F.lit(k).alias("part"), "valid") for k, o in parts.items()))


_NEIGHBOURS = (
    "nb AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), "
    "places AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY coalesce(d, 0), node) - 1 AS place FROM nodes LEFT JOIN (SELECT dst, count(*) AS d FROM nb GROUP BY dst) ON node = dst), "
    # the whole state at each round: root * 1000000 + level, until no node hears of a smaller one
    "reach AS (SELECT 0 AS it, node, place * 1000000 AS code FROM places UNION ALL SELECT it + 1, node, least(reach.code, coalesce(m, reach.code)) FROM reach LEFT JOIN "
    "(SELECT dst, min(code) + 1 AS m FROM nb JOIN reach ON src = node GROUP BY dst) ON node = dst QUALIFY bool_or(m < reach.code) OVER ()), "
    "lv AS MATERIALIZED (SELECT node, code // 1000000 AS root, code % 1000000 AS level FROM reach WHERE it = (SELECT max(it) FROM reach)), "
    "ranks AS (SELECT level, node, root AS pos FROM lv WHERE level = 0 UNION ALL SELECT f.level, lv.node, row_number() OVER (ORDER BY f.parent, places.place) - 1 FROM "
    "(SELECT dst, ranks.level + 1 AS level, min(pos) AS parent FROM nb JOIN ranks ON src = ranks.node GROUP BY ALL) f JOIN lv ON lv.node = f.dst AND lv.level = f.level JOIN places ON places.node = lv.node), "
    f"rcm AS MATERIALIZED (SELECT {X.N} - row_number() OVER (ORDER BY root, lv.level, pos) AS new, node AS old FROM ranks JOIN lv USING (node))"
)


@query(f"WITH RECURSIVE {X.edges_sql()}, {_NEIGHBOURS} SELECT new, old FROM rcm")
def rcm_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.reverse_cuthill_mckee(X.trade(spark, sf_dir))


@query(f"WITH RECURSIVE {X.edges_sql('regional')}, {_NEIGHBOURS.replace(X.N, '(SELECT count(*) FROM nodes)')} SELECT a.new AS src, b.new AS dst FROM edges JOIN rcm a ON a.old = src JOIN rcm b ON b.old = dst")
def rcm_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and regions: a component for each region, with a hub in it."""
    g = X.regional(spark, sf_dir)
    return A.permuted(g, A.reverse_cuthill_mckee(g)).edges


_ENSEMBLE = f"WITH {X.edges_sql('weighted')}, {X.ensemble_sql('seir')}"
_IN = "degrees AS (SELECT node, coalesce(d, 0) AS degree FROM nodes LEFT JOIN (SELECT dst, count(*) AS d FROM edges GROUP BY dst) ON node = dst)"


@query(f"{_ENSEMBLE}, {_IN} SELECT replica, sum((state = 0)::BIGINT)::BIGINT AS susceptible_nodes, sum(CASE WHEN state = 0 THEN degree ELSE 0 END)::BIGINT AS susceptible_edges, sum((state IN (1, 2))::BIGINT)::BIGINT AS hazard_nodes FROM states JOIN degrees USING (node) GROUP BY replica")
def activity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "weighted")
    return A.activity(g, X.ensemble(g.nodes, "seir"), 0, [1, 2])


@query(f"{_ENSEMBLE}, {_IN} SELECT tile, count(*) AS union_nodes, sum(degree)::BIGINT AS union_edges FROM (SELECT DISTINCT node, replica // 2 AS tile FROM states WHERE state = 0) JOIN degrees USING (node) GROUP BY tile")
def tile_activity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "weighted")
    return A.tile_activity(g, X.ensemble(g.nodes, "seir"), 0, 2)


def _influence_sql(kind: str, inducers: str = "2", where: str = "true") -> str:
    return f"WITH {X.edges_sql(kind)}, {X.states_sql('seir')}, felt AS (SELECT dst, sum(weight)::BIGINT AS w FROM edges JOIN states ON src = node WHERE state IN ({inducers}) GROUP BY dst) SELECT states.node, coalesce(w, 0) AS influence FROM states LEFT JOIN felt ON dst = node WHERE {where}"


def _states(g: graphs.Graph) -> DataFrame:
    return X.states(g.nodes, "seir")


@query(_influence_sql("unit"))
def influence_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir)
    return J.influence(g, _states(g), [2])


@query(_influence_sql("multi"))
def influence_multi_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "multi")
    return J.influence(g, _states(g), [2])


@query(_influence_sql("weighted", "1, 2"))
def influence_weighted_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "weighted")
    return J.influence(g, _states(g), [1, 2])


@query(_influence_sql("directed"))
def influence_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "directed")
    return J.influence(g, _states(g), [2])


@query(_influence_sql("weighted", "2"))
def influence_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "weighted")
    return J.salted_influence(g, _states(g), [2])


@query(f"WITH {X.edges_sql('weighted')}, {X.states_sql('seir')}, felt AS (SELECT dst, sum(CASE WHEN state = 1 THEN weight ELSE 0 END)::BIGINT AS a, sum(CASE WHEN state = 2 THEN weight ELSE 0 END)::BIGINT AS b FROM edges JOIN states ON src = node GROUP BY dst) SELECT node, coalesce(a, 0) AS influence_1, coalesce(b, 0) AS influence_2 FROM nodes LEFT JOIN felt ON dst = node")
def influence_multi_inducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "weighted")
    return J.influence_by_state(g, _states(g), [1, 2])


@query(_influence_sql("weighted", "2", "state = 0"))
def susceptible_only_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "weighted")
    return J.susceptible_pressure(g, _states(g), 0, [2])


@query(f"WITH {X.edges_sql('valued')}, {X.states_sql('seir')}, felt AS (SELECT dst, sum(weight * age) AS p FROM edges JOIN states ON src = node GROUP BY dst) SELECT node, round(coalesce(p, 0), 6) AS pressure FROM nodes LEFT JOIN felt ON dst = node")
def pressure_infectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "valued")
    return J.pressure(g, _states(g).select("node", F.col("age").alias("infectivity"))).select("node", F.round("pressure", 6).alias("pressure"))


_ENSEMBLE_INFLUENCE = f"{_ENSEMBLE}, felt AS (SELECT dst, replica AS r, sum(weight)::BIGINT AS w FROM edges JOIN states ON src = node WHERE state = 2 GROUP BY ALL) SELECT node, replica, coalesce(w, 0) AS influence FROM every LEFT JOIN felt ON dst = node AND r = replica"


@query(_ENSEMBLE_INFLUENCE)
def ensemble_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "weighted")
    return J.ensemble_influence(g, X.ensemble(g.nodes, "seir"), [2], X.REPLICAS)


@query(_ENSEMBLE_INFLUENCE)
def packed_mask_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "weighted")
    return J.packed_influence(g, J.packed(X.ensemble(g.nodes, "seir"), [2], X.REPLICAS), X.REPLICAS)


#: More replicas than a word has bits.
MANY = 100


@query(_ENSEMBLE_INFLUENCE.replace(_ENSEMBLE, f"WITH {X.edges_sql('weighted')}, {X.ensemble_sql('seir', MANY)}"))
def packed_mask_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "weighted")
    return J.packed_influence(g, J.packed(X.ensemble(g.nodes, "seir", MANY), [2], MANY), MANY)


@query(_influence_sql("regional"))
def hub_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a graph whose few hubs hold all edges: the gather is chosen by the skew measured when the graph is stored."""
    g = X.regional(spark, sf_dir).stored()
    return J.influence(g, _states(g), [2])


@query(f"{_ENSEMBLE}, felt AS (SELECT dst, replica, sum(weight * age) AS p FROM edges JOIN states ON src = node WHERE age > 0 GROUP BY ALL) SELECT dst AS node, replica, round(p, 6) AS pressure FROM felt")
def ensemble_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "weighted")
    p = J.ensemble_pressure(g, X.ensemble(g.nodes, "seir").select("node", "replica", F.col("age").alias("infectivity")))
    return p.select("node", "replica", F.round("pressure", 6).alias("pressure"))


# Nodes whose draw is below a tenth have changed, to their successor's state.
_CHANGED = f"changed AS (SELECT node, state AS before, CASE state WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS after FROM (SELECT *, {X.uniform_sql('node', 3, 2)} AS u FROM states) WHERE u < 0.1)"


def _changed(g: graphs.Graph) -> DataFrame:
    after = F.when(F.col("state") == 0, 1).when(F.col("state") == 1, 2).otherwise(3)
    return with_uniform(_states(g), "u", F.col("node"), 3, 2).where("u < 0.1").select("node", F.col("state").alias("before"), after.alias("after"))


@query(f"WITH {X.edges_sql('weighted')}, {X.states_sql('seir')}, {_CHANGED} SELECT dst AS node, sum(weight * ((after = 2)::INT - (before = 2)::INT))::BIGINT AS delta FROM edges JOIN changed ON src = node WHERE (after = 2) <> (before = 2) GROUP BY dst")
def frontier_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "weighted")
    return J.frontier_delta(g, _changed(g), [2])


@query(f"WITH {X.edges_sql('weighted')}, {X.states_sql('seir')}, {_CHANGED}, new AS (SELECT states.node, coalesce(after, state) AS state FROM states LEFT JOIN changed USING (node)), felt AS (SELECT dst, sum(weight)::BIGINT AS w FROM edges JOIN new ON src = node WHERE state = 2 GROUP BY dst) SELECT node, coalesce(w, 0) AS influence FROM nodes LEFT JOIN felt ON dst = node")
def frontier_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "weighted")
    return J.updated_influence(J.influence(g, _states(g), [2]), J.frontier_delta(g, _changed(g), [2]))


@query(f"WITH {X.edges_sql('weighted')}, {X.states_sql('seir')}, {_CHANGED} SELECT (SELECT count(*) FROM edges JOIN changed ON src = node) AS frontier, (SELECT count(*) FROM edges) AS total, 5 * (SELECT count(*) FROM edges JOIN changed ON src = node) >= (SELECT count(*) FROM edges) AS rebuild")
def frontier_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.trade(spark, sf_dir, "weighted")
    return J.frontier_edges(g, _changed(g))


# Five changes of a fifth of the nodes each (by node % 5), of which the first sends all its nodes on and the others a tenth of theirs.
_TURNS = 5


@query(
    f"WITH {X.edges_sql('weighted')}, {X.states_sql('seir')}, new AS (SELECT node, CASE WHEN node % {_TURNS} = 0 OR {X.uniform_sql('node', 3, 2)} < 0.1 THEN least(state + 1, 3) ELSE state END AS state FROM states), "
    "felt AS (SELECT dst, sum(weight)::BIGINT AS w FROM edges JOIN new ON src = node WHERE state = 2 GROUP BY dst) SELECT node, coalesce(w, 0) AS influence FROM nodes LEFT JOIN felt ON dst = node"
)
def frontier_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The influence after five changes, kept up by frontier steps and made anew after two of them or a change of a fifth of all edges."""
    g = X.trade(spark, sf_dir, "weighted").stored()
    held = J.Frontier.started(g, _states(g), [2], rebuild_after=2)
    for k in range(_TURNS):
        moved = (F.col("node") % _TURNS == k) & ((F.col("u") < 0.1) | F.lit(k == 0))
        drawn = with_uniform(held.states, "u", F.col("node"), 3, 2).where(moved)
        held = held.after(drawn.select("node", F.col("state").alias("before"), F.least(F.col("state") + 1, F.lit(3)).alias("after")))
    return held.influence
