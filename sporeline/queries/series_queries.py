"""Queries on trajectories. The events table serves as curves: a run for each user, a time for each day, counts as values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sporeline.operators import series as T
from sporeline.queries import fixtures as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
START = "2024-01-01"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_CURVES = f"curves AS (SELECT user_id AS run, date_diff('day', DATE '{START}', ts::DATE)::INTEGER AS t, sum((event_type = 'click')::BIGINT)::BIGINT AS clicks, sum((event_type = 'error')::BIGINT)::BIGINT AS errors, count(*) AS infected FROM events GROUP BY ALL)"


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.datediff(F.to_date("ts"), F.lit(START).cast("date")).alias("t"), "event_type")
    kind = lambda k: F.sum((F.col("event_type") == k).cast("long"))
    return held.groupBy("run", "t").agg(kind("click").alias("clicks"), kind("error").alias("errors"), F.count("*").alias("infected"))


@query(f"WITH {_CURVES} SELECT run, t, clicks, errors, clicks + errors AS infected FROM curves")
def infected_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.infected(curves(spark, sf_dir).drop("infected"), ["clicks", "errors"])


@query(f"WITH {_CURVES} SELECT run, infected AS peak, t AS peak_time FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY infected DESC, t) AS i FROM curves) WHERE i = 1")
def trajectory_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.peaks(curves(spark, sf_dir))


@query(f"WITH {_CURVES} SELECT run, round((50 - arg_max(infected, t)) / 50.0::DOUBLE, 9) AS attack_rate FROM curves GROUP BY run")
def attack_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.attack_rate(curves(spark, sf_dir), "infected", F.lit(50)).select("run", F.round("attack_rate", 9).alias("attack_rate"))


@query(f"WITH {_CURVES} SELECT run, arg_max(infected, t) AS final FROM curves GROUP BY run")
def final_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.final(curves(spark, sf_dir), "infected")


@query(f"WITH {_CURVES} SELECT t, round(avg(infected), 9) AS mean FROM curves GROUP BY t")
def mean_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.mean_curve(curves(spark, sf_dir)).select("t", F.round("mean", 9).alias("mean"))


@query(f"WITH {_CURVES} SELECT t, round(quantile_cont(infected::DOUBLE, 0.25), 9) AS low, round(quantile_cont(infected::DOUBLE, 0.75), 9) AS high FROM curves GROUP BY t")
def quantile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.quantile_bands(curves(spark, sf_dir)).select("t", *X.rounded("low", "high"))


@query(f"WITH {_CURVES}, p AS (SELECT run, max(infected) AS peak, arg_max(infected, t) AS final FROM curves GROUP BY run), q AS (SELECT run, min(t) AS t FROM curves JOIN p USING (run) WHERE infected = peak GROUP BY run) SELECT count(*) AS runs, round(avg(peak), 9) AS peak, round(avg(q.t), 9) AS peak_time, round(avg(final), 9) AS final FROM p JOIN q USING (run)")
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curves(spark, sf_dir)
    held = T.peaks(c).join(T.final(c, "infected"), "run")
    return held.agg(F.count("*").alias("runs"), *(F.round(F.avg(x), 9).alias(x) for x in ("peak", "peak_time", "final")))


@query(f"WITH {_CURVES}, a AS (SELECT t, avg(infected) AS m FROM curves WHERE run % 2 = 0 GROUP BY t), b AS (SELECT t, avg(infected) AS m FROM curves WHERE run % 2 = 1 GROUP BY t) SELECT round(max(abs(a.m - b.m)), 9) AS linf, round(sqrt(avg((a.m - b.m) * (a.m - b.m))), 9) AS l2 FROM a JOIN b USING (t)")
def curve_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curves(spark, sf_dir)
    return T.curve_distance(T.mean_curve(c.where("run % 2 = 0")), T.mean_curve(c.where("run % 2 = 1"))).select(*X.rounded("linf", "l2"))


_GRID = "grid AS (SELECT run, g / 2.0::DOUBLE AS t FROM (SELECT DISTINCT run FROM curves), (SELECT unnest(range(61)) AS g))"


def _grid(c: DataFrame) -> DataFrame:
    return c.select("run").distinct().select("run", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("g")).select("run", (F.col("g") / 2.0).alias("t"))


def _samples(c: DataFrame) -> DataFrame:
    return c.withColumn("t", F.col("t").cast("double"))


@query(f"WITH {_CURVES}, {_GRID} SELECT grid.run, grid.t, c.infected::DOUBLE AS infected FROM grid ASOF LEFT JOIN curves c ON grid.run = c.run AND grid.t >= c.t")
def asof_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curves(spark, sf_dir)
    return T.resampled(_samples(c), _grid(c))


@query(
    f"WITH {_CURVES}, {_GRID}, lo AS (SELECT grid.run, grid.t, c.t AS t0, c.infected AS v0 FROM grid ASOF LEFT JOIN curves c ON grid.run = c.run AND grid.t >= c.t), "
    "hi AS (SELECT lo.*, c.t AS t1, c.infected AS v1 FROM lo ASOF LEFT JOIN curves c ON lo.run = c.run AND lo.t <= c.t) "
    "SELECT run, t, round(CASE WHEN t1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (t - t0) / (t1 - t0) * (v1 - v0) END, 9)::DOUBLE AS infected FROM hi"
)
def linear_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curves(spark, sf_dir)
    return T.resampled(_samples(c), _grid(c), linear=True).withColumn("infected", F.round("infected", 9))


@query(f"WITH {_CURVES}, {_GRID} SELECT grid.run, grid.t, c.infected::DOUBLE AS infected FROM grid ASOF LEFT JOIN curves c ON grid.run = c.run AND grid.t >= c.t")
def asof_resample_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curves(spark, sf_dir)
    return T.resampled_by_range(_samples(c), _grid(c))


#: One run of all events: a sample for each second that has any, a grid time for each half hour.
_LONG = f"seconds AS (SELECT date_diff('second', DATE '{START}'::TIMESTAMP, date_trunc('second', ts))::DOUBLE AS t, count(*)::DOUBLE AS v FROM events GROUP BY ALL), times AS (SELECT unnest(range(1600)) * 1800.0::DOUBLE AS t)"


@query(
    f"WITH {_LONG}, lo AS (SELECT g.t, s.t AS t0, s.v AS v0 FROM times g ASOF LEFT JOIN seconds s ON g.t >= s.t), hi AS (SELECT lo.*, s.t AS t1, s.v AS v1 FROM lo ASOF LEFT JOIN seconds s ON lo.t <= s.t) "
    "SELECT 0 AS run, t, round(CASE WHEN t1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (t - t0) / (t1 - t0) * (v1 - v0) END, 9)::DOUBLE AS infected FROM hi"
)
def linear_resample_long_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long run, which spans all ranges."""
    second = F.unix_timestamp(F.date_trunc("second", "ts").cast("timestamp")) - F.unix_timestamp(F.lit(START).cast("timestamp"))
    samples = X.table(spark, sf_dir, "events").groupBy(second.cast("double").alias("t")).agg(F.count("*").alias("infected")).withColumn("run", F.lit(0))
    grid = spark.range(1600).select(F.lit(0).alias("run"), (F.col("id") * 1800.0).alias("t"))
    return T.resampled_by_range(samples, grid, linear=True).withColumn("infected", F.round("infected", 9))


_WORK = f"work AS (SELECT date_diff('second', DATE '{START}'::TIMESTAMP, date_trunc('second', ts)) AS b, abs(coalesce(value, 0)) * 600 AS d FROM events), spans AS (SELECT b::DOUBLE AS b, b + d AS e, d AS amount FROM work WHERE d > 0)"


@query(f"WITH {_WORK}, buckets AS (SELECT unnest(range(60)) AS bucket) SELECT bucket, round(sum(amount * (least(e, (bucket + 1) * 43200.0::DOUBLE) - greatest(b, bucket * 43200.0::DOUBLE)) / (e - b)), 3) AS amount FROM spans JOIN buckets ON b <= (bucket + 1) * 43200 AND e >= bucket * 43200 WHERE floor(b / 43200) <= bucket AND least(floor(e / 43200), 59) >= bucket GROUP BY bucket")
def bucket_apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = F.unix_timestamp(F.lit(START).cast("timestamp"))
    begin = (F.unix_timestamp(F.date_trunc("second", "ts").cast("timestamp")) - origin).cast("double")
    work = X.table(spark, sf_dir, "events").select(begin.alias("begin"), (F.abs(F.coalesce("value", F.lit(0.0))) * 600).alias("amount")).where("amount > 0").withColumn("end", F.col("begin") + F.col("amount"))
    buckets = spark.range(1).select(F.lit(0.0).alias("origin"), F.lit(43200.0).alias("width"), F.lit(60).cast("long").alias("n"))
    return T.apportioned(work, buckets).select("bucket", F.round("amount", 3).alias("amount"))



@query(
    f"WITH {_CURVES}, vals AS (SELECT row_number() OVER (ORDER BY run) - 1 AS i, c AS x FROM (SELECT run, sum(infected)::DOUBLE AS c FROM curves GROUP BY run)), n AS (SELECT count(*) AS n FROM vals), "
    f"draws AS (SELECT b, floor(({X.uniform_sql('b * n + d', 17, 1)}) * n)::BIGINT AS i FROM (SELECT b, n, unnest(range(n)) AS d FROM (SELECT unnest(range(200)) AS b), n)), "
    "m AS (SELECT b, avg(x) AS m FROM draws JOIN vals USING (i) GROUP BY b) SELECT round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m"
)
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sporeline.sources.graphs import numbered

    totals = curves(spark, sf_dir).groupBy("run").agg(F.sum("infected").cast("double").alias("x"))
    return T.bootstrap_interval(numbered(totals, "run", name="i").select("i", "x"), 17, 200).select(*X.rounded("low", "high"))


@query(
    f"WITH {_CURVES}, vals AS (SELECT row_number() OVER (ORDER BY run) - 1 AS i, c AS x FROM (SELECT run, sum(infected)::DOUBLE AS c FROM curves GROUP BY run)), "
    "chances AS (SELECT unnest(range(20)) AS k), steps AS (SELECT list(c ORDER BY k) AS l FROM (SELECT k, sum(exp(-1.0::DOUBLE) / factorial(k::INTEGER)) OVER (ORDER BY k) AS c FROM chances)), "
    f"w AS (SELECT b, x, list_count(list_filter(l, lambda c: c <= u)) AS w FROM (SELECT b, x, {X.uniform_sql('i * 200 + b', 17, 1)} AS u FROM vals, (SELECT unnest(range(200)) AS b)), steps), "
    "m AS (SELECT b, sum(w * x) / sum(w) AS m FROM w GROUP BY b) SELECT round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m"
)
def bootstrap_poisson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sporeline.sources.graphs import numbered

    totals = curves(spark, sf_dir).groupBy("run").agg(F.sum("infected").cast("double").alias("x"))
    return T.poisson_interval(numbered(totals, "run", name="i").select("i", "x"), 17, 200).select(*X.rounded("low", "high"))


@query(f"WITH {_CURVES}, m AS (SELECT 'peak' AS name, max(infected)::DOUBLE AS value FROM curves UNION ALL SELECT 'mean', round(avg(infected), 9) FROM curves UNION ALL SELECT 'runs', count(DISTINCT run)::DOUBLE FROM curves), b AS (SELECT * FROM (VALUES ('peak', 50.0::DOUBLE), ('mean', 2.0::DOUBLE)) v(name, band)) SELECT m.name, value, band, coalesce(value <= band, false) AS passed FROM m LEFT JOIN b ON m.name = b.name")
def banded_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curves(spark, sf_dir)
    m = c.agg(F.max("infected").cast("double").alias("peak"), F.round(F.avg("infected"), 9).alias("mean"), F.count_distinct("run").cast("double").alias("runs"))
    measured = m.select(F.expr("stack(3, 'peak', peak, 'mean', mean, 'runs', runs) AS (name, value)"))
    return T.banded(measured, spark.createDataFrame([("peak", 50.0), ("mean", 2.0)], "name string, band double"))
