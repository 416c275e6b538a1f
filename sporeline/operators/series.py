"""Statistics of trajectories: tables (run, t, value) or (t, counts of states)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sporeline.functions.rng import with_uniform
from sporeline.sources.graphs import ranged


def infected(trajectory: DataFrame, inducers: list[str]) -> DataFrame:
    """trajectory with infected, the sum of its inducing states' columns."""
    total = F.lit(0)
    for c in inducers:
        total = total + F.col(c)
    return trajectory.withColumn("infected", total)


def peaks(curves: DataFrame, by: tuple[str, ...] = ("run",), value: str = "infected") -> DataFrame:
    """The highest value of each run and the first time it is reached."""
    top = F.max_by(F.struct(value, "t"), F.struct(F.col(value), -F.col("t")))
    return curves.groupBy(*by).agg(top.alias("_top")).select(*by, F.col(f"_top.{value}").alias("peak"), F.col("_top.t").alias("peak_time"))


def final(curves: DataFrame, column: str, by: tuple[str, ...] = ("run",), name: str = "final") -> DataFrame:
    """The value of column at each run's last time."""
    return curves.groupBy(*by).agg(F.max_by(column, "t").alias(name))


def attack_rate(curves: DataFrame, susceptible: str, n: Column, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """The share of nodes that aren't susceptible at the end. Where nodes become susceptible again it isn't cumulative."""
    return final(curves, susceptible, by, "_s").select(*by, ((n - F.col("_s")) / n).alias("attack_rate"))


def mean_curve(curves: DataFrame, value: str = "infected") -> DataFrame:
    return curves.groupBy("t").agg(F.avg(value).alias("mean"))


def quantile_bands(curves: DataFrame, low: float = 0.25, high: float = 0.75, value: str = "infected") -> DataFrame:
    """t, low, high: exact quantiles over runs, interpolated linearly."""
    q = F.percentile(F.col(value).cast("double"), F.array(F.lit(low), F.lit(high)))
    return curves.groupBy("t").agg(q.alias("_q")).select("t", F.get("_q", 0).alias("low"), F.get("_q", 1).alias("high"))


def curve_distance(a: DataFrame, b: DataFrame, value: str = "mean") -> DataFrame:
    """linf and l2 (root of the mean square) between two curves (t, value), over the times that both have."""
    d = F.col(value) - F.col("_other")
    return a.join(b.select("t", F.col(value).alias("_other")), "t").agg(F.max(F.abs(d)).alias("linf"), F.sqrt(F.avg(d * d)).alias("l2"))


def _so_far(*order: str, by, backward: bool = False) -> WindowSpec:
    """The rows from the first to the present one; backward: from the last one.

    What comes next is sought in the opposite order, as a frame up to the last row is read anew for each row.
    """
    w = Window.partitionBy(by).orderBy(*(F.desc(c) if backward else F.asc(c) for c in order))
    return w.rowsBetween(Window.unboundedPreceding, 0)


def resampled(curves: DataFrame, grid: DataFrame, linear: bool = False, value: str = "infected") -> DataFrame:
    """run, t, value at each time of grid (run, t): the last sample's value, or on the line to the next one.

    Samples and grid times are sorted together, run by run. Before the first sample the value is null; after the last
    one it stays.
    """
    both = curves.select("run", "t", F.col(value).cast("double").alias("_v"), F.lit(False).alias("_g")).unionByName(grid.select("run", "t", F.lit(None).cast("double").alias("_v"), F.lit(True).alias("_g")))
    so_far, on = _so_far("t", "_g", by="run"), _so_far("t", "_g", by="run", backward=True)
    sample_t = F.when(~F.col("_g"), F.col("t"))
    held = both.withColumn("_v0", F.last("_v", True).over(so_far))
    if linear:
        held = held.withColumn("_t0", F.last(sample_t, True).over(so_far)).withColumn("_t1", F.last(sample_t, True).over(on)).withColumn("_v1", F.last("_v", True).over(on))
        part = F.when(F.col("_t1") > F.col("_t0"), (F.col("t") - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))).otherwise(0.0)
        held = held.withColumn("_v0", F.when(F.col("_t1").isNull(), F.col("_v0")).otherwise(F.col("_v0") + part * (F.col("_v1") - F.col("_v0"))))
    return held.where("_g").select("run", "t", F.col("_v0").alias(value))


def resampled_by_range(curves: DataFrame, grid: DataFrame, linear: bool = False, value: str = "infected") -> DataFrame:
    """The rows of resampled, for runs too long for one task: all runs are sorted by ranges of (run, t), so that a run may span many.

    A range's last sample is carried into the ranges after it, and its first one into those before, if a run goes on there. Each
    range has one run at most that goes on at either end, so what is carried is two rows for each range.
    """
    both = curves.select("run", "t", F.col(value).cast("double").alias("_v"), F.lit(False).alias("_g")).unionByName(grid.select("run", "t", F.lit(None).cast("double").alias("_v"), F.lit(True).alias("_g")))
    held = ranged(both, "samples", "run", "t", "_g", "_v")
    sample = F.when(~F.col("_g") & F.col("_v").isNotNull(), F.struct("t", "_v"))
    ends = held.groupBy("run", "_part").agg(F.max(sample).alias("_last"), F.min(sample).alias("_first"))
    # a row for each range that the run is in
    earlier, later = (Window.partitionBy("run").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_part"), F.desc("_part")))
    carried = ends.select(F.col("run").alias("_run"), F.col("_part").alias("_of"), F.last("_last", True).over(earlier).alias("_earlier"), F.last("_first", True).over(later).alias("_later")).where("_earlier is not null or _later is not null")
    met = held.join(F.broadcast(carried), held["run"].eqNullSafe(carried["_run"]) & (held["_part"] == carried["_of"]), "left")
    order, within = ("t", "_g", "_v"), ["_part", "run"]
    out = met.withColumn("_s0", F.coalesce(F.last(sample, True).over(_so_far(*order, by=within)), "_earlier"))
    found = F.col("_s0._v")
    if linear:
        out = out.withColumn("_s1", F.coalesce(F.last(sample, True).over(_so_far(*order, by=within, backward=True)), "_later"))
        part = F.when(F.col("_s1.t") > F.col("_s0.t"), (F.col("t") - F.col("_s0.t")) / (F.col("_s1.t") - F.col("_s0.t"))).otherwise(0.0)
        found = F.when(F.col("_s1").isNull(), found).otherwise(found + part * (F.col("_s1._v") - found))
    return out.where("_g").select("run", "t", found.alias(value))


def apportioned(work: DataFrame, buckets: DataFrame) -> DataFrame:
    """bucket, amount: the amounts of work (begin, end, amount) dealt out to buckets of equal width by their overlap.

    buckets has one row: origin, width, n. A piece of work adds to its first and its last bucket what it has there; for all
    between, it raises the amount of each bucket where they begin and lowers it again where they end. So it is four rows at most
    however many buckets it spans. Running sums over ranges of buckets then give every bucket its amount.
    """
    held = work.where("end > begin").crossJoin(F.broadcast(buckets))  # one row
    first = F.greatest(F.floor((F.col("begin") - F.col("origin")) / F.col("width")), F.lit(0))
    last = F.least(F.floor((F.col("end") - F.col("origin")) / F.col("width")), F.col("n") - 1)
    held = held.withColumn("_a", first).withColumn("_b", last).where("_a <= _b").withColumn("_rate", F.col("amount") / (F.col("end") - F.col("begin")))

    def inside(bucket: Column) -> Column:
        low = F.greatest(F.col("begin").cast("double"), F.col("origin") + bucket * F.col("width"))
        return F.col("_rate") * F.greatest(F.least(F.col("end").cast("double"), F.col("origin") + (bucket + 1) * F.col("width")) - low, F.lit(0.0))

    def change(bucket: Column, own: Column, slope: Column, pieces: int) -> Column:
        return F.struct(bucket.cast("long").alias("bucket"), own.cast("double").alias("own"), slope.cast("double").alias("slope"), F.lit(pieces).cast("long").alias("pieces"))

    a, b, none, whole = F.col("_a"), F.col("_b"), F.lit(0.0), F.when(F.col("_b") > F.col("_a") + 1, F.col("_rate") * F.col("width")).otherwise(0.0)
    changes = F.array(change(a, inside(a), none, 1), change(a + 1, none, whole, 0), change(b, F.when(b > a, inside(b)).otherwise(0.0), -whole, 0), change(b + 1, none, none, -1))
    edges = held.select(F.explode(changes).alias("c")).groupBy("c.bucket").agg(*(F.sum(f"c.{x}").alias(x) for x in ("own", "slope", "pieces")))
    ranges = ranged(edges, "edges", "bucket")
    sums = ranges.groupBy("_part").agg(F.sum("slope").alias("_slope"), F.sum("pieces").alias("_pieces"), F.min("bucket").alias("_bucket"))
    parts = Window.orderBy("_part")  # a row for each range
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    around = sums.select("_part", F.coalesce(F.sum("_slope").over(before), F.lit(0.0)).alias("_slope"), F.coalesce(F.sum("_pieces").over(before), F.lit(0)).alias("_pieces"), F.lead("_bucket").over(parts).alias("_next"))
    w = Window.partitionBy("_part").orderBy("bucket")
    placed = ranges.join(F.broadcast(around), "_part").select(
        "bucket", "own", (F.col("_slope") + F.sum("slope").over(w)).alias("slope"), (F.col("_pieces") + F.sum("pieces").over(w)).alias("pieces"), F.coalesce(F.lead("bucket").over(w), "_next").alias("_next")
    ).where("pieces > 0")
    each = placed.select(F.col("bucket").alias("_first"), "own", "slope", F.explode(F.sequence("bucket", F.col("_next") - 1)).alias("bucket"))
    return each.select("bucket", (F.col("slope") + F.when(F.col("bucket") == F.col("_first"), F.col("own")).otherwise(0.0)).alias("amount"))


def poisson_steps() -> list[float]:
    """The chances of at most k for a Poisson count of mean 1, as far as doubles tell them from 1."""
    out, term, k = [], math.exp(-1), 0
    while not out or out[-1] < 1 - 2.0**-53:
        out.append((out[-1] if out else 0.0) + term)
        k += 1
        term /= k
        if term < 2.0**-60:
            break
    return out


def poisson_interval(values: DataFrame, seed: int, resamples: int = 1000, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """low and high quantile of the mean over resamples of values (i, x), in which each value has a Poisson weight of mean 1.

    Value i has in resample b the weight of lane i * resamples + b. Weights are drawn where the values are and summed up by
    resample before the shuffle, so that nothing is joined and each task hands on a row for each resample.
    """
    each = values.select("i", F.col("x").cast("double").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    drawn = with_uniform(each, "_u", F.col("i") * resamples + F.col("b"), seed, 1)
    weight = F.aggregate(F.array(*map(F.lit, poisson_steps())), F.lit(0), lambda n, c: n + (F.col("_u") >= c).cast("int"))
    sums = drawn.select("b", "x", weight.alias("w")).groupBy("b").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    return sums.agg(F.percentile("m", F.array(F.lit(low), F.lit(high))).alias("_q")).select(F.get("_q", 0).alias("low"), F.get("_q", 1).alias("high"))


def bootstrap_interval(values: DataFrame, seed: int, resamples: int = 1000, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """low and high quantile of the mean over resamples of values (i from 0 to n - 1, x). Draw d of resample b is lane b * n + d.

    The draws are joined with the values by index, resample sums are made before the shuffle.
    """
    n = values.count()
    draws = values.sparkSession.range(resamples * n)
    drawn = with_uniform(draws, "_u", F.col("id"), seed, 1).select(F.floor(F.col("id") / n).alias("b"), F.floor(F.col("_u") * n).alias("i"))
    means = drawn.join(values, "i").groupBy("b").agg(F.avg("x").alias("m"))
    return means.agg(F.percentile("m", F.array(F.lit(low), F.lit(high))).alias("_q")).select(F.get("_q", 0).alias("low"), F.get("_q", 1).alias("high"))


def event_score(rated: DataFrame) -> DataFrame:
    """accepted and expected events, and the distance between them in standard deviations, from rows (event, p)."""
    held = rated.agg(F.sum(F.col("event").cast("long")).alias("accepted"), F.sum("p").alias("expected"))
    sigma = F.greatest(F.sqrt("expected"), F.lit(1.0))
    return held.withColumn("z", (F.col("accepted") - F.col("expected")) / sigma).withColumn("passed", F.abs("z") < 6)


def banded(measured: DataFrame, bands: DataFrame) -> DataFrame:
    """name, value, band, passed for each row of measured(name, value) with a band(name, band): the value may not exceed it."""
    return measured.join(F.broadcast(bands), "name", "left").withColumn("passed", F.coalesce(F.col("value") <= F.col("band"), F.lit(False)))
