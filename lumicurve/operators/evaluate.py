"""Evaluation of detectors from trials with and without an injected event.

Trials are rows (kind: inject or null; peak; frame; center). All measures are
aggregates over bins of fixed number, so they cost one pass and one small
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recovered(threshold: Column | float, near: int = 12) -> Column:
    """Whether a trial's peak is at the threshold and at its event's place."""
    return (F.col("peak") >= threshold) & (F.abs(F.col("frame") - F.col("center")) <= near)


def roc(trials: DataFrame, points: int = 80, near: int = 12) -> DataFrame:
    """(point, threshold, completeness, far) over an even grid from the least to
    the greatest peak of all trials. Each trial counts once, at the last
    threshold it reaches; sums from the top give the shares. Null peaks reach none."""
    ends = trials.agg(F.min("peak").alias("_lo"), F.max("peak").alias("_hi"))
    step = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0) / (points - 1)
    grid = ends.select("_lo", step.alias("_step"))
    level = lambda k: F.col("_lo") + k * F.col("_step")
    k = F.least(F.floor((F.col("peak") - F.col("_lo")) / F.col("_step")), F.lit(points - 1)).cast("int")
    at = trials.join(F.broadcast(grid)).withColumn("_k", k)
    # Thresholds are rounded, so the quotient may be one off.
    reached = F.when(level(F.col("_k")) > F.col("peak"), F.col("_k") - 1).when((F.col("_k") < points - 1) & (level(F.col("_k") + 1) <= F.col("peak")), F.col("_k") + 1).otherwise(F.col("_k"))
    at = at.withColumn("point", F.coalesce(reached, F.lit(-1)).cast("int"))
    near_center = F.coalesce(F.abs(F.col("frame") - F.col("center")) <= near, F.lit(False))
    counts = at.groupBy("point").agg(F.count_if((F.col("kind") == "inject") & near_center).alias("hit"), F.count_if((F.col("kind") == "null")).alias("false"), F.count_if((F.col("kind") == "inject") & F.col("peak").isNotNull()).alias("inject"), F.count_if((F.col("kind") == "null") & F.col("peak").isNotNull()).alias("null"))
    totals = counts.agg(F.sum("inject").alias("inject"), F.sum("null").alias("null"))
    rows = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")).select("point", level(F.col("point")).alias("threshold")).join(counts.select("point", "hit", "false"), "point", "left")
    down = Window.orderBy(F.desc("point")).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.select("point", "threshold", F.coalesce(F.sum("hit").over(down), F.lit(0)).alias("hit"), F.coalesce(F.sum("false").over(down), F.lit(0)).alias("false"))
    share = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(0.0)
    return sums.join(F.broadcast(totals)).select("point", "threshold", share("hit", "inject").alias("completeness"), share("false", "null").alias("far"))


def completeness_at_far(curve: DataFrame, target: float) -> DataFrame:
    """The best completeness at no more than the target false-alarm rate; 0 if none."""
    return curve.agg(F.coalesce(F.max(F.when(F.col("far") <= target, F.col("completeness"))), F.lit(0.0)).alias("completeness"))


def threshold_at_far(trials: DataFrame, target: float) -> DataFrame:
    """The null peaks' quantile at 1 - target; infinite without null trials."""
    null = F.when(F.col("kind") == "null", F.col("peak"))
    return trials.agg(F.coalesce(F.percentile(null, 1 - target), F.lit(float("inf"))).alias("threshold"))


def edge_bin(value: Column, low: float, high: float, bins: int, close_last: bool = True) -> Column:
    """Which of even bins a value falls in; null outside. The last bin holds its
    right edge if ``close_last``."""
    width = (high - low) / bins
    inside = (value >= low) & (value <= high if close_last else value < high)
    return F.when(inside, F.least(F.floor((value - low) / width), F.lit(bins - 1))).cast("int")


def completeness_map(trials: DataFrame, threshold: float, max_snr: float, snr_bins: int = 6, depth_bins: int = 5, near: int = 12) -> DataFrame:
    """(snr_bin, depth_bin, n, completeness) over all cells; null where there are no trials."""
    i = trials.where("kind = 'inject'").withColumn("snr_bin", edge_bin(F.col("snr"), 0.0, max_snr, snr_bins)).withColumn("depth_bin", edge_bin(F.col("depth"), 0.0, 1.0, depth_bins))
    cells = i.groupBy("snr_bin", "depth_bin").agg(F.count(F.lit(1)).alias("n"), F.avg(recovered(threshold, near).cast("int")).alias("completeness"))
    spark = trials.sparkSession
    grid = spark.range(snr_bins * depth_bins).select((F.col("id") / depth_bins).cast("int").alias("snr_bin"), (F.col("id") % depth_bins).cast("int").alias("depth_bin"))
    return grid.join(cells, ["snr_bin", "depth_bin"], "left").select("snr_bin", "depth_bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "completeness")


def event_snr(depth: Column, snr: Column, duration: Column) -> Column:
    """Depth times stellar signal-to-noise times the root of the duration."""
    return depth * snr * F.sqrt(duration)


def completeness_by_log_bins(trials: DataFrame, threshold: float, low: float, high: float, bins: int = 12, near: int = 12) -> DataFrame:
    """(bin, center, n, completeness) in even bins of the logarithm of event_snr."""
    import math

    a, b = math.log10(low), math.log10(high)
    e = trials.where("kind = 'inject' AND event_snr > 0").withColumn("bin", edge_bin(F.log10("event_snr"), a, b, bins)).where("bin IS NOT NULL")
    out = e.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(recovered(threshold, near).cast("int")).alias("completeness"))
    return out.select("bin", F.pow(F.lit(10.0), a + (F.col("bin") + 0.5) * ((b - a) / bins)).alias("center"), "n", "completeness")


def completeness_by_depth(trials: DataFrame, threshold: float, bins: int = 8, near: int = 12) -> DataFrame:
    """(bin, n, completeness) in even bins of depth from 0 to 1, the last one open at 1."""
    d = trials.where("kind = 'inject'").withColumn("bin", edge_bin(F.col("depth"), 0.0, 1.0, bins, close_last=False)).where("bin IS NOT NULL")
    return d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(recovered(threshold, near).cast("int")).alias("completeness"))
