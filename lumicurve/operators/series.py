"""Operators on ordered series: detrending, convolution, gaps, bins, segments.

A series is the rows of one key in the order of some columns. Every operator
is one hash partitioning by the key; operators that follow each other on the
same key share it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = str | Sequence[str]


def _list(names: Names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def indexed(df: DataFrame, key: Names, order: Names, index: str = "i", count: str | None = None) -> DataFrame:
    """Add the position of each row in its series (from 0), and the series' length."""
    out = df.withColumn(index, (F.row_number().over(Window.partitionBy(*_list(key)).orderBy(*_list(order))) - 1).cast("long"))
    return out.withColumn(count, F.count(F.lit(1)).over(Window.partitionBy(*_list(key)))) if count else out


def trim_zeros(df: DataFrame, key: Names, value: str, index: str = "i", least: int = 100) -> DataFrame:
    """Drop leading and trailing exact zeros of each series, then series of
    under ``least`` samples; zeros inside stay, and so does a sample's index."""
    w = Window.partitionBy(*_list(key))
    live = F.when(F.col(value) != 0, F.col(index))
    kept = df.withColumn("_a", F.min(live).over(w)).withColumn("_b", F.max(live).over(w)).where(F.col(index).between(F.col("_a"), F.col("_b")))
    return kept.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= least).drop("_a", "_b", "_n")


def boxcar(df: DataFrame, key: Names, value: str, width: int, index: str = "i", out: str = "trend") -> DataFrame:
    """Running mean over [i - width // 2, i + (width - 1) // 2] with the series
    mirrored at its ends (the edge sample repeats), as often as a short series
    needs. ``index`` runs from 0 without holes. Null values are left out of the
    means; a window of nulls alone gives null."""
    half, keys = width // 2, _list(key)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    i, size = F.col(index).cast("long"), F.col("_n")
    none = F.array().cast("array<bigint>")
    once = F.concat(F.array(i), F.when(i < half, F.array(-1 - i)).otherwise(none), F.when(i >= size - half, F.array(2 * size - 1 - i)).otherwise(none))
    turns = F.floor((half + size) / (2 * size)) + 1
    all_turns = F.flatten(F.transform(F.sequence(-turns, turns), lambda k: F.array(i + 2 * size * k, 2 * size * k - 1 - i)))
    at = F.when(size >= half, once).otherwise(F.filter(all_turns, lambda p: (p >= -half) & (p < size + half)))
    wide = df.withColumn("_n", n).withColumn("_at", F.explode(at))
    mean = F.avg(value).over(Window.partitionBy(*keys).orderBy("_at").rowsBetween(-half, width - 1 - half))
    return wide.withColumn(out, mean).where(F.col("_at") == i).drop("_n", "_at")


def detrend(df: DataFrame, key: Names, value: str, width: int = 200, index: str = "i", out: str = "d") -> DataFrame:
    """The value less its running mean."""
    return boxcar(df, key, value, width, index, "_trend").withColumn(out, F.col(value) - F.col("_trend")).drop("_trend")


def ricker(width: float, taps: int = 49) -> list[float]:
    """Samples of a Ricker wavelet of scale ``width``, centred, without its constant factor."""
    import math

    half = taps // 2
    return [(1 - (o / width) ** 2) * math.exp(-((o / width) ** 2) / 2) for o in range(-half, half + 1)]


def convolve(df: DataFrame, key: Names, value: str, taps: Sequence[float], index: str = "i", out: str = "c", mode: str = "valid") -> DataFrame:
    """Correlate each series with ``taps`` (equal to convolution where they are
    symmetric). ``valid`` keeps only samples whose taps all lie in the series and
    meet no null (so a null takes the samples around it along), ``same`` takes
    zeros beyond the ends and for nulls. One window, a lag or lead for each tap."""
    half, w = len(taps) // 2, Window.partitionBy(*_list(key)).orderBy(index)
    total: Column | None = None
    for k, tap in enumerate(taps):
        o = k - half
        x = F.col(value) if o == 0 else F.lead(value, o).over(w) if o > 0 else F.lag(value, -o).over(w)
        term = (x if mode == "valid" else F.coalesce(x, F.lit(0.0))) * F.lit(float(tap))
        total = term if total is None else total + term
    done = df.withColumn(out, total)
    return done.where(F.col(out).isNotNull()) if mode == "valid" else done


def gap_mask(df: DataFrame, key: Names, time: str, hz: float = 40.0, factor: float = 1.5, out: str = "gap") -> DataFrame:
    """Whether a sample comes more than ``factor`` sample times behind the one before."""
    step = F.col(time) - F.lag(time).over(Window.partitionBy(*_list(key)).orderBy(time))
    return df.withColumn(out, F.coalesce(step > factor / hz, F.lit(False)))


def segments(df: DataFrame, key: Names, time: str, gap: str = "gap", out: str = "segment") -> DataFrame:
    """Number the stretches between gaps, from 0."""
    w = Window.partitionBy(*_list(key)).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.col(gap).cast("long")).over(w))


def gap_breaks(df: DataFrame, key: Names, time: str, value: str, gap: str = "gap") -> DataFrame:
    """A row with a null value just in front of each sample behind a gap, for drawing."""
    keys = _list(key)
    marks = df.where(F.col(gap)).select(*keys, F.col(time), F.lit(None).cast("double").alias(value))
    return df.select(*keys, time, value).unionByName(marks)


def on_axis(df: DataFrame, key: Names, time: str, value: str, field: Names = ()) -> DataFrame:
    """Each series on the whole axis of its field: a row for every time at which
    any series of the field has a sample, null where this one has none, so that
    gaps and missing minutes show. Of samples at one time the least value counts;
    nulls are no samples of a series, but their times are on the axis."""
    keys, fields = _list(key), _list(field)
    axis = df.where(F.col(time).isNotNull()).select(*fields, time).distinct()
    members = df.select(*dict.fromkeys([*fields, *keys])).distinct()
    whole = members.join(axis, fields) if fields else members.crossJoin(axis)
    own = df.groupBy(*dict.fromkeys([*fields, *keys]), time).agg(F.min(value).alias(value))
    return whole.join(own, [*dict.fromkeys([*fields, *keys]), time], "left")


def time_bins(df: DataFrame, key: Names, time: str, value: str, width: float, how: str = "mean") -> DataFrame:
    """(key, bin, t_center, value, n): bins of ``width`` from each series' first
    time. The last sample falls into the last bin also where the span is a
    multiple of the width; bins without samples have a null value."""
    keys = _list(key)
    agg = {"mean": F.avg, "median": F.median, "sum": F.sum}[how]
    ends = df.groupBy(*keys).agg(F.min(time).alias("_t0"), F.max(time).alias("_t1"))
    ends = ends.select(*keys, "_t0", F.greatest(F.lit(1), F.ceil((F.col("_t1") - F.col("_t0")) / width)).cast("long").alias("_bins"))
    placed = df.join(ends, keys)
    placed = placed.withColumn("bin", F.least(F.floor((F.col(time) - F.col("_t0")) / width), F.col("_bins") - 1).cast("long"))
    full = placed.groupBy(*keys, "bin").agg(agg(value).alias("value"), F.count(value).alias("n"))
    axis = ends.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_bins") - 1)))
    out = axis.join(full, [*keys, "bin"], "left")
    return out.select(*keys, "bin", (F.col("_t0") + (F.col("bin") + 0.5) * width).alias("t_center"), "value", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def count_bins(df: DataFrame, key: Names, order: Names, time: str, value: str, size: int) -> DataFrame:
    """Means of each ``size`` samples in order; a last, shorter group stays."""
    keys = _list(key)
    return indexed(df, keys, order, "_i").groupBy(*keys, F.floor(F.col("_i") / size).cast("long").alias("bin")).agg(F.avg(time).alias("t"), F.avg(value).alias("value"), F.count(F.lit(1)).alias("n"))


def synthetic_axis(df: DataFrame, key: Names, order: Names, time: str, hz: float = 40.0, out: str = "t_axis") -> DataFrame:
    """Times t0 + i / hz for series in which over half of the steps are exactly
    0 (whole-second stamps), the times themselves otherwise."""
    keys = _list(key)
    w = Window.partitionBy(*keys).orderBy(*_list(order))
    done = indexed(df, keys, order, "_i").withColumn("_flat", (F.col(time) - F.lag(time).over(w) == 0).cast("double"))
    whole = Window.partitionBy(*keys)
    axis = F.when(F.avg("_flat").over(whole) > 0.5, F.min(time).over(whole) + F.col("_i") / hz).otherwise(F.col(time))
    return done.withColumn(out, axis).drop("_flat", "_i")


def cadence(df: DataFrame, key: Names, order: Names, time: str) -> DataFrame:
    """Median step of each series."""
    w = Window.partitionBy(*_list(key)).orderBy(*_list(order))
    return df.withColumn("_dt", F.col(time) - F.lag(time).over(w)).groupBy(*_list(key)).agg(F.median("_dt").alias("cadence"))


def local_linear_detrend(df: DataFrame, key: Names, index: str, value: str, center: str, margin: int = 10, out: str = "normalised") -> DataFrame:
    """Divide by the line fitted to each series' samples more than ``margin``
    from its ``center`` sample."""
    w = Window.partitionBy(*_list(key))
    outside = F.abs(F.col(index) - F.col(center)) > margin
    x, y = F.when(outside, F.col(index).cast("double")), F.when(outside, F.col(value))
    fitted = df.withColumn("_slope", F.regr_slope(y, x).over(w)).withColumn("_base", F.regr_intercept(y, x).over(w))
    line = F.col("_slope") * F.col(index) + F.col("_base")
    return fitted.withColumn(out, F.when(line != 0, F.col(value) / line)).drop("_slope", "_base")


def rollover_seconds(df: DataFrame, key: Names, order: Names, seconds: str, limit: float = 0.3, out: str = "unrolled") -> DataFrame:
    """Add a minute each time the seconds go backwards; ``broken`` tells series
    with a step over ``limit``."""
    keys = _list(key)
    w = Window.partitionBy(*keys).orderBy(*_list(order))
    back = F.coalesce((F.col(seconds) < F.lag(seconds).over(w)).cast("long"), F.lit(0))
    done = df.withColumn("_back", back).withColumn(out, F.col(seconds) + 60 * F.sum("_back").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    done = done.withColumn("_step", F.col(out) - F.lag(out).over(w))
    return done.withColumn("broken", F.coalesce(F.max("_step").over(Window.partitionBy(*keys)) > limit, F.lit(False))).drop("_back", "_step")


def cutout(samples: DataFrame, events: DataFrame, key: Names, index: str, event_index: str, before: int = 40, behind: int = 39) -> DataFrame:
    """Samples around each event of the same series, clipped at its ends. Each
    event asks for its own places, so the join is on series and place."""
    at = F.explode(F.sequence(F.col(event_index).cast("long") - before, F.col(event_index).cast("long") + behind))
    wanted = events.withColumn("_at", at)
    s = samples.withColumn("_at", F.col(index).cast("long"))
    return s.join(wanted, [*_list(key), "_at"]).drop("_at").withColumn("offset", (F.col(index) - F.col(event_index)).cast("long"))


def drift(df: DataFrame, key: Names, order: Names, time: str, x: str, y: str) -> DataFrame:
    """Per series the drift from its first to its last sample, per second."""
    w = F.struct(*_list(order))
    ends = df.groupBy(*_list(key)).agg(*[f(c, w).alias(f"{c}_{n}") for c in (time, x, y) for n, f in (("a", F.min_by), ("b", F.max_by))])
    dt = F.col(f"{time}_b") - F.col(f"{time}_a")
    return ends.select(*_list(key), *[F.when(dt != 0, (F.col(f"{c}_b") - F.col(f"{c}_a")) / dt).alias(f"v_{c}") for c in (x, y)])


def drift_rate(df: DataFrame, key: Names, order: Names, time: str, x: str, y: str) -> DataFrame:
    """Medians of the drifts of all series."""
    return drift(df, key, order, time, x, y).agg(F.median(f"v_{x}").alias(f"v_{x}"), F.median(f"v_{y}").alias(f"v_{y}"))


def propagate(df: DataFrame, key: Names, order: Names, time: str, x0: str, y0: str, vx: float | Column, vy: float | Column) -> DataFrame:
    """Positions moving at a constant rate from each series' first time."""
    t0 = F.first(time).over(Window.partitionBy(*_list(key)).orderBy(*_list(order)))
    dt = F.col(time) - t0
    return df.withColumn("x_t", F.col(x0) + vx * dt).withColumn("y_t", F.col(y0) + vy * dt)
