"""Robust statistics, reference stars and differential photometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumicurve.operators.series import Names, _list, boxcar


def star_summary(df: DataFrame, key: Names, value: str, minute: str) -> DataFrame:
    """n_valid_frames, n_minutes, median_flux, snr (median over population deviation)."""
    agg = df.groupBy(*_list(key)).agg(F.count(value).alias("n_valid_frames"), F.count_distinct(minute).alias("n_minutes"), F.median(value).alias("median_flux"), F.stddev_pop(value).alias("_s"))
    return agg.withColumn("snr", F.when(F.col("_s") > 0, F.col("median_flux") / F.col("_s")).otherwise(0.0)).drop("_s")


def star_snr(df: DataFrame, key: Names, value: str, width: int = 200, index: str = "i") -> DataFrame:
    """Median over the deviation about the running mean; 0 where that is 0."""
    d = boxcar(df, key, value, width, index).withColumn("_r", F.col(value) - F.col("trend"))
    agg = d.groupBy(*_list(key)).agg(F.median(value).alias("_m"), F.stddev_pop("_r").alias("_s"))
    return agg.select(*_list(key), F.when(F.col("_s") > 0, F.col("_m") / F.col("_s")).otherwise(0.0).alias("snr"))


def with_mad(df: DataFrame, key: Names, value: str, center: str = "center", sigma: str = "mad_std") -> DataFrame:
    """Add the median of the key and 1.4826 times its median absolute deviation.
    Medians are aggregates joined back, so no partition is held in a window."""
    keys = _list(key)
    with_center = df.join(df.groupBy(*keys).agg(F.median(value).alias(center)), keys)
    spread = with_center.groupBy(*keys).agg((F.median(F.abs(F.col(value) - F.col(center))) * 1.4826).alias(sigma))
    return with_center.join(spread, keys)


def mad_std(df: DataFrame, key: Names, value: str) -> DataFrame:
    """(key, center, mad_std)."""
    keys = _list(key)
    return with_mad(df, keys, value).groupBy(*keys).agg(F.first("center").alias("center"), F.first("mad_std").alias("mad_std"))


def sigma_clip(df: DataFrame, key: Names, value: str, k: float = 3.0, rounds: int = 2) -> DataFrame:
    """Set values further than k robust deviations from the median to null, some rounds."""
    for _ in range(rounds):
        df = with_mad(df, key, value, "_c", "_s").withColumn(value, F.when(F.abs(F.col(value) - F.col("_c")) <= k * F.col("_s"), F.col(value))).drop("_c", "_s")
    return df


def clipped_mean(df: DataFrame, value: str, k: float = 2.0, most_rounds: int = 20) -> DataFrame:
    """(mean, std, n) after clipping about the mean at k deviations until no
    value goes any more. Each round is one aggregate that keeps a single row."""
    low, high, n = None, None, -1
    for _ in range(most_rounds):
        kept = df if low is None else df.where((F.col(value) >= low) & (F.col(value) <= high))
        row = kept.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.count(value).alias("n")).collect()[0]
        if row["n"] in (0, n):
            break
        n, new_low, new_high = row["n"], row["m"] - k * row["s"], row["m"] + k * row["s"]
        low, high = (new_low, new_high) if low is None else (max(low, new_low), min(high, new_high))
    kept = df if low is None else df.where((F.col(value) >= low) & (F.col(value) <= high))
    return kept.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def flux_check(df: DataFrame, key: Names, value: str, index: str = "i", part: int = 2400) -> DataFrame:
    """(key, code): -1 empty, -2 median 0, -3 the means of the first and last
    ``part`` samples differ by over a deviation, -4 median under 5 deviations, else 0."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*_list(key)))
    d = df.withColumn("_n", n)
    agg = d.groupBy(*_list(key)).agg(
        F.count(value).alias("n"),
        F.median(value).alias("med"),
        F.stddev_pop(value).alias("std"),
        F.avg(F.when(F.col(index) < part, F.col(value))).alias("head"),
        F.avg(F.when(F.col(index) >= F.col("_n") - part, F.col(value))).alias("tail"),
    )
    code = F.when(F.col("n") == 0, -1).when(F.col("med") == 0, -2).when(F.abs(F.col("head") - F.col("tail")) > F.col("std"), -3).when(F.col("med") / F.col("std") < 5, -4).otherwise(0)
    return agg.select(*_list(key), code.cast("int").alias("code"))


def reference_band(flux: DataFrame, n_frames: int, least_presence: float = 0.9, low: float = 0.25, high: float = 0.75, most: int = 50, star: str = "star", value: str = "flux") -> DataFrame:
    """Reference stars: present often enough, with a median flux between two
    percentiles of all such stars', the brightest ``most`` of them."""
    m = flux.groupBy(star).agg((F.count_if(F.col(value) > 0) / n_frames).alias("presence"), F.median(F.when(F.col(value) > 0, F.col(value))).alias("median_flux"))
    m = m.where((F.col("presence") >= least_presence) & F.col("median_flux").isNotNull())
    edges = m.agg(F.percentile("median_flux", low).alias("_lo"), F.percentile("median_flux", high).alias("_hi"))
    inside = m.join(F.broadcast(edges)).where(F.col("median_flux").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    return inside.orderBy(F.desc("median_flux"), star).limit(most)


def reference_flux(flux: DataFrame, refs: DataFrame, frame: str = "frame", star: str = "star", value: str = "flux") -> DataFrame:
    """Per frame the sum, mean, number and magnitude of the reference stars' positive fluxes."""
    f = flux.join(refs.select(star).distinct(), star, "left_semi").where(F.col(value) > 0)
    agg = f.groupBy(frame).agg(F.sum(value).alias("ref_sum"), F.avg(value).alias("ref_mean"), F.count(F.lit(1)).alias("n_used"))
    return agg.withColumn("ref_mag", -2.5 * F.log10("ref_mean"))


def differential(flux: DataFrame, per_frame: DataFrame, refs: DataFrame | None = None, denominator: str = "ref_mean", frame: str = "frame", star: str = "star", value: str = "flux") -> DataFrame:
    """Relative flux and magnitude against the references of the frame. With
    ``refs`` a reference star is left out of its own denominator."""
    j = flux.join(per_frame, frame, "left")
    d = F.col(denominator)
    if refs is not None:
        j = j.join(refs.select(star).distinct().withColumn("_is_ref", F.lit(True)), star, "left")
        own = F.col("_is_ref").isNotNull() & (F.col(value) > 0)
        n, total = F.col("n_used") - own.cast("int"), F.col("ref_sum") - F.when(own, F.col(value)).otherwise(0.0)
        d = F.when(n > 0, total / n if denominator == "ref_mean" else total)
    rel = F.when((d > 0) & F.col(value).isNotNull(), F.col(value) / d)
    return j.withColumn("rel_flux", rel).withColumn("diff_mag", F.when(F.col("rel_flux") > 0, -2.5 * F.log10("rel_flux"))).drop("_is_ref")


def normalise_by_median(df: DataFrame, key: Names, value: str, least: int = 3, out: str = "norm") -> DataFrame:
    """Divide by the median of the key's positive values, if there are enough."""
    pos = F.when(F.col(value) > 0, F.col(value))
    m = df.groupBy(*_list(key)).agg(F.when(F.count(pos) >= least, F.median(pos)).alias("_m"))
    return df.join(m, _list(key), "left").withColumn(out, F.when(F.col("_m") > 0, F.col(value) / F.col("_m"))).drop("_m")


def reference_selection(pairs: DataFrame, radius: float, most: int, least: int, target: str = "target", ref: str = "ref", distance: str = "d") -> DataFrame:
    """Of candidate pairs the nearest ``most`` references of each target within
    the radius; targets with under ``least`` get none."""
    w = Window.partitionBy(target).orderBy(distance, ref)
    kept = pairs.where(F.col(distance) <= radius).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return kept.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(target))).where(F.col("_n") >= least).drop("_n")


def similar_references(flux: DataFrame, selection: DataFrame, fraction: float = 0.5, fewest: int = 3, star: str = "star", time: str = "t", value: str = "flux", target: str = "target", ref: str = "ref") -> DataFrame:
    """Two passes over each target's references: those whose normalised curve is
    most like the target's, and of them those most like the kept ones' mean. A
    pass keeps the given fraction, ``fewest`` at least."""
    norm = normalise_by_median(flux.select(star, time, value), star, value, 1, "f").select(star, time, "f")

    def keep(sel: DataFrame, like: DataFrame) -> DataFrame:
        pairs = sel.select(target, ref).join(norm.withColumnRenamed(star, ref), ref).join(like, [target, time])
        sse = pairs.groupBy(target, ref).agg(F.avg(F.pow(F.col("f") - F.col("_g"), 2)).alias("sse"))
        w = Window.partitionBy(target)
        n = F.count(F.lit(1)).over(w)
        limit = F.greatest(F.lit(fewest), F.least(F.bround(fraction * n), n))
        return sse.withColumn("rank", F.row_number().over(w.orderBy("sse", ref))).withColumn("_l", limit).where(F.col("rank") <= F.col("_l")).drop("_l")

    first = keep(selection, norm.select(F.col(star).alias(target), time, F.col("f").alias("_g")))
    mean = first.select(target, ref).join(norm.withColumnRenamed(star, ref), ref).groupBy(target, time).agg(F.avg("f").alias("_g"))
    return keep(first, mean)


def in_ranges(df: DataFrame, **ranges: tuple[float | None, float | None]) -> DataFrame:
    """Rows inside all the given inclusive ranges; a null fails every test."""
    for c, (low, high) in ranges.items():
        if low is not None:
            df = df.where(F.col(c) >= low)
        if high is not None:
            df = df.where(F.col(c) <= high)
    return df


def edge_mask(x: Column, y: Column, width: int, height: int, margin: int = 10) -> Column:
    """Whether a position keeps its distance from the image's edges."""
    return (x + margin < width) & (x - margin > 0) & (y + margin < height) & (y - margin > 0)


def full_scopes(df: DataFrame, scope: str, least: float = 0.9) -> DataFrame:
    """Scopes with at least the given share of the longest one's frames."""
    n = df.groupBy(scope).agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(n.agg(F.max("n").alias("_m")))).where(F.col("n") >= least * F.col("_m")).drop("_m")


def scopes_identical(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row: whether all values of the frames' common keys are the same up to rounding."""
    j = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), list(keys))
    close = F.abs(F.col("_a") - F.col("_b")) <= 1e-8 + 1e-5 * F.abs("_b")
    return j.agg(F.coalesce(F.bool_and(close), F.lit(False)).alias("identical"), F.count(F.lit(1)).alias("n"))
