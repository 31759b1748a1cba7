"""Operators on long series, dealt by stretches with halos.

A series of any length is cut into stretches of equally many samples. Each
stretch also gets the samples just beyond its edges, as many as a window
reaches, so that windows see what they would see in the whole series; results
are then cut back to the stretch's own samples. No task holds more than a
stretch and its halo, and a few long series fill as many tasks as they have
stretches. What belongs to a whole series (its length, its noise, its deepest
dip) is a partial aggregate joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumicurve.operators import detect, series, trials
from lumicurve.operators.series import Names, _list

#: Samples of a stretch.
LENGTH = 65_536


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key equals itself; one of the key columns stays."""
    if not keys:
        return left.join(F.broadcast(right), how=how) if how != "inner" else left.crossJoin(F.broadcast(right))
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same: Column | None = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        same = one if same is None else same & one
    return left.join(renamed, same, how).drop(*[f"_k_{k}" for k in keys])


def indexed(df: DataFrame, key: Names, order: Names, index: str = "i", count: str | None = None, length: int = LENGTH) -> DataFrame:
    """The same as ``series.indexed``, with no series in one task: add the
    position of each row in its series (from 0), and the series' length.

    The first column of ``order`` is a number. Each series is cut into as many
    equal spans of it as it has stretches; rows are counted per span, and a
    row's position is the rows of the spans in front and its place in its own.
    """
    keys, by = _list(key), _list(order)
    x = F.col(by[0]).cast("double")
    ends = df.groupBy(*keys).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.count(F.lit(1)).alias("_size"))
    parts = F.ceil(F.col("_size") / length)
    place = F.when(F.col("_x1") > F.col("_x0"), F.floor((x - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * parts)).otherwise(0)
    # Nulls come first, as in an ascending order.
    dealt = null_safe(df, ends, keys).withColumn("_part", F.when(x.isNull(), -1).otherwise(F.least(place, parts - 1)).cast("long")).drop("_x0", "_x1")
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    counts = counts.withColumn("_ahead", F.coalesce(F.sum("_rows").over(ahead), F.lit(0).cast("long"))).drop("_rows")
    row = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*by))
    out = null_safe(dealt, counts, [*keys, "_part"]).withColumn(index, (F.col("_ahead") + row - 1).cast("long")).drop("_ahead", "_part")
    return out.withColumnRenamed("_size", count) if count else out.drop("_size")


def sizes(df: DataFrame, key: Names, index: str = "i", out: str = "_size") -> DataFrame:
    """(key, out): the length of each series, from its greatest index."""
    return df.groupBy(*_list(key)).agg((F.max(index) + 1).alias(out))


def with_halo(df: DataFrame, at: str, before: int, behind: int, length: int = LENGTH) -> DataFrame:
    """Each row once for its own stretch, and once for every other one of which
    it is at most ``before`` samples in front or ``behind`` samples behind.
    ``at`` is the row's place; it may lie beyond the ends of a series, but no
    further than a window reaches. Adds _stretch; own rows are those with ``at``
    in it."""
    first, last = F.greatest(F.floor((F.col(at) - behind) / length), F.lit(0)), F.floor((F.col(at) + before) / length)
    return df.withColumn("_stretch", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def is_own(at: str, length: int = LENGTH) -> Column:
    return F.floor(F.col(at) / length) == F.col("_stretch")


def _mirrored(df: DataFrame, key: Names, half: int, index: str) -> DataFrame:
    """Rows also at the places beyond both ends that mirror them, as ``series.boxcar`` has it: adds _at."""
    i, n = F.col(index).cast("long"), F.col("_size")
    none = F.array().cast("array<bigint>")
    once = F.concat(F.array(i), F.when(i < half, F.array(-1 - i)).otherwise(none), F.when(i >= n - half, F.array(2 * n - 1 - i)).otherwise(none))
    turns = F.floor((half + n) / (2 * n)) + 1
    often = F.flatten(F.transform(F.sequence(-turns, turns), lambda k: F.array(i + 2 * n * k, 2 * n * k - 1 - i)))
    places = F.when(n >= half, once).otherwise(F.filter(often, lambda p: (p >= -half) & (p < n + half)))
    return null_safe(df, sizes(df, key, index), _list(key)).withColumn("_at", F.explode(places))


def _running_mean(wide: DataFrame, key: Names, value: str, width: int, out: str) -> DataFrame:
    half = width // 2
    w = Window.partitionBy(*_list(key), "_stretch").orderBy("_at").rowsBetween(-half, width - 1 - half)
    return wide.withColumn(out, F.avg(value).over(w))


def boxcar(df: DataFrame, key: Names, value: str, width: int, index: str = "i", out: str = "trend", length: int = LENGTH) -> DataFrame:
    """The same as ``series.boxcar``, by stretches."""
    half = width // 2
    wide = with_halo(_mirrored(df, key, half, index), "_at", half, half, length)
    done = _running_mean(wide, key, value, width, out)
    return done.where((F.col("_at") == F.col(index)) & is_own("_at", length)).drop("_size", "_at", "_stretch")


def detrend(df: DataFrame, key: Names, value: str, width: int = 200, index: str = "i", out: str = "d", length: int = LENGTH) -> DataFrame:
    """The same as ``series.detrend``, by stretches."""
    return boxcar(df, key, value, width, index, "_trend", length).withColumn(out, F.col(value) - F.col("_trend")).drop("_trend")


def convolve(df: DataFrame, key: Names, value: str, taps: Sequence[float], index: str = "i", out: str = "c", mode: str = "valid", length: int = LENGTH) -> DataFrame:
    """The same as ``series.convolve``, by stretches."""
    half = len(taps) // 2
    wide = with_halo(df, index, half, half, length)
    return series.convolve(wide, [*_list(key), "_stretch"], value, taps, index, out, mode).where(is_own(index, length)).drop("_stretch")


def detrended_convolution(df: DataFrame, key: Names, value: str, width: int, taps: Sequence[float], index: str = "i", out: str = "c", length: int = LENGTH) -> DataFrame:
    """``detrend`` and a valid ``convolve`` behind each other in one exchange: the
    halo is as wide as both reach, d (the detrended value) and ``out`` are added."""
    half, reach = width // 2, len(taps) // 2
    wide = with_halo(_mirrored(df, key, half, index), "_at", half + reach, half + reach, length)
    flat = _running_mean(wide, key, value, width, "_trend").where(F.col("_at") == F.col(index)).withColumn("d", F.col(value) - F.col("_trend"))
    # Of the halo's rows those within the taps' reach have a whole window behind them.
    done = series.convolve(flat, [*_list(key), "_stretch"], "d", taps, index, out, "valid")
    return done.where(is_own("_at", length)).drop("_size", "_at", "_stretch", "_trend")


def trim_zeros(df: DataFrame, key: Names, value: str, index: str = "i", least: int = 100) -> DataFrame:
    """The same as ``series.trim_zeros``; _first has the first index that stays."""
    keys, live = _list(key), F.when(F.col(value) != 0, F.col(index))
    ends = df.groupBy(*keys).agg(F.min(live).alias("_first"), F.max(live).alias("_last")).where(F.col("_last") - F.col("_first") + 1 >= least)
    return null_safe(df, ends, keys).where(F.col(index).between(F.col("_first"), F.col("_last"))).drop("_last")


def dip_detection(df: DataFrame, key: Names, order: Names, value: str, detrend_width: int = 200, kernel_width: float = 6.0, taps: int = 49, exclude: int = 5, threshold: float = 5.0, least: int = 100, length: int = LENGTH) -> DataFrame:
    """The same as ``detect.dip_detection`` for series without holes in their
    order, by stretches: one exchange for detrending and convolution, minima
    and moments of the background by partial aggregates."""
    keys = _list(key)
    s = trim_zeros(indexed(df, keys, order, "frame", length=length), keys, value, "frame", least).withColumn("i", F.col("frame") - F.col("_first")).drop("_first")
    c = detrended_convolution(s, keys, value, detrend_width, series.ricker(kernel_width, taps), length=length).select(*keys, "i", "frame", "c")
    best = c.groupBy(*keys).agg(F.min(F.struct("c", "i", "frame")).alias("_b"))
    away = F.when(F.abs(F.col("i") - F.col("_b.i")) > exclude, F.col("c"))
    found = null_safe(c, best, keys).groupBy(*keys).agg(F.min("_b").alias("_b"), F.avg(away).alias("bkg_mean"), F.stddev_pop(away).alias("bkg_std"), F.count(F.lit(1)).alias("n_conv"))
    found = found.select(*keys, F.col("_b.frame").alias("frame"), F.col("_b.c").alias("conv_min"), "bkg_mean", "bkg_std", "n_conv")
    found = found.withColumn("significance", F.when(F.col("bkg_std") > 0, (F.col("bkg_mean") - F.col("conv_min")) / F.col("bkg_std")))
    return found.withColumn("detected", F.coalesce(F.col("significance") >= threshold, F.lit(False)))


def bank_scores(df: DataFrame, key: Names, value: str, bank: dict[str, list[float]], sigma: str, index: str = "i", length: int = LENGTH) -> DataFrame:
    """The same as ``detect.bank_scores``, by stretches whose halo is half the longest template."""
    half = max(len(t) // 2 for t in bank.values())
    wide = with_halo(df, index, half, half, length)
    return detect.bank_scores(wide, [*_list(key), "_stretch"], value, bank, sigma, index).where(is_own(index, length)).drop("_stretch")


def per_stretch(df: DataFrame, key: Names, value: str, fn: Callable[[np.ndarray], np.ndarray], reach: int, out: str, index: str = "i", mirrored: bool = False, length: int = LENGTH) -> DataFrame:
    """Add ``fn`` of each series, computed in numpy on a stretch and ``reach``
    samples on both sides of it. ``fn`` takes an array (nulls as NaN) and gives
    one of the same length, each value from samples within ``reach``. ``mirrored``
    continues a series beyond its ends as ``series.boxcar`` does; else a stretch
    ends where its series does."""
    wide = _mirrored(df, key, reach, index) if mirrored else df.withColumn("_at", F.col(index).cast("long"))
    wide = with_halo(wide, "_at", reach, reach, length)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        pdf = pdf.assign(**{out: np.asarray(fn(pdf[value].to_numpy(float)), float)})
        return pdf[(pdf["_at"] == pdf[index]) & (pdf["_at"] // length == pdf["_stretch"])][[*columns, out]]

    columns = [c for c in df.columns if c != out]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out)
    return wide.select(*columns, "_at", "_stretch").groupBy(*_list(key), "_stretch").applyInPandas(run, f"{fields}, `{out}` double")


def best_scores(df: DataFrame, key: Names, value: str, bank: Sequence[Sequence[float]], sigma: str, index: str = "i", out: str = "score", length: int = LENGTH) -> DataFrame:
    """The best score at each sample over a bank of templates of any number and
    length, in numpy by stretches whose halo is the longest template's half.
    Nulls count as 0, as do samples beyond the ends."""
    reach = max(len(t) for t in bank) // 2
    best = per_stretch(df, key, value, lambda x: np.fmax.reduce([trials.matched(x, np.array(t, float), 1.0) for t in bank]), reach, "_raw", index, length=length)
    return best.withColumn(out, F.col("_raw") / F.when(F.col(sigma) == 0, 1.0).otherwise(F.col(sigma))).drop("_raw")


def bank_peaks(df: DataFrame, key: Names, value: str, banks: dict[str, Sequence[Sequence[float]]], sigma: str, index: str = "i", length: int = LENGTH) -> DataFrame:
    """(key, shape, peak, frame): where each bank scores best in each series, the
    first place on ties (to nine decimals). A stretch gives one row per bank, of
    which the greatest is taken."""
    keys = _list(key)
    reach = max(len(t) for bank in banks.values() for t in bank) // 2
    wide = with_halo(df.select(*keys, F.col(index).cast("long").alias("_at"), F.col(value).alias("_x"), F.when(F.col(sigma) == 0, 1.0).otherwise(F.col(sigma)).alias("_sigma")), "_at", reach, reach, length)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        at, x, noise = pdf["_at"].to_numpy(), pdf["_x"].to_numpy(float), float(pdf["_sigma"].iloc[0])
        own, rows = at // length == pdf["_stretch"].iloc[0], []
        for shape, bank in banks.items():
            score = np.fmax.reduce([trials.matched(x, np.array(t, float), noise) for t in bank])[own].round(9)
            if len(score):
                rows.append((*pdf[keys].iloc[0], shape, float(score.max()), int(at[own][score.argmax()])))
        return pd.DataFrame(rows, columns=[*keys, "shape", "peak", "frame"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keys).schema.fields)
    found = wide.groupBy(*keys, "_stretch").applyInPandas(run, f"{fields}shape string, peak double, frame long")
    best = found.groupBy(*keys, "shape").agg(F.max(F.struct("peak", (-F.col("frame")).alias("f"))).alias("_b"))
    return best.select(*keys, "shape", F.col("_b.peak").alias("peak"), (-F.col("_b.f")).alias("frame"))


def with_sigma(df: DataFrame, key: Names, value: str, out: str = "sigma") -> DataFrame:
    """Add the standard deviation of each whole series."""
    return null_safe(df, df.groupBy(*_list(key)).agg(F.stddev_pop(value).alias(out)), _list(key))


def steps(df: DataFrame, key: Names, order: Names, time: str, out: str = "dt", length: int = LENGTH) -> DataFrame:
    """Add the time since the sample in front (null at the first), by stretches."""
    wide = with_halo(indexed(df, key, order, "_i", length=length), "_i", 1, 0, length)
    w = Window.partitionBy(*_list(key), "_stretch").orderBy("_i")
    return wide.withColumn(out, F.col(time) - F.lag(time).over(w)).where(is_own("_i", length)).drop("_i", "_stretch")
