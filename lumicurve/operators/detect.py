"""Dip detection, templates and the scores of several streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumicurve.operators.bandjoin import neighbours
from lumicurve.operators.series import Names, _list, convolve, detrend, indexed, ricker, trim_zeros


def dip_detection(df: DataFrame, key: Names, order: Names, value: str, detrend_width: int = 200, kernel_width: float = 6.0, taps: int = 49, exclude: int = 5, threshold: float = 5.0, least: int = 100) -> DataFrame:
    """The deepest dip of each series: frame, conv_min, bkg_mean, bkg_std,
    significance, detected.

    Zeros at the ends are trimmed and short series dropped; the series is
    detrended by a running mean and convolved with a Ricker wavelet. The frame
    (the sample's place in the whole series) is where the convolution is least,
    the first one on ties; its background are the samples more than ``exclude``
    away from it.
    """
    keys = _list(key)
    s = trim_zeros(indexed(df, keys, order, "frame"), keys, value, "frame", least)
    c = convolve(detrend(indexed(s, keys, "frame", "i"), keys, value, detrend_width), keys, "d", ricker(kernel_width, taps))
    w = Window.partitionBy(*keys)
    c = c.withColumn("_best", F.min(F.struct("c", "i", "frame")).over(w))
    away = F.when(F.abs(F.col("i") - F.col("_best.i")) > exclude, F.col("c"))
    found = c.groupBy(*keys).agg(
        F.min(F.struct("c", "i", "frame")).alias("_b"), F.avg(away).alias("bkg_mean"), F.stddev_pop(away).alias("bkg_std"), F.count(F.lit(1)).alias("n_conv")
    )
    found = found.select(*keys, F.col("_b.frame").alias("frame"), F.col("_b.c").alias("conv_min"), "bkg_mean", "bkg_std", "n_conv")
    found = found.withColumn("significance", F.when(F.col("bkg_std") > 0, (F.col("bkg_mean") - F.col("conv_min")) / F.col("bkg_std")))
    return found.withColumn("detected", F.coalesce(F.col("significance") >= threshold, F.lit(False)))


def box(width: int) -> list[float]:
    """A box dip of ``width`` samples, odd number of taps, centred."""
    half = (width + 1) // 2
    return [-1.0 if -(width // 2) <= o < width - width // 2 else 0.0 for o in range(-half, half + 1)]


def unit(taps: list[float]) -> list[float]:
    norm = sum(x * x for x in taps) ** 0.5
    return [x / norm for x in taps] if norm else taps


def matched_filter(df: DataFrame, key: Names, value: str, template: list[float], sigma: str, index: str = "i", out: str = "score") -> DataFrame:
    """Correlation with the template of unit norm, zeros beyond the ends, over
    the noise ``sigma`` (1 where it is 0)."""
    s = F.when(F.col(sigma) == 0, 1.0).otherwise(F.col(sigma))
    return convolve(df, key, value, unit(template), index, "_raw", "same").withColumn(out, F.col("_raw") / s).drop("_raw")


def bank_scores(df: DataFrame, key: Names, value: str, bank: dict[str, list[float]], sigma: str, index: str = "i") -> DataFrame:
    """Per sample the best score over a bank of templates: all of them are
    expressions over one window, so the bank costs no further shuffle or join."""
    for name, template in bank.items():
        df = matched_filter(df, key, value, template, sigma, index, f"_s_{name}")
    names = [f"_s_{n}" for n in bank]
    best = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    return df.withColumn("score", best).drop(*names)


def peak(df: DataFrame, key: Names, score: str = "score", index: str = "i") -> DataFrame:
    """The highest score of each series and where it is, the first one on ties."""
    keys = _list(key)
    best = df.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(index)).alias("i"))).alias("b"))
    return best.select(*keys, F.col("b.s").alias("peak"), (-F.col("b.i")).cast("long").alias("frame"))


def align_by_index(scores: DataFrame, scope: str, index: str = "i", score: str = "score") -> DataFrame:
    """Scores of several scopes at the frames they all have (up to the shortest
    one's length), nulls as 0."""
    n = scores.groupBy(scope).agg(F.max(index).alias("m")).agg(F.min("m").alias("_last"))
    return scores.join(F.broadcast(n)).where(F.col(index) <= F.col("_last")).drop("_last").withColumn(score, F.coalesce(score, F.lit(0.0)))


def align_by_time(reference: DataFrame, other: DataFrame, key: Names, time: str, score: str, out: str = "aligned", span: float = 3600.0) -> DataFrame:
    """The other stream's score at the reference's times by linear
    interpolation, 0 outside of it and null where it depends on a null score.
    Both streams merge in ordered stretches of ``span``."""
    keys = _list(key)
    mark = F.struct(F.col(time).alias("_t"), F.col(score).cast("double").alias("_v"))
    marks = other.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("_t"), mark.alias("_k"))
    both = reference.select(*keys, F.col(time).alias("_t"), F.lit(None).cast(marks.schema["_k"].dataType).alias("_k")).unionByName(marks)
    m = neighbours(both, keys, "_t", "_k", span).where("_k IS NULL")
    a, b, t = F.col("_a"), F.col("_b"), F.col("_t")
    value = F.when(a["_t"] == t, a["_v"]).when(a.isNull() | b.isNull(), 0.0).otherwise(a["_v"] + (b["_v"] - a["_v"]) * (t - a["_t"]) / (b["_t"] - a["_t"]))
    return m.select(*keys, t.alias(time), value.alias(out))


def joint_score(scores: DataFrame, key: Names, index: str = "i", score: str = "score") -> DataFrame:
    """Sum of the scopes' scores over the root of their number, per frame."""
    return scores.groupBy(*_list(key), index).agg((F.sum(F.coalesce(score, F.lit(0.0))) / F.sqrt(F.count(F.lit(1)))).alias("joint"))


def and_policy(peaks: DataFrame, key: Names, threshold: float, spread: int = 8) -> DataFrame:
    """Whether all scopes peak at the threshold or over, within ``spread`` frames."""
    agg = peaks.groupBy(*_list(key)).agg(F.min("peak").alias("least"), (F.max("frame") - F.min("frame")).alias("spread"), F.bool_and(F.col("peak").isNotNull()).alias("_all"))
    return agg.withColumn("detected", F.col("_all") & (F.col("least") >= threshold) & (F.col("spread") <= spread)).drop("_all")


#: Bytes of templates that are sent to every task; templates and windows whose distances are bounded at once.
BANK_BYTES, AT_ONCE, WINDOWS = 64 << 20, 4096, 24


class TemplateBank:
    """Templates of equal lengths as matrices, and in whole steps of their range, a row for each sample."""

    def __init__(self, ids: list, curves: list[np.ndarray]):
        self.sizes: dict[int, tuple[list, np.ndarray, np.ndarray, float, float]] = {}
        for n in sorted({len(c) for c in curves} - {0}):
            own = sorted((i, k) for k, (i, c) in enumerate(zip(ids, curves, strict=True)) if len(c) == n)
            matrix = np.array([curves[k] for _, k in own], float)
            known = matrix[np.isfinite(matrix)]
            low, high = (float(known.min()), float(known.max())) if len(known) else (0.0, 0.0)
            # Sums of n differences must fit the type.
            kind = np.int16 if n <= 1024 else np.int32
            step = (high - low) / min(2047, np.iinfo(kind).max // n) or 1.0
            self.sizes[n] = ([i for i, _ in own], matrix, np.ascontiguousarray(self.steps(matrix, low, high, step).astype(kind).T), low, step)

    @staticmethod
    def steps(x: np.ndarray, low: float, high: float, step: float) -> np.ndarray:
        return np.rint((np.clip(np.nan_to_num(x), low, high) - low) / step)

    def best(self, flux: np.ndarray, center: int, median: float, first: int, last: int, gain: float) -> tuple[tuple | None, int]:
        """((chi, id, offset), samples compared): the nearest template of one event."""
        return self.best_of([(flux, center, median)], first, last, gain)[0]

    def best_of(self, events: list[tuple[np.ndarray, int, float]], first: int, last: int, gain: float) -> list[tuple[tuple | None, int]]:
        """For each event (flux, center, median) ((chi, id, offset), samples
        compared): the nearest template, the lower id and offset on ties (to
        nine decimals); distances that are no numbers are the farthest.

        Templates and windows are rounded to whole steps of the templates' range
        and their differences summed as small integers. The sum, less a step for
        each sample, over the window's largest error bounds the distance from
        below. Templates whose bound is over the best distance found so far are
        never laid on the event.
        """
        found: list[tuple | None] = [None] * len(events)
        compared = np.zeros(len(events), np.int64)
        least = np.full(len(events), np.inf)
        noises = []
        for flux, _, median in events:
            noise = np.sqrt(np.abs(flux) / median / gain) * gain
            noise[noise == 0] = 0.01
            noises.append(noise)
        for size, bank in self.sizes.items():
            places = [(e, o, c + o - size // 2) for e, (f, c, _) in enumerate(events) for o in range(first, last + 1) if 0 <= c + o - size // 2 <= len(f) - size]
            for k in range(0, len(places), WINDOWS):
                some = places[k : k + WINDOWS]
                windows = np.array([events[e][0][at : at + size] for e, _, at in some], float)
                errors = np.array([noises[e][at : at + size] for e, _, at in some])
                self._lay(bank, windows, errors, np.array([e for e, _, _ in some]), np.array([o for _, o, _ in some]), least, found, compared)
        return [(f and f[1:], int(n)) for f, n in zip(found, compared, strict=True)]

    def _lay(self, bank: tuple, windows: np.ndarray, errors: np.ndarray, event: np.ndarray, offset: np.ndarray, least: np.ndarray, found: list[tuple | None], compared: np.ndarray) -> None:
        """Hold some windows against all templates of their length."""
        ids, matrix, codes, low, step = bank
        size, count = codes.shape
        high = low + step * int(codes.max(initial=0))
        own = self.steps(windows, low, high, step).astype(codes.dtype)
        # A window that is no number everywhere is compared with all.
        unit = np.where(np.isfinite(windows).all(axis=1) & (errors > 0).all(axis=1) & np.isfinite(errors).all(axis=1), step / errors.max(axis=1), 0.0) * (1 - 1e-9)

        def take(rows: np.ndarray, at: np.ndarray) -> None:
            for k in range(0, len(rows), 1 << 16):
                r, t = rows[k : k + (1 << 16)], at[k : k + (1 << 16)]
                with np.errstate(invalid="ignore"):
                    chi = (np.abs(windows[r] - matrix[t]) / errors[r]).sum(axis=1)
                e = event[r]
                np.add.at(compared, e, size)
                ties = np.where(np.isnan(chi), np.inf, np.round(chi, 9))
                order = np.lexsort((offset[r], t, np.isnan(chi), ties, e))
                for w in order[np.unique(e[order], return_index=True)[1]].tolist():
                    # Rounded distance, whether it is no number; what is found.
                    one = ((float(ties[w]), bool(np.isnan(chi[w])), ids[int(t[w])], int(offset[r[w]])), float(chi[w]), ids[int(t[w])], int(offset[r[w]]))
                    was = found[e[w]]
                    if was is None or one[0] < was[0]:
                        found[e[w]] = one
                    least[e[w]] = found[e[w]][0][0]

        sums = np.empty((len(windows), min(AT_ONCE, count)), codes.dtype)
        gaps = np.empty_like(sums)
        for start in range(0, count, AT_ONCE):
            part = codes[:, start : start + AT_ONCE]
            total, gap = sums[:, : part.shape[1]], gaps[:, : part.shape[1]]
            total[:] = 0
            for j in range(size):
                np.subtract(part[j], own[:, j, None], out=gap)
                np.abs(gap, out=gap)
                np.add(total, gap, out=total)
            if start == 0:
                # The most promising template of each window first.
                take(np.arange(len(windows)), total.argmin(axis=1))
            with np.errstate(divide="ignore", invalid="ignore"):
                most = np.where((unit > 0) & np.isfinite(least[event]), np.floor((least[event] + 1e-8) / unit) + size, np.inf)
            at = np.flatnonzero(total <= np.minimum(most, np.iinfo(codes.dtype).max).astype(codes.dtype)[:, None])
            if len(at):
                take(*np.divmod(at, part.shape[1])) if start == 0 else take(at // part.shape[1], at % part.shape[1] + start)


def kernel_match(events: DataFrame, kernels: DataFrame, first: int = -3, last: int = 2, gain: float = 0.82, bank_bytes: int = BANK_BYTES) -> DataFrame:
    """The best template of each event: (event_id, kernel_id, offset, chi, compared).

    ``events``: event_id, center, flux (array, normalised), median;
    ``kernels``: kernel_id, curve. A template is laid on the flux from
    center + offset less half its length; its distance is the sum of absolute
    differences over Poisson-like errors; ``compared`` counts the samples that
    were compared for it, once bounds had ruled most templates out. Ties (to
    nine decimals) go to the lower kernel and offset. A bank of at most ``bank_bytes`` is broadcast;
    a larger one is cut into blocks of that size, and events and blocks meet in
    a grid of tasks, each with some events and one block, of which the least
    distances are taken. Events that no template fits into, and null arrays or
    ones with nulls, have no row.
    """
    spark = events.sparkSession
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    kinds = {"event_id": events.schema["event_id"].dataType.simpleString(), "kernel_id": kernels.schema["kernel_id"].dataType.simpleString()}
    schema = f"event_id {kinds['event_id']}, kernel_id {kinds['kernel_id']}, offset int, chi double, compared long"
    asked = events.where(whole("flux")).select("event_id", "center", F.col("flux").cast("array<double>").alias("flux"), F.col("median").cast("double").alias("median"))
    bank = kernels.where(whole("curve")).select("kernel_id", F.col("curve").cast("array<double>").alias("curve"))
    size = (bank.agg(F.sum(F.size("curve"))).collect()[0][0] or 0) * 8
    names = ["event_id", "kernel_id", "offset", "chi", "compared"]

    def matched(pdf: pd.DataFrame, held: TemplateBank) -> pd.DataFrame:
        laid = [(np.asarray(f, float), int(c), m) for f, c, m in zip(pdf["flux"], pdf["center"], pdf["median"], strict=True)]
        rows = []
        for k in range(0, len(laid), WINDOWS):
            for event, (found, compared) in zip(pdf["event_id"].iloc[k : k + WINDOWS], held.best_of(laid[k : k + WINDOWS], first, last, gain), strict=True):
                if found:
                    rows.append((event, found[1], found[2], found[0], compared))
        return pd.DataFrame(rows, columns=names)

    if size <= bank_bytes:
        rows = bank.toArrow()
        shared = spark.sparkContext.broadcast((rows.column("kernel_id").to_pylist(), [np.array(c, float) for c in rows.column("curve").to_pylist()]))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = TemplateBank(*shared.value)
            for pdf in batches:
                yield matched(pdf, held)

        return asked.mapInPandas(run, schema)

    # The bank is sent once for each part of the events: as few as give every core work and fit into memory.
    blocks, asking = -(-size // bank_bytes), (asked.agg(F.sum(F.size("flux"))).collect()[0][0] or 0) * 8
    parts = max(1, -(-3 * spark.sparkContext.defaultParallelism // blocks), -(-asking // (64 << 20)))
    left = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("event_id"), F.lit(parts)).alias("part"))
    right = bank.select("*", F.pmod(F.xxhash64("kernel_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part"))
    found = met.applyInPandas(lambda e, k: matched(e, TemplateBank(k["kernel_id"].tolist(), [np.asarray(c, float) for c in k["curve"]])), schema)
    best = found.groupBy("event_id").agg(F.min(F.struct(F.round("chi", 9).alias("ties"), "kernel_id", "offset", "chi")).alias("m"), F.sum("compared").alias("compared"))
    return best.select("event_id", F.col("m.kernel_id").alias("kernel_id"), F.col("m.offset").alias("offset"), F.col("m.chi").alias("chi"), "compared")


def inject(df: DataFrame, key: Names, value: str, centers: DataFrame, profile: DataFrame, index: str = "i", out: str = "injected") -> DataFrame:
    """Multiply the profile (offset, factor) into each series around its center;
    samples beyond it keep their value."""
    at = df.join(centers, _list(key), "left").withColumn("offset", (F.col(index) - F.col("center")).cast("int"))
    return at.join(F.broadcast(profile), "offset", "left").withColumn(out, F.col(value) * F.coalesce("factor", F.lit(1.0))).drop("offset", "factor", "center")
