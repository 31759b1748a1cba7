"""Streaming forms of the operators, for near-real-time use."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumicurve.operators.match import KnownStars, follow_minutes
from lumicurve.operators.series import ricker


def new_minutes(minutes: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each minute once, however often it is listed."""
    return minutes.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def coincident_pairs(left: DataFrame, right: DataFrame, seconds: float, late: str = "1 minute") -> DataFrame:
    """Pairs of two streams (a, a_t; b, b_t) within some seconds of each other.

    A bucket of time, repeated for its neighbours on one side, gives the
    equality that a stream join needs; watermarks bound the state.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1e6))
    a = left.withWatermark("a_t", late).withColumn("bucket", bucket("a_t"))
    b = right.withWatermark("b_t", late).withColumn("b_bucket", F.explode(F.sequence(bucket("b_t") - 1, bucket("b_t") + 1)))
    near = F.expr(f"a_t BETWEEN b_t - INTERVAL {seconds} SECONDS AND b_t + INTERVAL {seconds} SECONDS")
    return a.join(b, (F.col("bucket") == F.col("b_bucket")) & near).drop("bucket", "b_bucket")


def sessions(samples: DataFrame, key: str, time: str, gap: str = "37500 microseconds", late: str = "1 minute") -> DataFrame:
    """(key, start, end, n): stretches without a gap; a step of exactly the gap does not break one."""
    s = samples.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def binned(samples: DataFrame, key: str, time: str, value: str, width: str, late: str = "1 minute") -> DataFrame:
    """Means in bins that begin at multiples of the width."""
    b = samples.withWatermark(time, late).groupBy(key, F.window(time, width).alias("w")).agg(F.avg(value).alias("value"), F.count(value).alias("n"))
    return b.select(key, F.col("w.start").alias("start"), "value", "n")


def scored_run(frames: np.ndarray, values: np.ndarray, width: int, kernel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and scores of those samples of an unbroken run whose windows it
    holds: values less their running mean of ``width``, convolved. Missing
    values (NaN) count in neither; a window without any gives NaN."""
    if len(values) < width + len(kernel) - 1:
        return frames[:0], values[:0]
    known = ~np.isnan(values)
    n = np.correlate(known.astype(float), np.ones(width), "valid")
    trend = np.correlate(np.where(known, values, 0.0), np.ones(width), "valid") / np.maximum(n, 1)
    own = slice(width // 2, width // 2 + len(trend))
    there = known[own]
    score = np.correlate(np.where(there, values[own] - trend, 0.0), kernel, "valid")
    if not there.all():
        score[np.correlate(there.astype(float), np.ones(len(kernel)), "valid") < 0.5] = np.nan
    first = width // 2 + len(kernel) // 2
    return frames[first : first + len(score)], score


def edges_of(n: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of n samples others may need, as many as ``reach`` at both ends, and
    which of those come behind a gap."""
    if n <= 2 * reach:
        return np.arange(n), np.zeros(n, bool)
    at = np.concatenate([np.arange(reach), np.arange(n - reach, n)])
    return at, at == n - reach


def dip_scores(samples: DataFrame, key: str, value: str = "flux", order: str = "frame", detrend_width: int = 200, kernel_width: float = 6.0, taps: int = 49, idle: str | None = None, stretch: int = 65_536) -> DataFrame:
    """(key, frame, score): detrended and convolved samples as they come. With
    ``idle`` (such as "10 minutes") a key without new samples for so long is
    forgotten, so that the state holds only series that still grow.

    What a batch has of a key is dealt out by spans of ``stretch`` frames (some
    thousands of samples each). A span gives the scores that it has all samples
    for; of the others only the samples at its ends go on to the key, which
    gives the scores across the edges of spans and batches. The key's state is
    the stretch of samples that scores still to come need: half a running mean
    and half a kernel on both sides. A sample's score is given once all samples
    it depends on are there; frames arrive in order.
    """
    kernel = np.array(ricker(kernel_width, taps))
    reach = detrend_width + taps - 2
    kind = samples.schema[key].dataType.simpleString()

    def in_order(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        frames, first = np.unique(pdf[order].to_numpy(np.int64), return_index=True)
        return frames, pdf[value].to_numpy(float)[first]

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        f, v = in_order(pdf)
        f, score = scored_run(f, v, detrend_width, kernel) if len(v) > 2 * reach else (f[:0], v[:0])
        return pd.DataFrame({key: pdf[key].iloc[0], "frame": f, "score": score})

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        f, v = in_order(pdf)
        at, gap = edges_of(len(v), reach)
        return pd.DataFrame({key: pdf[key].iloc[0], "f": f[at], "v": v[at], "gap": gap})

    def across(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = [np.array(x, t) for x, t in zip(state.get if state.exists else ([], []), (np.int64, float), strict=True)]
        come = [(b["f"].to_numpy(np.int64), b["v"].to_numpy(float), b["gap"].to_numpy(bool)) for b in batches]
        f, v, gap = (np.concatenate(c) for c in zip((*held, np.zeros(len(held[0]), bool)), *come, strict=True))
        row = np.argsort(f, kind="stable")
        f, first = np.unique(f[row], return_index=True)
        v, gap = v[row][first], np.logical_or.reduceat(gap[row], first)
        breaks = np.flatnonzero(gap)
        runs = list(zip(np.split(f, breaks), np.split(v, breaks), strict=True))
        done = [scored_run(*run, detrend_width, kernel) for run in runs]
        state.update(tuple(x[-reach:].tolist() for x in runs[-1]))
        if idle:
            state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))
        frames, scores = (np.concatenate(c) for c in zip(*done, strict=True))
        if len(frames):
            yield pd.DataFrame({key: k[0], "frame": frames, "score": scores})

    spans = samples.select(key, order, value).groupBy(key, F.floor(F.col(order) / stretch).alias("_span"))
    out = f"`{key}` {kind}, frame long, score double"
    edges = spans.applyInPandas(ends, f"`{key}` {kind}, f long, v double, gap boolean").groupBy(key)
    seams = edges.applyInPandasWithState(across, out, "f array<long>, v array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
    return spans.applyInPandas(inside, out).union(seams)


class _FollowedStars(StatefulProcessor):
    """What a night knows of its stars, an entry for each: only those that a
    batch has seen are written back."""

    SUMS = ["x", "y", "ra", "dec", "seen", "seen_sky"]

    def __init__(self, night: str, tolerance: float, sky_tolerance: float, idle_ms: int | None):
        self.night, self.tolerance, self.sky_tolerance, self.idle_ms = night, tolerance, sky_tolerance, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stars = handle.getMapState("stars", "star long", ", ".join(f"{c} double" for c in self.SUMS), ttlDurationMs=self.idle_ms)
        self.named = handle.getValueState("named", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = sorted((int(k[0]), tuple(v)) for k, v in self.stars.iterator())
        ids = np.array([k for k, _ in known], np.int64)
        sums = np.array([v for _, v in known], float).reshape(-1, 6)
        named = int(self.named.get()[0]) if self.named.exists() else 0
        state = KnownStars(sums[:, :4], sums[:, 4], sums[:, 5])
        pdf = pd.concat(list(rows)).sort_values(["minute", "local"])
        at = follow_minutes(pdf, state, self.sky_tolerance, self.tolerance)
        # Stars of this batch are numbered on from all that the night ever had.
        ids = np.concatenate([ids, named + np.arange(len(state.seen) - len(ids))])
        for k in np.unique(at).tolist():
            self.stars.updateValue((int(ids[k]),), (*map(float, state.place[k]), float(state.seen[k]), float(state.seen_sky[k])))
        fresh = len(state.seen) - len(known)
        if fresh:
            self.named.update((named + fresh,))
        yield pd.DataFrame({self.night: key[0], "minute": pdf["minute"].to_numpy(), "local": pdf["local"].to_numpy(), "star_id": ids[at]})


def followed_stars(stars: DataFrame, night: str, tolerance: float = 2.0, sky_tolerance: float = 2.0 / 3600, idle: str | None = None) -> DataFrame:
    """(night, minute, local, star_id): stars (night, minute, local, x, y, ra,
    dec) followed as their minutes come, as ``global_star_ids`` does in batch.
    Minutes of a night arrive in order. What a night knows is a map of its
    stars in state, of which a batch writes those it has seen; with ``idle``
    (such as "1 day") a star that was not seen for so long is forgotten.

    Sets the session's state store to RocksDB, which maps in state need.
    """
    stars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    kinds = ", ".join(f"`{c}` {stars.schema[c].dataType.simpleString()}" for c in (night, "minute", "local"))
    processor = _FollowedStars(night, tolerance, sky_tolerance, idle_ms)
    return stars.groupBy(night).transformWithStateInPandas(processor, f"{kinds}, star_id long", "append", "processingTime" if idle else "none")


def complete_nights(done: DataFrame, night: str, scope: str, time: str, scopes: int = 3, late: str = "1 hour") -> DataFrame:
    """(night): each night once all of its scopes have said they are done
    (night, scope, time), which is what a stage that needs them all waits for.
    A night is forgotten when the watermark has passed it."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        have, told = (set(state.get[0]), state.get[1]) if state.exists else (set(), False)
        for b in batches:
            have |= set(b[scope].dropna().astype(str))
        ready = len(have) >= scopes
        state.update((sorted(have), told or ready))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + int(pd.Timedelta(late).total_seconds() * 1000) + 1)
        if ready and not told:
            yield pd.DataFrame({night: [k[0]]})

    kind = done.schema[night].dataType.simpleString()
    return done.withWatermark(time, late).groupBy(night).applyInPandasWithState(step, f"`{night}` {kind}", "have array<string>, told boolean", "append", GroupStateTimeout.EventTimeTimeout)
