"""A telescope's minutes from frames to light curves and dips.

Frames are rows (minute, frame, t, pixels, height, width). Minutes are
independent: what one step finds out about a minute (its stars, its drift) is
one or some hundred rows, joined to its frames by the minute.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumicurve.functions.text import key_time, minute_key, repaired_hour
from lumicurve.operators import detect, images, rollup, series
from lumicurve.operators.bandjoin import asof_nearest
from lumicurve.operators.images import subtract_dark
from lumicurve.operators.reports import aperture_sigma
from lumicurve.operators.robust import edge_mask
from lumicurve.session import materialise
from lumicurve.sources.frame_source import frame_bands


@dataclass(frozen=True)
class Settings:
    """Parameters of a reduction, as the telescopes use them."""

    threshold: float = 4.0  # deviations of the background that a star stands out by
    stack: int = 9  # frames of the stack that stars are found in
    edge: float = 10.0  # pixels from the border
    fewest_stars: int = 10
    radius: float = 3.0
    most_drift: float = 1.0  # pixels per second
    significance: float = 5.0
    box: int = 64
    detrend_width: int = 200
    kernel_width: float = 6.0
    taps: int = 49
    annulus: tuple[float, float] | None = None  # radii of the ring whose background is taken off


def frame_slice(frames: DataFrame, by: str, order: str, first: int, n: int) -> DataFrame:
    """Frames ``first`` to ``first + n - 1`` of each ``by``, in order, numbered from 0."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    kept = frames.withColumn("frame", (k - first).cast("long"))
    return kept.where((F.col("frame") >= 0) & (F.col("frame") < n))


def with_seconds(frames: DataFrame, date_obs: str = "date_obs") -> DataFrame:
    """Add t, unix seconds of an ISO time whose hour may be over 23."""
    return frames.withColumn("t", F.unix_micros(repaired_hour(F.col(date_obs)).try_cast("timestamp")) / 1e6)


def hour_of_folder(iso: Column, folder_hour: Column, folder_minute: Column) -> Column:
    """An ISO time with the hour of its folder, one more where the minute has
    gone round since the folder was made."""
    minute = F.regexp_extract(iso, r"T\d{2}:(\d{2})", 1).try_cast("int")
    hour = F.pmod(folder_hour + F.when(minute < folder_minute, 1).otherwise(0), F.lit(24))
    return F.regexp_replace(iso, r"T\d{2}", F.format_string("T%02d", hour))


def master_darks(darks: DataFrame, folder: str, order: str, n: int) -> DataFrame:
    """(folder, dark): the median of the first ``n`` frames of each folder of darks."""
    return rollup.median_images(rollup.first_frames(darks, folder, order, n), folder, out="dark")


def stacked(frames: DataFrame, n: int, by: str = "minute", order: str = "frame") -> DataFrame:
    """(by, pixels, height, width): the median image of each ``by``'s first frames."""
    first = frames.where(F.col(order) < n)
    pixels = rollup.median_images(first, by)
    return pixels.join(first.groupBy(by).agg(F.first("height").alias("height"), F.first("width").alias("width")), by)


def near_border(x: Column, y: Column, width: Column | int, height: Column | int, margin: float = 20.0, inclusive: bool = False) -> Column:
    """Whether a place is within ``margin`` of the border."""
    if inclusive:
        return (x <= margin) | (x >= width - margin) | (y <= margin) | (y >= height - margin)
    return (x < margin) | (x > width - margin) | (y < margin) | (y > height - margin)


def field_stars(frames: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(minute, star, x, y, r) of each minute's stack, away from the border;
    minutes with under ``fewest_stars`` have none."""
    stack = stacked(frames, s.stack)
    found = images.find_stars(stack, "minute", s.threshold, box=s.box).join(stack.select("minute", "height", "width"), "minute")
    kept = found.where(edge_mask(F.col("x"), F.col("y"), F.col("width"), F.col("height"), s.edge))
    return kept.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("minute"))).where(F.col("_n") >= s.fewest_stars).select("minute", "star", "x", "y", "r")


def field_drift(frames: DataFrame, stars: DataFrame) -> DataFrame:
    """(minute, t0, vx, vy): how a minute's stars move from its first to its last
    frame, the median over the stars, after their places are refined in both."""
    ends = frames.groupBy("minute").agg(F.min("frame").alias("_a"), F.max("frame").alias("_b"))
    both = frames.join(ends, "minute").where((F.col("frame") == F.col("_a")) | (F.col("frame") == F.col("_b")))
    # The window is that of the minute's own stars, whatever else is reduced with it.
    wide = images.with_stars(both, stars, "minute").join(aperture_sigma(stars, "minute"), "minute").withColumn("sigma", F.coalesce("sigma", F.lit(1.0)))
    seen = images.refined(wide, ["minute", "frame", "t"], "sigma").join(ends, "minute")
    first, last = (seen.where(F.col("frame") == F.col(c)).select("minute", "star", "x", "y", "t") for c in ("_a", "_b"))
    return images.median_drift(first, last, "minute", "t").join(first.groupBy("minute").agg(F.min("t").alias("t0")), "minute")


def minute_status(frames: DataFrame, stars: DataFrame, drift: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(minute, frames, stars, status): why a minute is not searched, or ok."""
    n = frames.groupBy("minute").agg(F.count(F.lit(1)).alias("frames"))
    found = stars.groupBy("minute").agg(F.count(F.lit(1)).alias("stars"))
    both = n.join(found, "minute", "left").join(drift, "minute", "left")
    status = F.when(F.col("stars").isNull(), "too few stars").when(F.col("frames") < 3 * s.taps, "too few frames")
    status = status.when(F.greatest(F.abs("vx"), F.abs("vy")) > s.most_drift, "tracking failed").otherwise("ok")
    return both.select("minute", "frames", F.coalesce("stars", F.lit(0).cast("long")).alias("stars"), status.alias("status"))


def light_curves(frames: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(minute, frame, t, star, x, y, flux, mag) of all minutes that can be
    searched, and the status of every minute.

    Stars come from a stack of the first frames; their apertures then drift at
    the minute's median rate.
    """
    stars = materialise(field_stars(frames, s), "field-stars")
    drift = materialise(field_drift(frames, stars), "field-drift")
    status = minute_status(frames, stars, drift, s)
    good = frames.join(status.where("status = 'ok'").select("minute"), "minute", "left_semi")
    return images.drifting_photometry(good, stars, drift, ["minute", "frame"], "minute", radius=s.radius, annulus=s.annulus), status


def search_minutes(frames: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """The significant dips of all minutes' stars (see ``dip_detection``), and
    the status of every minute."""
    curves, status = light_curves(frames, s)
    found = detect.dip_detection(curves, ["minute", "star"], "frame", "flux", s.detrend_width, s.kernel_width, s.taps, threshold=s.significance)
    return found.where("detected"), status


def time_of_day_pairs(left: DataFrame, right: DataFrame, seconds: float, left_time: str, right_time: str) -> DataFrame:
    """Pairs whose times of day (of unix seconds) differ by less than some
    seconds, whatever their dates, also across midnight."""
    from lumicurve.operators.bandjoin import band_join

    a = left.withColumn("_day_a", F.pmod(F.col(left_time), F.lit(86400.0)))
    day = F.pmod(F.col(right_time), F.lit(86400.0))
    around = F.array_compact(F.array(day, F.when(day < seconds, day + 86400.0), F.when(day > 86400.0 - seconds, day - 86400.0)))
    b = right.withColumn("_day_b", F.explode(around))
    return band_join(a, b, "_day_a", "_day_b", seconds, strict=True).drop("_day_a", "_day_b")


def common_minutes(minutes: DataFrame, spacing: float = 60.0, lead: str = "green", others: tuple[str, ...] = ("red", "blue")) -> DataFrame:
    """(minute_id, t, stars, one column per other scope, scopes): the leading
    scope's minutes with the earliest minute of each other scope within the
    spacing, null without one; most scopes first, then most stars. The first row
    is the minute to take, with the scopes that have it."""
    from lumicurve.operators.bandjoin import band_join, best_match

    best = minutes.where(F.col("scope") == lead).select("minute_id", "t", "stars")
    own = best.select(F.col("minute_id"), F.col("t").alias("_t"))
    for scope in others:
        o = minutes.where(F.col("scope") == scope).select(F.col("minute_id").alias(scope), F.col("t").alias("_o"))
        near = best_match(band_join(own, o, "_t", "_o", spacing, strict=True), "minute_id", [F.col("_o"), F.col(scope)])
        best = best.join(near.select("minute_id", scope), "minute_id", "left")
    scopes = sum((F.col(c).isNotNull().cast("int") for c in others), F.lit(1))
    return best.withColumn("scopes", scopes).orderBy(F.desc("scopes"), F.desc("stars"), "t", "minute_id")


def events_by_series(curves: DataFrame, events: DataFrame) -> DataFrame:
    """Cutouts of 40 frames before to 39 behind each event (minute, star, frame)."""
    e = events.select("minute", "star", F.col("frame").alias("event_frame"))
    return series.cutout(curves, e, ["minute", "star"], "frame", "event_frame")


def folder_frames(spark: SparkSession, path: str, gain: str = "low") -> DataFrame:
    """(folder, minute, start, frame, t, pixels, height, width) of the raw frames
    below a folder: frames numbered by name in each minute's folder, their hour
    that of the folder, t in unix seconds. A folder whose name is no minute key
    gives none. Numbers come from the headers alone, so no pixels are sorted."""
    order = Window.partitionBy("folder").orderBy("name")
    numbers = frame_bands(spark, path, headersOnly="true").select("folder", "name", (F.row_number().over(order) - 1).cast("long").alias("frame"))
    whole = frame_bands(spark, path, bandRows=1 << 20).withColumn("minute", minute_key(F.col("folder"))).where("minute IS NOT NULL")
    start = key_time(F.col("minute"))
    iso = hour_of_folder(F.col("date_obs"), F.hour(start), F.minute(start))
    timed = with_seconds(whole.withColumn("date_obs", iso)).withColumn("start", F.unix_micros(start) / 1e6)
    return timed.join(numbers, ["folder", "name"]).select("folder", "minute", "start", "frame", "t", F.col(gain).alias("pixels"), "height", "width")


def with_nearest_dark(frames: DataFrame, darks: DataFrame, n: int = 10) -> DataFrame:
    """The frames less the median of the first ``n`` frames of the folder of darks
    whose time is nearest to their minute's, the earlier one on ties; as they are
    if there are no darks. Both as ``folder_frames`` gives them."""
    master = materialise(master_darks(darks, "folder", "frame", n), "darks")
    times = darks.select(F.col("folder").alias("dark_folder"), F.col("start").alias("dark_start")).distinct()
    minutes = frames.select("minute", "start").distinct()
    near = asof_nearest(minutes, times, "minute", "start", "dark_start", ["dark_folder"]).select("minute", "dark_folder")
    return subtract_dark(frames.join(near, "minute", "left"), master.withColumnRenamed("folder", "dark_folder"), "dark_folder").drop("dark_folder")


def search_folders(spark: SparkSession, path: str, darks: str | None = None, s: Settings = Settings(), n_darks: int = 10, gain: str = "low") -> tuple[DataFrame, DataFrame]:
    """``search_minutes`` from raw files: the minute folders below ``path``, their
    frames' hours repaired, less the nearest of the darks below ``darks``."""
    frames = folder_frames(spark, path, gain)
    if darks is not None:
        frames = with_nearest_dark(frames, folder_frames(spark, darks, gain), n_darks)
    frames = frames.select("minute", "frame", "t", F.col("pixels").cast("array<double>").alias("pixels"), "height", "width")
    return search_minutes(frames, s)
