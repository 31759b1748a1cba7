"""Readers of detection texts, summaries, weather, logs, kernels and frames.

They parse whole files with built-in functions; nothing is opened on the
driver, so any file system that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicurve.functions.text import key_time, little_endian, log_time, minute_key, unpack12

# The columns of a weather log.
WEATHER = "unix_time double, temp double, humidity double, wind_speed double, wind_direction double, rain_value double, sky_temp double, ground_temp double, alert double, polaris_mag double"

# Names in the header of a detection file, and the columns they become.
HEADER = {
    "Event File": "event_file",
    "Star Coords": "star_coords",
    "RA Dec Coords": "radec",
    "DATE-OBS": "date_obs",
    "Telescope": "scope",
    "Field": "field",
    "significance": "significance",
    "Raw lightcurve std": "raw_std",
    "Raw lightcurve mean": "raw_mean",
    "Convolution background std": "conv_bkg_std",
    "Convolution background mean": "conv_bkg_mean",
    "Convolution minimal value": "conv_min",
}
_NUMBERS = ("significance", "raw_std", "raw_mean", "conv_bkg_std", "conv_bkg_mean", "conv_min")


def whole_texts(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(path, text) of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.decode("content", encoding).alias("text"))


def detection_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per detection file: det_id (the file's name) and its header.

    Values are read by their names, not their line numbers. What is missing or
    no number (as in artificial files) is null.
    """
    t = whole_texts(spark, path)
    find = lambda name: F.nullif(F.trim(F.regexp_extract("text", rf"(?m)^#\s*{name}:\s*(.*?)\s*$", 1)), F.lit(""))
    raw = t.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("det_id"), *[find(n).alias(c) for n, c in HEADER.items()])
    part = lambda c, k: F.try_element_at(F.split(c, r"\s+"), F.lit(k)).try_cast("double")
    raw = raw.withColumn("star_x", part("star_coords", 1)).withColumn("star_y", part("star_coords", 2)).withColumn("ra_deg", part("radec", 1)).withColumn("dec_deg", part("radec", 2))
    raw = raw.withColumn("is_artificial", F.coalesce(F.upper("significance").startswith("ARTIFIC"), F.lit(False)))
    for c in _NUMBERS:
        raw = raw.withColumn(c, F.col(c).try_cast("double"))
    stamp = F.to_timestamp_ntz(F.regexp_extract("date_obs", r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)", 1))
    good = F.when(F.col("date_obs").rlike(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), stamp)
    return raw.withColumn("date_obs", good).drop("star_coords", "radec")


def detection_samples(spark: SparkSession, path: str) -> DataFrame:
    """(det_id, frame, filename, seconds, flux, conv_flux) of detection files."""
    t = whole_texts(spark, path)
    lines = t.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("det_id"), F.posexplode(F.filter(F.split("text", r"\r?\n"), lambda x: ~F.ltrim(x).startswith("#") & (F.trim(x) != ""))).alias("frame", "line"))
    f = F.split(F.trim("line"), r"\s+")
    at = lambda k: F.try_element_at(f, F.lit(k))
    return lines.select("det_id", "frame", at(1).alias("filename"), *[at(k).try_cast("double").alias(n) for k, n in ((2, "seconds"), (3, "flux"), (4, "conv_flux"))])


def primary_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(minute_key, t, stars, detec); lines whose key is none are dropped."""
    t = spark.read.text(path, recursiveFileLookup=True).where(~F.ltrim("value").startswith("#"))
    f = F.split("value", r"\s*,\s*")
    out = t.select(minute_key(f[0]).alias("minute_key"), F.try_element_at(f, F.lit(2)).try_cast("int").alias("stars"), F.try_element_at(f, F.lit(3)).try_cast("int").alias("detec"))
    return out.withColumn("t", key_time(F.col("minute_key"))).where("t IS NOT NULL")


def weather(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of all the logs; malformed lines are dropped."""
    return spark.read.csv(list(paths), schema=WEATHER, mode="DROPMALFORMED")


def weather_in_order(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of all the logs by time."""
    return weather(spark, *paths).orderBy("unix_time")


def weather_log(spark: SparkSession, folder: str, date: str, today: str) -> str | None:
    """The log of a night (both dates as YYYYMMDD): the one that is being written
    for today, else the one that carries the date; None if there is none."""
    if date == today:
        return f"{folder}/weather.log"
    path = f"{folder}/weather.log.{date[:4]}-{date[4:6]}-{date[6:]}"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there) else None


def observatory_log(spark: SparkSession, path: str, patterns: list[str] | None = None) -> DataFrame:
    """(path, line_no, t, line) of UTF-16 logs, only lines with one of the patterns."""
    t = whole_texts(spark, path, "UTF-16")
    lines = t.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line")).where("line <> ''")
    if patterns:
        any_of: Column = F.lit(False)
        for p in patterns:
            any_of = any_of | F.contains("line", F.lit(p))
        lines = lines.where(any_of)
    return lines.withColumn("t", log_time(F.col("line")))


def sun_times(log: DataFrame, by: str = "path") -> DataFrame:
    """(path, sunset, sunrise): the last Julian dates that a log gives, null where it gives none."""
    jd = lambda what: F.regexp_extract("line", rf"INFO: {what} JD: ([0-9.]+)", 1).try_cast("double")
    last = lambda what: F.max(F.when(jd(what).isNotNull(), F.struct("line_no", jd(what).alias("jd"))))["jd"]
    return log.groupBy(by).agg(last("Sunset").alias("sunset"), last("Sunrise").alias("sunrise"))


def fields_observed(log: DataFrame) -> DataFrame:
    """(path, t, field) of lines that name a field and are not too late."""
    kept = log.where(F.contains("line", F.lit("INFO: Field Name: ")) & ~F.contains("line", F.lit("TooLate")))
    return kept.select("path", "t", F.regexp_extract("line", r"INFO: Field Name: \D*(\d+)", 1).try_cast("int").alias("field"))


def observing_plan(log: DataFrame) -> DataFrame:
    """Distinct (path, field, at, stars) of lines that start a field, by the
    places of their words (7, 9 and 16, from 0)."""
    w = F.split("line", " ")
    at = lambda k: F.try_element_at(w, F.lit(k + 1))
    return log.where(F.contains("line", F.lit("starts"))).select("path", at(7).alias("field"), at(9).try_cast("double").alias("at"), at(16).try_cast("int").alias("stars")).distinct()


def kernel_bank(spark: SparkSession, path: str, stride: int = 1, less: float = 0.0) -> DataFrame:
    """(kernel_id, curve) of text rows: every ``stride``-th one, cut to the
    shortest row's length, less a constant."""
    t = whole_texts(spark, path)
    rows = t.select(F.posexplode(F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != "")).alias("kernel_id", "line")).where(F.col("kernel_id") % stride == 0)
    rows = rows.select("kernel_id", F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double") - less).alias("curve"))
    return rows.join(F.broadcast(rows.agg(F.min(F.size("curve")).alias("_n")))).select("kernel_id", F.slice("curve", F.lit(1), F.col("_n")).alias("curve"))


# Where a raw frame's pixels and its control byte are.
RCD_PIXELS, RCD_CONTROL = 384, 140


def raw_frames(spark: SparkSession, path: str, locked_only: bool = False) -> DataFrame:
    """(path, modified, serial, sensor_temp, base_temp, fpga_temp, date_obs,
    gps_lock, pixels) of raw frames; pixels stay packed, in one binary cell."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = lambda at, n: F.regexp_replace(F.decode(F.substring("content", at + 1, n), "US-ASCII"), r"[\x00 ]+$", "")
    out = f.select(
        "path",
        F.col("modificationTime").alias("modified"),
        text(63, 9).alias("serial"),
        little_endian(F.col("content"), 91, 2).alias("sensor_temp"),
        little_endian(F.col("content"), 141, 2).alias("base_temp"),
        little_endian(F.col("content"), 143, 2).alias("fpga_temp"),
        text(152, 29).alias("date_obs"),
        (little_endian(F.col("content"), RCD_CONTROL, 1) == 96).alias("gps_lock"),
        F.substring("content", RCD_PIXELS + 1, 2**31 - 1).alias("pixels"),
    )
    return out.where("gps_lock") if locked_only else out


def gain_image(frames: DataFrame, width: int, gain: str = "low", out: str = "image") -> DataFrame:
    """Decoded pixels of one gain: rows of the frame alternate, even ones low
    and odd ones high gain. Made with built-in functions; whole frames are
    better decoded by ``decode_frames``."""
    rows = unpack12(F.col("pixels"))
    wanted = 0 if gain == "low" else 1
    return frames.withColumn(out, F.filter(rows, lambda v, i: F.floor(i / width) % 2 == wanted))


def decode_frames(frames: DataFrame, width: int, gain: str = "low") -> DataFrame:
    """(path, image): pixels of one gain as an array<int> a frame, in numpy."""
    wanted = 0 if gain == "low" else 1

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            images = []
            for cell in b.column("pixels").to_pylist():
                d = np.frombuffer(cell[: len(cell) // 3 * 3], np.uint8).astype(np.uint16).reshape(-1, 3)
                px = np.column_stack([(d[:, 0] << 4) | (d[:, 1] >> 4), ((d[:, 1] & 15) << 8) | d[:, 2]]).reshape(-1, width)
                images.append(px[wanted::2].reshape(-1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(images, pa.list_(pa.int32()))], names=["path", "image"])

    return frames.select("path", "pixels").mapInArrow(run, "path string, image array<int>")


def samples_from_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, star, x, y, flux, t) of _stars.npy arrays, frames x stars x 4,
    as numpy writes them; one file is one task's work, in batches of frames."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_stars.npy").load(path).select("path", "content")

    def run(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cube = np.load(io.BytesIO(content), allow_pickle=False)
                stars = cube.shape[1]
                for a in range(0, len(cube), max(1, 100_000 // max(1, stars))):
                    part = cube[a : a + max(1, 100_000 // max(1, stars))]
                    n = len(part) * stars
                    flat = part.reshape(n, -1)
                    cols = [pa.array([name] * n), pa.array(np.repeat(np.arange(a, a + len(part)), stars).astype(np.int32)), pa.array(np.tile(np.arange(stars), len(part)).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*cols, *(pa.array(flat[:, k].astype(float)) for k in range(4))], names=["path", "frame", "star", "x", "y", "flux", "t"])

    return files.mapInArrow(run, "path string, frame int, star int, x double, y double, flux double, t double")


def minutes(spark: SparkSession, path: str) -> DataFrame:
    """(minute_key, t, stars_path, pos_path): files of samples, with those of
    positions of the same key; keys that are no times come last."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    named = f.withColumn("minute_key", minute_key(F.regexp_extract("path", r"([^/]+)$", 1)))
    s = named.where(F.col("path").endswith("_stars.npy")).groupBy("minute_key").agg(F.min("path").alias("stars_path"))
    p = named.where(F.col("path").rlike(r"sig_pos\.npy$")).groupBy("minute_key").agg(F.min("path").alias("pos_path"))
    return s.join(p, "minute_key", "left").withColumn("t", key_time(F.col("minute_key"))).orderBy(F.asc_nulls_last("t"), "minute_key")
