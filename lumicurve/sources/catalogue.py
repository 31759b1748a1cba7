"""Positions of stars, star catalogues, and tables kept in files.

Catalogues are local tables (ra, dec, gmag, ..): what a remote service would
filter is pushed down to the scan as ranges, then checked exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicurve.functions.text import key_time, minute_key
from lumicurve.operators.bandjoin import separation


def positions_from_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, minute_key, star, x, y, r, ra, dec) of position files as numpy
    writes them: stars x 3 columns, or x 5 where the field was solved."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_pos.npy").load(path).select("path", "content")

    def run(batches):
        import io

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = np.load(io.BytesIO(content), allow_pickle=False)
                wide = np.full((len(rows), 5), np.nan)
                wide[:, : min(5, rows.shape[1])] = rows[:, :5]
                yield pd.DataFrame({"path": name, "star": np.arange(len(rows)), **{c: wide[:, k] for k, c in enumerate(("x", "y", "r", "ra", "dec"))}})

    out = files.mapInPandas(run, "path string, star int, x double, y double, r double, ra double, dec double")
    null = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select("path", minute_key(F.regexp_extract("path", r"([^/]+)$", 1)).alias("minute_key"), "star", *[null(c) for c in ("x", "y", "r", "ra", "dec")])


def star_coordinates(samples: DataFrame, positions: DataFrame, minute: str = "minute_key") -> DataFrame:
    """(minute, star, x, y, ra, dec): places from the positions, else from the
    minute's first frame, where a star has none there. Stars are those of the samples."""
    first = samples.groupBy(minute, "star").agg(F.min_by("x", "frame").alias("_x"), F.min_by("y", "frame").alias("_y"))
    p = positions.select(minute, "star", "x", "y", "ra", "dec")
    both = first.join(p, [minute, "star"], "left")
    return both.select(minute, "star", F.coalesce("x", "_x").alias("x"), F.coalesce("y", "_y").alias("y"), "ra", "dec")


def unsolved(positions: DataFrame, by: str = "path") -> DataFrame:
    """The files without any sky coordinates: those still to be solved."""
    return positions.groupBy(by).agg(F.count("ra").alias("_n")).where("_n = 0").select(by)


def cone_search(catalogue: DataFrame, ra: float, dec: float, radius: float, faintest: float | None = None, ra_col: str = "ra", dec_col: str = "dec", mag_col: str = "gmag") -> DataFrame:
    """Sources within ``radius`` degrees, with their separation, brighter than
    ``faintest``. Ranges of declination and, away from the poles, of right
    ascension go to the scan."""
    import math

    low, high = dec - radius, dec + radius
    rows = catalogue.where(F.col(dec_col).between(low, high))
    if faintest is not None:
        rows = rows.where(F.col(mag_col) < faintest)
    if low > -90 and high < 90:
        half = math.degrees(math.asin(min(1.0, math.sin(math.radians(min(radius, 90.0))) / math.cos(math.radians(dec)))))
        a, b = (ra - half) % 360.0, (ra + half) % 360.0
        here = F.pmod(F.col(ra_col), F.lit(360.0)) if half < 180 else None
        if here is not None and radius < 90:
            rows = rows.where(here.between(a, b) if a <= b else (here >= a) | (here <= b))
    return rows.withColumn("sep", separation(F.col(ra_col), F.col(dec_col), F.lit(float(ra)), F.lit(float(dec)))).where(F.col("sep") <= radius)


def field_radius(width: int, height: int, scale: float, factor: float = 1.0) -> float:
    """Degrees from a frame's centre to its corner, times a factor; ``scale`` in degrees per pixel."""
    return factor * scale * (width**2 + height**2) ** 0.5 / 2


def field_centre(stars: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, ra, dec): medians over the stars with sky coordinates, four decimals."""
    known = stars.where("ra IS NOT NULL AND dec IS NOT NULL")
    return known.groupBy(*by).agg(F.round(F.median("ra"), 4).alias("ra"), F.round(F.median("dec"), 4).alias("dec"))


def night_catalogue(catalogue: DataFrame, stars: DataFrame, radius: float, faintest: float | None = None) -> DataFrame:
    """Sources around the centre of a night's stars; empty if none has coordinates."""
    centre = field_centre(stars).collect()[0]
    if centre["ra"] is None:
        return catalogue.limit(0).withColumn("sep", F.lit(None).cast("double"))
    return cone_search(catalogue, centre["ra"], centre["dec"], radius, faintest)


def faintest_in_box(stars: DataFrame, sources: DataFrame, reach: float = 0.1, star: str = "star", source: str = "source", snr: str = "snr") -> DataFrame:
    """(star, source, snr): of the sources whose x and y differ by less than
    ``reach`` from a star's, that of least signal-to-noise; null without one.
    ``stars``: star, x, y; ``sources``: source, sx, sy, snr."""
    from lumicurve.operators.bandjoin import least_near

    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    near_cells = lambda c: F.explode(F.array(cell(c) - 1, cell(c), cell(c) + 1))
    asks = stars.select(star, "x", "y", near_cells("x").alias("_cx")).withColumn("_cy", near_cells("y"))
    asks = asks.select(star, "x", "y", F.struct("_cx", "_cy").alias("_cell"))
    points = sources.select(source, "sx", "sy", snr, F.struct(cell("sx").alias("_cx"), cell("sy").alias("_cy")).alias("_cell"))
    near = lambda get: (F.abs(F.col("x") - get("sx")) < reach) & (F.abs(F.col("y") - get("sy")) < reach)
    best = least_near(asks, points, star, snr, near, lambda get: [get(source).alias(source)])
    return stars.select(star).join(best, star, "left").select(star, F.col("_best")[source].alias(source), F.col("_best")[snr].alias(snr))


def attached(rows: DataFrame, meta: DataFrame, on: str) -> DataFrame:
    """The rows with what a table of one row per key says of them, if it does."""
    return rows.join(meta, on, "left")


def star_files(spark: SparkSession, path: str) -> DataFrame:
    """(star, line_no, t, flux) of a folder of text files, one a star: comment
    lines begin with #, the star is the last number in the file's name."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    text = F.decode("content", "UTF-8")
    lines = f.select(numeric_id(F.regexp_extract("path", r"([^/]+)$", 1)).alias("star"), F.posexplode(F.filter(F.split(text, r"\r?\n"), lambda x: ~F.ltrim(x).startswith("#") & (F.trim(x) != ""))).alias("line_no", "line"))
    words = F.split(F.trim("line"), r"\s+")
    # The last two words of a line are its time and light; names of frames may stand in front.
    at = lambda k: F.try_element_at(words, F.lit(k)).try_cast("double")
    return lines.where("star IS NOT NULL").select("star", "line_no", at(-2).alias("t"), at(-1).alias("flux"))


def numeric_id(name: Column) -> Column:
    """The last run of digits in a name, as a number, so that 10 sorts behind 9."""
    return F.regexp_extract(name, r"(\d+)\D*$", 1).try_cast("long")


def cumulative_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table kept as CSV with a header; malformed lines are dropped."""
    return spark.read.csv(path, schema=schema, header=True, mode="DROPMALFORMED")


def minute_of(events: DataFrame, minutes: DataFrame, seconds: float = 60.0, event_time: str = "t", minute_time: str = "start") -> DataFrame:
    """Each event with the minute that holds it: start <= t < start + ``seconds``;
    the latest such minute counts, and of minutes of one start the greatest.
    That is the last start at or before the event, so both sides merge in
    ordered stretches of time and no pair is made."""
    from lumicurve.operators.bandjoin import neighbours

    names = [c for c in minutes.columns if c != minute_time]
    last = minutes.where(F.col(minute_time).isNotNull()).groupBy(F.col(minute_time).alias("_t")).agg(F.max(F.struct(*names)).alias("_m"))
    marks = last.select("_t", F.struct("_t", "_m").alias("_k"))
    asks = events.distinct().withColumn("_t", F.col(event_time)).where(F.col("_t").isNotNull())
    both = asks.withColumn("_k", F.lit(None).cast(marks.schema["_k"].dataType)).unionByName(marks, allowMissingColumns=True)
    found = neighbours(both, [], "_t", "_k", max(6 * seconds, 3600.0)).where("_k IS NULL").where(F.col("_t") < F.col("_a._t") + seconds)
    return found.select(*events.columns, *[(F.col("_a._t") if c == minute_time else F.col("_a._m")[c]).alias(c) for c in minutes.columns])


def by_key_in_name(rows: DataFrame, files: DataFrame, row_key: str = "minute_key", file_path: str = "path") -> DataFrame:
    """Rows with the first file whose name holds their key; null without one."""
    named = files.select(minute_key(F.regexp_extract(file_path, r"([^/]+)$", 1)).alias(row_key), F.col(file_path).alias("_file")).where(F.col(row_key).isNotNull())
    return rows.join(named.groupBy(row_key).agg(F.min("_file").alias("file")), row_key, "left")


def sorted_keys(files: DataFrame, path: str = "path") -> DataFrame:
    """(minute_key, t, path) of files by time; names without a key are left out."""
    k = files.select(minute_key(F.regexp_extract(path, r"([^/]+)$", 1)).alias("minute_key"), path)
    return k.withColumn("t", key_time(F.col("minute_key"))).where("t IS NOT NULL").orderBy("t", path)
