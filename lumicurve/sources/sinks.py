"""Writers: partitioned tables, upserts, detection texts, manifests, regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicurve.operators.rollup import upsert


def write_table(df: DataFrame, path: str, partitions: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet; an overwrite replaces only the partitions that ``df`` holds.
    ``ignore`` writes only if there is nothing yet."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic" if partitions else "static").partitionBy(*partitions).parquet(path)


def upsert_table(path: str, new: DataFrame, key: str | Sequence[str]) -> None:
    """Replace the rows of the new keys in a Parquet table. The merged rows are
    written beside the table, which is then renamed out of the way, so that at
    any moment a whole table stands under its name or under ``._old``; what an
    interrupted call has left is put right by the next one."""
    spark = new.sparkSession
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    table, fresh, old = to(path), to(f"{path}._new"), to(f"{path}._old")
    fs = table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old):
        if fs.exists(table):
            fs.delete(old, True)
        else:
            fs.rename(fresh if fs.exists(to(f"{path}._new/_SUCCESS")) else old, table)
    exists = fs.exists(table)
    (upsert(spark.read.parquet(path), new, key) if exists else new).write.mode("overwrite").parquet(f"{path}._new")
    if exists:
        fs.rename(table, old)
    fs.rename(fresh, table)
    fs.delete(old, True)


#: The line of a detection's text (from 0) that has its coordinates.
COORDINATES_LINE = 6


def with_coordinates(texts: DataFrame, solved: DataFrame) -> DataFrame:
    """(det_id, value): detection texts whose line of coordinates is rewritten
    where a field was solved (det_id, ra, dec); other texts, and those that are
    too short to have the line, stay as they are."""
    joined = texts.join(solved.select("det_id", F.col("ra").alias("_ra"), F.col("dec").alias("_dec")), "det_id", "left")
    line = F.concat(F.lit("#    RA Dec Coords: "), F.format_string("%f %f", "_ra", "_dec"))
    known = F.col("_ra").isNotNull() & F.col("_dec").isNotNull()
    rewritten = F.array_join(F.transform(F.split("value", "\n"), lambda x, i: F.when(i == COORDINATES_LINE, line).otherwise(x)), "\n")
    return joined.select("det_id", F.when(known, rewritten).otherwise(F.col("value")).alias("value"))


def target_tables(curves: DataFrame, path: str, target: str = "target", time: str = "t") -> None:
    """A folder of Parquet for each target, its curve in order of time; targets
    that are written again are replaced, others stay."""
    ordered = curves.repartition(target).sortWithinPartitions(target, time)
    write_table(ordered, path, [target])


def detection_texts(detections: DataFrame, samples: DataFrame) -> DataFrame:
    """(det_id, value): the text of each detection's file, header and body. A
    cutout has some 80 samples, so a text is small."""
    h = lambda label, c: F.concat(F.lit(f"#    {label}: "), F.coalesce(F.col(c).cast("string"), F.lit("N/A")))
    number = lambda label, c, f: F.concat(F.lit(f"#    {label}: "), F.coalesce(F.format_string(f, F.col(c)), F.lit("N/A")))
    # The labels, number formats and order of the file's header.
    lines = [
        F.lit("#\n#\n#\n#"),
        h("Event File", "event_file"),
        F.concat(F.lit("#    Star Coords: "), F.format_string("%f %f", "star_x", "star_y")),
        F.when(F.col("ra_deg").isNotNull(), F.concat(F.lit("#    RA Dec Coords: "), F.format_string("%f %f", "ra_deg", "dec_deg"))).otherwise("#"),
        F.concat(F.lit("#    DATE-OBS: "), F.date_format("date_obs", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
        h("Telescope", "scope"),
        h("Field", "field"),
        F.when(F.col("is_artificial"), "#    significance: ARTIFICIAL").otherwise(number("significance", "significance", "%.3f")),
        number("Raw lightcurve std", "raw_std", "%.4f"),
        number("Raw lightcurve mean", "raw_mean", "%.4f"),
        number("Convolution background std", "conv_bkg_std", "%.4f"),
        number("Convolution background mean", "conv_bkg_mean", "%.4f"),
        number("Convolution minimal value", "conv_min", "%.4f"),
        F.lit("#\n#"),
        F.lit("#filename     time      flux     conv_flux"),
    ]
    row = F.concat("filename", F.format_string(" %f %f  %f", "seconds", "flux", F.coalesce("conv_flux", F.lit(float("nan")))))
    body = samples.groupBy("det_id").agg(F.array_sort(F.collect_list(F.struct("frame", row.alias("l")))).alias("b"))
    return detections.join(body, "det_id", "left").select("det_id", F.concat_ws("\n", *lines, F.array_join(F.coalesce(F.col("b.l"), F.array()), "\n")).alias("value"))


def write_texts(texts: DataFrame, path: str) -> None:
    """Texts as lines, in a folder for each det_id."""
    texts.write.mode("overwrite").partitionBy("det_id").text(path)


def summary_lines(summary: DataFrame, seconds: float) -> DataFrame:
    """The lines of a primary summary: three comments, then key, stars, detections."""
    spark = summary.sparkSession
    head = spark.createDataFrame([(0, f"# Ran for {seconds} seconds"), (1, "# time, star count"), (2, "#--------------------#")], "n int, value string")
    rows = summary.select(F.lit(3).alias("n"), F.concat_ws(", ", "minute_key", F.col("stars").cast("string"), F.col("detections").cast("string")).alias("value"))
    return head.union(rows).orderBy("n", "value").select("value")


def region_lines(stars: DataFrame, radius: float = 5.0) -> DataFrame:
    """Display regions: positions from 1, not 0, as circles."""
    return stars.select(F.format_string(f"circle(%.3f, %.3f, {radius:g})", F.col("x") + 1, F.col("y") + 1).alias("value"))


def manifest(parameters: dict[str, str], **counts: DataFrame) -> DataFrame:
    """One row of JSON: the parameters and the frames' row counts."""
    spark = next(iter(counts.values())).sparkSession
    out = spark.range(1).select(F.map_from_arrays(F.array(*map(F.lit, parameters)), F.array(*map(F.lit, parameters.values()))).alias("parameters"))
    for name, df in counts.items():
        out = out.join(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))))
    return out.select(F.to_json(F.struct("*")).alias("value"))


def write_positions(stars: DataFrame, path: str, by: str = "minute_key", fewest: int = 10) -> None:
    """Star lists, replaced minute by minute; minutes with too few stars are not written."""
    enough = stars.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= fewest).select(by)
    write_table(stars.join(enough, by, "left_semi"), path, [by])


def with_sky(stars: DataFrame, solved: DataFrame, on: Sequence[str] = ("minute_key", "star")) -> DataFrame:
    """Star lists with ra and dec where a field was solved; what is known stays."""
    new = solved.select(*on, F.col("ra").alias("_ra"), F.col("dec").alias("_dec"))
    rows = stars
    for c in ("ra", "dec"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    joined = rows.join(new, list(on), "left")
    return joined.select(*[c for c in rows.columns if c not in ("ra", "dec")], F.coalesce("_ra", "ra").alias("ra"), F.coalesce("_dec", "dec").alias("dec"))


def curve_texts(curves: DataFrame, by: str = "star", order: str = "t", header: str = "# time flux") -> DataFrame:
    """(by, line_no, value): lines of one text per star, numbered in order."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    rows = curves.select(by, n.alias("line_no"), F.concat_ws(" ", F.col(order).cast("string"), F.coalesce(F.col("flux").cast("string"), F.lit("nan"))).alias("value"))
    return rows.unionByName(curves.select(by).distinct().select(by, F.lit(0).alias("line_no"), F.lit(header).alias("value")))


def write_curves(curves: DataFrame, path: str, by: str = "star", order: str = "t") -> None:
    """A folder of lines for each star, in order of time."""
    lines = curve_texts(curves, by, order).repartition(by).sortWithinPartitions(by, "line_no")
    lines.select(by, "value").write.mode("overwrite").partitionBy(by).text(path)


def append_lines(lines: DataFrame, path: str) -> None:
    """Lines (value) behind those that are there."""
    lines.select("value").write.mode("append").text(path)


def write_catalogue(path: str, **tables: DataFrame) -> None:
    """A night's tables, each in a folder of its own, and what they hold as one JSON line."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    manifest({"tables": ",".join(tables)}, **tables).write.mode("overwrite").text(f"{path}/manifest")


def read_catalogue(spark, path: str) -> dict[str, DataFrame]:
    """The tables that ``write_catalogue`` wrote."""
    import json

    names = json.loads(spark.read.text(f"{path}/manifest").collect()[0]["value"])["parameters"]["tables"]
    return {name: spark.read.parquet(f"{path}/{name}") for name in names.split(",") if name}


def catalogue_summary(stars: DataFrame, samples: DataFrame) -> DataFrame:
    """(star, n_frames, n_minutes, median_flux, snr, x, y, ra, dec) by signal-to-noise, for a CSV."""
    s = samples.where(F.col("flux").isNotNull()).groupBy("star").agg(F.count(F.lit(1)).alias("n_frames"), F.count_distinct("minute").alias("n_minutes"), F.median("flux").alias("median_flux"), (F.median("flux") / F.nullif(F.stddev_pop("flux"), F.lit(0.0))).alias("snr"))
    return stars.select("star", "x", "y", "ra", "dec").join(s, "star", "left").orderBy(F.desc_nulls_last("snr"), "star")


def kernel_lines(kernels: DataFrame) -> DataFrame:
    """(kernel_id, curve_line, parameter_line): a bank and its parameters as text."""
    curve = F.array_join(F.transform("curve", lambda v: F.format_string("%.6f", v)), " ")
    columns = [c for c in kernels.columns if c not in ("kernel_id", "curve")]
    return kernels.select("kernel_id", curve.alias("curve_line"), F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("parameter_line"))


def star_hours_file(star_hours: DataFrame, value: str = "star_hours") -> DataFrame:
    """(name): the file name that tells the night's star hours."""
    return star_hours.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("v")).select(F.format_string("starhours_%.2f.txt", "v").alias("name"))
