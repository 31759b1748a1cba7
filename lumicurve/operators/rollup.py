"""Nightly and cumulative tables, histograms, and darks."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumicurve.operators.series import Names, _list


def primary_summary(stars: DataFrame, detections: DataFrame, minute: str = "minute_key") -> DataFrame:
    """(minute, stars, detections), with 0 where a minute has no detection."""
    s = stars.groupBy(minute).agg(F.count(F.lit(1)).alias("stars"))
    d = detections.groupBy(minute).agg(F.count(F.lit(1)).alias("detections"))
    return s.join(d, minute, "left").select(minute, "stars", F.coalesce("detections", F.lit(0).cast("long")).alias("detections"))


def histogram(df: DataFrame, value: str, low: float, high: float, width: float, by: Names = ()) -> DataFrame:
    """(bin, n) of values clipped to [low, high]; the last bin holds its right edge."""
    bins = round((high - low) / width)
    clipped = F.least(F.greatest(F.col(value), F.lit(low)), F.lit(high))
    at = F.least(F.floor((clipped - low) / width), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).isNotNull()).groupBy(*_list(by), at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def least_of(df: DataFrame, columns: Sequence[str], out: str = "least") -> DataFrame:
    """The least of the columns that are not null, and whether all are there."""
    return df.withColumn(out, F.least(*columns)).withColumn("complete", F.col(columns[-1]).isNotNull())


def nightly_rollup(df: DataFrame, night: str, scope: str, scopes: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """One row a night with a column for each scope and measure. The scopes are
    named, so the pivot needs no pass to find them."""
    return df.groupBy(night).pivot(scope, list(scopes)).agg(*[c.alias(n) for n, c in measures.items()])


def upsert(old: DataFrame, new: DataFrame, key: Names) -> DataFrame:
    """The old rows whose key the new ones lack, and the new ones."""
    return old.join(new.select(*_list(key)).distinct(), _list(key), "left_anti").unionByName(new)


def rank_sigmas(df: DataFrame, group: str, scope: str, sigma: str, most: int = 3) -> DataFrame:
    """(group, sigma1 .. ): each group's sigmas in the order of their scopes."""
    w = Window.partitionBy(group).orderBy(scope)
    ranked = df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
    return ranked.groupBy(group).agg(*[F.max(F.when(F.col("_k") == k, F.col(sigma))).alias(f"sigma{k}") for k in range(1, most + 1)])


def median_tiles(frames: DataFrame, key: Names, pixels: str = "pixels", tile: int = 4096) -> DataFrame:
    """(key, tile, values): the median of each pixel over the frames of a key,
    an array for each tile, which begins at pixel ``tile``.

    Frames are cut into tiles of ``tile`` pixels, dealt by key and tile, so one
    stack uses many tasks and a task holds one tile of all its frames. Nulls are
    left out; frames may differ in length.
    """
    keys = _list(key)
    starts = F.sequence(F.lit(0), F.greatest(F.size(pixels) - 1, F.lit(0)), F.lit(tile))
    tiles = frames.where(F.size(pixels) > 0).select(*keys, F.col(pixels).cast("array<double>").alias("_p"), F.explode(starts).alias("tile")).select(*keys, "tile", F.slice("_p", F.col("tile") + 1, F.lit(tile)).alias("_p"))

    def stack(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.full((len(pdf), max(map(len, pdf["_p"]))), np.nan)
        for row, p in zip(image, pdf["_p"], strict=True):
            row[: len(p)] = p
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)
            value = np.nanmedian(image, axis=0)
        return pdf[[*keys, "tile"]].iloc[[0]].assign(values=[value])

    kinds = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)
    return tiles.groupBy(*keys, "tile").applyInPandas(stack, f"{kinds}, tile int, values array<double>")


def median_stack(frames: DataFrame, key: Names, pixels: str = "pixels", tile: int = 4096) -> DataFrame:
    """(key, pixel, value): ``median_tiles`` with a row for each pixel."""
    t = median_tiles(frames, key, pixels, tile).select(*_list(key), "tile", F.posexplode("values").alias("_at", "value"))
    return t.select(*_list(key), (F.col("tile") + F.col("_at")).alias("pixel"), F.when(~F.isnan("value"), F.col("value")).alias("value"))


def median_images(frames: DataFrame, key: Names, pixels: str = "pixels", out: str = "pixels", tile: int = 4096) -> DataFrame:
    """(key, out): the whole median image of each key, put together from its
    tiles, of which there are few; pixels never are rows."""
    t = median_tiles(frames, key, pixels, tile)
    return t.groupBy(*_list(key)).agg(F.flatten(F.array_sort(F.collect_list(F.struct("tile", "values")))["values"]).alias(out))


def first_frames(frames: DataFrame, key: Names, order: str, n: int) -> DataFrame:
    """The first ``n`` frames of each key."""
    w = Window.partitionBy(*_list(key)).orderBy(order)
    return frames.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def value_counts(frames: DataFrame, key: Names, pixels: str = "pixels") -> DataFrame:
    """(key, v, c): how often each value is among a key's pixels. A frame gives a
    row for each of its distinct values, of which a 12-bit frame has 4,096."""
    keys = _list(key)

    def run(batches):
        for b in batches:
            for k in range(len(b)):
                column = b.column(len(keys))
                values, counts = np.unique(column.slice(k, 1).flatten().drop_null().to_numpy(zero_copy_only=False), return_counts=True)
                head = [b.column(j).slice(k, 1).take(pa.array(np.zeros(len(values), np.int64))) for j in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*head, pa.array(values, kind), pa.array(counts, pa.int64())], names=[*keys, "v", "c"])

    element = frames.schema[pixels].dataType.elementType
    kind = to_arrow_type(element)
    fields = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)
    each = frames.select(*keys, pixels).mapInArrow(run, f"{fields}, v {element.simpleString()}, c long")
    return each.groupBy(*keys, "v").agg(F.sum("c").alias("c"))


def image_statistics(frames: DataFrame, key: Names, pixels: str = "pixels") -> DataFrame:
    """mean, median, mode (the least of the most frequent), rms of each key's
    pixels, from counts of their values."""
    return value_counts(frames, key, pixels).groupBy(*_list(key)).agg(
        (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"),
        F.percentile("v", 0.5, F.col("c")).alias("median"),
        F.max(F.struct("c", (-F.col("v")).alias("v")))["v"].alias("_mode"),
        F.sqrt(F.sum(F.col("v") * F.col("v") * F.col("c")) / F.sum("c")).alias("rms"),
    ).withColumn("mode", -F.col("_mode")).drop("_mode")


def read_noise(frames: DataFrame, key: Names, order: str, gain: float, pixels: str = "pixels") -> DataFrame:
    """(key, read_noise, pairs): over disjoint pairs of consecutive frames the
    deviation of their difference times gain over root 2, averaged."""
    keys = _list(key)
    n = frames.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    two = n.groupBy(*keys, F.floor(F.col("_k") / 2).alias("_pair")).agg(F.min(F.struct("_k", pixels)).alias("a"), F.max(F.struct("_k", pixels)).alias("b"), F.count(F.lit(1)).alias("_n")).where("_n = 2")

    def run(batches):
        for b in batches:
            x, y = b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist()
            s = [float(np.nanstd(np.array(i, float) - np.array(j, float))) * gain / 2**0.5 if i else None for i, j in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(s, pa.float64())], names=[*keys, "s"])

    fields = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)
    each = two.select(*keys, F.col(f"a.{pixels}").alias("x"), F.col(f"b.{pixels}").alias("y")).mapInArrow(run, f"{fields}, s double")
    return each.groupBy(*keys).agg(F.avg("s").alias("read_noise"), F.count(F.lit(1)).alias("pairs"))
