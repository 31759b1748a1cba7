"""Tables in their roles: light curves, detections, stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c: str) -> Column:
    """Unix seconds of a time stamp, as double."""
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def curves(spark: SparkSession, sf_dir: str, star: str = "event_type") -> DataFrame:
    """Light curves from events: star, event_id, t, flux."""
    return table(spark, sf_dir, "events").select(F.col(star).alias("star"), "event_id", seconds("ts").alias("t"), F.col("value").alias("flux"))


#: Samples of a stretch of the long curves: so few that even the smallest tables have several.
STRETCH = 1024


def r6(c: str | Column) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


#: Light curves in SQL, by event type and by user, with their sample numbers.
LC = "lc AS (SELECT event_type AS star, event_id, epoch_us(ts) / 1e6 AS t, value AS flux, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)"
USER_LC = LC.replace("event_type", "user_id")


def trend_sql(source: str, value: str, width: int, name: str) -> str:
    """SQL of a mirrored running mean over ``source`` (star, i, n)."""
    half = width // 2
    return f"""{name}_m AS (
  SELECT *, i AS pos FROM {source} UNION ALL SELECT *, -1 - i FROM {source} WHERE i < {half} UNION ALL SELECT *, 2 * n - 1 - i FROM {source} WHERE i >= n - {half}
), {name}_w AS (SELECT *, avg({value}) OVER (PARTITION BY star ORDER BY pos ROWS BETWEEN {half} PRECEDING AND {width - 1 - half} FOLLOWING) AS trend FROM {name}_m
), {name} AS (SELECT * EXCLUDE (pos), {value} - trend AS d FROM {name}_w WHERE pos = i)"""


def ricker_sql(source: str, width: int, name: str, half: int = 24) -> str:
    """SQL of a valid convolution of d in ``source`` with a Ricker wavelet."""
    return f"""{name} AS (
  SELECT a.star, a.i, a.n, sum(b.d * (1 - power((b.i - a.i) / {width}.0, 2)) * exp(-power((b.i - a.i) / {width}.0, 2) / 2)) AS c
  FROM {source} a JOIN {source} b ON a.star = b.star AND b.i BETWEEN a.i - {half} AND a.i + {half}
  WHERE a.i BETWEEN {half} AND a.n - 1 - {half} GROUP BY a.star, a.i, a.n)"""
