"""Minutes from frames to dips, their helpers, and writers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumicurve.operators import reduction
from lumicurve.sources import sinks

N, SIZE = 230, 56
PLACES = [(12 + 11 * (k % 4), 13 + 15 * (k // 4)) for k in range(12)]


def minute(name, places, speed=0.1, dip=None):
    rng = np.random.default_rng(len(name))
    y, x = np.mgrid[:SIZE, :SIZE]
    rows = []
    for k in range(N):
        image = rng.normal(20, 0.5, (SIZE, SIZE))
        for star, (px, py) in enumerate(places):
            light = 3000.0 * (0.4 if dip and star == dip[0] and dip[1] <= k < dip[1] + 6 else 1.0)
            image += light / (2 * np.pi * 1.44) * np.exp(-((x - px - speed * 0.025 * k) ** 2 + (y - py) ** 2) / 2.88)
        rows.append((name, k, 1000.0 + 0.025 * k, image.ravel(), SIZE, SIZE))
    return pd.DataFrame(rows, columns=["minute", "frame", "t", "pixels", "height", "width"])


@pytest.fixture(scope="module")
def frames(spark):
    made = pd.concat([minute("good", PLACES, 0.1, (5, 140)), minute("empty", PLACES[:3]), minute("moving", PLACES, 0.4), minute("short", PLACES).head(60)])
    schema = "minute string, frame long, t double, pixels array<double>, height int, width int"
    return spark.createDataFrame(made, schema).repartition(4, "frame")


def test_minutes_are_searched(frames):
    settings = reduction.Settings(edge=5.0, most_drift=0.25)
    found, status = reduction.search_minutes(frames, settings)
    assert {r.minute: (r.frames, r.stars, r.status) for r in status.collect()} == {"good": (N, 12, "ok"), "empty": (N, 0, "too few stars"), "moving": (N, 12, "tracking failed"), "short": (60, 12, "too few frames")}
    dips = found.collect()
    assert len(dips) == 1 and dips[0].minute == "good" and abs(dips[0].frame - 142) <= 3
    curves, _ = reduction.light_curves(frames.where("minute = 'good'"), settings)
    star = curves.where(F.col("star") == dips[0].star).toPandas().sort_values("frame")
    assert len(star) == N and np.hypot(star.x.iloc[0] - PLACES[5][0], star.y.iloc[0] - PLACES[5][1]) < 0.5
    assert star.x.iloc[-1] - star.x.iloc[0] == pytest.approx(0.1 * 0.025 * (N - 1), abs=0.1)
    cut = reduction.events_by_series(curves, found.select("minute", "star", "frame")).toPandas()
    assert len(cut) == 80 and cut.offset.min() == -40 and cut.offset.max() == 39


def test_raw_folders_are_searched(spark, tmp_path):
    """From files to dips in one call: hours of the folder, the nearest dark taken off, frames in order of their names."""
    from lumicurve.sources.frame_source import write_frames

    y, x = np.mgrid[:SIZE, :SIZE]
    pattern = {"20250830_02.00.00.000": 300 + 40 * ((x + y) % 3), "20250830_09.00.00.000": 900 + 0 * x}
    key, rows = "20250830_03.04.00.000", []
    for r in minute(key, PLACES, 0.1, (5, 140)).itertuples():
        image = np.rint(4 * np.asarray(r.pixels).reshape(SIZE, SIZE) + pattern["20250830_02.00.00.000"]).astype(int).ravel().tolist()
        # The camera's clock counts its own hours; minute and second are right.
        rows.append((key, f"f{r.frame:05d}.rcd", f"2025-08-30T27:04:{r.frame * 0.025:09.6f}", SIZE, SIZE, image, image))
    darks = [(name, f"d{k}.rcd", "2025-08-30T00:00:00", SIZE, SIZE, (p + k % 2).ravel().tolist(), p.ravel().tolist()) for name, p in pattern.items() for k in range(3)]
    schema = "folder string, name string, date_obs string, height int, width int, low array<int>, high array<int>"
    for name, made in (("night", rows), ("darks", darks)):
        write_frames(spark.createDataFrame(made, schema).repartition(3), str(tmp_path / name))
    frames = reduction.folder_frames(spark, str(tmp_path / "night"))
    first = frames.where("frame = 4").select("minute", "t", "height").collect()
    assert [(r.minute, r.t, r.height) for r in first] == [(key, pytest.approx(pd.Timestamp("2025-08-30T03:04:00.1", tz="UTC").timestamp()), SIZE)]
    found, status = reduction.search_folders(spark, str(tmp_path / "night"), str(tmp_path / "darks"), reduction.Settings(edge=5.0, most_drift=0.25))
    assert [(r.minute, r.frames, r.stars, r.status) for r in status.collect()] == [(key, N, 12, "ok")]
    dips = found.collect()
    assert len(dips) == 1 and dips[0].minute == key and abs(dips[0].frame - 142) <= 3


def test_slices_times_and_darks(spark, frames):
    cut = reduction.frame_slice(frames.drop("frame"), "minute", "t", 10, 5).groupBy("minute").agg(F.min("t").alias("t"), F.count(F.lit(1)).alias("n"), F.max("frame").alias("m")).collect()
    assert all((r.t, r.n, r.m) == (pytest.approx(1000.25), 5, 4) for r in cut)
    iso = spark.createDataFrame([("2024-01-02T25:00:10.5",), ("2024-01-02T05:59:00",), (None,)], "date_obs string")
    assert [r.t and r.t % 86400 for r in reduction.with_seconds(iso).collect()] == [3610.5, 21540.0, None]
    fixed = iso.select(reduction.hour_of_folder(F.col("date_obs"), F.lit(23), F.lit(30)).alias("d")).collect()
    assert [r.d for r in fixed] == ["2024-01-02T00:00:10.5", "2024-01-02T23:59:00", None]
    darks = spark.createDataFrame([("a", k, [float(k), 5.0]) for k in range(5)] + [("b", 0, [1.0, 1.0])], "folder string, k int, pixels array<double>")
    assert {r.folder: r.dark for r in reduction.master_darks(darks, "folder", "k", 3).collect()} == {"a": [1.0, 5.0], "b": [1.0, 1.0]}
    edge = spark.createDataFrame([(20.0, 50.0), (19.9, 50.0), (50.0, 80.0)], "x double, y double")
    near = edge.select(reduction.near_border(F.col("x"), F.col("y"), 100, 100).alias("a"), reduction.near_border(F.col("x"), F.col("y"), 100, 100, inclusive=True).alias("b")).collect()
    assert [tuple(r) for r in near] == [(False, True), (True, True), (False, True)]


def test_times_of_day(spark):
    a = spark.createDataFrame([(1, 86400 * 5 + 10.0), (2, 86399.95), (3, 500.0)], "a int, ta double")
    b = spark.createDataFrame([(7, 10.05), (8, 86400 * 9 + 0.02), (9, 500.2)], "b int, tb double")
    assert {(r.a, r.b) for r in reduction.time_of_day_pairs(a, b, 0.1, "ta", "tb").collect()} == {(1, 7), (2, 8)}


def test_scopes_drop_out(spark):
    rows = [(1, "green", 0.0, 5), (2, "green", 500.0, 9), (3, "green", 900.0, 7), (4, "red", 30.0, 0), (5, "red", 520.0, 0), (6, "blue", 10.0, 0), (7, "red", 10.0, 0)]
    got = reduction.common_minutes(spark.createDataFrame(rows, "minute_id int, scope string, t double, stars int")).collect()
    assert [(r.minute_id, r.red, r.blue, r.scopes) for r in got] == [(1, 7, 6, 3), (2, 5, None, 2), (3, None, None, 1)]


def test_writers(spark, tmp_path):
    stars = spark.createDataFrame([("m1", k, float(k), 0.0) for k in range(10)] + [("m2", 0, 0.0, 0.0)], "minute_key string, star int, x double, y double")
    sinks.write_positions(stars, str(tmp_path / "pos"))
    assert {r.minute_key for r in spark.read.parquet(str(tmp_path / "pos")).collect()} == {"m1"}
    solved = spark.createDataFrame([("m1", 3, 10.0, 20.0)], "minute_key string, star int, ra double, dec double")
    again = sinks.with_sky(sinks.with_sky(stars, solved), solved.where("star < 0"))
    assert [(r.star, r.dec) for r in again.where("ra IS NOT NULL").collect()] == [(3, 20.0)]
    curves = spark.createDataFrame([(1, 2.0, 5.0), (1, 1.0, None), (2, 0.0, 1.0)], "star int, t double, flux double")
    sinks.write_curves(curves, str(tmp_path / "curves"))
    assert [r.value for r in spark.read.text(str(tmp_path / "curves" / "star=1")).collect()] == ["# time flux", "1.0 nan", "2.0 5.0"]
    line = spark.createDataFrame([("a line",)], "value string")
    for _ in range(2):
        sinks.append_lines(line, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2
    sinks.write_catalogue(str(tmp_path / "cat"), stars=stars, curves=curves)
    back = sinks.read_catalogue(spark, str(tmp_path / "cat"))
    assert back["stars"].count() == 11 and back["curves"].count() == 3
    samples = spark.createDataFrame([(0, "a", 1.0), (0, "b", 3.0), (0, "b", None), (1, "a", 2.0)], "star int, minute string, flux double")
    summary = sinks.catalogue_summary(stars.where("star < 3 AND minute_key = 'm1'").withColumn("ra", F.lit(1.0)).withColumn("dec", F.lit(2.0)), samples).collect()
    assert [(r.star, r.n_frames, r.n_minutes, r.snr) for r in summary] == [(0, 2, 2, 2.0), (1, 1, 1, None), (2, None, None, None)]
    bank = spark.createDataFrame([(1, [1.0, 0.5], 500.0, 0.1)], "kernel_id int, curve array<double>, object_r double, star_d double")
    assert [tuple(r) for r in sinks.kernel_lines(bank).collect()] == [(1, "1.000000 0.500000", "500.0 0.1")]
    assert sinks.star_hours_file(spark.createDataFrame([(1.5,), (2.25,)], "star_hours double")).collect()[0].name == "starhours_3.75.txt"
