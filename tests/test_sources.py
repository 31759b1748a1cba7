"""Readers, writers and streams on small files."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicurve.operators import detect, series
from lumicurve.plans.numeric import run_to_end
from lumicurve.sources import readers, sinks
from lumicurve.streaming import streams

HEAD = "#\n#\n#\n#\n#    Event File: f_{k}.rcd\n#    Star Coords: 10.5 20.25\n#    RA Dec Coords: 271.5 -20.5\n#    DATE-OBS: 2025-08-30T03:04:05.678901Z\n#    Telescope: Green\n#    Field: field1\n#    significance: {sig}\n#    Raw lightcurve std: 1.5000\n#    Raw lightcurve mean: 100.0000\n#\n#filename     time      flux     conv_flux\n"


def test_detection_files(spark, tmp_path):
    for k, sig in enumerate(("6.125", "ARTIFICIAL")):
        (tmp_path / f"det_{k}.txt").write_text(HEAD.format(k=k, sig=sig) + "a.rcd 5.1 100.0  -1.5\n\nb.rcd 5.2 x\n")
    d = {r.det_id: r for r in readers.detection_files(spark, str(tmp_path)).collect()}
    one, two = d["det_0.txt"], d["det_1.txt"]
    assert (one.significance, one.star_y, one.ra_deg, one.scope, one.raw_std, one.conv_min, one.is_artificial) == (6.125, 20.25, 271.5, "Green", 1.5, None, False)
    assert str(one.date_obs) == "2025-08-30 03:04:05.678901" and two.is_artificial and two.significance is None
    s = readers.detection_samples(spark, str(tmp_path)).orderBy("det_id", "frame").collect()
    assert len(s) == 4 and (s[0].filename, s[0].seconds, s[0].conv_flux) == ("a.rcd", 5.1, -1.5) and s[1].flux is None


def test_detection_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "det_1.txt").write_text(HEAD.format(k=1, sig="7.000") + "".join(f"f{k}.rcd {k / 40:f} {100 + k:f}  {k:f}\n" for k in range(80)))
    d, s = readers.detection_files(spark, str(tmp_path / "in")), readers.detection_samples(spark, str(tmp_path / "in"))
    sinks.write_texts(sinks.detection_texts(d, s), str(tmp_path / "out"))
    text = spark.read.text(str(tmp_path / "out")).collect()
    assert sum(r.value.startswith("f") for r in text) == 80 and any("significance: 7.000" in r.value for r in text)


def test_summary_weather_and_log(spark, tmp_path):
    (tmp_path / "primary.txt").write_text("# Ran\n# time\n#--#\n20250830_03.04.05.678, 12, 1\nbad, 1, 2\n\n")
    assert [(r.minute_key, r.stars, r.detec) for r in readers.primary_summaries(spark, str(tmp_path / "primary.txt")).collect()] == [("20250830_03.04.05.678", 12, 1)]
    (tmp_path / "w.csv").write_text("1.0,2,3,4,5,6,7,8,9,10\nbroken,line\n")
    assert readers.weather(spark, str(tmp_path / "w.csv")).select("humidity").collect()[0][0] == 3.0
    log = "Sat Aug 30 03:04:05 UTC 2025 INFO: Sunset JD: 2460000.5\nSat Aug 30 03:04:06 UTC 2025 INFO: Field Name: field7\nSat Aug 30 03:04:07 UTC 2025 INFO: Sunset JD: 2460001.5\nSat Aug 30 03:04:08 UTC 2025 INFO: Field Name: TooLate\nother\n"
    (tmp_path / "acp.log").write_bytes(log.encode("utf-16"))
    lines = readers.observatory_log(spark, str(tmp_path / "acp.log"), ["INFO"])
    assert lines.count() == 4
    assert [(r.sunset, r.sunrise) for r in readers.sun_times(lines).collect()] == [(2460001.5, None)]
    assert [r.field for r in readers.fields_observed(lines).collect()] == [7]


def test_raw_frames(spark, tmp_path):
    width, rows = 4, 4
    px = np.arange(width * rows) * 37 % 4096
    packed = b"".join(bytes([a >> 4, ((a & 15) << 4) | (b >> 8), b & 255]) for a, b in zip(px[::2].tolist(), px[1::2].tolist(), strict=True))
    head = bytearray(384)
    head[63:72], head[140], head[152:181] = b"SN0000001", 96, b"2025-08-30T03:04:05.678901234"
    head[91:93] = (300).to_bytes(2, "little")
    (tmp_path / "a.rcd").write_bytes(bytes(head) + packed)
    head[140] = 0
    (tmp_path / "b.rcd").write_bytes(bytes(head) + packed)
    f = readers.raw_frames(spark, str(tmp_path), locked_only=True)
    r = f.collect()
    assert len(r) == 1 and (r[0].serial, r[0].sensor_temp, r[0].date_obs) == ("SN0000001", 300, "2025-08-30T03:04:05.678901234")
    low = px.reshape(rows, width)[::2].reshape(-1).tolist()
    assert readers.decode_frames(f, width).collect()[0].image == low
    assert readers.gain_image(f, width).collect()[0].image == low


def test_arrays_minutes_and_kernels(spark, tmp_path):
    cube = np.arange(3 * 2 * 4, dtype=float).reshape(3, 2, 4)
    np.save(tmp_path / "20250830_03.04.05.678_stars.npy", cube)
    np.save(tmp_path / "20250830_03.04.05.678_4sig_pos.npy", cube[0, :, :3])
    s = readers.samples_from_arrays(spark, str(tmp_path)).orderBy("frame", "star").collect()
    assert len(s) == 6 and (s[3].x, s[3].flux, s[3].t) == tuple(cube[1, 1, [0, 2, 3]])
    m = readers.minutes(spark, str(tmp_path)).collect()
    assert len(m) == 1 and m[0].pos_path.endswith("sig_pos.npy") and m[0].t is not None
    (tmp_path / "k.txt").write_text("1 2 3\n1 1 1\n4 5\n")
    assert [r.curve for r in readers.kernel_bank(spark, str(tmp_path / "k.txt"), 2, 1.0).orderBy("kernel_id").collect()] == [[0.0, 1.0], [3.0, 4.0]]


def test_upsert_table_and_manifest(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    for _ in range(2):
        sinks.upsert_table(str(tmp_path / "t"), rows((1, "a")), "k")
    sinks.upsert_table(str(tmp_path / "t"), rows((1, "b"), (2, "c")), "k")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(1, "b"), (2, "c")]
    # An upsert that broke off between the two renames: the whole new table stands beside the old one.
    (tmp_path / "t").rename(tmp_path / "t._old")
    rows((1, "x"), (2, "y"), (3, "z")).write.parquet(str(tmp_path / "t._new"))
    sinks.upsert_table(str(tmp_path / "t"), rows((3, "d")), "k")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(1, "x"), (2, "y"), (3, "d")]
    # One that broke off while it wrote: the old table counts.
    (tmp_path / "t").rename(tmp_path / "t._old")
    (tmp_path / "t._new").mkdir()
    sinks.upsert_table(str(tmp_path / "t"), rows((1, "b")), "k")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(1, "b"), (2, "y"), (3, "d")]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    assert sinks.manifest({"sigma": "5"}, stars=rows((1, "a"))).collect()[0].value == '{"parameters":{"sigma":"5"},"stars":1}'
    assert [r.value for r in sinks.region_lines(spark.createDataFrame([(1.0, 2.0)], "x double, y double")).collect()] == ["circle(2.000, 3.000, 5)"]
    assert sinks.summary_lines(spark.createDataFrame([("k", 1, 2)], "minute_key string, stars int, detections int"), 3.5).count() == 4


def test_stream_scores_equal_batch_over_many_batches(spark, tmp_path):
    x = np.random.default_rng(8).normal(size=900)
    df = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(x)], "star string, frame long, flux double")
    for k in range(3):
        df.where(f"frame >= {300 * k} AND frame < {300 * (k + 1)}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.frame: r.score for r in run_to_end(streams.dip_scores(src, "star"), "t").collect()}
    batch = series.convolve(series.detrend(df.withColumnRenamed("frame", "i"), "star", "flux"), "star", "d", series.ricker(6.0))
    want = {r.i: r.c for r in batch.where("i BETWEEN 124 AND 776").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("stretch", [100, 900, 65_536])
def test_stream_scores_by_spans_with_missing_values(spark, tmp_path, stretch):
    """Spans shorter and longer than a window, spread over batches, give the scores of whole series; a null is no sample's value."""
    rng = np.random.default_rng(3)
    rows = [(s, 7 * k + j, None if (k + j) % 97 == 5 or 1500 <= k < 1600 and s == "b" else float(1e6 + rng.normal())) for j, (s, n) in enumerate([("a", 200), ("b", 2600), ("c", 900)]) for k in range(n)]
    df = spark.createDataFrame(rows, "star string, frame long, flux double")
    for low, high in ((0, 1000), (1000, 4001), (4001, 4100), (4100, 99_999)):
        df.where(f"frame >= {low} AND frame < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_to_end(streams.dip_scores(src, "star", stretch=stretch), "s").collect()
    want = {}
    for star, n in (("b", 2600), ("c", 900)):
        f, x = zip(*((r[1], math.nan if r[2] is None else r[2]) for r in rows if r[0] == star), strict=True)
        x = np.array(x)
        d = np.array([x[i] - np.nanmean(x[i - 100 : i + 100]) if x[i] == x[i] else math.nan for i in range(100, n - 99)])
        for i in range(124, n - 123):
            terms = d[i - 124 : i - 75] * series.ricker(6.0)
            want[star, f[i]] = None if np.isnan(terms).all() else np.nansum(terms)
    assert sorted((r.star, r.frame) for r in got) == sorted(want)
    assert all(want[r.star, r.frame] == pytest.approx(r.score, abs=1e-6) if r.score is not None else want[r.star, r.frame] is None for r in got)
    assert any(r.score is None for r in got)


def test_a_span_sends_only_its_ends_to_its_key():
    at, gap = streams.edges_of(13_000, 247)
    assert len(at) == 494 and at[[246, 247, -1]].tolist() == [246, 12_753, 12_999] and np.flatnonzero(gap).tolist() == [247]


def test_stream_sessions_break_only_beyond_the_gap(spark, tmp_path):
    rows = [("s", f"2025-01-01 00:00:{v:09.6f}") for v in (0.0, 0.0375, 0.0752, 30.0)] + [("s", "2025-01-01 01:00:00")]
    spark.createDataFrame(rows, "k string, t string").select("k", F.to_timestamp("t").alias("t")).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "in"))
    assert sorted(r.n for r in run_to_end(streams.sessions(src, "k", "t"), "s").collect()) == [1, 1, 2]


def test_matched_filter_of_zero_noise(spark):
    df = spark.createDataFrame([("s", k, 1.0, 0.0) for k in range(20)], "star string, i long, flux double, sigma double")
    assert detect.peak(detect.matched_filter(df, "star", "flux", [1.0, 1.0, 1.0], "sigma"), "star").collect()[0].frame == 1
