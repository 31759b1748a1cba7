"""The frame source: bands, bytes read, pushed filters, sizes, FITS images, streams by minute folders."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicurve.sources import fits, frame_source

HEIGHT, WIDTH = 10, 6


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("frames"))
    r = np.random.default_rng(4)
    rows = []
    for minute in ("20250830_03.04.00.000", "20250830_03.05.00.000", "20250830_03.06.00.000"):
        for k in range(3):
            low, high = (r.integers(0, 4096, HEIGHT * WIDTH).tolist() for _ in range(2))
            rows.append((minute, f"f{k}.rcd", f"2025-08-30T03:04:0{k}.500000Z", HEIGHT, WIDTH, low, high))
    frame_source.write_frames(spark.createDataFrame(rows, "folder string, name string, date_obs string, height int, width int, low array<int>, high array<int>").repartition(3), path)
    return path, {(x[0], x[1]): x for x in rows}


def test_bands_hold_all_pixels_once(spark, folder):
    path, written = folder
    out = frame_source.frame_bands(spark, path, bandRows=4, taskBytes=200).collect()
    assert len(out) == 9 * 3 and {(r.row0, r.rows) for r in out} == {(0, 4), (4, 4), (8, 2)}
    for (minute, name), w in written.items():
        own = sorted((r for r in out if (r.folder, r["name"]) == (minute, name)), key=lambda r: r.row0)
        assert [v for r in own for v in r.low] == w[5] and [v for r in own for v in r.high] == w[6]
        assert all((r.height, r.width, r.date_obs, r.gps_lock) == (HEIGHT, WIDTH, w[2], True) for r in own)
        # A band costs the header and its own rows of both gains, 1.5 bytes a pixel.
        assert [r.bytes for r in own] == [384 + 2 * r.rows * WIDTH * 3 // 2 for r in own]


def test_ranges_decide_what_is_read(spark, folder):
    path, _ = folder
    load = lambda **options: frame_source.frame_bands(spark, path, bandRows=4, taskBytes=1, **options)
    some = load(fromFolder="20250830_03.05.00.000", fromRow=4, toRow=4)
    # Two folders of three files, one band: six tasks, where all bands are twenty-seven.
    assert some.rdd.getNumPartitions() == 6 and load().rdd.getNumPartitions() == 27
    assert {r.row0 for r in some.collect()} == {4} and some.where("name = 'f1.rcd'").count() == 2
    assert load(toTime="2001-01-01T00:00:00+00:00").collect() == [] and load(fromTime="2001-01-01T00:00:00+00:00").count() == 27
    assert load(fromFolder="x").collect() == []


def test_pushed_filters(spark, folder):
    path, _ = folder
    load = lambda: frame_source.frame_bands(spark, path, bandRows=4, taskBytes=1, pushFilters="true")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = load().where("folder >= '20250830_03.05.00.000' AND row0 = 4 AND name = 'f1.rcd'")
        assert len(some.collect()) == 2 and some.rdd.getNumPartitions() == 6
        assert load().where("folder = 'none'").collect() == [] and load().where("folder IN ('20250830_03.04.00.000')").count() == 9
        assert load().where("folder > '20250830_03.04.00.000' AND folder < '20250830_03.06.00.000' AND row0 <= 4").count() == 6
        old = load().where(F.col("modified") < F.lit("2001-01-01").cast("timestamp"))
        assert old.collect() == [] and old.rdd.getNumPartitions() <= 1
        assert load().where(F.col("modified") > F.lit("2001-01-01").cast("timestamp")).count() == 27
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_sizes_come_from_headers_alone(spark, folder):
    path, _ = folder
    assert {tuple(r) for r in frame_source.frame_sizes(spark, path).collect()} == {(f"20250830_03.0{m}.00.000", 3, HEIGHT, WIDTH) for m in (4, 5, 6)}
    assert {r.bytes for r in frame_source.frame_bands(spark, path, headersOnly="true").collect()} == {384}


def test_binning_short_files_and_no_files(spark, tmp_path):
    image = np.arange(2 * 4 * 4) % 4096
    whole = bytearray(frame_source.raw_file(None, 4, 4, image[:16], image[16:]))
    whole[81:83], whole[83:85], whole[100] = (8).to_bytes(2, "big"), (8).to_bytes(2, "big"), 2
    (tmp_path / "a.rcd").write_bytes(bytes(whole))
    (tmp_path / "b.rcd").write_bytes(bytes(whole[: 384 + 2 * 12 + 5]))
    out = {(r["name"], r.row0): (r.height, r.width, r.rows, r.date_obs, r.low) for r in frame_source.frame_bands(spark, str(tmp_path), bandRows=3).collect()}
    assert out["a.rcd", 0] == (4, 4, 3, None, image[:12].tolist()) and out["a.rcd", 3] == (4, 4, 1, None, image[12:16].tolist())
    assert out["b.rcd", 0][2:] == (2, None, image[:8].tolist()) and out["b.rcd", 3][2:] == (0, None, [])
    assert frame_source.frame_bands(spark, str(tmp_path / "none")).collect() == []


def test_fits_images(spark, tmp_path):
    image = np.arange(35.0).reshape(7, 5)
    (tmp_path / "m1").mkdir()
    (tmp_path / "m1" / "a.fits").write_bytes(fits.fits_bytes(image, {"DATE-OBS": "2025-08-30T01:02:03", "NOTE": "x" * 60}))
    out = sorted(frame_source.frame_bands(spark, str(tmp_path), bandRows=3).collect(), key=lambda r: r.row0)
    assert [(r.row0, r.rows, r.low, r.high, r.date_obs) for r in out] == [(a, min(3, 7 - a), image[a : a + 3].ravel().astype(int).tolist(), None, "2025-08-30T01:02:03") for a in (0, 3, 6)]
    assert [r.bytes for r in out] == [2880 + 8 * 5 * r.rows for r in out]


def test_stream_goes_on_from_its_folder(spark, folder, tmp_path):
    path, written = folder
    work = str(tmp_path / "copy")
    minutes = sorted({m for m, _ in written})
    frame_source.register(spark)

    def copy(minute):
        os.makedirs(f"{work}/{minute}")
        for name in os.listdir(f"{path}/{minute}"):
            if name.endswith(".rcd"):
                with open(f"{path}/{minute}/{name}", "rb") as a, open(f"{work}/{minute}/{name}", "wb") as b:
                    b.write(a.read())

    def run():
        s = spark.readStream.format("frame_bands").options(path=work, bandRows=4, settleSeconds=0).load().select("folder", "name", "row0")
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
        q.stop()
        return spark.read.parquet(str(tmp_path / "out")).groupBy("folder").count().collect()

    copy(minutes[0])
    assert {tuple(r) for r in run()} == {(minutes[0], 9)}
    copy(minutes[1])
    copy(minutes[2])
    assert {tuple(r) for r in run()} == {(m, 9) for m in minutes}
    assert {tuple(r) for r in run()} == {(m, 9) for m in minutes}
