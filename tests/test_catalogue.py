"""FITS files, positions, catalogues and report tables on hand-made data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicurve.operators import reports
from lumicurve.sources import catalogue, fits


def test_images_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"n{k}", 3, 4, rng.normal(size=12).tolist()) for k in range(3)]
    frames = spark.createDataFrame(rows, "name string, height int, width int, pixels array<double>")
    assert {(r.name, r.written) for r in fits.write_images(frames, str(tmp_path / "out")).collect()} == {(f"n{k}", True) for k in range(3)}
    assert not any(r.written for r in fits.write_images(frames, str(tmp_path / "out")).collect())
    back = {r.header["FRAME"]: r for r in fits.fits_frames(spark, str(tmp_path / "out")).collect()}
    assert {n: (r.height, r.width, r.pixels) for n, r in back.items()} == {n: (h, w, p) for n, h, w, p in rows}
    size = fits.frame_sizes(fits.fits_frames(spark, str(tmp_path / "out")).withColumn("folder", F.lit("a")), "folder").collect()[0]
    assert tuple(size) == ("a", 3, 3, 4)


def test_scaled_integers_and_headers(spark, tmp_path):
    raw = np.arange(6, dtype=">i2").reshape(2, 3)
    cards = ["SIMPLE  =                    T", "BITPIX  =                   16", "NAXIS   =                    2", "NAXIS1  =                    3", "NAXIS2  =                    2", "BSCALE  =                  2.0", "BZERO   =                 10.0 / zero", "DATE-OBS= '2016-00-03T12:00:00'", "OBJECT  = 'it''s / one'", "COMMENT = no, a comment", "HISTORY nothing", "END"]
    for name, extra in (("a.fits", []), ("b.fit", ["JD      =            2457000.5 / given"])):
        head = "".join(c.ljust(80) for c in [*cards[:-1], *extra, "END"]).encode()
        (tmp_path / name).write_bytes(head + b" " * (-len(head) % 2880) + raw.tobytes())
    got = {r.path[-6:].lstrip("/"): r for r in fits.fits_frames(spark, str(tmp_path)).collect()}
    one = got["a.fits"]
    assert one.pixels == [10.0, 12.0, 14.0, 16.0, 18.0, 20.0] and one.header["OBJECT"] == "it's / one" and one.header["BZERO"] == "10.0"
    assert one.jd == pytest.approx(2457391.0) and got["b.fit"].jd == 2457000.5
    heads = fits.fits_headers(spark, str(tmp_path)).collect()
    assert len(heads) == 2 and all(h.header["NAXIS1"] == "3" for h in heads)
    none = spark.createDataFrame([({"DATE-OBS": "no"},), ({"JD": "x"},)], "header map<string,string>").select(fits.header_jd(F.col("header")).alias("jd"))
    assert [r.jd for r in none.collect()] == [None, None]


def test_positions_and_fallback(spark, tmp_path):
    np.save(tmp_path / "20240102_03.04.05.678_4sig_pos.npy", np.array([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]))
    np.save(tmp_path / "20240102_03.05.05.678_4sig_pos.npy", np.array([[1.0, 2.0, 3.0, 10.0, 20.0]]))
    p = catalogue.positions_from_arrays(spark, str(tmp_path))
    rows = {(r.minute_key[-12:-4], r.star): r for r in p.collect()}
    assert rows["03.04.05", 1].y == 5.0 and rows["03.04.05", 1].ra is None and rows["03.05.05", 0].dec == 20.0
    assert [r.path[-31:-15] for r in catalogue.unsolved(p).collect()] == [r.path[-31:-15] for r in p.where("ra IS NULL").select("path").distinct().collect()]
    samples = spark.createDataFrame([("20240102_03.05.05.678", s, f, 7.0 + f, 8.0) for s in (0, 1) for f in (0, 1)], "minute_key string, star int, frame int, x double, y double")
    got = {r.star: (r.x, r.y, r.ra) for r in catalogue.star_coordinates(samples, p).collect()}
    assert got == {0: (1.0, 2.0, 10.0), 1: (7.0, 8.0, None)}
    keyed = catalogue.by_key_in_name(samples.select("minute_key").distinct(), p.select("path").distinct()).collect()
    assert keyed[0].file.endswith("03.05.05.678_4sig_pos.npy")
    assert [r.minute_key for r in catalogue.sorted_keys(p.select("path").distinct()).collect()] == ["20240102_03.04.05.678", "20240102_03.05.05.678"]


@pytest.mark.parametrize("centre", [(0.05, 10.0), (359.9, -40.0), (120.0, 89.9), (10.0, -89.99), (200.0, 0.0)])
def test_cones_equal_all_sources(spark, centre):
    rng = np.random.default_rng(3)
    ra = (centre[0] + rng.normal(0, 2, 400)) % 360
    dec = np.clip(centre[1] + rng.normal(0, 0.6, 400), -90, 90)
    df = spark.createDataFrame([(k, float(a), float(d), float(k % 20)) for k, (a, d) in enumerate(zip(ra, dec, strict=True))], "source long, ra double, dec double, gmag double")
    got = {r.source for r in catalogue.cone_search(df, *centre, 0.7, 16.0).collect()}
    from lumicurve.operators.match import sky_distance

    apart = sky_distance(np.array([centre[0]]), np.array([centre[1]]), ra, dec)
    assert got == {k for k in range(400) if apart[k] <= 0.7 and k % 20 < 16} and got
    stars = spark.createDataFrame([(centre[0], centre[1]), (None, None)], "ra double, dec double")
    assert {r.source for r in catalogue.night_catalogue(df, stars, 0.7, 16.0).collect()} == {k for k in range(400) if sky_distance(np.array([round(centre[0], 4)]), np.array([round(centre[1], 4)]), ra, dec)[k] <= 0.7 and k % 20 < 16}
    assert catalogue.night_catalogue(df, stars.limit(0), 0.7).count() == 0


def test_files_of_stars_sort_by_number(spark, tmp_path):
    for n in (9, 10, 100):
        (tmp_path / f"star_{n}_2sig.txt".replace("_2sig", "")).write_text(f"# star\nframe_a 0.5 {n}\nframe_b 1.5 {n + 1}\n\n")
    got = [(r.star, r.t, r.flux) for r in catalogue.star_files(spark, str(tmp_path)).orderBy("star", "line_no").collect()]
    assert got == [(n, t, float(n + k)) for n in (9, 10, 100) for k, t in enumerate((0.5, 1.5))]


def test_field_and_minute_lookups(spark):
    assert catalogue.field_radius(3, 4, 2.0, 1.5) == 7.5
    e = spark.createDataFrame([(1, 100.0), (2, 159.9), (3, 160.0), (4, 99.0)], "event_id long, t double")
    m = spark.createDataFrame([(100.0, "a"), (130.0, "b")], "start double, minute string")
    assert {r.event_id: r.minute for r in catalogue.minute_of(e, m).collect()} == {1: "a", 2: "b", 3: "b"}
    names = spark.createDataFrame([("redbird",), ("Green",), ("other",), (None,)], "n string").select(reports.colour(F.col("n")).alias("c"))
    assert [r.c for r in names.collect()] == ["Red", "Green", "other", None]


def test_logs_of_a_night(spark):
    logs = spark.createDataFrame([("Green", "20240101", 1), ("Red", "20240101", 2), ("Red", "20240102", 3), ("Blue", "20240101", 4), ("Blue", "20240102", 5)], "scope string, date string, n int")
    assert sorted(r.n for r in reports.night_logs(logs, "20240101", "20240102").collect()) == [2, 3]
    assert [r.n for r in reports.night_logs(logs, "20240101", "20240101").collect()] == [1]
    assert reports.night_logs(logs, "20240101", "20240105").count() == 0
    files = spark.createDataFrame([("/x/20240101_plan.csv",), ("/x/b.txt",)], "path string")
    assert reports.previous_date(files).collect()[0].date == "20240101" and reports.previous_date(files.limit(0)).collect()[0].date is None


def test_report_rows(spark):
    r = spark.createDataFrame([(1, 7, 1.0, 2.0, "t", 3, 0.5, -1), (2, 7, 1.0, 2.0, "t", -1, 0.5, 0)], "event_id int, star int, x double, y double, t string, kernel_id int, chi double, offset int")
    k = spark.createDataFrame([(3, 500.0, 0.1, 0.0, 0.5)], "kernel_id int, object_r double, star_d double, impact double, shift double")
    s = spark.createDataFrame([(7, 10.0, 20.0, 15.0, None)], "star int, ra double, dec double, gmag double, bp_rp double")
    lines = [x.value for x in reports.kernel_report(r, k, s).collect()]
    assert len(lines) == 1 and lines[0].split()[:7] == ["7", "1.000000", "2.000000", "t", "3", "0.500000", "-1"] and len(lines[0].split()) == 15
    bad = reports.errors(("sky", "no field", spark.createDataFrame([("Red",)], "scope string")), ("log", "no log", spark.createDataFrame([("Blue",)], "scope string")))
    assert {tuple(x) for x in bad.collect()} == {("Red", "sky", "no field"), ("Blue", "log", "no log")}
    meta = reports.star_meta(spark.createDataFrame([(1, 0.0)], "star int, x double"), spark.createDataFrame([(1, 5.0)], "star int, ra double"), spark.createDataFrame([(1, 9.0)], "star int, gmag double"))
    assert tuple(meta.collect()[0]) == (1, 0.0, 5.0, 9.0)
    with pytest.raises(Exception, match="twice"):
        reports.star_meta(spark.createDataFrame([(1, 0.0)], "star int, x double"), spark.createDataFrame([(1, 5.0), (1, 6.0)], "star int, ra double"), spark.createDataFrame([(1, 9.0)], "star int, gmag double")).collect()
    options = spark.createDataFrame([(1, 5.0, None), (2, 9.0, None), (3, None, None)], "star int, snr double, gmag double")
    assert [x.star for x in reports.star_options(options, (1.0, 2.0)).collect()] == [2, 1, 3]
    assert [x.star for x in reports.selected_stars(options, most=1).collect()] == [2] and [x.star for x in reports.selected_stars(options, [3, 99]).collect()] == [3]
    box = spark.createDataFrame([(1.0, 1.0), (1.5, 1.0), (9.0, 1.0)], "x double, y double")
    assert reports.at_place(box, 1.0, 1.0).count() == 1 and reports.at_place(box, 1.0, 1.0, 0.5).count() == 2
    sens = spark.createDataFrame([("m", k, float(k)) for k in range(5)], "minute string, k int, a double")
    assert tuple(reports.sensitivity_of_night(sens, "minute", F.col("a"), F.col("a") * 2, "k").collect()[0]) == ("m", 5, 2.0, 4.0)
    before = spark.createDataFrame([(1, [1.0, 0.5])], "kernel_id int, curve array<double>")
    assert tuple(reports.kernel_changes(before, before.withColumn("curve", F.array(F.lit(0.75)))).collect()[0]) == (1, 0.5, 0.25)
    t = spark.createDataFrame([(7300.0,)], "t double").select(reports.time_axis(F.col("t"), F.lit(100.0), "hours").alias("h"), reports.time_axis(F.col("t"), F.lit(100.0)).alias("s"))
    assert tuple(t.collect()[0]) == (2.0, 7200.0)
