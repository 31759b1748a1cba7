"""Edges of the series, join and evaluation operators on hand-made data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicurve.functions import astro, text
from lumicurve.operators import bandjoin, detect, evaluate, match, numeric, robust, rollup, series


def curve(spark, values, star="s"):
    return spark.createDataFrame([(star, k, float(v)) for k, v in enumerate(values)], "star string, i long, flux double")


def test_detrend_of_a_constant_is_zero(spark):
    assert series.detrend(curve(spark, [7.0] * 300), "star", "flux").where("abs(d) > 1e-12").count() == 0


def test_boxcar_equals_numpy(spark):
    x = np.random.default_rng(1).normal(size=260)
    got = series.boxcar(curve(spark, x), "star", "flux", 200).orderBy("i").toPandas()["trend"].to_numpy()
    assert np.allclose(got, numeric.running_mean(x, 200))


def test_dip_is_found_where_it_is(spark):
    x = 100 + np.random.default_rng(2).normal(0, 1, 600)
    x[300:306] *= 0.5
    x = np.concatenate([[0, 0, 0], x, [0, 0]])
    d = detect.dip_detection(curve(spark, x), "star", "i", "flux").collect()[0]
    assert abs(d.frame - 305.5) <= 3 and d.detected and d.significance > 5
    assert detect.dip_detection(curve(spark, [1.0] * 99), "star", "i", "flux").count() == 0


def test_trim_keeps_zeros_inside(spark):
    x = [0.0] * 5 + [1.0] * 50 + [0.0] + [1.0] * 60 + [0.0] * 5
    kept = series.trim_zeros(curve(spark, x), "star", "flux")
    assert kept.count() == 111 and kept.agg(F.min("i"), F.max("i")).collect()[0][:] == (5, 115)
    assert series.trim_zeros(curve(spark, [0.0] * 200), "star", "flux").count() == 0


def test_gaps_are_strict(spark):
    t = [0.0, 0.025, 0.025 + 0.0374, 0.1374, 0.1374 + 0.0376]
    df = spark.createDataFrame([("s", v) for v in t], "star string, t double")
    assert [r.gap for r in series.gap_mask(df, "star", "t").orderBy("t").collect()] == [False, False, False, True, True]


def test_bins_hold_the_right_edge_and_empty_bins(spark):
    df = spark.createDataFrame([("s", 0.0, 1.0), ("s", 1.0, 3.0), ("s", 4.0, 5.0)], "star string, t double, flux double")
    b = series.time_bins(df, "star", "t", "flux", 1.0).orderBy("bin").collect()
    assert [(r.bin, r.value, r.n) for r in b] == [(0, 1.0, 1), (1, 3.0, 1), (2, None, 0), (3, 5.0, 1)]


def test_axis_is_made_up_only_over_half(spark):
    df = spark.createDataFrame([("a", k, 1.0) for k in range(4)] + [("b", k, float(k // 2)) for k in range(5)], "star string, i long, t double")
    out = {(r.star, r.i): r.t_axis for r in series.synthetic_axis(df, "star", "i", "t").collect()}
    assert out["a", 3] == pytest.approx(1.075) and out["b", 3] == 1.0


def test_band_join_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    a, b = rng.uniform(-5, 5, 60).round(1), rng.uniform(-5, 5, 60).round(1)
    left = spark.createDataFrame([(k, float(v)) for k, v in enumerate(a)], "a long, at double")
    right = spark.createDataFrame([(k, float(v)) for k, v in enumerate(b)], "b long, bt double")
    got = {(r.a, r.b) for r in bandjoin.band_join(left, right, "at", "bt", 0.5).collect()}
    assert got == {(i, j) for i in range(60) for j in range(60) if abs(a[i] - b[j]) <= 0.5}
    plan = bandjoin.band_join(left, right, "at", "bt", 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sky_join_crosses_zero_and_poles(spark):
    rows = [(0, 359.9999, 0.0), (1, 0.0, 89.9999), (2, 180.0, 89.9999), (3, 10.0, -30.0)]
    left = spark.createDataFrame(rows, "a long, ra1 double, dec1 double")
    right = spark.createDataFrame([(0, 0.0001, 0.0), (1, 90.0, 89.9999), (2, 10.0, -30.0002)], "b long, ra2 double, dec2 double")
    got = {(r.a, r.b) for r in bandjoin.sky_join(left, right, ("ra1", "dec1"), ("ra2", "dec2"), 0.0005).collect()}
    assert got == {(0, 0), (1, 1), (2, 1), (3, 2)}


def test_nearest_in_time_takes_the_earlier_on_ties(spark):
    left = spark.createDataFrame([(1, 10.0), (2, -100.0), (3, 500.0)], "id long, t double")
    right = spark.createDataFrame([(1, 0.0), (2, 20.0), (3, 40.0)], "dark long, td double")
    out = {r.id: (r.dark, r.dt) for r in bandjoin.asof_nearest(left.withColumn("k", F.lit(1)), right.withColumn("k", F.lit(1)), "id", "t", "td", ["dark"], ["k"]).collect()}
    assert out == {1: (1, 10.0), 2: (1, 100.0), 3: (3, 460.0)}


def detections(spark, rows):
    return spark.createDataFrame(rows, "det_id long, scope string, t double, ra double, dec double")


def test_coincidences_tiers_and_missing(spark):
    d = detections(spark, [(1, "green", 0.0, 1.0, 1.0), (2, "red", 0.1, 1.001, 1.0), (3, "blue", 0.9, None, None), (4, "green", 50.0, 1.0, 1.0), (5, "blue", 51.0, 2.0, 2.0), (6, "red", 90.0, 1.0, 1.0)])
    m = match.coincidences(d)
    assert {(r.match_id, r.det_id) for r in m.collect()} == {(2, 1), (2, 2), (2, 3), (4, 4), (4, 5)}
    full = m.join(d.drop("scope"), "det_id")
    assert {(r.match_id, r.n, r.tier) for r in match.tiers(full).collect()} == {(2, 3, "Tier3"), (4, 2, "Tier1")}
    assert {r.match_id for r in match.coordinate_verified(full).collect()} == {2}
    assert {(r.match_id, r.scope) for r in match.missing_scope(m).collect()} == {(4, "red")}
    shuffled = match.coincidences(d.orderBy(F.desc("t")))
    assert {tuple(r) for r in shuffled.collect()} == {tuple(r) for r in m.collect()}


def test_stars_keep_their_ids_over_minutes(spark):
    rows = [("n", m, k, 10.0 * k + 0.1 * m, 5.0) for m in range(4) for k in range(3)] + [("n", 3, 3, 99.0, 99.0)]
    out = match.global_star_ids(spark.createDataFrame(rows, "night string, minute long, local long, x double, y double"), "night").toPandas()
    assert out.groupby("local")["star_id"].nunique().max() == 1 and out["star_id"].nunique() == 4


def test_roc_falls_with_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows = [("inject" if k % 2 else "null", float(rng.normal(3 if k % 2 else 1)), 20, 20) for k in range(200)]
    r = evaluate.roc(spark.createDataFrame(rows, "kind string, peak double, frame long, center long")).orderBy("point").toPandas()
    assert (r.completeness.diff().dropna() <= 0).all() and (r.far.diff().dropna() <= 0).all() and len(r) == 80


def test_joint_score_of_copies(spark):
    rows = [(s, k, float(k)) for s in "abc" for k in range(5)]
    j = detect.joint_score(spark.createDataFrame(rows, "scope string, i long, score double"), [])
    assert all(r.joint == pytest.approx(math.sqrt(3) * r.i) for r in j.collect())


def test_sigma_clip_and_mad(spark):
    df = curve(spark, [1.0, 2.0, 3.0, 2.0, 2.5, 1.5, 100.0, None and 0 or 2.0])
    kept = robust.sigma_clip(df, "star", "flux", 3.0, 2)
    assert kept.where("flux IS NULL").count() == 1


def test_upsert_is_idempotent(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "B"), (3, "c")], "k long, v string")
    once = rollup.upsert(old, new, "k")
    assert sorted(map(tuple, rollup.upsert(once, new, "k").collect())) == [(1, "a"), (2, "B"), (3, "c")]


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(10.0, 20.0), (359.9, 21.0), (1.0, 19.5)], "ra double, dec double")
    p = astro.tangent_plane(F.col("ra"), F.col("dec"), 2.0, 20.0)
    b = df.select("ra", "dec", p["xi"].alias("xi"), p["eta"].alias("eta"))
    q = astro.from_tangent_plane(F.col("xi"), F.col("eta"), 2.0, 20.0)
    for r in b.select("ra", "dec", q["ra"].alias("r"), q["dec"].alias("d")).collect():
        assert r.r == pytest.approx(r.ra) and r.d == pytest.approx(r.dec)


def test_text_functions(spark):
    df = spark.createDataFrame([("det_20250830_03.04.05.678_x.txt", "2025-08-30T25:01:02.5Z", "Sat Aug 30 03:04:05 UTC 2025 INFO"), ("none", "2025-08-30T05:01:02Z", "x")], "n string, iso string, l string")
    r = df.select(text.minute_key(F.col("n")).alias("k"), text.repaired_hour(F.col("iso")).alias("h"), F.unix_seconds(text.log_time(F.col("l"))).alias("t")).collect()
    assert r[0].k == "20250830_03.04.05.678" and r[1].k is None
    assert r[0].h == "2025-08-30T01:01:02.5Z" and r[1].h == "2025-08-30T05:01:02Z"
    assert r[0].t == 1756523045 and r[1].t is None


def test_band_pass_gain():
    t = np.arange(2000) / 40.0
    for f, low, high in ((5.0, 0.97, 1.03), (0.05, 0.0, 0.02), (19.0, 0.0, 0.05)):
        y = numeric.bandpass(np.sin(2 * np.pi * f * t))[400:-400]
        assert low <= np.sqrt(2 * (y**2).mean()) <= high


def test_bessel_identities():
    x = np.linspace(0.1, 30, 50)
    assert np.allclose(numeric.bessel_j(0, x) + numeric.bessel_j(2, x), 2 / x * numeric.bessel_j(1, x))
    assert float(numeric.bessel_j(0, np.array(2.404825557695773))) == pytest.approx(0, abs=1e-12)


def test_occultation_has_unit_baseline_and_a_dip():
    c = numeric.occultation_curve(0.025, (4e-7, 7e-7), 1500.0, 0.0, 40.0, 0.02, 0.0, colours=4, ring=2, step=20.0)
    assert c.min() < 0.6 and abs(np.median(c[:10]) - 1) < 0.05
    assert (numeric.normalised_profile(np.ones(10)) == [1.0]).all()


def test_whitened_score_finds_the_template():
    x = np.random.default_rng(6).normal(size=1200)
    template = -np.array(series.ricker(6.0))
    x[600 - 24 : 600 + 25] += 8 * template
    assert abs(int(np.argmax(numeric.whitened_score(x, template))) - 600) <= 2
