"""Small parts: running medians, weather logs in order and by date, tables per target, axes, annuli, cumulative tables, plans."""

import numpy as np
import pandas as pd
import pytest

from lumicurve.operators import differential, match, numeric, reduction, series
from lumicurve.sources import catalogue, readers, sinks


@pytest.mark.parametrize("width", [1, 2, 5, 200])
def test_running_median_equals_numpy(width):
    rng = np.random.default_rng(width)
    for n in (1, 3, 250):
        x = rng.normal(size=n).round(1)
        if n == 250:
            x[[40, 41, 200]] = np.nan
        wide = np.pad(x, (width // 2, (width - 1) // 2), mode="symmetric")
        want = np.median(np.lib.stride_tricks.sliding_window_view(wide, width), axis=1)
        assert numeric.running_median(x, width) == pytest.approx(want, nan_ok=True)
    assert len(numeric.running_median(np.empty(0), width)) == 0


def test_weather_logs(spark, tmp_path):
    row = lambda t: ",".join([str(t), *"123456789"])
    (tmp_path / "weather.log").write_text(row(30.0) + "\n" + row(10.0) + "\n")
    (tmp_path / "weather.log.2025-08-29").write_text(row(20.0) + "\nbroken\n" + row(5.0) + "\n")
    folder = str(tmp_path)
    today, night = readers.weather_log(spark, folder, "20250830", "20250830"), readers.weather_log(spark, folder, "20250829", "20250830")
    assert (today, night) == (f"{folder}/weather.log", f"{folder}/weather.log.2025-08-29") and readers.weather_log(spark, folder, "20250801", "20250830") is None
    assert [r[0] for r in readers.weather_in_order(spark, today, night).collect()] == [5.0, 10.0, 20.0, 30.0]


def test_tables_per_target(spark, tmp_path):
    path = str(tmp_path / "curves")
    sinks.target_tables(spark.createDataFrame([(k, t, float(k * t)) for k in (1, 2, 3) for t in range(5)], "target long, t long, rel double").repartition(4), path)
    sinks.target_tables(spark.createDataFrame([(2, 0, -1.0)], "target long, t long, rel double"), path)
    assert sorted(p.name for p in (tmp_path / "curves").glob("target=*")) == ["target=1", "target=2", "target=3"]
    assert [r.t for r in spark.read.parquet(f"{path}/target=3").collect()] == list(range(5))
    assert [(r.t, r.rel) for r in spark.read.parquet(f"{path}/target=2").collect()] == [(0, -1.0)]


def test_axis_of_a_field(spark):
    rows = [("f", "a", 0.0, 1.0), ("f", "a", 2.0, 3.0), ("f", "a", 2.0, 2.5), ("f", "b", 1.0, None), ("g", "c", 9.0, 1.0), ("g", "c", None, 1.0)]
    d = spark.createDataFrame(rows, "field string, star string, t double, flux double")
    got = sorted((r.star, r.t, r.flux) for r in series.on_axis(d, "star", "t", "flux", "field").collect())
    assert got == sorted([("a", 0.0, 1.0), ("a", 1.0, None), ("a", 2.0, 2.5), ("b", 0.0, None), ("b", 1.0, None), ("b", 2.0, None), ("c", 9.0, 1.0)], key=lambda r: r[:2])


def test_matches_clean_in_every_scope(spark):
    m = spark.createDataFrame([(1, 11), (2, 12), (3, 13)], "ref long, one long")
    flux = lambda scope, star, n: [(scope, star, i, 0.0 if i in (0, 5) else 1.0) for i in range(n)]
    s = spark.createDataFrame(flux("zero", 1, 101) + flux("zero", 2, 101) + flux("zero", 3, 100) + flux("one", 11, 101) + flux("one", 12, 50) + flux("one", 13, 300), "scope string, star long, i long, flux double")
    assert [(r.ref, r.one) for r in match.clean_matches(m, s, {"zero": "ref", "one": "one"}).collect()] == [(1, 11)]


def test_a_ring_takes_the_background_off(spark):
    """The same stars on a flat field: apertures with a ring lose the field's light and nothing else."""
    y, x = np.mgrid[0:40, 0:40]
    star = lambda a, b: 500 * np.exp(-((x - a) ** 2 + (y - b) ** 2) / 4)
    rows = [("m", k, k * 0.025, (7.0 + star(14, 15) + star(26, 25)).ravel().tolist(), 40, 40) for k in range(2)]
    frames = spark.createDataFrame(rows, "minute string, frame long, t double, pixels array<double>, height int, width int")
    stars = spark.createDataFrame([("m", 0, 14.0, 15.0), ("m", 1, 26.0, 25.0)], "minute string, star int, x double, y double")
    drift = spark.createDataFrame([("m", 0.0, 0.0, 0.0)], "minute string, t0 double, vx double, vy double")
    from lumicurve.operators import images

    light = lambda ring: sorted((r.frame, r.star, r.flux) for r in images.drifting_photometry(frames, stars, drift, ["minute", "frame"], "minute", radius=3.0, annulus=ring).collect())
    for bare, ringed in zip(light(None), light((6.0, 9.0)), strict=True):
        assert bare[2] - ringed[2] == pytest.approx(7.0 * np.pi * 9, rel=0.03)
    assert reduction.Settings(annulus=(6.0, 9.0)).annulus == (6.0, 9.0)


def test_cumulative_table_and_observing_plan(spark, tmp_path):
    (tmp_path / "c.csv").write_text("obsdate,n\n2025-08-30,3\n2025-08-31,x\n2025-09-01,5\n")
    assert [tuple(r) for r in catalogue.cumulative_table(spark, str(tmp_path / "c.csv"), "obsdate string, n int").collect()] == [("2025-08-30", 3), ("2025-09-01", 5)]
    words = [f"w{k}" for k in range(18)]
    words[7], words[9], words[16] = "field3", "2460918.5", "120"
    line = " ".join(words) + " starts"
    log = spark.createDataFrame([("p", line), ("p", line), ("p", "no plan"), ("p", "starts too short")], "path string, line string")
    assert {tuple(r) for r in readers.observing_plan(log).collect()} == {("p", "field3", 2460918.5, 120), ("p", None, None, None)}


def test_idl_curves_equal_their_steps(spark):
    """The most similar references first, then the target less their common modes, over its median."""
    rng = np.random.default_rng(3)
    trend = 1 + 0.3 * np.sin(np.linspace(0, 7, 50))
    flux = {k: (100 + 7 * k) * (trend if k < 6 else 1.0) * (1 + 0.01 * rng.normal(size=50)) for k in range(9)}
    table = spark.createDataFrame([(k, t, float(v)) for k, c in flux.items() for t, v in enumerate(c)], "star long, t long, flux double")
    wanted = spark.createDataFrame([(0, k) for k in range(1, 9)], "target long, ref long")
    from lumicurve.operators import robust

    chosen = robust.similar_references(table, wanted, 0.5, 3)
    assert {r.ref for r in chosen.collect()} <= set(range(1, 6))
    steps = differential.pca_postselect(differential.members(table, chosen), components=2, fewest=3).toPandas().sort_values("t")
    got = differential.idl_relative_flux(table, wanted, 0.5, 3, 2).toPandas().sort_values("t")
    assert got.rel.to_numpy() == pytest.approx(steps.rel.to_numpy())
    assert got.rel_norm.to_numpy() == pytest.approx(steps.rel.to_numpy() / np.median(steps.rel[steps.rel > 0]))
    assert got.rel_norm.std() < pd.Series(flux[0] / np.median(flux[0])).std() / 3
