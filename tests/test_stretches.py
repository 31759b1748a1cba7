"""Operators by stretches give the rows of the operators on whole series."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumicurve.operators import detect, series, stretches

KEY = "star"


@pytest.fixture(scope="module")
def flux(spark):
    """Series of 1 to 300 samples, one with a null key, some with nulls, zeros at the ends and equal times."""
    r = random.Random(8)
    rows = []
    for k, n in enumerate([1, 2, 3, 9, 10, 11, 60, 120, 300]):
        for i in range(n):
            v = 0.0 if i < k % 3 or i >= n - k % 2 else r.gauss(10, 1) - 6 * math.exp(-(((i - n // 2) / 3) ** 2))
            rows.append((f"s{k}" if k else None, i // 2 * 1.5 + (i // 40) ** 2, i, None if k == 6 and i % 17 == 3 else v))
    return spark.createDataFrame(rows, "star string, t double, event_id long, flux double").repartition(5).cache()


def same(a, b, columns, digits=9):
    rows = lambda d: sorted((tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in d.select(*columns).collect()), key=repr)
    left = rows(a)
    assert left == rows(b)
    return left


@pytest.mark.parametrize("length", [4, 7, 50, 1000])
def test_indexed(flux, length):
    same(stretches.indexed(flux, KEY, ["t", "event_id"], "i", "n", length), series.indexed(flux, KEY, ["t", "event_id"], "i", "n"), ["star", "event_id", "i", "n"])


def test_indexed_with_null_times(spark):
    d = spark.createDataFrame([("a", None, k) for k in range(5)] + [("a", float(k), k) for k in range(9)] + [("b", None, 1)], "star string, t double, e long")
    same(stretches.indexed(d, KEY, ["t", "e"], length=3), series.indexed(d, KEY, ["t", "e"]), ["star", "t", "e", "i"])


@pytest.mark.parametrize("length", [4, 7, 50, 1000])
@pytest.mark.parametrize("width", [1, 2, 5, 20, 41])
def test_boxcar_and_detrend(flux, length, width):
    d = series.indexed(flux, KEY, ["t", "event_id"])
    same(stretches.boxcar(d, KEY, "flux", width, length=length), series.boxcar(d, KEY, "flux", width), ["star", "i", "trend"])


@pytest.mark.parametrize("length", [5, 64])
@pytest.mark.parametrize("mode", ["valid", "same"])
def test_convolve(flux, length, mode):
    d, taps = series.indexed(flux, KEY, ["t", "event_id"]), series.ricker(3.0, 25)
    assert same(stretches.convolve(d, KEY, "flux", taps, mode=mode, length=length), series.convolve(d, KEY, "flux", taps, mode=mode), ["star", "i", "c"])


@pytest.mark.parametrize("length", [6, 33, 1000])
def test_dip_detection(flux, length):
    d = flux.where("star <> 's6' OR star IS NULL")
    options = {"detrend_width": 20, "kernel_width": 3.0, "taps": 13, "threshold": 2.0, "least": 50}
    found = same(stretches.dip_detection(d, KEY, ["t", "event_id"], "flux", length=length, **options), detect.dip_detection(d, KEY, ["t", "event_id"], "flux", **options), ["star", "frame", "conv_min", "bkg_mean", "bkg_std", "n_conv", "significance", "detected"], 7)
    assert len(found) == 2 and all(r[-1] for r in found)


@pytest.mark.parametrize("length", [6, 100])
def test_bank_scores_and_sigma(flux, length):
    bank = {"a": detect.box(3), "b": [-1.0] * 9, "c": [-x for x in series.ricker(2.0, 15)]}
    d = stretches.with_sigma(series.indexed(flux, KEY, ["t", "event_id"]), KEY, "flux")
    same(stretches.bank_scores(d, KEY, "flux", bank, "sigma", length=length), detect.bank_scores(d, KEY, "flux", bank, "sigma"), ["star", "i", "score"])


def test_steps(flux):
    got = stretches.steps(flux, KEY, ["t", "event_id"], "t", length=7).groupBy(KEY).agg(F.count("dt").alias("n"), F.median("dt").alias("cadence"))
    same(got.select("star", "cadence"), series.cadence(flux, KEY, ["t", "event_id"], "t"), ["star", "cadence"])


def test_tasks_hold_a_stretch_at_most(spark):
    """One series of 20,000 samples is dealt to many tasks, none with more than a stretch and its halo."""
    d = spark.range(20_000).select(F.lit("x").alias("star"), F.col("id").alias("i"), F.rand(1).alias("flux"))
    wide = stretches.with_halo(d, "i", 124, 124, 500).groupBy("star", "_stretch").count().toPandas()
    # Forty stretches, and the halo of one behind the end, which has no samples of its own.
    assert len(wide) == 41 and wide["count"].max() == 748 and wide.loc[wide["_stretch"] == 40, "count"].item() == 124


def test_bandpass_by_stretches_equals_the_whole_series(spark, tmp_path, monkeypatch):
    """No group holds a whole series, and a series with a missing value has none, as before."""
    rng = np.random.default_rng(7)
    n = 9000
    e = pd.DataFrame({"event_id": np.arange(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="s"), "user_id": 1, "event_type": np.where(np.arange(n) < 8900, "click", "view"), "value": 100 + rng.normal(0, 5, n), "props": ""})
    e.loc[8950, "value"] = None
    e["ts"] = e["ts"].astype("datetime64[us]")
    e.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    from lumicurve.operators import numeric
    from lumicurve.plans import catalog
    from lumicurve.plans import numeric as plans

    monkeypatch.setattr(plans, "STRETCH", 250)
    monkeypatch.setattr(numeric, "per_series", None)
    got = catalog.QUERIES["bandpass"](spark, str(tmp_path)).toPandas().sort_values(["star", "i"])
    assert got[got.star == "view"].band.isna().all() and len(got) == n
    assert got[got.star == "click"].band.to_numpy() == pytest.approx(numeric.bandpass(e.value.to_numpy()[:8900]).round(6), abs=2e-6)
