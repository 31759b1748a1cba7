"""Tables in which many rows share a time, a place or a host, against their SQL or brute force."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumicurve.operators import bandjoin, match, trials
from lumicurve.plans import catalog


def write_events(folder, n=240, times=60, seed=3):
    """Events at a few times, most of them shared by several rows, one without a time and one without a value."""
    rng = np.random.default_rng(seed)
    kinds = rng.choice(["click", "view", "purchase", "error", "signup"], n)
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, times, n) * 20, unit="s")
    e = pd.DataFrame({"event_id": np.arange(n), "ts": at.astype("datetime64[us]"), "user_id": np.arange(n) % 7, "event_type": kinds, "value": at.minute * 1.5, "props": ""})
    e.loc[e.index[kinds == "click"][0], "ts"] = pd.NaT
    e.loc[e["ts"] == e["ts"][kinds == "view"].iloc[0], "value"] = None
    e.to_parquet(folder / "events.parquet", coerce_timestamps="us")
    return str(folder)


def same_as_sql(spark, folder, name, tables):
    got = [tuple(r) for r in catalog.QUERIES[name](spark, folder).collect()]
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = c.execute(catalog.ORACLES[name]).fetchall()
    key = lambda r: tuple((v is None, v) for v in r)
    assert len(got) == len(want) > 0
    assert sorted(got, key=key) == sorted(want, key=key)


def test_align_interp_of_times_that_several_samples_have(spark, tmp_path):
    same_as_sql(spark, write_events(tmp_path), "align_interp", ["events"])


@pytest.mark.parametrize("name", ["best_common_minute", "minute_pairs", "minute_of_event", "missing_scope", "coincidence_groups"])
def test_joins_by_time_where_many_share_a_time(spark, tmp_path, name):
    same_as_sql(spark, write_events(tmp_path), name, ["events"])


def test_joins_by_time_make_no_pairs(spark, tmp_path):
    """200 first rows and 200 second ones at one time: no step has more than a few rows each."""
    at = lambda name, n: spark.range(n).select(F.col("id").alias(name), F.lit(5.0).alias(name + "t"))
    found = bandjoin.first_within(at("a", 200), at("b", 200), "a", "at", "b", "bt", 1.0)
    assert {(r.a, r.b, r.bt) for r in found.collect()} == {(k, 0, 5.0) for k in range(200)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" not in plan


def test_first_within_at_the_edge_itself(spark):
    left = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, None), (4, 0.3)], "a long, at double")
    right = spark.createDataFrame([(7, 8.0), (8, 8.0), (9, 12.0), (5, 22.0), (6, None), (4, 0.1)], "b long, bt double")
    got = lambda tolerance, strict: {(r.a, r.b) for r in bandjoin.first_within(left, right, "a", "at", "b", "bt", tolerance, strict).collect()}
    assert got(2.0, False) == {(1, 7), (2, 5), (4, 4)}
    assert got(2.0, True) == {(4, 4)}
    # 0.3 - 0.1 is a little under 0.2 in doubles.
    assert got(0.2, True) == {(4, 4)}


def test_trials_scored_by_host_as_by_trial(spark):
    """Events in the middle, over both ends and none, of hosts with several packs of samples, and one host without samples."""
    rng = np.random.default_rng(4)
    rows = [(host, scope, i, float(v)) for host, n in (("a", 5000), ("b", 700)) for scope in ("T1", "T2") for i, v in enumerate(rng.normal(100, 3, n))]
    flux = spark.createDataFrame(rows, "host string, scope string, i long, flux double")
    plan = [(1, "inject", "a", 5000, 2500), (2, "inject", "a", 5000, 4999), (3, "null", "a", 5000, None), (4, "null", "a", 5000, None), (5, "inject", "b", 700, 3), (6, "inject", "c", 9, 4), (7, "inject", "b", 700, 350)]
    plan = spark.createDataFrame(plan, "trial long, kind string, host string, n long, center long")
    profiles = spark.createDataFrame([(t, rng.uniform(0.2, 1, 31 + t).tolist()) for t in (1, 2, 5, 6, 7)], "trial long, curve array<double>")
    detectors = trials.detector_grid(trials.shapes())
    order = ["trial", "detector", "scope"]
    want = trials.score_trials(trials.trial_flux(plan, flux, profiles), detectors).toPandas().sort_values(order).reset_index(drop=True)
    got = trials.score_hosts(plan, flux, profiles, detectors, 2).toPandas().sort_values(order).reset_index(drop=True)
    assert len(want) == 6 * 25 * 3
    pd.testing.assert_frame_equal(got, want, rtol=1e-12)


@pytest.mark.parametrize("top", [1, 4, 64])
def test_least_near_looks_beyond_the_least_of_a_cell(spark, top):
    """The least points of a cell lie where few see them, and one has no value."""
    rng = np.random.default_rng(6)
    at, place = rng.uniform(0, 2, 40), rng.uniform(0, 2, 150)
    value = np.where(place % 1 < 0.2, -1.0, 1.0) + np.round(rng.uniform(0, 0.3, 150), 1)
    cell = F.floor("x").cast("long")
    asks = spark.createDataFrame([(k, float(x)) for k, x in enumerate(at)], "a long, x double").withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    points = spark.createDataFrame([(k, float(x), None if k == 3 else float(v)) for k, (x, v) in enumerate(zip(place, value))], "p long, s double, v double")
    points = points.withColumn("_cell", F.floor("s").cast("long"))
    got = bandjoin.least_near(asks, points, "a", "v", lambda get: F.abs(F.col("x") - get("s")) < 0.3, lambda get: [get("p").alias("p")], top)
    rank = lambda k: (k != 3, 0 if k == 3 else float(value[k]), k)
    want = {a: min((k for k in range(150) if abs(at[a] - place[k]) < 0.3), key=rank) for a in range(40)}
    assert {r.a: r["_best"].p for r in got.collect()} == want


@pytest.mark.parametrize("name", ["pixel_match_all_scopes", "clean_scope_matches", "nearest_sky"])
def test_matches_in_a_dense_field_make_no_pairs(spark, tmp_path, monkeypatch, name):
    """600 stars nearer to each other than the tolerance, many in the same places, one without a place."""
    v = np.random.default_rng(2).normal(0, 0.125, (600, 64)).astype("float32")
    v[:, :2] *= 0.02
    v[300:450, :2], v[450:500, :2] = v[:150, :2], v[0, :2]
    v[590:, :2] += 3
    table = pd.DataFrame({"vec_id": np.arange(600), "embedding": v.tolist(), "label": 0})
    table.at[7, "embedding"] = [None, *table.at[7, "embedding"][1:]]
    table.to_parquet(tmp_path / "embeddings.parquet")

    def pairs(*args, **kwargs):
        raise AssertionError("all pairs within reach are made")

    monkeypatch.setattr(match, "plane_join", pairs)
    monkeypatch.setattr(bandjoin, "sky_join", pairs)
    same_as_sql(spark, str(tmp_path), name, ["embeddings"])


def test_events_scored_by_what_they_reach(monkeypatch):
    """Scores with an event equal those of the whole changed series, for every
    preprocessor, at the ends too, while few samples are prepared again."""
    rng = np.random.default_rng(21)
    n = 30_000
    series = {s: (np.arange(m), 800 + 30 * rng.standard_normal(m) + 20 * np.sin(np.arange(m) / 900)) for s, m in (("a", n), ("b", n), ("c", n - 700))}
    events = [(int(c), 1 - 0.3 * np.exp(-((np.arange(w) - w / 2) ** 2) / 20)) for c, w in ((3, 41), (700, 30), (15_000, 61), (n - 650, 41), (n - 4, 41), (n + 500, 41))]
    detectors = trials.detector_grid(trials.shapes())
    prepared, steps = [], dict(trials.PREPROCESSORS)
    for name, fn in steps.items():
        monkeypatch.setitem(trials.PREPROCESSORS, name, lambda x, fn=fn: (prepared.append(len(x)), fn(x))[1])
    got = trials.scored_events(series, detectors, events)
    assert sum(prepared) < len(steps) * (3 * n + len(events) * 3 * 5000)
    for (center, curve), rows in zip(events, got, strict=True):
        changed = {}
        for scope, (i, x) in series.items():
            low = center - len(curve) // 2
            a, b = np.searchsorted(i, [low, low + len(curve)])
            changed[scope] = x.copy()
            changed[scope][a:b] *= curve[i[a:b] - low]
        want = {r[:2]: r[2:] for r in trials._scored(changed, detectors)}
        assert len(rows) == len(want)
        for detector, scope, peak, frame in rows:
            assert (peak, frame) == (pytest.approx(want[detector, scope][0], rel=1e-9), want[detector, scope][1])
