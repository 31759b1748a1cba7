"""Stars followed by place and light: crossing, faint and lost ones, ties, edges, and loops over all pairs."""

import math
import random

import numpy as np
import pytest

from lumicurve.operators import tracking
from lumicurve.plans import catalog

STARS, SOURCES = "field string, star long, x double, y double, flux double", "field string, frame long, x double, y double, flux double"


def track(spark, stars, sources, **options):
    a, b = spark.createDataFrame(stars, STARS).repartition(3), spark.createDataFrame(sources, SOURCES).repartition(3)
    return {(r.field, r.frame, r.star): (r.x, r.y, r.flux, r.found) for r in tracking.track_stars(a, b, "field", **options).collect()}


def loops(stars, sources, reach=6.0, ratio=2.0, smoothing=0.5):
    out = {}
    for field in {s[0] for s in stars}:
        known = {s[1]: [s[2], s[3], s[4]] if None not in s[2:4] else [None, None, s[4]] for s in sorted((x for x in stars if x[0] == field), key=lambda s: s[1])}
        for frame in sorted({s[1] for s in sources if s[0] == field and s[1] is not None}):
            seen = sorted((s[2:] for s in sources if s[:2] == (field, frame)), key=lambda s: tuple((v is not None, v or 0) for v in s))
            pairs = []
            for star, (x, y, f) in known.items():
                for j, (a, b, g) in enumerate(seen):
                    if None not in (x, y, a, b, g) and g > 0:
                        d = math.hypot(x - a, y - b)
                        if d < reach and (not f or f <= 0 or abs(math.log(g / f)) <= math.log(ratio)):
                            pairs.append((d, star, j))
            mine = {}
            for _, star, j in sorted(pairs):
                if star not in mine and j not in mine.values():
                    mine[star] = j
            moves = [(seen[j][0] - known[s][0], seen[j][1] - known[s][1]) for s, j in mine.items()]
            shift = np.median(moves, axis=0).tolist() if moves else [0.0, 0.0]
            for star, k in known.items():
                if star in mine:
                    a, b, g = seen[mine[star]]
                    known[star] = [a, b, k[2] + smoothing * (g - k[2]) if k[2] and k[2] > 0 else g]
                    out[field, frame, star] = (a, b, g, True)
                else:
                    if k[0] is not None and k[1] is not None:
                        known[star][:2] = [k[0] + shift[0], k[1] + shift[1]]
                    out[field, frame, star] = (*known[star][:2], None, False)
    return out


def same(got, want):
    assert set(got) == set(want)
    for key, row in want.items():
        assert got[key][3] == row[3] and got[key][:3] == pytest.approx(row[:3], nan_ok=True) if None not in row[:3] else [v if v is None else round(v, 9) for v in got[key]] == [v if v is None else round(v, 9) for v in row], key


def test_crossing_stars_keep_apart_by_their_light(spark):
    stars = [("f", 1, 10.0, 50.0, 1000.0), ("f", 2, 30.0, 50.0, 100.0)]
    sources = [x for k in range(21) for x in (("f", k, 10.0 + k, 50.0, 1000.0 + k), ("f", k, 30.0 - k, 50.2, 100.0))]
    got = track(spark, stars, sources)
    assert all(got["f", k, 1][:2] == (10.0 + k, 50.0) and got["f", k, 2][:2] == (30.0 - k, 50.2) for k in range(21))


def test_lost_stars_move_with_their_field(spark):
    """A faint star is out of sight for three frames of a drifting field and is found again where it has gone."""
    stars = [("f", k, 20.0 * k, 20.0, 100.0 + k) for k in range(1, 6)]
    sources = [("f", t, 20.0 * k + 2 * t, 20.0 - t, 100.0 + k) for t in range(1, 9) for k in range(1, 6) if not (k == 3 and 3 <= t <= 5)]
    got = track(spark, stars, sources)
    assert [got["f", t, 3][3] for t in range(1, 9)] == [True, True, False, False, False, True, True, True]
    assert all(got["f", t, 3][:2] == pytest.approx((60.0 + 2 * t, 20.0 - t)) for t in range(1, 9)) and got["f", 4, 3][2] is None


def test_equal_to_loops(spark):
    r = random.Random(5)
    stars = [(f, k, r.uniform(0, 100), r.uniform(0, 100), r.uniform(50, 500)) for f in ("a", "b", "c") for k in range(25)]
    sources = [(f, t, x + r.gauss(0, 1) + t, y + r.gauss(0, 1), g * r.uniform(0.7, 1.4)) for f, _, x, y, g in stars if f != "c" for t in range(6) if r.random() < 0.85]
    sources += [("a", t, r.uniform(0, 100), r.uniform(0, 100), r.uniform(50, 500)) for t in range(6) for _ in range(10)] + [("d", 0, 1.0, 1.0, 1.0)]
    same(track(spark, stars, sources), loops(stars, sources))


def test_ties_nulls_and_no_light(spark):
    stars = [("f", 1, 0.0, 0.0, 10.0), ("f", 2, 2.0, 0.0, 10.0), ("f", 3, None, 0.0, 10.0), ("f", 4, 50.0, 50.0, None), ("f", 5, 80.0, 80.0, 0.0)]
    sources = [("f", 0, 1.0, 0.0, 10.0), ("f", 0, None, 0.0, 10.0), ("f", 0, 50.0, 51.0, 7.0), ("f", 0, 50.0, 51.5, None), ("f", 0, 80.0, 80.0, -1.0), ("f", None, 0.0, 0.0, 1.0), ("f", 2, 1.0, 0.5, 40.0)]
    got = track(spark, stars, sources)
    same(got, loops(stars, sources))
    # Both stars are as near: the lower one has the source; one of four times the light is nobody's.
    assert got["f", 0, 1][3] and not got["f", 0, 2][3] and not got["f", 2, 1][3] and got["f", 0, 4][:3] == (50.0, 51.0, 7.0) and not got["f", 0, 5][3]
    assert track(spark, stars, [("f", 0, 1.0, 1.0, 1.0)][:0] + [("g", 0, 1.0, 1.0, 1.0)]) == {}


def test_query_follows_every_vector(spark):
    sf = "/root/testdata/sf0.001"
    got = catalog.QUERIES["tracked_stars"](spark, sf).collect()
    vectors = {r.vec_id: [float(v) for v in r.embedding] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    fields = {r.vec_id: r.label for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    stars = [(fields[k], k, v[0] * 1000, v[1] * 1000, (v[2] + 2) * 100) for k, v in vectors.items()]
    sources = [(fields[k], t, v[0] * 1000 + t + v[3 + t], v[1] * 1000 - t + v[13 + t], (v[2] + 2) * 100 * (1 + v[33 + t] / 4)) for k, v in vectors.items() for t in range(10) if v[23 + t] < 0.15]
    want = loops(stars, sources)
    assert len(got) == len(want)
    for r in got:
        w = want[r.field, r.frame, r.star]
        assert r.found == w[3] and (r.x, r.y) == pytest.approx(w[:2], abs=2e-6)
