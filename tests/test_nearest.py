"""Nearest points by growing cells against all pairs: even, clumped and sparse fields, ties, few points, the sky."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicurve.operators import nearest


def frame(spark, ids, places, name, xs=("x", "y")):
    rows = [(int(i), *map(float, p)) for i, p in zip(ids, places, strict=True)]
    return spark.createDataFrame(rows, f"{name} long, " + ", ".join(f"{x} double" for x in xs)).repartition(4)


def all_pairs(a_ids, a, b_ids, b, k, exclude_same=False):
    out = set()
    for i, p in zip(a_ids, a, strict=True):
        d = np.sqrt(((np.asarray(b) - p) ** 2).sum(axis=1))
        near = sorted((x, j) for x, j in zip(d.tolist(), b_ids, strict=True) if not (exclude_same and i == j))[:k]
        out |= {(int(i), int(j), rank) for rank, (_, j) in enumerate(near, 1)}
    return out


def fields(name):
    r = np.random.default_rng(6)
    if name == "even":
        return r.uniform(0, 10, (150, 2)), r.uniform(0, 10, (300, 2))
    if name == "clumped":  # a dense clump, a thin field, a far outlier
        return np.vstack([r.normal(5, 0.001, (40, 2)), r.uniform(0, 10, (40, 2)), [[900.0, -700.0], [5.2, 5.0]]]), np.vstack([r.normal(5, 0.001, (250, 2)), r.uniform(0, 10, (30, 2)), [[-300.0, 4.0]]])
    if name == "ties":
        grid = np.array([(x, y) for x in range(8) for y in range(8)], float)
        return np.vstack([grid, grid + 0.5]), np.vstack([grid, grid])
    return r.uniform(0, 1, (20, 2)), r.uniform(0, 1, (3, 2))


@pytest.mark.parametrize("name", ["even", "clumped", "ties", "few"])
@pytest.mark.parametrize("k", [1, 6])
def test_equal_to_all_pairs(spark, name, k):
    a, b = fields(name)
    got = nearest.k_nearest(frame(spark, range(len(a)), a, "target"), frame(spark, range(len(b)), b, "point"), k)
    assert {(r.target, r.point, r.rank) for r in got.collect()} == all_pairs(range(len(a)), a, range(len(b)), b, k)


def test_excluding_the_same_id_in_space(spark):
    r = np.random.default_rng(1)
    p = r.normal(size=(120, 3))
    got = nearest.k_nearest(frame(spark, range(120), p, "target", ("u", "v", "w")), frame(spark, range(120), p, "point", ("u", "v", "w")), 4, ("u", "v", "w"), exclude_same=True)
    assert {(x.target, x.point, x.rank) for x in got.collect()} == all_pairs(range(120), p, range(120), p, 4, True)


def test_pairs_stay_near_k_in_a_clump(spark):
    """In a field with a clump of 4,000 points in a thousandth of its width, a target meets a few cells of some k points."""
    r = np.random.default_rng(3)
    p = np.vstack([r.normal(5, 0.003, (4000, 2)), r.uniform(0, 10, (1000, 2))])
    points, targets = frame(spark, range(5000), p, "point"), frame(spark, range(5000), p, "target")
    size, levels = nearest.finest_grid(targets, points, ("x", "y"), 7)
    level = nearest.levels_of(targets, points, ("x", "y"), size, levels, 7)
    cells = targets.withColumns(dict(zip(["_c0", "_c1"], nearest._cells(("x", "y"), size, 0), strict=True))).join(level, ["_c0", "_c1"]).drop("_c0", "_c1")
    pairs = nearest._looked_up(cells, points, ("x", "y"), size, "target", "point", True).groupBy("_t").count().agg(F.avg("count"), F.count_if(F.col("count") > 1000)).collect()[0]
    # All pairs within the radius that thin places need would be 4,000 for every target of the clump; only
    # targets of the thin field that have the clump beside them meet so many.
    assert pairs[0] < 9 * nearest.DENSEST * 7 and pairs[1] < 20


def test_null_places_and_no_points(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (None, 1.0, 1.0)], "target long, x double, y double")
    p = spark.createDataFrame([(5, 3.0, 4.0), (6, None, None)], "point long, x double, y double")
    assert [tuple(r) for r in nearest.k_nearest(t, p, 3).collect()] == [(1, 5, 5.0, 1)]
    assert nearest.k_nearest(t, p.limit(0), 3).collect() == [] and nearest.k_nearest(t.limit(0), p, 3).collect() == []


def test_nearest_star_on_the_sky_else_in_pixels(spark):
    stars = spark.createDataFrame([(1, 359.9, 0.0, 0.0, 0.0), (2, 10.0, 89.0, 50.0, 50.0), (3, None, None, 3.0, 4.0)], "star long, ra double, dec double, x double, y double")
    t = spark.createDataFrame([(1, 0.2, 0.1, 3.0, 4.0), (2, 190.0, 89.5, 0.0, 0.0), (3, None, 5.0, 2.5, 4.0), (4, None, None, None, 1.0)], "target long, ra double, dec double, x double, y double")
    got = {r.target: (r.star, r.by, round(r.d, 6)) for r in nearest.nearest_star(t, stars).collect()}
    assert got == {1: (1, "sky", pytest.approx(np.hypot(0.3, 0.1), abs=1e-4)), 2: (2, "sky", 1.5), 3: (3, "pixels", 0.5)}
    lone = nearest.nearest_star(t, stars.where("star = 3"))
    assert {(r.target, r.by) for r in lone.collect()} == {(1, "pixels"), (2, "pixels"), (3, "pixels")}
