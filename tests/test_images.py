"""Photometry on frames against sums written out, on made frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicurve.operators import images


def star_field(places, size=64, sigma=1.3, light=4000.0, level=100.0, noise=2.0, seed=1):
    y, x = np.mgrid[:size, :size]
    image = np.random.default_rng(seed).normal(level, noise, (size, size))
    for px, py in places:
        image += light / (2 * np.pi * sigma**2) * np.exp(-((x - px) ** 2 + (y - py) ** 2) / (2 * sigma**2))
    return image


def as_frames(spark, named):
    rows = [(k, img.ravel().tolist(), *img.shape) for k, img in named]
    return spark.createDataFrame(rows, "frame long, pixels array<double>, height int, width int").repartition(2)


PLACES = [(12.3, 20.7), (40.0, 8.5), (50.2, 50.9), (22.6, 44.1)]


def test_stars_are_found_where_they_are(spark):
    f = as_frames(spark, [(0, star_field(PLACES)), (1, star_field([]))])
    found = images.find_stars(f, "frame", 4.0, margin=3.0).toPandas()
    assert set(found.frame) == {0} and len(found) == 4
    for x, y in PLACES:
        near = found[np.hypot(found.x - x, found.y - y) < 0.3]
        assert len(near) == 1 and near.flux.iloc[0] == pytest.approx(4000, rel=0.15) and near.axis_ratio.iloc[0] > 0.8
        assert near.r.iloc[0] == pytest.approx(np.sqrt(near.npix.iloc[0] / np.pi) / 2)
    assert images.find_stars(f.limit(0), "frame").count() == 0


def test_regions_equal_a_flood_fill():
    rng = np.random.default_rng(4)
    for density in (0.2, 0.4, 0.7):
        mask = rng.uniform(size=(30, 37)) < density
        label, n = np.zeros(mask.shape, int), 0
        for start in zip(*np.nonzero(mask), strict=True):
            if label[start]:
                continue
            n += 1
            todo = [start]
            while todo:
                y, x = todo.pop()
                if 0 <= y < 30 and 0 <= x < 37 and mask[y, x] and not label[y, x]:
                    label[y, x] = n
                    todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        got = images.regions(mask)
        assert (got == label).all()


def test_background_of_a_slope(spark):
    y, x = np.mgrid[:200, :150]
    slope = 50 + 0.02 * x + 0.01 * y
    image = slope + np.random.default_rng(2).normal(0, 1, x.shape)
    image[90:93, 70:73] += 500
    level, rms = images.background(image)
    assert np.abs(level - slope)[60:140, 50:100].max() < 1 and 0.8 < rms < 2
    f = as_frames(spark, [(0, image)])
    row = images.background_level(f, "frame").collect()[0]
    assert row.level == pytest.approx(np.median(level)) and row.rms == pytest.approx(rms)
    left = np.array(images.subtract_background(f).collect()[0].pixels).reshape(image.shape)
    assert np.allclose(left, image - level)


def test_circles_equal_points_written_out():
    image = np.random.default_rng(3).uniform(0, 10, (20, 23))
    xs, ys = [10.2, 0.4, 22.9, 5.5, np.nan], [9.7, 0.1, 19.2, 12.5, 3.0]

    def share(px, py, x, y, r):
        return sum((px + (i + 0.5) / 5 - 0.5 - x) ** 2 + (py + (j + 0.5) / 5 - 0.5 - y) ** 2 <= r * r for i in range(5) for j in range(5)) / 25

    for annulus in (None, (4.0, 6.0)):
        got = images.circle_sums(image, np.array(xs), np.array(ys), 3.0, annulus)
        for k in range(4):
            own, ring, area, ring_area = 0.0, 0.0, 0.0, 0.0
            for py in range(20):
                for px in range(23):
                    s = share(px, py, xs[k], ys[k], 3.0)
                    own, area = own + s * image[py, px], area + s
                    if annulus:
                        s = share(px, py, xs[k], ys[k], 6.0) - share(px, py, xs[k], ys[k], 4.0)
                        ring, ring_area = ring + s * image[py, px], ring_area + s
            assert got[k] == pytest.approx(own - (ring / ring_area * area if annulus else 0))
        assert np.isnan(got[4])


def test_centroids_move_to_the_light(spark):
    f = as_frames(spark, [(0, star_field(PLACES, level=0.0, noise=0.5))])
    rough = spark.createDataFrame([(0, k, x + 0.6, y - 0.5) for k, (x, y) in enumerate(PLACES)], "frame long, star int, x double, y double")
    got = images.refined(images.with_stars(f, rough, "frame"), "frame", 1.5).orderBy("star").collect()
    assert all(abs(r.x - x) < 0.05 and abs(r.y - y) < 0.05 for r, (x, y) in zip(got, PLACES, strict=True))
    x, y = images.windowed_centroids(np.zeros((20, 20)), np.array([5.0, np.nan]), np.array([6.0, 1.0]), 1.5)
    assert (x[0], y[0]) == (5.0, 6.0)


def test_registration_finds_the_shift(spark):
    moved = [(0, PLACES), (1, [(x + 2.0, y - 3.0) for x, y in PLACES]), (2, [(x - 1.4, y + 0.6) for x, y in PLACES])]
    f = as_frames(spark, [(k, star_field(p, noise=0.2, seed=k)) for k, p in moved]).withColumn("field", F.lit(1))
    got = {r.frame: (r.dx, r.dy) for r in images.rigid_shifts(f, "field", "frame").collect()}
    assert got[0] == (0, 0) and got[1] == pytest.approx((2.0, -3.0), abs=0.1) and got[2] == pytest.approx((-1.4, 0.6), abs=0.15)
    stars = images.find_stars(f, ["field", "frame"], 5.0)
    guides = stars.where("frame = 0").where(images.guide_mask(0.3, 500.0, 5000.0)).select("field", "star", "x", "y")
    near = {r.frame: (r.dx, r.dy, r.guides) for r in images.guided_shifts(stars, guides, "field", "frame").collect()}
    assert near[2][:2] == pytest.approx((-1.4, 0.6), abs=0.15) and near[0] == (0, 0, 4)


def test_light_of_drifting_stars(spark):
    rows, at = [], [(0, 10.0, 12.0), (1, 40.0, 33.0)]
    for k in range(6):
        rows.append((k, star_field([(x + 0.5 * k, y - 0.25 * k) for _, x, y in at], level=0.0, noise=0.0)))
    f = as_frames(spark, rows).withColumn("field", F.lit("a")).withColumn("t", F.col("frame") * 0.5)
    stars = spark.createDataFrame([("a", *s) for s in at], "field string, star int, x double, y double")
    last = stars.withColumn("x", F.col("x") + 2.5).withColumn("y", F.col("y") - 1.25).withColumn("t", F.lit(2.5))
    drift = images.median_drift(stars.withColumn("t", F.lit(0.0)), last, "field", "t").withColumn("t0", F.lit(0.0))
    assert tuple(drift.select("vx", "vy").collect()[0]) == (1.0, -0.5)
    got = images.drifting_photometry(f, stars, drift, "frame", "field", radius=4.0).toPandas()
    assert len(got) == 12 and got.flux.between(3900, 4010).all()
    still = images.drifting_photometry(f, stars, drift.limit(0), "frame", "field", radius=2.0).toPandas()
    assert still[still.frame == 5].flux.max() < got[got.frame == 5].flux.min()
    forced = images.forced_photometry(f, spark.createDataFrame([(7, "a", 1.2, 11.0, 11.5)], "request long, field string, at double, x double, y double"), "field", radius=4.0).toPandas()
    assert forced.sort_values("t").offset.tolist() == [-1, 0, 1, 2] and (forced.x == 11.0).all()


def test_dark_and_nulls(spark):
    f = spark.createDataFrame([(0, "a", [5.0, None, 7.0, 8.0], 2, 2), (1, "b", [1.0] * 4, 2, 2)], "frame long, field string, pixels array<double>, height int, width int")
    darks = spark.createDataFrame([("a", [1.0, 1.0, 1.0, 1.0])], "field string, dark array<double>")
    got = {r.frame: r.pixels for r in images.subtract_dark(f, darks, "field").collect()}
    assert got == {0: [4.0, None, 6.0, 7.0], 1: [1.0] * 4}
    stars = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, None, 1.0)], "frame long, star int, x double, y double")
    light = {(r.frame, r.star): r.flux for r in images.aperture_photometry(f, stars, "frame", "frame", 0.4, parts=1).collect()}
    assert light == {(0, 0): 5.0, (0, 1): None}
    with pytest.raises(Exception, match="pixels do not make"):
        images.background_level(f.withColumn("width", F.lit(3)), "frame").collect()
