"""Exact medians by closing in: against sorting, with ties, extreme values, many keys and bounded gathering."""

import random
import statistics

import pytest

from lumicurve.operators import quantiles


def check(spark, rows, most):
    d = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: (r.n, r.median) for r in quantiles.exact_medians(d, "k", "v", most=most).collect()}
    own = {}
    for k, v in rows:
        if v is not None and v == v:
            own.setdefault(k, []).append(v)
    assert got == {k: (len(v), statistics.median(v)) for k, v in own.items()}


def values(name, r):
    return {
        "normal": [r.gauss(0, 1) for _ in range(1001)],
        "even": [r.gauss(0, 1) for _ in range(1000)],
        "heavy": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(777)],
        "ties": [float(r.randint(0, 3)) for _ in range(800)],
        "edge": [1.0] * 400 + [2.0] * 400,
        "straddle": [1.0] * 400 + [2.0] * 399 + [1.5],
        "one": [5.0] * 500,
        "single": [3.0],
        "two": [3.0, 4.0],
        "nulls": [None, float("nan"), 7.0, None],
        "none": [None],
    }[name]


NAMES = ["normal", "even", "heavy", "ties", "edge", "straddle", "one", "single", "two", "nulls", "none"]


@pytest.mark.parametrize("most", [3, 60, 10_000])
def test_equal_to_sorting(spark, most):
    r = random.Random(4)
    rows = [(None if name == "two" else name, v) for name in NAMES for v in values(name, r)]
    r.shuffle(rows)
    check(spark, rows, most)


def test_distances_from_the_median(spark):
    r = random.Random(8)
    own = {k: [r.gauss(0, k) for _ in range(500)] for k in range(1, 4)}
    d = spark.createDataFrame([(k, v) for k, vs in own.items() for v in vs], "k long, v double")
    got = {r.k: (r.median, r.mad) for r in quantiles.exact_mads(d, "k", "v", most=40).collect()}
    for k, vs in own.items():
        m = statistics.median(vs)
        assert got[k] == (m, pytest.approx(statistics.median(abs(v - m) for v in vs)))
    assert quantiles.exact_medians(d.limit(0), "k", "v").collect() == []
