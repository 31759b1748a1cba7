"""Trial studies, diffraction curves, followed stars and differential curves against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumicurve.operators import detect, differential, evaluate, match, numeric, series, trials


def test_matched_scores_equal_sums():
    rng = np.random.default_rng(1)
    x = rng.normal(size=50)
    for template in ([-1.0], [-1.0] * 6, [-0.5, -1.0, -0.5], [-1.0] * 60):
        norm, n, half = math.sqrt(sum(t * t for t in template)), len(template), len(template) // 2
        want = [sum(template[k] / norm * x[i + k - half] for k in range(n) if 0 <= i + k - half < 50) / 2.5 for i in range(50)]
        assert trials.matched(x, np.array(template), 2.5) == pytest.approx(want)


def test_scores_of_a_trial(spark):
    """An event in all scopes is found where it is; the joint score is the scaled sum."""
    rng = np.random.default_rng(2)
    flux = spark.createDataFrame([("h", s, i, 1000 + float(v)) for s in ("T1", "T2") for i, v in enumerate(rng.normal(0, 20, 700))], "host string, scope string, i long, flux double")
    plan = spark.createDataFrame([(0, "inject", "h", 700, 400), (1, "null", "h", 700, None), (2, "inject", "h", 700, 2)], "trial long, kind string, host string, n long, center long")
    profile = [1.0, 0.7, 0.5, 0.7, 1.0]
    profiles = spark.createDataFrame([(0, profile), (2, profile)], "trial long, curve array<double>")
    made = trials.trial_flux(plan, flux, profiles).toPandas()
    base = {(r.scope, r.i): r.flux for r in flux.collect()}
    for r in made.itertuples():
        factor = 1.0
        if r.trial != 1 and 0 <= r.i - r.center + 2 < 5:
            factor = profile[int(r.i - r.center + 2)]
        assert r.flux == pytest.approx(base[r.scope, r.i] * factor)
    grid = trials.detector_grid({"box": [[-1.0] * 3], "delta": [[-1.0]]}, ["mean_subtract", "whiten"])
    got = trials.score_trials(trials.trial_flux(plan, flux, profiles), grid).toPandas()
    assert len(got) == 3 * 4 * 3 and got[got.kind == "null"].center.isna().all()
    found = got[(got.trial == 0) & (got.detector == "box@mean_subtract")]
    assert (abs(found.frame - 400) <= 1).all()
    own = []
    for scope in ("T1", "T2"):
        x = made[(made.trial == 0) & (made.scope == scope)].sort_values("i").flux.to_numpy()
        d = x - numeric.running_mean(x, 200)
        own.append(trials.matched(d, np.array([-1.0] * 3), d.std()))
    assert found[found.scope == "joint"].peak.iloc[0] == pytest.approx((sum(own) / np.sqrt(2)).max())


def test_unusual_parameters_are_named(spark):
    rows = [(1, 500.0, 0.1, 0.0), (2, 5.0, 0.1, None), (3, 500.0, 2.0, 0.4)]
    bad = trials.bad_parameters(spark.createDataFrame(rows, "kernel_id int, object_r double, star_d double, shift double"))
    assert {r.kernel_id: r.wrong for r in bad.collect()} == {2: ["object_r", "shift"], 3: ["star_d"]}


def integral_bessel(n, x):
    theta = np.linspace(0, 2 * np.pi, 4000, endpoint=False)
    return float(np.cos(n * theta - x * np.sin(theta)).mean())


def test_bessel_table():
    x = np.array([0.0, 0.3, 5.0, 60.0])
    table = numeric.bessel_table(x, 80)
    assert all(table[k, n] == pytest.approx(integral_bessel(n, v), abs=1e-10) for k, v in enumerate(x) for n in range(0, 80, 7))


def diffracted(rho, p, points=4000):
    """Intensity behind a disc by Babinet's principle: the diffraction integral
    over the disc, by quadrature, taken from the open wave."""
    r = (np.arange(points) + 0.5) * p / points
    j0 = np.cos(np.pi * r[:, None] * rho * np.sin(np.linspace(0, np.pi, 400, endpoint=False))).mean(axis=1)
    disc = (np.exp(0.5j * np.pi * r * r) * j0 * r).sum() * p / points
    return abs(1 + 1j * np.pi * np.exp(0.5j * np.pi * rho * rho) * disc) ** 2


@pytest.mark.parametrize("p", [0.3, 0.8, 1.0, 2.5])
def test_intensity_equals_the_diffraction_integral(p):
    rho = np.array([0.0, 0.2 * p, 0.7 * p, 1.3 * p, 2.0, 4.0, 9.0])
    assert numeric.intensity_at(rho, p) == pytest.approx([diffracted(x, p) for x in rho], abs=2e-4)
    # The bright spot in the middle of any round shadow, and full light far from it.
    assert numeric.intensity_at(np.array([0.0]), p)[0] == pytest.approx(1.0)
    assert numeric.intensity_at(np.linspace(60, 61, 50), p).mean() == pytest.approx(1.0, abs=0.01)


def test_curve_of_a_point_source():
    """One colour, a point source, exposures of one step: the intensity at each
    place; a finite disc, a band and longer exposures only take means of it."""
    unit = math.sqrt(5e-7 * 40 * numeric.AU_METRES / 2)
    places = np.arange(-4000.0, 4000.0, 80.0)
    rho = np.round(np.hypot(places, 150.0) / unit, 2)
    got = numeric.occultation_curve(1e-6, (5e-7, 5e-7), 600.0, 150.0, 40.0, 0.0, 0.0, reach=4000.0, step=80.0)
    assert got == pytest.approx([diffracted(x, 600.0 / unit) for x in rho], abs=2e-4)
    assert got[1:] == pytest.approx(got[:0:-1], abs=1e-9)
    wide = numeric.occultation_curve(1e-6, (4e-7, 7e-7), 600.0, 150.0, 40.0, 0.05, 0.0, reach=4000.0, step=80.0, colours=2, ring=2)
    assert np.ptp(wide) < np.ptp(got) and wide.mean() == pytest.approx(got.mean(), abs=0.03)


@pytest.mark.parametrize("shift", [0.0, -0.3, 0.4])
def test_exposures_are_means_of_their_samples(shift):
    x = np.random.default_rng(3).normal(size=103)
    out = numeric.exposures(x, 7, shift)
    means = {round(float(v), 9) for k in range(len(x)) for v in [x[k : k + 7].mean()]} | {round(float(x[:k].mean()), 9) for k in range(1, 14)} | {round(float(x[-k:].mean()), 9) for k in range(1, 7)}
    assert len(out) in (15, 16) and all(round(float(v), 9) in means for v in out)
    assert numeric.exposures(np.ones(103), 7, shift) == pytest.approx(1.0)


def test_filter_blocks_equal_single_steps():
    sections = numeric.butterworth(1.0, 15.0, 40.0)
    x = np.random.default_rng(5).normal(size=333)

    def slow(x):
        for b, a in sections:
            level = b.sum() / a.sum() * x[0]
            s2 = b[2] * x[0] - a[2] * level
            s1 = b[1] * x[0] - a[1] * level + s2
            y = []
            for v in x:
                y.append(b[0] * v + s1)
                s1, s2 = b[1] * v - a[1] * y[-1] + s2, b[2] * v - a[2] * y[-1]
            x = np.array(y)
        return x

    assert numeric.filtered(sections, x) == pytest.approx(slow(x)) and len(numeric.filtered(sections, x[:0])) == 0
    assert numeric.filtered(sections, x[:5]) == pytest.approx(slow(x[:5]))


def test_roc_equals_every_threshold(spark):
    rng = np.random.default_rng(6)
    rows = [(("inject", "null")[k % 2], float(v), int(rng.integers(0, 40)), 20) for k, v in enumerate(rng.normal(size=300).round(1))] + [("inject", None, 3, 20)]
    got = evaluate.roc(spark.createDataFrame(rows, "kind string, peak double, frame int, center int")).orderBy("point").collect()
    peaks = [r[1] for r in rows if r[1] is not None]
    step = (max(peaks) - min(peaks)) / 79
    for r in got:
        at = min(peaks) + r.point * step
        assert r.threshold == at
        hits = [r1[1] >= at and abs(r1[2] - 20) <= 12 for r1 in rows if r1[0] == "inject" and r1[1] is not None]
        false = [r1[1] >= at for r1 in rows if r1[0] == "null"]
        assert (r.completeness, r.far) == pytest.approx((sum(hits) / len(hits), sum(false) / len(false)))
    one = evaluate.roc(spark.createDataFrame([("inject", 2.0, 20, 20)], "kind string, peak double, frame int, center int")).orderBy("point").collect()
    assert one[0].completeness == 1.0 and one[1].completeness == 0.0


def test_stars_are_followed(spark):
    """Sky first, then pixels; each star once a minute; the rest is new."""
    rows = [
        ("n", 0, 0, 10.0, 10.0, 50.0, 20.0),
        ("n", 0, 1, 30.0, 30.0, None, None),
        ("n", 1, 0, 90.0, 90.0, 50.0003, 20.0),  # far in pixels, near on the sky
        ("n", 1, 1, 30.5, 30.0, None, None),
        ("n", 1, 2, 30.1, 30.0, 10.0, 10.0),  # also near the second star, which is taken
        ("n", 2, 0, 31.0, 30.0, None, None),
        ("n", 2, 1, 50.0, 50.0, 50.00015, 20.0001),
        ("n", 2, 2, None, None, None, None),
        ("m", 0, 0, 10.0, 10.0, 50.0, 20.0),
    ]
    df = spark.createDataFrame(rows, "night string, minute long, local long, x double, y double, ra double, dec double").repartition(3)
    followed = match.global_star_ids(df, "night")
    ids = {(r.night, r.minute, r.local): r.star_id for r in followed.collect()}
    # The first of the rows near the second star has it; what comes later is new.
    assert ids == {("n", 0, 0): 0, ("n", 0, 1): 1, ("n", 1, 0): 0, ("n", 1, 1): 1, ("n", 1, 2): 2, ("n", 2, 0): ids["n", 2, 0], ("n", 2, 1): 0, ("n", 2, 2): 3, ("m", 0, 0): 0}
    assert ids["n", 2, 0] in (1, 2)
    stars = {(r.night, r.star_id): r for r in match.global_stars(followed, "night").collect()}
    assert stars["n", 0].n_detections == 3 and stars["n", 0].x == pytest.approx(50.0) and stars["n", 0].ra == pytest.approx(50.00015)
    assert stars["m", 0].n_detections == 1 and stars["n", 3].x is None
    assert match.global_star_ids(df.drop("ra", "dec").limit(0), "night").count() == 0


def test_minute_triplets_advance_greedily(spark):
    rng = np.random.default_rng(7)
    rows = [(n, s, float(t)) for n in range(3) for s in (1, 2, 3) for t in np.sort(rng.uniform(0, 5000, 30))]
    got = {(r.night, r.t1, r.t2, r.t3) for r in match.minute_triplets(spark.createDataFrame(rows, "night int, scope int, t double"), "night").collect()}
    want = set()
    for n in range(3):
        one, two, three = ([t for a, s, t in rows if a == n and s == k] for k in (1, 2, 3))
        used2, used3 = -1, -1
        for a in one:
            j = next((k for k in range(used2 + 1, 30) if two[k] > a - 60), None)
            if j is None or two[j] - a >= 60:
                continue
            used2 = j
            k = next((k for k in range(used3 + 1, 30) if three[k] > a - 60), None)
            if k is not None and three[k] - a < 60:
                want.add((n, a, two[j], three[k]))
                used3 = k
    assert got == want and want


def test_nearest_dark_across_stretches(spark):
    from lumicurve.operators import bandjoin

    rng = np.random.default_rng(8)
    t, d = rng.integers(0, 40_000, 300).astype(float), rng.integers(0, 40_000, 40).astype(float)
    left = spark.createDataFrame([(k, float(v), "n" if k % 5 else None) for k, v in enumerate(t)], "id long, t double, night string")
    right = spark.createDataFrame([(f"d{k}", float(v), "n" if k % 2 else None) for k, v in enumerate(d)], "dark string, td double, night string")
    for on, same in ((), lambda k, j: True), (("night",), lambda k, j: bool(k % 5) == bool(j % 2)):
        got = {r.id: (r.dt, r.dark) for r in bandjoin.asof_nearest(left, right, "id", "t", "td", ["dark"], list(on), span=500.0).collect()}
        for k, v in enumerate(t):
            best = min((abs(v - x), x, f"d{j}") for j, x in enumerate(d) if same(k, j))
            assert got[k] == (best[0], best[2])
    assert bandjoin.asof_nearest(left, right.limit(0), "id", "t", "td", ["dark"]).where("dark IS NOT NULL").count() == 0


def test_short_series_are_mirrored_again(spark):
    for n in (1, 3, 60, 99, 100, 101, 230):
        x = np.random.default_rng(n).normal(size=n)
        df = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(x)], "star string, i long, flux double")
        got = series.boxcar(df, "star", "flux", 200).orderBy("i").toPandas()["trend"].to_numpy()
        wide = [x[p % (2 * n) if p % (2 * n) < n else 2 * n - 1 - p % (2 * n)] for p in range(-100, n + 99)]
        assert got == pytest.approx([np.mean(wide[k : k + 200]) for k in range(n)]), n


def test_a_null_takes_its_neighbours_along(spark):
    rows = [("s", k, None if k == 30 else 1.0) for k in range(60)]
    out = series.convolve(spark.createDataFrame(rows, "star string, i long, flux double"), "star", "flux", [1.0] * 5)
    assert sorted(r.i for r in out.collect()) == [k for k in range(2, 58) if abs(k - 30) > 2]


def test_kernels_in_several_blocks(spark):
    rng = np.random.default_rng(9)
    events = spark.createDataFrame([(k, 20, [float(v) for v in rng.uniform(0.5, 1.5, 40)], 1.0) for k in range(12)] + [(99, 20, None, 1.0), (98, 0, [1.0] * 5, 1.0)], "event_id long, center int, flux array<double>, median double")
    kernels = spark.createDataFrame([(k, [float(v) for v in rng.uniform(0.5, 1.5, 9 + k % 3)]) for k in range(50)], "kernel_id long, curve array<double>")
    one, many = (sorted(tuple(r)[:4] for r in detect.kernel_match(events, kernels, bank_bytes=b).collect()) for b in (1 << 20, 500))
    assert one == many and [r[0] for r in one] == list(range(12))


def test_bounds_rule_most_kernels_out():
    """Dips of many depths, widths and phases: the same kernel as by all distances, from a fifth of the samples."""
    rng = np.random.default_rng(4)
    at = np.arange(31)
    dip = lambda depth, width, phase: 1 - depth * np.exp(-(((at - 15 - phase) / width) ** 2))
    curves = [dip(*v) for v in zip(rng.uniform(0.05, 0.9, 2000), rng.uniform(1, 8, 2000), rng.uniform(-0.5, 0.5, 2000), strict=True)]
    bank, total, every = detect.TemplateBank(list(range(2000)), curves), 0, 0
    for k in range(40):
        flux = np.ones(60) + rng.normal(0, 0.03, 60)
        flux[14:45] += dip(rng.uniform(0.2, 0.9), rng.uniform(1.5, 6), rng.uniform(-0.5, 0.5)) - 1
        found, compared = bank.best(flux, 29, 1.0, -3, 2, 0.82)
        noise = np.sqrt(np.abs(flux) / 0.82) * 0.82
        want = min((float((np.abs(flux[s : s + 31] - c) / noise[s : s + 31]).sum()), i, o) for o in range(-3, 3) for s in [29 + o - 15] for i, c in enumerate(curves))
        assert found == (pytest.approx(want[0]), *want[1:])
        total, every = total + compared, every + 6 * 2000 * 31
    assert total < every / 5


def test_bounds_hold_where_no_kernel_is_like_another():
    """Noise in every sample, which sums over blocks do not tell apart: under a hundredth is compared."""
    rng = np.random.default_rng(8)
    curves, events = list(1 + rng.normal(0, 0.125, (6000, 15))), 1 + rng.normal(0, 0.125, (10, 64))
    bank, total = detect.TemplateBank(list(range(6000)), curves), 0
    for flux, (found, compared) in zip(events, bank.best_of([(f, 32, 1.0) for f in events], -3, 2, 0.82), strict=True):
        noise = np.sqrt(flux / 0.82) * 0.82
        want = min((float((np.abs(flux[s : s + 15] - c) / noise[s : s + 15]).sum()), i, s - 25) for s in range(22, 28) for i, c in enumerate(curves))
        assert found == (pytest.approx(want[0]), *want[1:])
        total += compared
    assert total < 10 * 6 * 6000 * 15 / 100


def test_kernels_alike_to_nine_decimals_are_tied():
    flux = np.full(40, 1.0)
    curves = [np.full(9, 1.1), np.full(9, 1.1 - 1e-12), np.full(9, np.nan), np.full(9, np.inf)]
    for order in ([7, 9, 1, 2], [9, 7, 1, 2]):
        assert detect.TemplateBank(order, curves).best(flux, 20, 1.0, -3, 2, 0.82)[0][1:] == (7, -3)
    assert detect.TemplateBank([5, 4], curves[2:]).best(flux, 20, 1.0, -3, 2, 0.82)[0][1:] == (4, -3)


def flux_table(spark, curves):
    return spark.createDataFrame([(k, t, None if math.isnan(v) else float(v)) for k, c in curves.items() for t, v in enumerate(c)], "star long, t long, flux double")


def test_whole_curves_joined_give_what_joined_samples_give(spark):
    """Gaps, a star without values, one with its own times, a reference named twice, a target that is its own reference."""
    rng = np.random.default_rng(12)
    curves = {k: (100 + 10 * k) * (1 + 0.05 * rng.normal(size=30)) for k in range(8)}
    curves[3][5] = curves[4][9] = curves[0][2] = math.nan
    curves[6][:] = math.nan
    flux = flux_table(spark, curves).union(spark.createDataFrame([(9, 100 + t, 5.0 + t) for t in range(10)], "star long, t long, flux double"))
    sel = spark.createDataFrame([(0, r) for r in (0, 1, 2, 2, 3, 4, 6, 9)] + [(5, 0), (5, 1), (5, 7)] + [(7, 6)], "target long, ref long")
    for fn in (differential.pca_postselect, numeric.pca_differential):
        got, want = ({(r.target, r.t): r.rel for r in df.collect()} for df in (fn(flux, selection=sel), fn(differential.members(flux, sel))))
        assert got == want and {t for t, _ in got} == {0, 5}
        assert any(v is None for v in got.values())


def test_postselected_curves_equal_the_steps(spark):
    rng = np.random.default_rng(10)
    trend = 1 + 0.2 * np.sin(np.linspace(0, 9, 40))
    curves = {k: (100 + 10 * k) * trend * (1 + 0.01 * rng.normal(size=40)) for k in range(7)}
    curves[3][5] = math.nan
    curves[4][7] *= 40
    sel = spark.createDataFrame([(0, r) for r in range(1, 7)] + [(5, 0), (5, 1)], "target long, ref long")
    got = differential.pca_postselect(differential.members(flux_table(spark, curves), sel)).toPandas()
    assert set(got.target) == {0}
    norm = {k: c / np.nanmean(c[c > 0]) for k, c in curves.items()}
    refs = np.array([norm[k] for k in range(1, 7)])
    for row in refs:
        known = row[np.isfinite(row)]
        row[np.abs(row - np.median(known)) > 4 * 1.4826 * np.median(np.abs(known - np.median(known)))] = np.nan
    assert np.isnan(refs).sum() >= 2
    full = np.array([np.where(np.isfinite(r), r, np.nanmedian(r)) for r in refs]) - 1
    mean = full.mean(axis=0)
    axes = np.linalg.svd(full - mean, full_matrices=False)[2][:2]
    clean = lambda x: x - (mean + (x - mean) @ axes.T @ axes) + 1
    level = np.nanmean(np.where(np.isfinite(refs), [clean(r) for r in full], np.nan), axis=0)
    assert got.sort_values("t").rel.to_numpy() == pytest.approx(clean(norm[0] - 1) / level)
    modes = differential.common_modes_removed(flux_table(spark, curves).withColumn("field", F.lit("f")), "field").toPandas()
    assert len(modes) == 280 and modes[modes.star == 1].clean.std() < norm[1].std() / 3


def test_curves_of_too_few_references_are_null(spark):
    curves = {k: np.full(10, 50.0 + k) for k in range(6)}
    sel = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 2)], "target long, ref long")
    for method in ("ensemble", "pca"):
        out = differential.differential_curve(flux_table(spark, curves), sel, method).toPandas()
        assert out[out.target == 0].rel.to_numpy() == pytest.approx(np.ones(10), abs=1e-9) and out[out.target == 1].rel.isna().all() and len(out) == 20
    with pytest.raises(ValueError):
        differential.differential_curve(flux_table(spark, curves), sel, "other")


@pytest.mark.parametrize("how", ["mean", "median"])
@pytest.mark.parametrize("regular", [True, False])
@pytest.mark.parametrize("batch", [3, 10_000])
def test_differential_curves_by_whole_curves_equal_the_steps(spark, monkeypatch, how, regular, batch):
    """No sample is shuffled for its bin; batches that cut a target, gaps, nulls and curves without a value give what the steps give."""
    rng = np.random.default_rng(4)
    curves = {k: {t: float(x) for t, x in zip(range(23), rng.normal(50, 20, 23), strict=True)} for k in range(9)}
    curves[2][5] = curves[5][0] = curves[0][9] = None
    curves[7] = dict.fromkeys(range(23))
    if not regular:
        curves[3] = {t: x for t, x in curves[3].items() if t % 3}
        curves[0] = {t: x for t, x in curves[0].items() if not 7 <= t < 17}
        curves[6] = {t: x for t, x in curves[6].items() if t < 12}
    refs = {0: [1, 2, 3, 4, 5, 6], 1: [2, 3, 5], 3: [4, 5, 7, 3], 5: [6, 1, 2], 7: [0, 1, 2], 8: [0, 6, 7], 4: [1, 2], 99: [1, 2, 3]}
    flux = spark.createDataFrame([(k, t, x) for k, c in curves.items() for t, x in c.items()], "star long, t long, flux double")
    sel = spark.createDataFrame([(k, r) for k, rs in refs.items() for r in rs], "target long, ref long")
    want, bins = {}, {}
    for k, rs in refs.items():
        used = [r for r in rs if r != k] if k in curves else []
        rel = {}
        for t, x in curves.get(k, {}).items():
            others = [curves[r][t] for r in used if len(used) >= 3 and curves[r].get(t) is not None]
            d = getattr(np, how)(others) if others else 0.0
            rel[t] = x / d if x is not None and d > 0 else None
        positive = [x for x in rel.values() if x is not None and x > 0]
        rel = {t: x / np.median(positive) if x is not None and positive else None for t, x in rel.items()}
        want |= {(k, t): x for t, x in rel.items()}
        if rel:
            first, last = min(rel), max(rel)
            for b in range(math.ceil((last - first) / 4)):
                mine = [x for t, x in rel.items() if min((t - first) // 4, math.ceil((last - first) / 4) - 1) == b and x is not None]
                bins[k, b] = (first + (b + 0.5) * 4, np.mean(mine) if mine else None, len(mine))
    monkeypatch.setattr(series, "time_bins", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {(r.target, r.t): r.rel for r in differential.differential_curve(flux, sel, "ensemble", how).collect()}
        binned = {(r.target, r.bin): (r.t_center, r.rel, r.n) for r in differential.differential_curve(flux, sel, "ensemble", how, bin_width=4.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: pytest.approx(x, rel=1e-12) if x is not None else None for k, x in want.items()}
    assert binned.keys() == bins.keys() and all(b[0] == a[0] and b[2] == a[2] and b[1] == (None if a[1] is None else pytest.approx(a[1], rel=1e-12)) for a, b in ((bins[k], binned[k]) for k in bins))


def test_streamed_bins(spark, tmp_path):
    from lumicurve.plans.numeric import run_to_end
    from lumicurve.streaming import streams

    rows = pd.DataFrame({"k": ["a"] * 20, "t": pd.date_range("2024-01-01", periods=20, freq="1s"), "v": range(20)})
    rows.astype({"t": "datetime64[us]"}).to_parquet(tmp_path / "x.parquet")
    s = spark.readStream.schema("k string, t timestamp, v long").parquet(str(tmp_path))
    got = sorted((r.start.second, r.value, r.n) for r in run_to_end(streams.binned(s, "k", "t", "v", "5 seconds", "1 second"), "bins").collect())
    assert got[:3] == [(0, 2.0, 5), (5, 7.0, 5), (10, 12.0, 5)]


def test_template_banks_equal_sums(spark):
    from lumicurve.plans import catalog
    from lumicurve.plans.common import curves

    got = {(r.star, r["shape"]): (r.peak, r.frame) for r in catalog.QUERIES["template_banks"](spark, "/root/testdata/sf0.001").collect()}
    rows = curves(spark, "/root/testdata/sf0.001").toPandas().sort_values(["t", "event_id"])
    star = rows.star.iloc[0]
    x = rows[rows.star == star].flux.to_numpy()
    d = x - numeric.running_mean(x, 200)
    for shape, width in (("box", 6), ("delta", 1)):
        scores = [-sum(d[i + k] for k in range(-(width // 2), width - width // 2) if 0 <= i + k < len(d)) / math.sqrt(width) / d.std() for i in range(len(d))]
        assert got[star, shape] == (pytest.approx(max(scores), abs=1e-6), int(np.argmax(scores)))
    wide = max(got[star, "box_bank"][0], got[star, "box"][0])
    assert got[star, "box_bank"][0] == wide and len(got) == 5 * rows.star.nunique()


def test_streamed_stars_equal_batch(spark):
    from lumicurve.plans import catalog

    batch = {(r.night, r.minute, r.local): r.star_id for r in catalog.QUERIES["global_star_ids"](spark, "/root/testdata/sf0.001").collect()}
    stream = {(r.night, r.minute, r.local): r.star_id for r in catalog.QUERIES["stream_star_ids"](spark, "/root/testdata/sf0.001").collect()}
    assert batch == stream and batch


def test_distortion_is_taken_off_again(spark):
    from lumicurve.functions import astro

    wcs = {"crpix1": 500.0, "crpix2": 400.0, "crval1": 270.0, "crval2": -20.0, "cd1_1": -6e-4, "cd1_2": 1e-5, "cd2_1": 1e-5, "cd2_2": 6e-4}
    sip = {"a": {(2, 0): 2e-6, (1, 1): -1e-6}, "b": {(0, 2): 3e-6, (3, 0): 1e-9}}
    at = spark.createDataFrame([(10.0, 20.0), (900.0, 700.0), (500.0, 400.0)], "x double, y double")
    sky = astro.pixel_to_sky(F.col("x"), F.col("y"), wcs, sip)
    on_sky = at.select("x", "y", sky["ra"].alias("ra"), sky["dec"].alias("dec"))
    back = astro.sky_to_pixel(F.col("ra"), F.col("dec"), wcs, sip)
    for r in on_sky.select("x", "y", back["x"].alias("bx"), back["y"].alias("by")).collect():
        assert (r.bx, r.by) == pytest.approx((r.x, r.y), abs=1e-3)


def test_bessel_table_beyond_its_arguments_and_at_zero():
    x = np.array([0.0, 1e-9, 1e-3, 0.7, 30.0, 250.0])
    table = numeric.bessel_table(x, 320)
    assert table[0] == pytest.approx(np.eye(1, 320)[0], abs=1e-15)
    for n in (0, 1, 7, 60, 319):
        assert table[:, n] == pytest.approx(numeric.bessel_j(n, x), abs=1e-12)


def test_curve_does_not_take_long():
    """Distances are looked up in a table; a curve with sorted distances and transforms took some 0.6 s."""
    import time

    kinds = (0.025, (4e-7, 7e-7), 1200.0, 800.0, 38.0, 0.15, 0.1)
    numeric.occultation_curve(*kinds)
    start = time.process_time()
    numeric.occultation_curve(*kinds)
    assert time.process_time() - start < 0.3
