"""Queries over whole tables against brute force, with ids beyond those their SQL forms take."""

import numpy as np
import pandas as pd
import pytest

from lumicurve.plans import catalog


def write_embeddings(folder, vectors):
    ids = [7 * k + 3 for k in range(len(vectors))]
    pd.DataFrame({"vec_id": ids, "embedding": [v.astype("float32").tolist() for v in vectors], "label": 0}).to_parquet(folder / "embeddings.parquet")
    return str(folder), dict(zip(ids, vectors.astype("float32").astype("float64"), strict=True))


def test_kernel_match_all_takes_every_event_and_kernel(spark, tmp_path):
    folder, vectors = write_embeddings(tmp_path, np.random.default_rng(1).normal(0, 0.125, (40, 64)))
    want = {}
    for event, f in vectors.items():
        best = []
        for kernel, c in vectors.items():
            for offset in range(-3, 3):
                part = f[25 + offset : 40 + offset] + 1
                best.append((float(np.sum(np.abs(part - (c[:15] + 1)) / (np.sqrt(np.abs(part) / 0.82) * 0.82))), kernel, offset))
        want[event] = min(best)
    got = {r.event_id: r for r in catalog.QUERIES["kernel_match"](spark, folder).collect()}
    assert set(got) == set(vectors)
    for event, (chi, kernel, offset) in want.items():
        assert (got[event].kernel_id, got[event].offset) == (kernel, offset)
        assert got[event].chi == pytest.approx(chi, abs=1e-6)
    assert any(r.kernel_id >= 40 for r in got.values())


@pytest.fixture(scope="module")
def sky(tmp_path_factory):
    """80 stars with ids to 556 in two clusters, and some alone; their references by brute force."""
    rng = np.random.default_rng(5)
    v = rng.normal(0, 0.125, (80, 64))
    v[:, :2] = np.where(np.arange(80)[:, None] < 40, 0.0, 0.5) + rng.normal(0, 0.06, (80, 2))
    v[::20, :2] += 3 + np.arange(4)[:, None]
    folder, vectors = write_embeddings(tmp_path_factory.mktemp("sky"), v)
    refs = {}
    for target, a in vectors.items():
        near = sorted((float(np.hypot(*(a[:2] - b[:2]))), star) for star, b in vectors.items() if star != target)
        near = [star for d, star in near if d <= 0.1]
        if len(near) >= 3:
            refs[target] = near[:6]
    assert max(refs) > 60 and len(refs) < 80
    return folder, {k: b + 1 for k, b in vectors.items()}, refs


def test_references_of_all_stars(spark, sky):
    folder, _, refs = sky
    got = {(r.target, r.rank): r.ref for r in catalog.QUERIES["reference_selection"](spark, folder).collect()}
    assert got == {(t, k + 1): ref for t, near in refs.items() for k, ref in enumerate(near)}


def test_ensemble_of_all_stars(spark, sky):
    folder, flux, refs = sky
    got = catalog.QUERIES["ensemble_differential"](spark, folder).toPandas().set_index(["target", "t"]).rel.unstack()
    assert set(got.index) == set(refs)
    for target, near in refs.items():
        rel = flux[target] / np.mean([flux[r] for r in near], axis=0)
        assert np.allclose(got.loc[target].to_numpy(), rel / np.median(rel), atol=2e-6)


def test_similar_references_of_all_stars(spark, sky):
    folder, flux, refs = sky
    norm = {k: f / np.median(f) for k, f in flux.items()}

    def keep(near, like):
        sse = sorted((float(np.mean((norm[r] - like) ** 2)), r) for r in near)
        return sse[: max(3, min(round(0.5 * len(sse)), len(sse)))]

    want = {}
    for target, near in refs.items():
        first = [r for _, r in keep(near, norm[target])]
        want |= {(target, k + 1): r for k, (_, r) in enumerate(keep(first, np.mean([norm[r] for r in first], axis=0)))}
    got = {(r.target, r["rank"]): r.ref for r in catalog.QUERIES["idl_reference_selection"](spark, folder).collect()}
    assert got == want


def test_pca_of_all_stars(spark, sky):
    folder, flux, refs = sky
    got = catalog.QUERIES["pca_differential"](spark, folder).toPandas().set_index(["target", "t"]).rel.unstack()
    assert set(got.index) == set(refs)
    norm = {k: f / np.median(f[f > 0]) for k, f in flux.items()}
    for target, near in refs.items():
        own, r = norm[target], np.array([norm[k] for k in near])
        mean = r.mean(axis=0)
        v = np.linalg.svd(r - mean, full_matrices=False)[2][: min(3, len(r) - 1)]
        assert np.allclose(got.loc[target].to_numpy(), own - (mean - 1) - ((own - mean) @ v.T) @ v, atol=2e-6)


def test_occultation_curves_of_every_supplier(spark, tmp_path):
    from lumicurve.operators import numeric, trials

    spark.createDataFrame([(3,), (8,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = catalog.QUERIES["occultation_curves"](spark, str(tmp_path)).toPandas()
    assert set(got.kernel_id) == {3, 8}
    for p in trials.sampled_parameters(spark.createDataFrame([(3,), (8,)], "trial long")).collect():
        want = numeric.occultation_curve(0.025, (4e-7, 7e-7), p.object_r, p.impact, p.dist, p.star_d, p.shift, reach=10_000.0, step=10.0, colours=20, ring=5)
        assert np.allclose(got[got.kernel_id == p.trial].sort_values("frame").flux.to_numpy(), want, atol=2e-6)
