"""Differential curves by principal components after the references are chosen.

A target and its references, some dozens of curves of a night, are one group.
Selections come from ``robust``; this module cleans and divides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicurve.operators import numeric, series


def flux_matrix(rows: pd.DataFrame, star: str, time: str, value: str) -> tuple[list, np.ndarray, np.ndarray]:
    """Stars, times and a matrix of their values, NaN where there is none."""
    wide = rows.pivot_table(index=star, columns=time, values=value, aggfunc="first")
    return wide.index.tolist(), wide.columns.to_numpy(), wide.to_numpy(float)


def normalised(flux: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Curves over the means of their values above ``least``; NaN without one."""
    good = np.isfinite(flux) & (flux > least)
    n = good.sum(axis=1)
    mean = np.where(good, flux, 0.0).sum(axis=1) / np.maximum(n, 1)
    return flux / np.where((n > 0) & (mean > 0), mean, np.nan)[:, None]


def clipped(curves: np.ndarray, k: float, rounds: int) -> np.ndarray:
    """Values further than k robust deviations from their curve's median are NaN."""
    out = curves.copy()
    for _ in range(rounds):
        for row in out:
            known = row[np.isfinite(row)]
            if len(known):
                middle = np.median(known)
                spread = 1.4826 * np.median(np.abs(known - middle))
                if spread > 0:
                    row[np.abs(row - middle) > k * spread] = np.nan
    return out


def filled(curves: np.ndarray) -> np.ndarray:
    """NaN become their curve's median, 1 in a curve without values."""
    out = curves.copy()
    for row in out:
        known = row[np.isfinite(row)]
        row[~np.isfinite(row)] = np.median(known) if len(known) else 1.0
    return out


def components_of(curves: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean of some curves and the ``most`` leading components about it."""
    mean = curves.mean(axis=0)
    return mean, np.linalg.svd(curves - mean, full_matrices=False)[2][: min(most, *curves.shape)]


def without_common_modes(curves: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """What the mean and the components leave of curves about 1, about 1 again."""
    left = curves - 1.0
    return left - (mean + (left - mean) @ axes.T @ axes) + 1.0


def postselected_curve(own: np.ndarray, refs: np.ndarray, components: int = 2, fewest: int = 3) -> np.ndarray:
    """A normalised curve over the mean of its normalised references, both less
    what the references' components explain; NaN where too few are positive."""
    refs = clipped(refs, 4.0, 1)
    mean, axes = components_of(filled(refs) - 1.0, components)
    clean_refs = np.where(np.isfinite(refs), without_common_modes(filled(refs), mean, axes), np.nan)
    clean_own = np.where(np.isfinite(own), without_common_modes(filled(own[None])[0], mean, axes), np.nan)
    good = np.isfinite(clean_refs) & (clean_refs > 0)
    n = good.sum(axis=0)
    level = np.where(good, clean_refs, 0.0).sum(axis=0) / np.maximum(n, 1)
    return np.where((n >= fewest) & (level > 0), clean_own / np.where(level > 0, level, 1.0), np.nan)


def pca_postselect(flux: DataFrame, target: str = "target", star: str = "star", time: str = "t", value: str = "flux", components: int = 2, fewest: int = 3, least: float = 0.0, selection: DataFrame | None = None) -> DataFrame:
    """(target, t, rel) of each target among its references' curves; rows with
    star = target are its own. Targets with under ``fewest`` references have no
    rows, a missing or unusable sample a null. With a ``selection`` (target,
    ref) ``flux`` has each star's curve once, which is what is sent."""

    def one(me: object, stars: list, refs: list[bool], matrix: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        known = (~np.isnan(matrix)).any(axis=1)
        others = [k for k, s in enumerate(stars) if s != me and known[k]]
        if me not in stars or not known[stars.index(me)] or len(others) < fewest:
            return None
        used = ~np.isnan(matrix).all(axis=0)
        norm = normalised(matrix[:, used], least)
        rel = np.full(len(used), np.nan)
        rel[used] = postselected_curve(norm[stars.index(me)], norm[others], components, fewest)
        return rel, used

    return numeric.per_target(flux, one, target, star, time, value, selection)


def common_modes_removed(flux: DataFrame, group: str, star: str = "star", time: str = "t", value: str = "flux", components: int = 2, sigma: float = 5.0, rounds: int = 2) -> DataFrame:
    """(group, star, t, clean): the normalised curves of each group of stars
    less their common modes; gaps are filled with their curves' medians."""
    kinds = {f.name: f.dataType.simpleString() for f in flux.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stars, times, matrix = flux_matrix(pdf, star, time, value)
        curves = filled(clipped(normalised(matrix), sigma, rounds))
        mean, axes = components_of(curves - 1.0, components)
        clean = without_common_modes(curves, mean, axes)
        return pd.DataFrame({group: pdf[group].iloc[0], star: np.repeat(stars, len(times)), time: np.tile(times, len(stars)), "clean": clean.ravel()})

    return flux.groupBy(group).applyInPandas(run, f"`{group}` {kinds[group]}, `{star}` {kinds[star]}, `{time}` {kinds[time]}, clean double")


def members(flux: DataFrame, selection: DataFrame, target: str = "target", ref: str = "ref", star: str = "star") -> DataFrame:
    """The samples of each target and its references, named by the target."""
    who = selection.select(target, F.col(ref).alias(star)).union(selection.select(target, F.col(target).alias(star)).distinct())
    return who.join(flux, star)


def idl_relative_flux(flux: DataFrame, candidates: DataFrame, fraction: float = 0.25, fewest: int = 3, components: int = 2, star: str = "star", time: str = "t", value: str = "flux") -> DataFrame:
    """(target, t, rel, rel_norm): the most similar of each target's candidate
    references (target, ref), then the curve less their common modes, and that
    over its median."""

    def one(me: object, stars: list, refs: list[bool], matrix: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        known = (~np.isnan(matrix)).any(axis=1)
        if me not in stars:
            return None
        mine, asked = stars.index(me), [k for k, r in enumerate(refs) if r]
        chosen = most_similar(matrix, present, mine, asked, fraction, fewest)
        others = [k for k in chosen if k != mine and known[k]]
        if not known[mine] or len(others) < fewest:
            return None
        used = (~np.isnan(matrix[[mine, *others]])).any(axis=0)
        norm = normalised(matrix[:, used])
        rel = np.full(len(used), np.nan)
        rel[used] = postselected_curve(norm[mine], norm[sorted(others)], components, fewest)
        positive = rel[rel > 0]
        middle = np.median(positive) if len(positive) >= fewest else np.nan
        return np.stack([rel, rel / middle]), used

    return numeric.per_target(flux, one, "target", star, time, value, candidates, ("rel", "rel_norm"))


def most_similar(matrix: np.ndarray, present: np.ndarray, mine: int, asked: list[int], fraction: float, fewest: int) -> list[int]:
    """The rows that ``robust.similar_references`` keeps of the references of
    one target: curves in the order of their ids, and where they have samples."""
    with np.errstate(invalid="ignore"):
        positive = np.where(matrix > 0, matrix, np.nan)
    some = np.isfinite(positive).any(axis=1)
    middle = np.full(len(matrix), np.nan)
    middle[some] = np.nanmedian(positive[some], axis=1)
    f = matrix / middle[:, None]

    def keep(rows: list[int], like: np.ndarray, there: np.ndarray) -> list[int]:
        both = [k for k in rows if (present[k] & there).any()]
        square = (f[both] - like) ** 2
        n = np.isfinite(square).sum(axis=1)
        sse = np.where(n > 0, np.nansum(square, axis=1) / np.maximum(n, 1), -np.inf)  # nulls come first
        limit = max(fewest, min(round(fraction * len(both)), len(both)))
        return [both[k] for k in np.lexsort((both, sse))[:limit]]

    first = keep(asked, f[mine], present[mine])
    if not first:
        return []
    n = np.isfinite(f[first]).sum(axis=0)
    mean = np.where(n > 0, np.nansum(f[first], axis=0) / np.maximum(n, 1), np.nan)
    return keep(first, mean, present[first].any(axis=0))


def differential_curve(flux: DataFrame, selection: DataFrame, method: str = "ensemble", denominator: str = "mean", components: int = 3, fewest: int = 3, bin_width: float | None = None, star: str = "star", time: str = "t", value: str = "flux") -> DataFrame:
    """Differential curves of the targets of a selection (target, ref): (target,
    t, rel), or, with ``bin_width``, (target, bin, t_center, rel, n).

    ``method`` is ensemble (over the references' mean or median) or pca. A
    target with under ``fewest`` references keeps its rows, with null values.
    """
    if method not in ("ensemble", "pca") or denominator not in ("mean", "median"):
        raise ValueError(f"no such method or denominator: {method}, {denominator}")
    others = F.collect_set(F.when(F.col("ref") != F.col("target"), F.col("ref"))).alias("_refs")
    # A target with too few keeps one row, without a reference.
    enough = F.when(F.size("_refs") >= fewest, F.col("_refs"))
    refs = selection.groupBy("target").agg(others).select("target", F.explode_outer(enough).alias("ref"))
    if method == "ensemble":
        return numeric.ensemble(flux, refs, denominator, star, time, value, every_time=True, bin_width=bin_width)
    rel = numeric.pca_differential(flux, star=star, time=time, value=value, components=components, selection=refs.where("ref IS NOT NULL"))
    axis = flux.select(F.col(star).alias("target"), time).join(selection.select("target").distinct(), "target", "left_semi")
    rel = axis.join(rel, ["target", time], "left")
    if bin_width is None:
        return rel
    return series.time_bins(rel, "target", time, "rel", bin_width).withColumnRenamed("value", "rel")
