"""Photometry on frames: background, stars, centroids, apertures, tracking.

A frame is a row with its pixels as one array (row by row) and its height and
width. Everything here works on one frame at a time in Arrow batches, so frames
spread over all tasks; positions of stars come along as arrays of the frame's
row or by a join on the frame's key. Inside a frame all stars are measured at
once by numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumicurve.operators.series import Names, _list


def image_of(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """The frame as a matrix of doubles; null pixels are NaN."""
    image = np.asarray(pixels, float)
    if len(image) != height * width:
        raise ValueError(f"{len(image)} pixels do not make {height} x {width}")
    return image.reshape(height, width)


def per_frame(frames: DataFrame, keep: Names, fn: Callable[..., list[tuple]], out: str, more: Names = ()) -> DataFrame:
    """Rows that ``fn(image, *more)`` gives for each frame, with the frame's ``keep`` columns."""
    keys, others = _list(keep), _list(more)
    names = [c.strip().split(" ")[0].strip("`") for c in out.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                image = image_of(row["pixels"], row["height"], row["width"])
                rows += [(*(row[k] for k in keys), *found) for found in fn(image, *(row[c] for c in others))]
            yield pd.DataFrame(rows, columns=[*keys, *names])

    kinds = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)
    return frames.select(*dict.fromkeys([*keys, *others, "pixels", "height", "width"])).mapInPandas(run, f"{kinds}, {out}")


# Background


def clipped_level(values: np.ndarray, sigma: float = 3.0, rounds: int = 10) -> tuple[float, float]:
    """Level and deviation of a box of pixels, clipped about its median. In a
    crowded box, whose mean leaves its median, the level is its estimated mode."""
    v = values[np.isfinite(values)]
    for _ in range(rounds):
        if not len(v):
            return 0.0, 0.0
        middle, dev = np.median(v), v.std()
        kept = v[np.abs(v - middle) <= sigma * dev] if dev else v
        if len(kept) == len(v):
            break
        v = kept
    mean, middle, dev = v.mean(), np.median(v), v.std()
    return (float(mean) if dev == 0 or abs(mean - middle) < 0.3 * dev else float(2.5 * middle - 1.5 * mean)), float(dev)


def background(image: np.ndarray, box: int = 64) -> tuple[np.ndarray, float]:
    """A smooth background and its global deviation: clipped levels of boxes, a
    3 x 3 median over them, and linear interpolation between their centres."""
    height, width = image.shape
    ny, nx = -(-height // box), -(-width // box)
    cells = [[clipped_level(image[y * box : (y + 1) * box, x * box : (x + 1) * box].ravel()) for x in range(nx)] for y in range(ny)]
    level = np.array([[c[0] for c in row] for row in cells])
    wide = np.pad(level, 1, mode="edge")
    level = np.median([wide[a : a + ny, b : b + nx] for a in range(3) for b in range(3)], axis=0)
    centers = lambda n, size: (np.minimum((np.arange(n) + 1) * box, size) + np.arange(n) * box - 1) / 2
    rows = np.array([np.interp(np.arange(width), centers(nx, width), line) for line in level])
    y = np.arange(height)
    cy = centers(ny, height)
    k = np.clip(np.searchsorted(cy, y, "right") - 1, 0, max(0, ny - 2))
    if ny == 1:
        return np.repeat(rows, height, axis=0), float(np.median([c[1] for row in cells for c in row]))
    share = np.clip((y - cy[k]) / (cy[k + 1] - cy[k]), 0, 1)[:, None]
    return rows[k] * (1 - share) + rows[k + 1] * share, float(np.median([c[1] for row in cells for c in row]))


def background_level(frames: DataFrame, key: Names, box: int = 64) -> DataFrame:
    """(key, level, rms): median of each frame's background, and its deviation."""

    def one(image: np.ndarray) -> list[tuple]:
        smooth, rms = background(image, box)
        return [(float(np.median(smooth)), rms)]

    return per_frame(frames, key, one, "level double, rms double")


def subtract_background(frames: DataFrame, box: int = 64) -> DataFrame:
    """The frames, with all their columns, less their backgrounds."""
    return _change(frames, lambda image: image - background(image, box)[0])


def subtract_dark(frames: DataFrame, darks: DataFrame, on: Names) -> DataFrame:
    """The frames less the dark of equal ``on`` columns, pixel by pixel; darks
    (on, dark) are few, their frames join on the key. Frames without a dark stay
    as they are."""
    joined = frames.join(darks, _list(on), "left")
    less = F.zip_with(F.col("pixels").cast("array<double>"), F.col("dark").cast("array<double>"), lambda x, y: x - y)
    return joined.withColumn("pixels", F.when(F.col("dark").isNull(), F.col("pixels").cast("array<double>")).otherwise(less)).drop("dark")


def _change(frames: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            new = [fn(image_of(p, h, w)).ravel() for p, h, w in zip(pdf["pixels"], pdf["height"], pdf["width"], strict=True)]
            yield pdf.assign(pixels=pd.Series(new, index=pdf.index, dtype=object))

    fields = ", ".join(f"`{f.name}` {'array<double>' if f.name == 'pixels' else f.dataType.simpleString()}" for f in frames.schema.fields)
    return frames.mapInPandas(run, fields)


# Stars


def regions(mask: np.ndarray) -> np.ndarray:
    """Numbers (from 1) of the stretches of true pixels that touch, also at
    corners; 0 elsewhere. Labels spread as minima until none changes, each
    sweep following the labels' own links."""
    height, width = mask.shape
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape), mask.size)
    links = np.arange(mask.size + 1)
    while True:
        wide = np.pad(label, 1, constant_values=mask.size)
        low = np.min([wide[a : a + height, b : b + width] for a in range(3) for b in range(3)], axis=0)
        low = np.where(mask, low, mask.size)
        np.minimum.at(links, label[mask], low[mask])
        while True:
            jumped = links[links]
            if (jumped == links).all():
                break
            links = jumped
        new = np.where(mask, links[low], mask.size)
        if (new == label).all():
            break
        label = new
    _, number = np.unique(label[mask], return_inverse=True)
    out = np.zeros(mask.shape, np.int64)
    out[mask] = number + 1
    return out


STAR = "star int, x double, y double, r double, npix int, flux double, peak double, axis_ratio double"


def extract_stars(image: np.ndarray, threshold: float, least: int = 5, box: int = 64, smooth: bool = True) -> list[tuple]:
    """(star, x, y, r, npix, flux, peak, axis_ratio) of each region over
    ``threshold`` deviations of the background, by y and x: the flux-weighted
    centre, half the radius of a circle of the region's area, and the ratio of
    its axes. Pixels are compared after a small smoothing."""
    level, rms = background(image, box)
    clean = np.nan_to_num(image - level)
    seen = clean
    if smooth:
        wide = np.pad(clean, 1)
        weights = np.outer([1.0, 2.0, 1.0], [1.0, 2.0, 1.0]) / 16
        seen = sum(weights[a, b] * wide[a : a + image.shape[0], b : b + image.shape[1]] for a in range(3) for b in range(3))
    number = regions(seen > threshold * rms)
    y, x = np.nonzero(number)
    n, light = number[y, x] - 1, np.maximum(clean[y, x], 1e-12)
    size = int(n.max()) + 1 if len(n) else 0
    total = lambda v: np.bincount(n, v, size)
    count, flux = np.bincount(n, minlength=size), total(light)
    cx, cy = (total(light * v) / np.maximum(flux, 1e-300) for v in (x, y))
    peak = np.full(size, -np.inf)
    np.maximum.at(peak, n, clean[y, x])
    xx, yy, xy = (total(light * a * b) / np.maximum(flux, 1e-300) for a, b in ((x - cx[n], x - cx[n]), (y - cy[n], y - cy[n]), (x - cx[n], y - cy[n])))
    middle, half = (xx + yy) / 2, np.sqrt(((xx - yy) / 2) ** 2 + xy**2)
    ratio = np.sqrt(np.maximum(middle - half, 0) / np.maximum(middle + half, 1e-300))
    good = sorted(np.flatnonzero(count >= least).tolist(), key=lambda k: (cy[k], cx[k]))
    return [(i, float(cx[k]), float(cy[k]), float(np.sqrt(count[k] / np.pi) / 2), int(count[k]), float(flux[k]), float(peak[k]), float(ratio[k])) for i, k in enumerate(good)]


def find_stars(frames: DataFrame, key: Names, threshold: float = 4.0, least: int = 5, margin: float = 0.0, box: int = 64) -> DataFrame:
    """Stars of each frame (see ``extract_stars``) that are ``margin`` pixels or
    more from its border."""

    def one(image: np.ndarray) -> list[tuple]:
        height, width = image.shape
        return [s for s in extract_stars(image, threshold, least, box) if margin <= s[1] <= width - 1 - margin and margin <= s[2] <= height - 1 - margin]

    return per_frame(frames, key, one, STAR)


def guide_mask(max_ellipticity: float = 0.2, least_flux: float = 500.0, most_peak: float = 20_000.0):
    """Whether a star is round, bright and not saturated."""
    return (F.abs(1 - F.coalesce("axis_ratio", F.lit(0.0))) < max_ellipticity) & (F.col("flux") > least_flux) & (F.col("peak") < most_peak)


def _patches(image: np.ndarray, x: np.ndarray, y: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixels around each star and their places; NaN beyond the border."""
    wide = np.pad(image, reach, constant_values=np.nan)
    cx, cy = (np.clip(np.rint(v), -1, n).astype(int) for v, n in ((x, image.shape[1]), (y, image.shape[0])))
    offset = np.arange(-reach, reach + 1)
    px, py = cx[:, None] + offset, cy[:, None] + offset
    rows, columns = np.clip(py + reach, 0, wide.shape[0] - 1), np.clip(px + reach, 0, wide.shape[1] - 1)
    return wide[rows[:, :, None], columns[:, None, :]], px, py


def windowed_centroids(image: np.ndarray, x: np.ndarray, y: np.ndarray, sigma: float, rounds: int = 16, end: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Centres of stars under a Gaussian window that moves with them, until
    they move less than ``end``; a star without light stays where it was."""
    reach = int(np.ceil(4 * sigma)) + 2
    x, y = np.asarray(x, float).copy(), np.asarray(y, float).copy()
    live = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
    for _ in range(rounds):
        if not len(live):
            break
        light, px, py = _patches(image, x[live], y[live], reach)
        dx, dy = px - x[live][:, None], py - y[live][:, None]
        r2 = dx[:, None, :] ** 2 + dy[:, :, None] ** 2
        weight = np.where(r2 <= (4 * sigma) ** 2, np.exp(-r2 / (2 * sigma**2)), 0.0) * np.nan_to_num(light)
        total = weight.sum(axis=(1, 2))
        lit = total > 0
        safe = np.where(lit, total, 1.0)
        move_x, move_y = 2 * (weight * dx[:, None, :]).sum(axis=(1, 2)) / safe, 2 * (weight * dy[:, :, None]).sum(axis=(1, 2)) / safe
        x[live] += np.where(lit, move_x, 0.0)
        y[live] += np.where(lit, move_y, 0.0)
        live = live[lit & (np.hypot(move_x, move_y) > end)]
    return x, y


def circle_share(dx: np.ndarray, dy: np.ndarray, radius: float, parts: int) -> np.ndarray:
    """The share of each pixel that is inside a circle, by ``parts`` x ``parts`` points."""
    step = (np.arange(parts) + 0.5) / parts - 0.5
    inside = (dx[:, None, :, None, None] + step) ** 2 + (dy[:, :, None, None, None] + step[:, None]) ** 2 <= radius**2
    return inside.mean(axis=(3, 4))


def circle_sums(image: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float, annulus: tuple[float, float] | None = None, parts: int = 5) -> np.ndarray:
    """Light inside a circle around each star; with ``annulus``, less the mean
    light of a ring times the circle's area. Pixels beyond the border count as
    nothing; NaN for a star without a place."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    out = np.full(len(x), np.nan)
    known = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
    reach = int(np.ceil(max(radius, annulus[1] if annulus else 0.0))) + 1
    for a in range(0, len(known), 256):
        rows = known[a : a + 256]
        light, px, py = _patches(image, x[rows], y[rows], reach)
        lit, light = np.isfinite(light), np.nan_to_num(light)
        dx, dy = px - x[rows][:, None], py - y[rows][:, None]
        share = circle_share(dx, dy, radius, parts) * lit
        out[rows] = (light * share).sum(axis=(1, 2))
        if annulus:
            ring = (circle_share(dx, dy, annulus[1], parts) - circle_share(dx, dy, annulus[0], parts)) * lit
            area = ring.sum(axis=(1, 2))
            out[rows] -= np.where(area > 0, (light * ring).sum(axis=(1, 2)) / np.where(area > 0, area, 1), 0.0) * share.sum(axis=(1, 2))
    return out


def measured(frames: DataFrame, key: Names, radius: float = 3.0, annulus: tuple[float, float] | None = None, parts: int = 5) -> DataFrame:
    """(key, star, x, y, flux, mag) of the places in each frame's row: ``stars``
    is an array of structs (star, x, y). mag is null where no light is left."""

    def one(image: np.ndarray, stars: list) -> list[tuple]:
        stars = [] if stars is None else list(stars)
        x, y = (np.array([np.nan if s[c] is None else s[c] for s in stars], float) for c in ("x", "y"))
        flux = circle_sums(image, x, y, radius, annulus, parts)
        return [(int(s["star"]), s["x"], s["y"], float(f) if np.isfinite(f) else None, float(-2.5 * np.log10(f)) if f > 0 else None) for s, f in zip(stars, flux.tolist(), strict=True)]

    return per_frame(frames, key, one, "star int, x double, y double, flux double, mag double", "stars")


def with_stars(frames: DataFrame, stars: DataFrame, on: Names) -> DataFrame:
    """The frames with the places of their stars (on, star, x, y) as one array:
    one field's stars, which come together once for all of its frames."""
    keys = _list(on)
    placed = stars.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("star", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("stars"))
    return frames.join(placed, keys, "left")


def aperture_photometry(frames: DataFrame, stars: DataFrame, key: Names, on: Names, radius: float = 3.0, annulus: tuple[float, float] | None = None, parts: int = 5) -> DataFrame:
    """Light of every star (on, star, x, y) in every frame of its ``on``."""
    return measured(with_stars(frames, stars, on), key, radius, annulus, parts)


def square_photometry(pixels: DataFrame, stars: DataFrame, on: Names, half: int) -> DataFrame:
    """(on, star, flux): sums over squares of 2 * half + 1 pixels, truncated to
    whole places, by an equi-join on pixels. ``pixels``: on, px, py, v;
    ``stars``: on, star, x, y. Pixels beyond the border count as nothing."""
    keys = _list(on)
    corner = lambda c: F.when(F.col(c) - half < 0, F.ceil(F.col(c) - half)).otherwise(F.floor(F.col(c) - half)).cast("int")
    edge = lambda c: F.when(F.col(c) + half + 1 < 0, F.ceil(F.col(c) + half + 1)).otherwise(F.floor(F.col(c) + half + 1)).cast("int") - 1
    spread = stars.select(*keys, "star", "y", F.explode(F.sequence(corner("x"), edge("x"))).alias("px"), "x").select(*keys, "star", "px", F.explode(F.sequence(corner("y"), edge("y"))).alias("py"))
    light = spread.join(pixels, [*keys, "px", "py"]).groupBy(*keys, "star").agg(F.sum("v").alias("flux"))
    return stars.select(*keys, "star").join(light, [*keys, "star"], "left").withColumn("flux", F.coalesce("flux", F.lit(0.0)))


def refined(frames: DataFrame, key: Names, sigma: float | str) -> DataFrame:
    """(key, star, x, y): centres of the places in each frame's row, refined with
    a window of width ``sigma``, a number or a column of the frames."""
    frames = frames.withColumn("_sigma", F.col(sigma) if isinstance(sigma, str) else F.lit(float(sigma)))

    def one(image: np.ndarray, stars: list, width: float) -> list[tuple]:
        stars = [] if stars is None else list(stars)
        x, y = windowed_centroids(image, np.array([s["x"] for s in stars], float), np.array([s["y"] for s in stars], float), float(width))
        return [(int(s["star"]), float(a), float(b)) for s, a, b in zip(stars, x, y, strict=True)]

    return per_frame(frames, key, one, "star int, x double, y double", ["stars", "_sigma"])


def drifting_photometry(frames: DataFrame, stars: DataFrame, drift: DataFrame, key: Names, on: Names, time: str = "t", radius: float = 3.0, annulus: tuple[float, float] | None = None) -> DataFrame:
    """Light of stars that move at their field's drift (on, t0, vx, vy) from
    where they were (on, star, x, y) at t0. With no drift rows they stay."""
    keys = _list(on)
    both = with_stars(frames, stars, keys).join(drift.select(*keys, "t0", "vx", "vy"), keys, "left")
    shift = lambda v: F.coalesce(F.col(v) * (F.col(time) - F.col("t0")), F.lit(0.0))
    moved = F.transform("stars", lambda s: F.struct(s["star"].alias("star"), (s["x"] + shift("vx")).alias("x"), (s["y"] + shift("vy")).alias("y")))
    return measured(both.withColumn("stars", moved), [*_list(key), time], radius, annulus)


def median_drift(first: DataFrame, last: DataFrame, on: Names, seconds: str) -> DataFrame:
    """(on, vx, vy): medians over the stars of their moves from the first to the
    last frame (on, star, x, y, ``seconds``), per second."""
    keys = _list(on)
    b = last.select(*keys, "star", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col(seconds).alias("_t"))
    dt = F.col("_t") - F.col(seconds)
    rate = lambda new, old: F.median(F.when(dt != 0, (F.col(new) - F.col(old)) / dt))
    return first.join(b, [*keys, "star"]).groupBy(*keys).agg(rate("_x", "x").alias("vx"), rate("_y", "y").alias("vy"))


# Tracking


def registered_shift(reference: np.ndarray, image: np.ndarray, upsample: int = 50) -> tuple[float, float]:
    """(dx, dy) by which a frame is moved against the reference: the peak of
    their phase correlation, then a finer grid of its Fourier sum around it."""
    a, b = np.fft.fft2(np.nan_to_num(reference)), np.fft.fft2(np.nan_to_num(image))
    cross = a * np.conj(b)
    cross /= np.maximum(np.abs(cross), 100 * np.finfo(float).eps)
    height, width = reference.shape
    peak = np.abs(np.fft.ifft2(cross)).argmax()
    shift = [v - n if v > n // 2 else v for v, n in zip(divmod(int(peak), width), (height, width), strict=True)]
    if upsample > 1:
        side = int(np.ceil(upsample * 1.5))
        offset = (np.arange(side) - side // 2) / upsample
        fy, fx = np.fft.fftfreq(height), np.fft.fftfreq(width)
        ky, kx = (np.exp(2j * np.pi * np.outer(round(s * upsample) / upsample + offset, f)) for s, f in zip(shift, (fy, fx), strict=True))
        fine = np.abs(ky @ cross @ kx.T)
        y, x = divmod(int(fine.argmax()), side)
        shift = [shift[0] + offset[y], shift[1] + offset[x]]
    return -float(shift[1]), -float(shift[0])


def rigid_shifts(frames: DataFrame, key: Names, order: str, upsample: int = 50) -> DataFrame:
    """(key, order, dx, dy): each frame's shift against its key's first frame.
    The first frame is sent along with the others by a join on the key."""
    keys = _list(key)
    first = frames.groupBy(*keys).agg(F.min_by("pixels", order).alias("_first"))

    def one(image: np.ndarray, reference: np.ndarray) -> list[tuple]:
        return [registered_shift(image_of(reference, *image.shape), image, upsample)]

    return per_frame(frames.join(first, keys), [*keys, order], one, "dx double, dy double", "_first")


def guided_shifts(found: DataFrame, guides: DataFrame, key: Names, order: str, reach: float = 6.0) -> DataFrame:
    """(key, order, dx, dy, guides): the median move of the guide stars (key,
    star, x, y) to the nearest star found in a frame (key, order, x, y) within
    ``reach``; 0 where none is."""
    from lumicurve.operators.bandjoin import plane_join

    keys = _list(key)
    a = guides.select(*keys, F.col("star").alias("_g"), F.col("x").alias("_gx"), F.col("y").alias("_gy"))
    near = plane_join(a, found.select(*keys, order, "x", "y"), ("_gx", "_gy"), ("x", "y"), reach, keys)
    d = F.hypot(F.col("x") - F.col("_gx"), F.col("y") - F.col("_gy"))
    best = near.withColumn("_d", d).where(F.col("_d") <= reach).groupBy(*keys, order, "_g").agg(F.min(F.struct("_d", (F.col("x") - F.col("_gx")).alias("dx"), (F.col("y") - F.col("_gy")).alias("dy"))).alias("m"))
    moved = best.groupBy(*keys, order).agg(F.median("m.dx").alias("dx"), F.median("m.dy").alias("dy"), F.count(F.lit(1)).alias("guides"))
    every = found.select(*keys, order).distinct()
    zero = F.lit(0.0)
    return every.join(moved, [*keys, order], "left").select(*keys, order, F.coalesce("dx", zero).alias("dx"), F.coalesce("dy", zero).alias("dy"), F.coalesce("guides", F.lit(0).cast("long")).alias("guides"))


def follow_shifts(shifts: DataFrame, key: Names, order: str) -> DataFrame:
    """Moves from frame to frame summed up from each key's first frame."""
    w = Window.partitionBy(*_list(key)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return shifts.withColumn("dx", F.sum("dx").over(w)).withColumn("dy", F.sum("dy").over(w))


# Curves


def forced_photometry(frames: DataFrame, requests: DataFrame, on: Names, time: str = "t", before: float = 1.0, behind: float = 1.0, radius: float = 3.0, annulus: tuple[float, float] | None = None) -> DataFrame:
    """(request, on, t, offset, x, y, flux, mag): light at given places and times
    (request, on, at, x, y) in all frames of ``on`` from ``before`` to ``behind``
    seconds around them. ``offset`` counts frames from the one nearest to ``at``.

    A frame meets the requests whose stretch of time it lies in by an equi-join
    on ``on`` and whole stretches.
    """
    keys = _list(on)
    span = before + behind
    wanted = requests.select("request", *keys, F.col("at").cast("double").alias("_at"), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"))
    wanted = wanted.withColumn("_part", F.explode(F.sequence(F.floor((F.col("_at") - before) / span), F.floor((F.col("_at") + behind) / span))))
    rows = frames.withColumn("_part", F.floor(F.col(time) / span)).join(wanted, [*keys, "_part"]).where(F.col(time).between(F.col("_at") - before, F.col("_at") + behind))
    star = F.array(F.struct(F.lit(0).alias("star"), F.col("_x").alias("x"), F.col("_y").alias("y")))
    flux = measured(rows.withColumn("stars", star), ["request", *keys, time, "_at"], radius, annulus)
    w = Window.partitionBy("request", *keys)
    n = F.row_number().over(w.orderBy(time))
    center = F.min_by("_n", F.struct(F.abs(F.col(time) - F.col("_at")), F.col(time))).over(w)
    return flux.withColumn("_n", n).withColumn("offset", (F.col("_n") - center).cast("int")).select("request", *keys, time, "offset", "x", "y", "flux", "mag")
