"""The k nearest points of each target, in a space of any dimension, exactly.

A grid of cells is counted first, so fine that even its densest cell holds only
some times k points, and above it coarser grids whose cells are twice as wide
each. A target takes the finest grid on which its cell and the neighbouring ones
hold k points; only targets that lack them look at a coarser one. The k-th
distance found there bounds the search: where it reaches beyond the neighbouring
cells, a second look at the grid that covers it settles what is nearest. So what
a target is compared with are the points of a few cells around it, in dense and
in sparse places alike, and all joins are equi-joins on cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumicurve.operators.bandjoin import best_match, separation
from lumicurve.session import materialise

#: How many times k points the densest cell of the finest grid may hold, most grids, and grids looked at in one pass.
DENSEST, MOST_LEVELS, AT_ONCE = 4, 60, 4


def _cells(xs: Sequence[str], size: float, level: Column | int) -> list[Column]:
    width = F.lit(size) * F.pow(F.lit(2.0), level if isinstance(level, Column) else F.lit(level))
    return [F.floor(F.col(x) / width).cast("long").alias(f"_c{k}") for k, x in enumerate(xs)]


def _neighbouring(df: DataFrame, dims: int) -> DataFrame:
    """Each row for its cell and every neighbouring one."""
    for j in range(dims):
        c = F.col(f"_c{j}")
        df = df.withColumn(f"_c{j}", F.explode(F.array(c - 1, c, c + 1)))
    return df


def finest_grid(targets: DataFrame, points: DataFrame, xs: Sequence[str], k: int) -> tuple[float, int]:
    """(size of its cells, number of grids): halved until no cell holds over
    ``DENSEST`` times k points (points in one place count once), and as many
    doublings as make a cell as wide as all points and targets together."""
    sides = points.select(*xs, F.lit(0).alias("_side")).union(targets.select(*xs, F.lit(1).alias("_side")))
    ends = {r["_side"]: r for r in sides.groupBy("_side").agg(*[f(x).alias(f"{n}{j}") for j, x in enumerate(xs) for n, f in (("a", F.min), ("b", F.max))], F.count(F.lit(1)).alias("n")).collect()}
    if len(ends) < 2:
        return 1.0, 1
    own, every = ends[0], list(ends.values())
    span = max(own[f"b{j}"] - own[f"a{j}"] for j in range(len(xs))) or 1.0
    reach = max(max(e[f"b{j}"] for e in every) - min(e[f"a{j}"] for e in every) for j in range(len(xs)))
    size = span / max(1.0, (own["n"] / k) ** (1 / len(xs)))
    places, dense = points.select(*xs).distinct(), True
    while dense and size > span * 2.0 ** (4 - MOST_LEVELS):
        # Some halvings are counted in one pass.
        sized = places.withColumn("_level", F.explode(F.sequence(F.lit(1 - AT_ONCE), F.lit(0))))
        most = dict(sized.groupBy("_level", *_cells(xs, size, F.col("_level"))).count().groupBy("_level").agg(F.max("count")).collect())
        fit = [level for level, n in most.items() if n <= DENSEST * k]
        dense = not fit
        size *= 2.0 ** (max(fit) if fit else -AT_ONCE)
    levels = 1
    while size * 2 ** (levels - 1) < reach:
        levels += 1
    return size, levels


def levels_of(targets: DataFrame, points: DataFrame, xs: Sequence[str], size: float, levels: int, k: int) -> DataFrame:
    """(cells of the finest grid, _level) of each cell with targets: the finest
    grid on which it and its neighbours hold k points, else the coarsest. Some
    grids are looked at in one pass, coarser ones only for what is left."""
    own = [f"_c{j}" for j in range(len(xs))]
    parents = [f"_p{j}" for j in range(len(xs))]
    left = targets.select(*_cells(xs, size, 0)).distinct()
    counts = points.groupBy(*_cells(xs, size, 0)).agg(F.count(F.lit(1)).alias("_n"))
    done = None
    for low in range(0, levels, AT_ONCE):
        grids = F.explode(F.sequence(F.lit(low), F.lit(min(low + AT_ONCE, levels) - 1))).alias("_level")
        coarse = [F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level"))).cast("long") for c in own]
        cells = counts.select("*", grids).groupBy("_level", *[c.alias(p) for c, p in zip(coarse, own, strict=True)]).agg(F.sum("_n").alias("_n"))
        asks = left.select("*", grids).select("*", *[c.alias(p) for c, p in zip(coarse, parents, strict=True)])
        # A coarse cell is looked at once, however many of the fine ones in it still lack points.
        wanted = asks.select("_level", *parents).distinct()
        seen = _neighbouring(wanted.withColumns({c: F.col(p) for c, p in zip(own, parents, strict=True)}), len(xs)).join(cells, ["_level", *own])
        enough = seen.groupBy("_level", *parents).agg(F.sum("_n").alias("_n")).where(F.col("_n") >= k).select("_level", *parents, F.lit(True).alias("_enough"))
        met = F.when(F.col("_enough") | (F.col("_level") == levels - 1), F.col("_level"))
        marked = materialise(asks.join(enough, ["_level", *parents], "left").groupBy(*own).agg(F.min(met).alias("_level")), "levels")
        found, left = marked.where("_level IS NOT NULL"), marked.where("_level IS NULL").select(*own)
        done = found if done is None else done.unionByName(found)
        if low + AT_ONCE >= levels or left.isEmpty():
            break
    return done


def _looked_up(targets: DataFrame, points: DataFrame, xs: Sequence[str], size: float, target: str, point: str, exclude_same: bool) -> DataFrame:
    """(target, point, d): targets (with _level) and the points of their cells
    and the neighbouring ones on that grid."""
    own = [f"_c{j}" for j in range(len(xs))]
    used = sorted(r[0] for r in targets.select("_level").distinct().collect())
    if not used:
        used = [0]
    a = _neighbouring(targets.select(F.col(target).alias("_t"), "_level", *[F.col(x).alias(f"_a{j}") for j, x in enumerate(xs)], *_cells(xs, size, F.col("_level"))), len(xs))
    b = points.select(F.col(point).alias("_p"), *[F.col(x).alias(f"_b{j}") for j, x in enumerate(xs)], *xs, F.explode(F.array(*map(F.lit, used))).alias("_level"))
    b = b.select("_p", *[f"_b{j}" for j in range(len(xs))], "_level", *_cells(xs, size, F.col("_level")))
    square = None
    for j in range(len(xs)):
        one = F.pow(F.col(f"_a{j}") - F.col(f"_b{j}"), 2)
        square = one if square is None else square + one
    both = a.join(b, ["_level", *own])
    if exclude_same:
        both = both.where("_t <> _p")
    return both.select("_t", "_p", F.sqrt(square).alias("d"))


def _first(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("_t").orderBy("d", "_p")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def k_nearest(targets: DataFrame, points: DataFrame, k: int, xs: Sequence[str] = ("x", "y"), target: str = "target", point: str = "point", exclude_same: bool = False) -> DataFrame:
    """(target, point, d, rank): the ``k`` nearest points of each target, of all
    there are if they are fewer, ties by the lower point. ``exclude_same`` leaves
    out a point with the target's own id. Rows with a null id or place take no
    part; ids are unique. A few counts per grid are collected, nothing else.
    """
    placed = lambda df, name: df.select(name, *[F.col(x).cast("double").alias(x) for x in xs]).dropna()
    targets, points = placed(targets, target), placed(points, point)
    want = k + exclude_same
    size, levels = finest_grid(targets, points, xs, want)
    own = [f"_c{j}" for j in range(len(xs))]
    level = levels_of(targets, points, xs, size, levels, want)
    first = targets.withColumns(dict(zip(own, _cells(xs, size, 0), strict=True))).join(level, own).drop(*own)
    found = materialise(_first(_looked_up(first, points, xs, size, target, point, exclude_same), k), "nearest")
    # The grid a target looked at shows all points within the width of a cell.
    last = found.groupBy("_t").agg(F.max("d").alias("_d"), F.count(F.lit(1)).alias("_n"))
    width = lambda level: F.lit(size) * F.pow(F.lit(2.0), level)
    again = first.join(last, first[target] == F.col("_t"), "left").where((F.col("_level") < levels - 1) & (F.coalesce("_n", F.lit(0)) < k) | (F.col("_d") > width(F.col("_level"))))
    far = F.when(F.coalesce("_n", F.lit(0)) < k, F.lit(levels - 1)).otherwise(F.least(F.ceil(F.log2(F.col("_d") / size)), F.lit(levels - 1)))
    again = materialise(again.select(target, *xs, F.greatest(far, F.lit(0)).cast("int").alias("_level")), "again")
    settled = found.join(again.select(F.col(target).alias("_t")), "_t", "left_anti")
    more = _first(_looked_up(again, points, xs, size, target, point, exclude_same), k)
    return settled.unionByName(more).select(F.col("_t").alias(target), F.col("_p").alias(point), "d", F.col("rank").cast("long").alias("rank"))


def nearest_point(targets: DataFrame, points: DataFrame, limit: float, xs: Sequence[str] = ("x", "y"), target: str = "target", point: str = "point") -> DataFrame:
    """(target, point, d): the nearest point of each target that has one within
    ``limit``, ties by the lower point. Points in one place are looked at once,
    so neither a dense field nor copies make many pairs."""
    finite = lambda df: df.where(" AND ".join(f"abs(`{x}`) < double('infinity')" for x in xs))
    places = finite(points).where(F.col(point).isNotNull()).groupBy(*xs).agg(F.min(point).alias(point))
    return k_nearest(finite(targets), places, 1, xs, target, point).where(F.col("d") <= limit).select(target, point, "d")


def unit_vector(ra: str, dec: str) -> list[Column]:
    """u, v, w of a place on the sky: nearest along the chord is nearest on the sky."""
    a, d = F.radians(ra), F.radians(dec)
    return [(F.cos(d) * F.cos(a)).alias("u"), (F.cos(d) * F.sin(a)).alias("v"), F.sin(d).alias("w")]


def nearest_star(targets: DataFrame, stars: DataFrame, target: str = "target", star: str = "star") -> DataFrame:
    """(target, star, by, d): the star nearest to each target (id, ra, dec, x, y).

    A target with sky coordinates takes the nearest star that has them, d in
    degrees, if there is one; any other the nearest in pixels. Ties go to the
    lower star. Targets with neither, or that find no star, have no row.
    """
    sky = lambda df: df.where("ra IS NOT NULL AND dec IS NOT NULL")
    on_sky = k_nearest(sky(targets).select(target, *unit_vector("ra", "dec")), sky(stars).select(star, *unit_vector("ra", "dec")), 1, ("u", "v", "w"), target, star)
    on_sky = on_sky.select(target, star, F.lit("sky").alias("by"), F.degrees(2 * F.asin(F.least(F.col("d") / 2, F.lit(1.0)))).alias("d"))
    rest = targets.join(on_sky.select(target), target, "left_anti")
    in_plane = k_nearest(rest, stars, 1, ("x", "y"), target, star)
    return on_sky.union(in_plane.select(target, star, F.lit("pixels").alias("by"), "d"))


def nearest_on_sky(targets: DataFrame, sources: DataFrame, limit: float, target: str = "target", source: str = "source") -> DataFrame:
    """(target, source, sep): of the sources nearer than ``limit`` degrees the
    nearest of each target (id, ra, dec), ties by the lower source. Sources in
    one place are looked at once; the two with the least chords are held against
    each other by their separations."""
    placed = lambda df: df.where("abs(ra) < double('infinity') AND abs(dec) < double('infinity')")
    places = placed(sources).groupBy("ra", "dec").agg(F.min(source).alias(source))
    near = k_nearest(placed(targets).select(target, *unit_vector("ra", "dec")), places.select(source, *unit_vector("ra", "dec")), 2, ("u", "v", "w"), target, source)
    near = near.where(F.col("d") < 2 * math.sin(math.radians(min(limit, 180.0)) / 2) * (1 + 1e-6) + 1e-9).select(target, source)
    a, b = targets.select(target, F.col("ra").alias("ra1"), F.col("dec").alias("dec1")), places.select(source, F.col("ra").alias("ra2"), F.col("dec").alias("dec2"))
    both = near.join(a, target).join(b, source).withColumn("sep", separation(F.col("ra1"), F.col("dec1"), F.col("ra2"), F.col("dec2"))).where(F.col("sep") < limit)
    return best_match(both.select(target, source, "sep"), target, [F.col("sep"), F.col(source)])
