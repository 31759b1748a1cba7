"""Joins by nearness: in time, in the plane, and on the sky.

Each one buckets the keys by the tolerance, repeats one side over the
neighbouring buckets, joins on equality of buckets (so that Spark can hash or
sort-merge, spill, and split skewed buckets) and then checks the exact
predicate. No nested-loop join is ever planned.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumicurve.session import materialise


def band_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, tolerance: float, on: Sequence[str] = (), strict: bool = False, how: str = "inner") -> DataFrame:
    """Pairs with |left_key - right_key| <= tolerance (< if ``strict``), and equal
    ``on`` columns. The frames must not share other column names. ``how`` is
    inner or left."""
    bucket = lambda c: F.floor(F.col(c) / tolerance)
    wide = right.withColumn("_bucket", F.explode(F.sequence(bucket(right_key) - 1, bucket(right_key) + 1)))
    gap = F.abs(F.col(left_key) - F.col(right_key))
    near = gap < tolerance if strict else gap <= tolerance
    a, b = left.withColumn("_bucket", bucket(left_key)).alias("a"), wide.alias("b")
    same = F.col("a._bucket") == F.col("b._bucket")
    for c in on:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    joined = a.join(b, same & near, how)
    return joined.select("a.*", *[f"b.{c}" for c in right.columns if c not in on]).drop("_bucket")


def plane_join(left: DataFrame, right: DataFrame, left_xy: tuple[str, str], right_xy: tuple[str, str], reach: float, on: Sequence[str] = ()) -> DataFrame:
    """Pairs whose x and y both differ by at most ``reach``: candidates for any
    distance test within it."""
    cell = lambda c: F.floor(F.col(c) / reach)
    step = F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)])
    wide = right.withColumn("_cx", F.explode(F.transform(step, lambda k: cell(right_xy[0]) + k))).withColumn("_cy", F.explode(F.transform(step, lambda k: cell(right_xy[1]) + k)))
    a, b = left.withColumn("_cx", cell(left_xy[0])).withColumn("_cy", cell(left_xy[1])).alias("a"), wide.alias("b")
    same = (F.col("a._cx") == F.col("b._cx")) & (F.col("a._cy") == F.col("b._cy"))
    for c in on:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    near = (F.abs(F.col(left_xy[0]) - F.col(right_xy[0])) <= reach) & (F.abs(F.col(left_xy[1]) - F.col(right_xy[1])) <= reach)
    return a.join(b, same & near).select("a.*", *[f"b.{c}" for c in right.columns if c not in on]).drop("_cx", "_cy")


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance in degrees."""
    a, b = F.radians(dec1), F.radians(dec2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(ra2 - ra1) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), h))))


def _cells(dec_band: Column, reach: float) -> Column:
    """Cells of right ascension in a band of declination, each at least ``reach`` wide on the sky."""
    edge = F.least(F.greatest(F.abs(dec_band * reach), F.abs((dec_band + 1) * reach)), F.lit(90.0))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(edge)) / reach)).cast("long")


def sky_join(left: DataFrame, right: DataFrame, left_sky: tuple[str, str], right_sky: tuple[str, str], reach: float, out: str = "sep") -> DataFrame:
    """Pairs closer than ``reach`` degrees, with their separation. Holds across
    0 and 360 degrees and at the poles."""
    band = lambda c: F.floor(F.col(c) / reach).cast("long")
    place = lambda c, cells: F.floor(F.pmod(F.col(c), F.lit(360.0)) / 360.0 * cells).cast("long")
    one = F.lit(1).cast("long")
    wide = right.withColumn("_band", F.explode(F.sequence(band(right_sky[1]) - one, band(right_sky[1]) + one))).withColumn("_n", _cells(F.col("_band"), reach))
    here = place(right_sky[0], F.col("_n"))
    near_cells = F.array_distinct(F.transform(F.sequence(-one, one), lambda k: F.pmod(here + k, F.col("_n"))))
    wide = wide.withColumn("_cell", F.explode(near_cells)).drop("_n").alias("b")
    a = left.withColumn("_band", band(left_sky[1])).withColumn("_cell", place(left_sky[0], _cells(F.col("_band"), reach))).alias("a")
    sep = separation(F.col(left_sky[0]), F.col(left_sky[1]), F.col(right_sky[0]), F.col(right_sky[1]))
    same = (F.col("a._band") == F.col("b._band")) & (F.col("a._cell") == F.col("b._cell"))
    joined = a.join(wide, same).withColumn(out, sep).where(F.col(out) < reach)
    return joined.select("a.*", *[f"b.{c}" for c in right.columns], out).drop("_band", "_cell")


def sky_least(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_sky: tuple[str, str], right_sky: tuple[str, str], reach: float, value: str, out: str = "sep") -> DataFrame:
    """(left_id, right_id, value, sep): of the right rows closer than ``reach``
    degrees the one of least value, then the nearest, then of least id."""
    band = lambda c: F.floor(F.col(c) / reach).cast("long")
    place = lambda c, cells: F.floor(F.pmod(F.col(c), F.lit(360.0)) / 360.0 * cells).cast("long")
    one = F.lit(1).cast("long")
    at = F.struct(F.col("_band"), F.col("_place"))
    points = right.select(right_id, *right_sky, value).withColumn("_band", band(right_sky[1])).withColumn("_place", place(right_sky[0], _cells(F.col("_band"), reach)))
    wide = left.select(left_id, *left_sky).withColumn("_band", F.explode(F.sequence(band(left_sky[1]) - one, band(left_sky[1]) + one))).withColumn("_n", _cells(F.col("_band"), reach))
    here = place(left_sky[0], F.col("_n"))
    wide = wide.withColumn("_place", F.explode(F.array_distinct(F.transform(F.sequence(-one, one), lambda k: F.pmod(here + k, F.col("_n"))))))
    drop = lambda df: df.withColumn("_cell", at).drop("_band", "_place", "_n")
    sep = lambda get: separation(F.col(left_sky[0]), F.col(left_sky[1]), get(right_sky[0]), get(right_sky[1]))
    best = least_near(drop(wide), drop(points), left_id, value, lambda get: sep(get) < reach, lambda get: [sep(get).alias(out), get(right_id).alias(right_id)])
    return best.select(left_id, *[F.col("_best")[c].alias(c) for c in (right_id, value, out)])


def best_match(pairs: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first pair of each key in the given ascending order (nulls first), by
    a minimum that is combined before the shuffle."""
    rest = [c for c in pairs.columns if c != key]
    best = pairs.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*[F.col(c) if c == key else F.col("_best")[c].alias(c) for c in pairs.columns])


#: Points of a cell, those of least value, that all who look at the cell are compared with.
TOP = 64


def least_near(asks: DataFrame, points: DataFrame, key: str, value: str, near: Callable[[Callable[[str], Column]], Column], order: Callable[[Callable[[str], Column]], list[Column]], top: int = TOP) -> DataFrame:
    """(key, _best): of the points near a row the first by ``value`` (nulls
    first) and ``order``, as a struct of these; rows without one are left out.

    ``asks`` has a row for each cell (``_cell``) that a key looks at, ``points``
    one for each point, in its own cell; ``near`` and ``order`` take what gives a
    point's column. A key meets the ``top`` least points of each cell. Only cells
    in which more may be as good as the best one found are then looked at
    further, so that a dense field costs a bounded number of comparisons a key;
    only where the least points of a cell are all beyond reach of the many that
    look at it, its pairs are made.
    """
    ranked = points.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy(value)))
    names = [value, *[c for c in points.columns if c not in ("_cell", value)]]
    least = ranked.where(F.col("_rank") <= top).groupBy("_cell").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("_top"))
    tops = least.join(points.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")), "_cell")
    sized = lambda get: F.struct(get(value).alias(value), *order(get))
    hits = F.transform(F.filter("_top", lambda p: near(lambda c: p[c])), lambda p: sized(lambda c: p[c]))
    met = asks.join(tops, "_cell").withColumn("_hit", F.array_min(hits)).withColumn("_last", F.element_at("_top", -1)[value])
    more = (F.col("_n") > top) & (F.col("_hit").isNull() | (F.struct(F.col(f"_hit.{value}").alias("v")) >= F.struct(F.col("_last").alias("v"))))
    own = [c for c in asks.columns if c not in (key, "_cell")]
    found = met.groupBy(key, *own).agg(F.min("_hit").alias("_best"), F.collect_list(F.when(more, F.struct("_last", "_cell"))).alias("_open"))
    maybe = lambda v: F.col("_best").isNull() | (F.struct(v.alias("v")) <= F.struct(F.col(f"_best.{value}").alias("v")))
    found = materialise(found.withColumn("_open", F.filter("_open", lambda o: maybe(o["_last"]))), "least")
    left = found.where(F.size("_open") > 0).select(key, *own, "_best", F.explode("_open._cell").alias("_cell"))
    rest = left.join(ranked.where(F.col("_rank") > top), "_cell").where(maybe(F.col(value)) & near(F.col)).select(key, sized(F.col).alias("_best"))
    both = found.where("_best IS NOT NULL").select(key, "_best").unionByName(rest)
    return both.groupBy(key).agg(F.min("_best").alias("_best"))


def neighbours(rows: DataFrame, on: Sequence[str], time: str, mark: str, span: float = 3600.0) -> DataFrame:
    """Add ``_a``, the ``mark`` of the last marked row at or before each row's
    time, and ``_b``, that of the first one behind it.

    ``mark`` is a struct that begins with the time, null on rows that only look
    for others. Rows are dealt by ``on`` and stretches of ``span``; what holds
    at a stretch's edges comes from one row per stretch. Both passes run from
    the start of their order, so the cost is a sort whatever the gaps are. Of
    marks of one time the least counts.
    """
    keys = [*on, "_part"]
    rows = rows.withColumn("_part", F.floor(F.col(time) / span))
    marked = F.when(F.col(mark).isNotNull(), F.struct(-F.col(time), F.col(mark)))
    edges = rows.groupBy(*keys).agg(F.min_by(mark, marked).alias("_hi"), F.min(mark).alias("_lo"))
    up = Window.partitionBy(*on).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*on).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*[F.col(c).alias(f"_e_{c}") for c in keys], F.last("_hi", ignorenulls=True).over(up).alias("_before"), F.last("_lo", ignorenulls=True).over(down).alias("_behind"))
    looks = F.col(mark).isNull().cast("int")
    back = Window.partitionBy(*keys).orderBy(F.col(time), looks, F.desc(mark)).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(looks), F.desc(mark)).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in keys]
    both = rows.join(edges, same, "left").select(*rows.columns, "_before", "_behind")
    both = both.withColumn("_a", F.last(mark, ignorenulls=True).over(back)).withColumn("_b", F.last(mark, ignorenulls=True).over(ahead))
    return both.withColumn("_a", F.coalesce("_a", "_before")).withColumn("_b", F.coalesce("_b", "_behind")).drop("_part", "_before", "_behind")


def first_within(left: DataFrame, right: DataFrame, left_id: str, left_time: str, right_id: str, right_time: str, tolerance: float, strict: bool = False, span: float | None = None) -> DataFrame:
    """Each left row (one a ``left_id``) that has a right row within the tolerance
    in time (under it if ``strict``), with ``right_id`` and ``right_time`` of the
    earliest one, the least id on ties.

    The earliest is the first one at or behind the time less the tolerance, so
    both sides merge in ordered stretches of ``span`` (some tolerances, unless
    given) and no pair is made: the cost is a sort, however many rows are near.
    """
    near = lambda t: F.abs(F.col(left_time) - t) < tolerance if strict else F.abs(F.col(left_time) - t) <= tolerance
    named = right.where(F.col(right_time).isNotNull()).groupBy(F.col(right_time).alias("_t")).agg(F.min(right_id).alias("_id"))
    marks = named.select("_t", F.struct("_t", "_id").alias("_k"))
    kind = marks.schema["_k"].dataType
    asks = left.where(F.col(left_time).isNotNull()).withColumn("_t", F.col(left_time) - tolerance).withColumn("_k", F.lit(None).cast(kind))
    both = asks.unionByName(marks, allowMissingColumns=True)
    m = neighbours(both, [], "_t", "_k", span or max(6 * tolerance, 3600.0)).where("_k IS NULL")
    # A mark at the edge itself counts if it is near; the edge is rounded, the difference is what is asked.
    edge = (F.col("_a._t") == F.col("_t")) & near(F.col("_a._t"))
    found = m.withColumn("_m", F.when(edge, F.col("_a")).otherwise(F.col("_b"))).where(near(F.col("_m._t")))
    return found.select(*left.columns, F.col("_m._id").alias(right_id), F.col("_m._t").alias(right_time))


def asof_nearest(left: DataFrame, right: DataFrame, left_id: str, left_time: str, right_time: str, payload: Sequence[str], on: Sequence[str] = (), span: float = 3600.0) -> DataFrame:
    """For each left row the right row nearest in time, the earlier one on ties;
    null where there is none. ``span``: the stretch of time dealt to a task."""
    known = F.struct(F.col(right_time).alias("t"), *[F.col(c) for c in payload])
    # The columns that name the rows are made up here, so none of the frames' own can clash.
    lhs = left.select(*on, F.col(left_time).alias("_t"), F.lit(0).alias("_side"), F.col(left_id).alias("_id"), F.lit(None).cast(right.select(known.alias("k")).schema["k"].dataType).alias("_k"))
    rhs = right.select(*on, F.col(right_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(left.schema[left_id].dataType).alias("_id"), known.alias("_k"))
    m = neighbours(lhs.unionByName(rhs), on, "_t", "_k", span).where("_side = 0")
    use_b = F.col("_a").isNull() | (F.col("_b").isNotNull() & (F.col("_b.t") - F.col("_t") < F.col("_t") - F.col("_a.t")))
    pick = F.when(use_b, F.col("_b")).otherwise(F.col("_a"))
    return m.select(*on, F.col("_id").alias(left_id), F.abs(pick["t"] - F.col("_t")).alias("dt"), *[pick[c].alias(c) for c in payload])
