"""Exact medians in bounded memory, whatever a key holds.

``F.median`` keeps every distinct value of a key in one buffer. Here a key's
middle is closed in on instead: a sketch of percentiles gives a narrow range
around it, two counts say where the middle is in that range, and the next round
looks at the range alone. Once it holds few values, those are sorted. Every step
is an aggregate that combines before the shuffle; a round leaves a row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicurve.operators.series import Names, _list
from lumicurve.operators.stretches import null_safe
from lumicurve.session import materialise

#: Values of a key that may be gathered; steps of the percentiles; accuracy of their sketch.
MOST, STEPS, ACCURACY = 10_000, 100, 10_000


def _inside(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the keys in ``state`` that are in their range."""
    return null_safe(rows, state, keys).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """``state`` with ranges around the middle a few percentiles wide, and without
    the values at their edges where the middle is none of them."""
    part = _inside(rows, state, keys)
    marks = F.percentile_approx("_v", F.array(*[F.lit(k / STEPS) for k in range(STEPS + 1)]), ACCURACY)
    place = lambda r: (F.col(r) - F.col("_below")) / F.greatest(F.col("_inside") - 1, F.lit(1)) * STEPS
    low, high = F.greatest(F.floor(place("_r0")) - 1, F.lit(0)), F.least(F.ceil(place("_r1")) + 1, F.lit(STEPS))
    at = null_safe(state, part.groupBy(*keys).agg(marks.alias("_m")), keys)
    at = at.select(*keys, "_n", "_r0", "_r1", "_below", F.element_at("_m", (low + 1).cast("int")).alias("_lo"), F.element_at("_m", (high + 1).cast("int")).alias("_hi"), F.col("_lo").alias("_lo0"), F.col("_hi").alias("_hi0"))
    at = materialise(at, "ranges")
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    seen = null_safe(rows, at, keys).where((v >= F.col("_lo0")) & (v <= F.col("_hi0")))
    count = lambda test, name: F.count_if(test).alias(name)
    counts = seen.groupBy(*keys).agg(count(v < lo, "_less"), count((v >= lo) & (v <= hi), "_in"), count(v == lo, "_at_lo"), count(v == hi, "_at_hi"), F.min(F.when(v > lo, v)).alias("_next"), F.max(F.when(v < hi, v)).alias("_last"), F.count(F.lit(1)).alias("_all"))
    out = null_safe(at, counts, keys).withColumn("_below", F.col("_below") + F.col("_less"))
    # Percentiles are estimates: if the middle is not in their range, the old one stays (its edges are dropped below).
    missed = (F.col("_r0") < F.col("_below")) | (F.col("_r1") >= F.col("_below") + F.col("_in"))
    kept = out.where(~missed)
    first, last = F.col("_below") + F.col("_at_lo"), F.col("_below") + F.col("_in") - F.col("_at_hi")
    value = lambda r: F.when(F.col(r) < first, lo).when(F.col(r) >= last, hi).when(F.col(r) == first, F.col("_next")).when(F.col(r) == last - 1, F.col("_last"))
    kept = kept.withColumn("_v0", value("_r0")).withColumn("_v1", value("_r1"))
    drop_lo, drop_hi = F.col("_r0") >= first, F.col("_r1") < last
    kept = kept.select(*keys, "_n", "_r0", "_r1", (F.col("_below") + F.when(drop_lo, F.col("_at_lo")).otherwise(0)).alias("_below"), F.when(drop_lo, F.col("_next")).otherwise(lo).alias("_lo"), F.when(drop_hi, F.col("_last")).otherwise(hi).alias("_hi"), (F.col("_in") - F.when(drop_lo, F.col("_at_lo")).otherwise(0) - F.when(drop_hi, F.col("_at_hi")).otherwise(0)).alias("_inside"), "_v0", "_v1")
    none = F.lit(None).cast("double")
    lost = out.where(missed).select(*keys, "_n", "_r0", "_r1", (F.col("_below") - F.col("_less")).alias("_below"), F.col("_lo0").alias("_lo"), F.col("_hi0").alias("_hi"), F.col("_all").alias("_inside"), none.alias("_v0"), none.alias("_v1"))
    return kept.unionByName(lost)


def exact_medians(df: DataFrame, key: Names, value: str | Column, out: str = "median", most: int = MOST, rounds: int = 40) -> DataFrame:
    """(key, n, out): the exact median of each key's values and their number. At
    most ``most`` values of a key are ever in one buffer.

    Nulls and NaN are left out; a key without values has no row; a null key is a
    key. Raises if a range has not closed in after ``rounds`` (each takes some
    ninety-five hundredths of it away).
    """
    keys = _list(key)
    rows = df.select(*keys, (F.col(value) if isinstance(value, str) else value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    n = F.col("_n")
    state = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    none = F.lit(None).cast("double")
    state = materialise(state.select(*keys, "_n", F.floor((n - 1) / 2).alias("_r0"), F.floor(n / 2).alias("_r1"), F.lit(0).cast("long").alias("_below"), "_lo", "_hi", n.alias("_inside"), none.alias("_v0"), none.alias("_v1")), "middles")
    wide = "_v1 IS NULL AND _lo < _hi AND _inside > {} OR _v0 IS NULL AND _lo < _hi AND _inside > {}".format(most, most)
    for _ in range(rounds):
        active = state.where(wide)
        if active.isEmpty():
            break
        done = state.where(f"NOT ({wide})")
        state = materialise(done.unionByName(_narrowed(rows, active, keys)), "middles")
    else:
        raise RuntimeError(f"medians have not settled in {rounds} rounds")
    open_ = state.where("(_v0 IS NULL OR _v1 IS NULL) AND _lo < _hi")
    sorted_ = _inside(rows, open_.select(*keys, "_lo", "_hi"), keys).groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias("_s"))
    both = null_safe(state, sorted_, keys, "left")
    found = lambda k: F.coalesce(F.col(f"_v{k}"), F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")), F.try_element_at("_s", (F.col(f"_r{k}") - F.col("_below") + 1).cast("int")))
    return both.select(*keys, F.col("_n").alias("n"), ((found(0) + found(1)) / 2).alias(out))


def exact_mads(df: DataFrame, key: Names, value: str, most: int = MOST) -> DataFrame:
    """(key, n, median, mad): the median and the median of the absolute distances from it."""
    keys = _list(key)
    middle = materialise(exact_medians(df, keys, value, most=most), "medians")
    apart = null_safe(df, middle, keys).select(*keys, F.abs(F.col(value) - F.col("median")).alias("_apart"))
    return null_safe(middle, exact_medians(apart, keys, "_apart", "mad", most).drop("n"), keys)
