"""Tables of a night's report: log events, weather, tiers, diagnostics, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumicurve.operators.series import Names, _list

# A log event's text and the marker that stands for it.
EVENT_MARKERS = {"INFO: Weather unsafe!": "x", "ALERT: Dome closed!": "D"}
# Colours of the telescopes, and the order in which they are preferred.
COLOURS = {"REDBIRD": "Red", "GREENBIRD": "Green", "BLUEBIRD": "Blue"}
PREFERENCE = ("Green", "Red", "Blue")
#: What is added to the sky's temperature difference for drawing.
SKY_OFFSET = 14.55

# Right ascension and declination of the observed fields.
FIELDS = {
    "field1": (273.736, -18.640),
    "field2": (92.419, 23.902),
    "field3": (287.740, -17.914),
    "field4": (105.436, 22.379),
    "field5": (254.789, -27.225),
    "field6": (129.972, 19.312),
    "field7": (75.678, 23.580),
    "field8": (306.006, -14.551),
    "field9": (239.923, -25.287),
    "field10": (56.973, 23.942),
    "field11": (318.700, -11.365),
    "field12": (226.499, -22.274),
    "field13": (334.365, -10.910),
    "field14": (212.040, -17.675),
    "field15": (39.313, 17.413),
    "field16": (143.292, 10.261),
    "field17": (348.814, -0.699),
    "field18": (155.530, 5.914),
    "field19": (1.693, 3.707),
    "field20": (15.529, 2.557),
    "field21": (25.171, 14.130),
    "field22": (198.755, -11.953),
    "field23": (184.631, -3.816),
    "field24": (172.488, 0.500),
}


def fields(spark: SparkSession) -> DataFrame:
    """(field, ra, dec) of all fields."""
    return spark.createDataFrame([(n, *c) for n, c in FIELDS.items()], "field string, ra double, dec double")


def with_field(rows: DataFrame, field: str = "field") -> DataFrame:
    """The rows with their fields' coordinates, null for an unknown field."""
    known = fields(rows.sparkSession).select(F.col("field").alias(field), F.col("ra").alias("field_ra"), F.col("dec").alias("field_dec"))
    return rows.join(F.broadcast(known), field, "left")


def colour(name: Column) -> Column:
    """A telescope's colour by its name or colour in any case; other names stay."""
    out = name
    for label, c in COLOURS.items():
        out = F.when(F.upper(name).isin(label, c.upper()), c).otherwise(out)
    return out


# Logs


def log_events(log: DataFrame, markers: dict[str, str] = EVENT_MARKERS, line: str = "line") -> DataFrame:
    """The lines that tell of an event, each with its marker; a line that tells
    of several comes once for each."""
    hits = F.array_compact(F.array(*[F.when(F.contains(line, F.lit(text)), F.lit(mark)) for text, mark in markers.items()]))
    return log.withColumn("marker", F.explode(hits))


def plan_entries(log: DataFrame, line: str = "line") -> DataFrame:
    """(path, field, jd) of the lines of old plans: field and Julian date are the
    first and the third word behind the first colon."""
    words = F.split(F.try_element_at(F.split(line, ": "), F.lit(2)), " ")
    kept = log.where(F.contains(line, F.lit("starts")) & ~F.contains(line, F.lit("Current LST")))
    return kept.select("path", F.try_element_at(words, F.lit(1)).alias("field"), F.try_element_at(words, F.lit(3)).try_cast("double").alias("jd"))


def previous_date(files: DataFrame, path: str = "path") -> DataFrame:
    """(date): what stands before the underscore in the first table's name; null if there is none."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return files.where(F.contains(name, F.lit(".csv"))).agg(F.min(F.split(name, "_")[0]).alias("date"))


def minute_blocks(minutes: DataFrame, time: str, height: Column, minutes_long: float = 1.0) -> DataFrame:
    """The minutes with the corners of their blocks on a time line: t0, t1, low, high."""
    return minutes.withColumn("t0", F.col(time)).withColumn("t1", F.col(time) + 60.0 * minutes_long).withColumn("low", height - 0.4).withColumn("high", height + 0.4)


def preferred(rows: DataFrame, scope: str, by: Names = (), order: Sequence[str] = PREFERENCE) -> DataFrame:
    """Of each ``by`` the rows of the most preferred scope that has any."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(scope)), F.lit(0))
    ranked = rows.withColumn("_rank", F.when(rank > 0, rank)).where("_rank IS NOT NULL")
    if not _list(by):
        least = ranked.agg(F.min("_rank").alias("_least"))
        return ranked.join(F.broadcast(least)).where("_rank = _least").drop("_rank", "_least")
    least = ranked.groupBy(*_list(by)).agg(F.min("_rank").alias("_least"))
    return ranked.join(least, _list(by)).where("_rank = _least").drop("_rank", "_least")


def night_logs(logs: DataFrame, sunset: str, sunrise: str, scope: str = "scope", date: str = "date", order: Sequence[str] = PREFERENCE) -> DataFrame:
    """Logs of one night: those of the first scope that has one for every date
    the night touches. ``logs``: scope, date (yyyyMMdd), .."""
    wanted = sorted({sunset, sunrise})
    kept = logs.where(F.col(date).isin(*wanted))
    full = kept.groupBy(scope).agg(F.count_distinct(date).alias("_n")).where(F.col("_n") == len(wanted)).select(scope)
    return preferred(kept.join(full, scope), scope, (), order)


def night_weather(weather: DataFrame, sun: DataFrame, time: str = "t", value: str = "sky_delta", by: Names = ()) -> DataFrame:
    """Weather strictly between sunset and sunrise, with its drawn value."""
    s = sun.select(*_list(by), F.col("sunset").alias("_set"), F.col("sunrise").alias("_rise"))
    both = weather.join(s, _list(by)) if _list(by) else weather.join(F.broadcast(s))
    return both.where((F.col(time) > F.col("_set")) & (F.col(time) < F.col("_rise"))).drop("_set", "_rise").withColumn("drawn", F.col(value) + SKY_OFFSET)


def star_hour_series(summary: DataFrame, by: Names, time: str) -> DataFrame:
    """The minutes with the star hours up to them, and whether something was detected."""
    w = Window.partitionBy(*_list(by)).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return summary.withColumn("star_hours", F.sum("stars").over(w) / 60.0).withColumn("marked", F.col("detec") > 0)


def sensitivity_of_night(stars: DataFrame, minute: str, alt: Column, airmass: Column, order: str) -> DataFrame:
    """(minute, stars, alt, airmass): how many stars each minute has, and what
    holds for its middle row."""
    w = Window.partitionBy(minute)
    rows = stars.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_k", F.row_number().over(w.orderBy(order)) - 1).withColumn("_alt", alt).withColumn("_am", airmass)
    return rows.groupBy(minute).agg(F.max("_n").alias("stars"), F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2), F.col("_alt"))).alias("alt"), F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2), F.col("_am"))).alias("airmass"))


# Detections


def copied_name(name: Column, sigma: Column) -> Column:
    """The name under which a detection is kept: without its ending, with its significance."""
    return F.concat(F.regexp_replace(name, r"\.txt$", ""), F.format_string("_sig%.2f.txt", F.coalesce(sigma, F.lit(0.0))))


def night_date(name: Column) -> Column:
    """The date in front of a folder's name; 2020-01-01 without one."""
    return F.coalesce(F.try_to_timestamp(F.substring(name, 1, 10), F.lit("yyyy-MM-dd")).cast("date"), F.lit("2020-01-01").cast("date"))


def tier_sigmas(matched: DataFrame, group: str = "match_id", scope: str = "scope", sigma: str = "sigma", tier: str = "tier") -> DataFrame:
    """(group, tier, kind, sigma1, sigma2, sigma3): kind is satellite for Tier1,
    double and triple for Tier2 and Tier3, with as many sigmas in the order of
    the scopes; other tiers have neither."""
    w = Window.partitionBy(group).orderBy(scope, sigma)
    ranked = matched.withColumn("_k", F.row_number().over(w))
    count = F.when(F.col(tier) == "Tier2", 2).when(F.col(tier) == "Tier3", 3).otherwise(0)
    of = lambda k: F.max(F.when((F.col("_k") == k) & (count >= k), F.col(sigma))).alias(f"sigma{k}")
    kind = F.when(F.col(tier) == "Tier1", "satellite").when(F.col(tier) == "Tier2", "double").when(F.col(tier) == "Tier3", "triple")
    return ranked.groupBy(group, tier).agg(*[of(k) for k in (1, 2, 3)]).select(group, tier, kind.alias("kind"), "sigma1", "sigma2", "sigma3")


def reported_matches(matches: DataFrame, tier: str = "tier") -> DataFrame:
    """Matches of Tier2 and Tier3, which alone are reported."""
    return matches.where(F.col(tier).isin("Tier2", "Tier3"))


def kernel_report(results: DataFrame, parameters: DataFrame, sources: DataFrame) -> DataFrame:
    """One line per event with its best kernel, the kernel's parameters and the
    source at its place, as text; events without a kernel are left out."""
    rows = results.where("kernel_id IS NOT NULL AND kernel_id >= 0").join(parameters, "kernel_id", "left").join(sources, "star", "left")
    number = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in ("object_r", "star_d", "impact", "shift", "ra", "dec", "gmag", "bp_rp")]
    line = F.format_string("%s %f %f %s %d %f %d %f %f %f %f %f %f %f %f", F.col("star").cast("string"), "x", "y", "t", F.col("kernel_id"), "chi", F.col("offset"), *number)
    return rows.select("event_id", line.alias("value"))


def errors(*checks: tuple[str, str, DataFrame]) -> DataFrame:
    """(scope, stage, message) of what went wrong: ``checks`` are a stage, a
    message and the rows (scope) it is true of."""
    out = None
    for stage, message, rows in checks:
        one = rows.select(F.col("scope"), F.lit(stage).alias("stage"), F.lit(message).alias("message"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no checks")
    return out


# Stars


def photometric_hosts(flux: DataFrame, star: Names, value: str = "flux", order: str = "i", least: float = 500.0, fewest: int = 100) -> DataFrame:
    """(star, median) of curves that hold ``fewest`` samples between their first
    and last non-zero one and whose median, of the whole curve, is at least ``least``."""
    lit = F.when(F.col(value) != 0, F.col(order))
    s = flux.groupBy(*_list(star)).agg(F.median(value).alias("median"), (F.max(lit) - F.min(lit) + 1).alias("_n"))
    return s.where((F.col("_n") >= fewest) & (F.col("median") >= least)).drop("_n")


def shallow_kernels(kernels: DataFrame, least: float = 0.8, curve: str = "curve") -> DataFrame:
    """Kernels that nowhere fall to ``least`` or below."""
    return kernels.where(F.array_min(curve) > least)


def kernel_changes(before: DataFrame, after: DataFrame, on: Names = "kernel_id") -> DataFrame:
    """The kernels of equal parameters before and after: (on, depth_before, depth_after)."""
    a = before.select(*_list(on), (1 - F.array_min("curve")).alias("depth_before"))
    return a.join(after.select(*_list(on), (1 - F.array_min("curve")).alias("depth_after")), _list(on))


def star_options(stars: DataFrame, gmag: tuple[float, float] | None = None) -> DataFrame:
    """(star, label), brightest signal first. The range of magnitudes holds only
    if any star has a magnitude."""
    kept = stars
    if gmag is not None:
        some = stars.agg(F.bool_or(F.col("gmag").isNotNull()).alias("_some"))
        kept = stars.join(F.broadcast(some)).where(~F.coalesce("_some", F.lit(False)) | F.col("gmag").between(*gmag)).drop("_some")
    label = F.concat(F.lit("star "), F.col("star").cast("string"), F.lit(" SNR "), F.format_string("%.1f", "snr"), F.when(F.col("gmag").isNotNull(), F.format_string(" G %.2f", "gmag")).otherwise(""))
    return kept.select("star", "snr", label.alias("label")).orderBy(F.desc_nulls_last("snr"), "star")


def selected_stars(stars: DataFrame, ids: Sequence[int] | None = None, most: int = 50) -> DataFrame:
    """The stars of the given ids that there are, else the ``most`` of best signal-to-noise."""
    if ids is not None:
        return stars.where(F.col("star").isin(*map(int, ids)))
    return stars.orderBy(F.desc_nulls_last("snr"), "star").limit(most)


def at_place(rows: DataFrame, x: float, y: float, half: float = 0.0) -> DataFrame:
    """Rows at a place exactly, or within a box around it."""
    return rows.where(F.col("x").between(x - half, x + half) & F.col("y").between(y - half, y + half))


def magnitude_diagnostic(mags: DataFrame, meta: DataFrame, star: str = "star") -> DataFrame:
    """(star, gmag, mag): catalogue magnitude and median instrumental one of each
    matched star."""
    m = mags.groupBy(star).agg(F.median("mag").alias("mag"))
    return meta.where("gmag IS NOT NULL").select(star, "gmag").join(m, star)


def position_residuals(stars: DataFrame) -> DataFrame:
    """(star, d_ra, d_dec) in seconds of arc against the catalogue's ra0, dec0."""
    d_ra = (F.col("ra") - F.col("ra0")) * 3600 * F.cos(F.radians("dec"))
    return stars.where("ra0 IS NOT NULL AND dec0 IS NOT NULL").select("star", d_ra.alias("d_ra"), ((F.col("dec") - F.col("dec0")) * 3600).alias("d_dec"))


def star_meta(positions: DataFrame, sky: DataFrame, sources: DataFrame, star: str = "star") -> DataFrame:
    """What is known of each star in one row; a star that a table holds twice is an error."""
    out = positions
    for table in (sky, sources):
        one = table.groupBy(star).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in table.columns if c != star])
        checked = one.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("a star is in a table twice"))).otherwise(F.col("_n")))
        out = out.join(checked, star, "left").where("_n IS NULL OR _n = 1").drop("_n")
    return out


def aperture_sigma(stars: DataFrame, by: Names = (), r: str = "r", factor: float = 2.35) -> DataFrame:
    """(by, sigma): the mean width of the stars, of which r is half the radius."""
    return stars.groupBy(*_list(by)).agg(F.avg(2 * F.col(r) / factor).alias("sigma"))


# Order


def paged(rows: DataFrame, order: Sequence[Column], size: int = 16) -> DataFrame:
    """The rows with the page they are on (from 0) in the given order and their
    place on it; for tables that are shown, a few thousand rows."""
    n = F.row_number().over(Window.orderBy(*order)) - 1
    return rows.withColumn("_n", n).withColumn("page", F.floor(F.col("_n") / size).cast("int")).withColumn("slot", (F.col("_n") % size).cast("int")).drop("_n")


def first_frames_by_date(rows: DataFrame, date: str, n: int, by: Names = ()) -> DataFrame:
    """The rows of the first ``n`` distinct dates. Dates are made distinct before
    they are ranked."""
    keys = _list(by)
    dates = rows.select(*keys, date).where(F.col(date).isNotNull()).distinct()
    w = Window.partitionBy(*keys).orderBy(date)
    first = dates.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
    return rows.join(first, [*keys, date], "left_semi")


def event_signal(rows: DataFrame, star: str, date: str, value: str, frames: int, fewest: int = 5) -> DataFrame:
    """(star, n, signal): median over robust deviation of the positive values in
    a star's first frames; null for under ``fewest``."""
    kept = first_frames_by_date(rows, date, frames).where(F.col(value) > 0)
    m = kept.groupBy(star).agg(F.median(value).alias("_m"), F.count(F.lit(1)).alias("n"))
    spread = kept.join(m.select(star, "_m"), star).groupBy(star).agg((1.4826 * F.median(F.abs(F.col(value) - F.col("_m")))).alias("_s"))
    return m.join(spread, star).select(star, "n", F.when((F.col("n") >= fewest) & (F.col("_s") > 0), F.col("_m") / F.col("_s")).alias("signal"))


def outward(rows: DataFrame, index: str, chosen: int) -> DataFrame:
    """The rows from the chosen one outward, the earlier one first on ties."""
    return rows.withColumn("distance", F.abs(F.col(index) - chosen)).orderBy("distance", index)


def frames_to_skip(target: Column, guessed: Column, exposure: float = 0.025) -> Column:
    """Whole exposures from one time (seconds) to another; negative if it is before."""
    return F.floor((target - guessed) / exposure).cast("long")


def time_axis(t: Column, first: Column, unit: str = "seconds") -> Column:
    """Times for drawing: seconds or hours since the first one, or time stamps."""
    if unit not in ("seconds", "hours", "datetime"):
        raise ValueError(f"no such unit: {unit}")
    return F.timestamp_seconds(t) if unit == "datetime" else (t - first) / (3600.0 if unit == "hours" else 1.0)


def zoomed(samples: DataFrame, key: Names, time: str, value: str, seconds: float = 60.0) -> DataFrame:
    """Samples around each series' least value."""
    c = samples.groupBy(*_list(key)).agg(F.min(F.when(F.col(value).isNotNull(), F.struct(value, time)))[time].alias("_c"))
    return samples.join(c, _list(key)).where(F.col(time).between(F.col("_c") - seconds / 2, F.col("_c") + seconds / 2)).drop("_c")
