"""Queries of catalogue look-ups and of report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicurve.functions import astro
from lumicurve.operators import reports
from lumicurve.plans.common import r6, seconds, table
from lumicurve.plans.match import SEP, STARS, stars
from lumicurve.plans.registry import query
from lumicurve.sources import catalogue, sinks


@query("cone_search", f"WITH {STARS}, a AS (SELECT 358.5 AS ra, 4.0 AS dec) SELECT star, round({SEP}, 6) AS sep FROM a, s b WHERE {SEP} <= 12 AND b.gmag < 0.1")
def cone_search(spark, sf_dir):
    return catalogue.cone_search(stars(spark, sf_dir), 358.5, 4.0, 12.0, 0.1).select("star", r6("sep").alias("sep"))


@query("field_centre", f"WITH {STARS} SELECT minute, round(median(ra), 4) AS ra, round(median(dec), 4) AS dec FROM s WHERE star % 7 <> 0 GROUP BY minute")
def field_centre(spark, sf_dir):
    s = stars(spark, sf_dir).withColumn("ra", F.when(F.col("star") % 7 != 0, F.col("ra")))
    return catalogue.field_centre(s, ["minute"])


@query("faintest_in_box", f"WITH {STARS}, a AS (SELECT * FROM s WHERE star % 2 = 0), b AS (SELECT * FROM s WHERE star % 2 = 1) SELECT a.star, arg_min(b.star, (b.gmag, b.star)) AS source, round(min(b.gmag), 6) AS snr FROM a LEFT JOIN b ON abs(b.x - a.x) < 0.1 AND abs(b.y - a.y) < 0.1 GROUP BY a.star")
def faintest_in_box(spark, sf_dir):
    s = stars(spark, sf_dir)
    b = s.where("star % 2 = 1").select(F.col("star").alias("source"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("gmag").alias("snr"))
    return catalogue.faintest_in_box(s.where("star % 2 = 0"), b).select("star", "source", r6("snr").alias("snr"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("t", seconds("ts"))


@query("minute_of_event", "WITH e AS (SELECT event_id, event_type, epoch_us(ts) / 1e6 AS t FROM events) SELECT a.event_id, arg_max(b.event_id, (b.t, b.event_id)) AS minute FROM e a JOIN e b ON a.event_type <> 'click' AND b.event_type = 'click' AND b.t <= a.t AND a.t < b.t + 600 GROUP BY a.event_id")
def minute_of_event(spark, sf_dir):
    e = events(spark, sf_dir)
    minutes = e.where("event_type = 'click'").select(F.col("t").alias("start"), F.col("event_id").alias("minute"))
    return catalogue.minute_of(e.where("event_type <> 'click'").select("event_id", "t"), minutes, 600.0).select("event_id", "minute")


@query("star_coordinates", "WITH e AS (SELECT user_id AS star, event_type AS minute_key, event_id, value FROM events), f AS (SELECT minute_key, star, arg_min(value, event_id) AS x, arg_min(value * 2, event_id) AS y FROM e GROUP BY ALL) SELECT minute_key, star, round(CASE WHEN star % 3 = 0 THEN star * 1.5 ELSE x END, 6) AS x, round(CASE WHEN star % 3 = 0 THEN star * 2.5 ELSE y END, 6) AS y FROM f")
def star_coordinates(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("star"), F.col("event_type").alias("minute_key"), F.col("event_id").alias("frame"), F.col("value").alias("x"), (F.col("value") * 2).alias("y"))
    known = s.where("star % 3 = 0").select("minute_key", "star").distinct()
    p = known.select("minute_key", "star", (F.col("star") * 1.5).alias("x"), (F.col("star") * 2.5).alias("y"), F.lit(None).cast("double").alias("ra"), F.lit(None).cast("double").alias("dec"))
    c = catalogue.star_coordinates(s, p)
    return c.select("minute_key", "star", r6("x").alias("x"), r6("y").alias("y"))


TOLD = "CASE event_type WHEN 'error' THEN 'INFO: Weather unsafe!' WHEN 'signup' THEN 'ALERT: Dome closed!' WHEN 'purchase' THEN 'INFO: Weather unsafe! ALERT: Dome closed!' ELSE 'INFO: ' || event_type END"


@query("log_event_markers", f"WITH l AS (SELECT event_id, {TOLD} AS line FROM events) SELECT event_id, 'x' AS marker FROM l WHERE contains(line, 'INFO: Weather unsafe!') UNION ALL SELECT event_id, 'D' FROM l WHERE contains(line, 'ALERT: Dome closed!')")
def log_event_markers(spark, sf_dir):
    return reports.log_events(table(spark, sf_dir, "events").select("event_id", F.expr(TOLD).alias("line"))).select("event_id", "marker")


@query("plan_entries", "SELECT event_id::VARCHAR AS path, 'field' || (user_id % 25) AS field, round(2450000 + value, 6) AS jd FROM events WHERE event_type = 'view'")
def plan_entries(spark, sf_dir):
    what = F.when(F.col("event_type") == "view", "starts").otherwise("ends")
    line = F.concat(F.lit("Fri Jan 05 INFO: field"), (F.col("user_id") % 25).cast("string"), F.lit(" "), what, F.lit(" "), (2450000 + F.col("value")).cast("string"))
    log = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), line.alias("line"))
    return reports.plan_entries(log).select("path", "field", r6("jd").alias("jd"))


NIGHTS = "WITH e AS (SELECT event_id, epoch_us(ts) / 1e6 AS t, strftime(ts, '%Y-%m-%d') AS night, value, event_type FROM events), s AS (SELECT night, min(t) AS rise, max(t) AS sunset FROM e WHERE event_type = 'click' GROUP BY night)"


@query("night_weather", NIGHTS + " SELECT event_id, round(value + 14.55, 6) AS drawn FROM e JOIN s USING (night) WHERE t > rise AND t < sunset AND event_type = 'view'")
def night_weather(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("night", F.date_format("ts", "yyyy-MM-dd"))
    sun = e.where("event_type = 'click'").groupBy("night").agg(F.min("t").alias("sunset"), F.max("t").alias("sunrise"))
    return reports.night_weather(e.where("event_type = 'view'"), sun, "t", "value", "night").select("event_id", r6("drawn").alias("drawn"))


@query("preferred_scope", "WITH e AS (SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 'Green' WHEN 'error' THEN 'Red' WHEN 'signup' THEN 'Blue' ELSE 'other' END AS scope FROM events), r AS (SELECT *, CASE scope WHEN 'Green' THEN 1 WHEN 'Red' THEN 2 WHEN 'Blue' THEN 3 END AS k FROM e) SELECT event_id, user_id, scope FROM (SELECT *, min(k) OVER (PARTITION BY user_id) AS m FROM r WHERE k IS NOT NULL) WHERE k = m")
def preferred_scope(spark, sf_dir):
    scope = F.when(F.col("event_type") == "purchase", "Green").when(F.col("event_type") == "error", "Red").when(F.col("event_type") == "signup", "Blue").otherwise("other")
    return reports.preferred(table(spark, sf_dir, "events").select("event_id", "user_id", scope.alias("scope")), "scope", "user_id").select("event_id", "user_id", "scope")


@query("star_hour_series", "SELECT o_orderkey, round(sum(o_custkey % 50) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) / 60.0, 6) AS star_hours, o_orderkey % 4 > 0 AS marked FROM orders")
def star_hour_series(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 50).alias("stars"), (F.col("o_orderkey") % 4).alias("detec"))
    return reports.star_hour_series(o, "o_orderdate", "o_orderkey").select("o_orderkey", r6("star_hours").alias("star_hours"), "marked")


@query(
    "tier_sigmas",
    "WITH m AS (SELECT l_orderkey AS match_id, l_linenumber AS scope, l_quantity::DOUBLE AS sigma, 'Tier' || (l_orderkey % 4) AS tier FROM lineitem WHERE l_linenumber <= 3), r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY scope, sigma) AS k FROM m), c AS (SELECT *, CASE tier WHEN 'Tier2' THEN 2 WHEN 'Tier3' THEN 3 ELSE 0 END AS n FROM r) "
    "SELECT match_id, tier, CASE tier WHEN 'Tier1' THEN 'satellite' WHEN 'Tier2' THEN 'double' WHEN 'Tier3' THEN 'triple' END AS kind, max(CASE WHEN k = 1 AND n >= 1 THEN sigma END) AS sigma1, max(CASE WHEN k = 2 AND n >= 2 THEN sigma END) AS sigma2, max(CASE WHEN k = 3 AND n >= 3 THEN sigma END) AS sigma3 FROM c GROUP BY match_id, tier",
)
def tier_sigmas(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("scope"), F.col("l_quantity").cast("double").alias("sigma"), F.concat(F.lit("Tier"), (F.col("l_orderkey") % 4).cast("string")).alias("tier"))
    return reports.tier_sigmas(m)


@query("copied_names", "SELECT event_id, 'det_' || event_id || '_sig' || printf('%.2f', coalesce(CASE WHEN event_id % 5 > 0 THEN value END, 0)) || '.txt' AS name, CASE WHEN event_id % 3 = 0 THEN '2020-01-01' ELSE strftime(ts, '%Y-%m-%d') END AS night FROM events")
def copied_names(spark, sf_dir):
    name = F.concat(F.lit("det_"), F.col("event_id").cast("string"), F.lit(".txt"))
    folder = F.when(F.col("event_id") % 3 == 0, "no date here").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("_night")))
    return table(spark, sf_dir, "events").select("event_id", reports.copied_name(name, F.when(F.col("event_id") % 5 > 0, F.col("value"))).alias("name"), F.date_format(reports.night_date(folder), "yyyy-MM-dd").alias("night"))


FIELD_SQL = ", ".join(f"('{n}', {a}, {d})" for n, (a, d) in reports.FIELDS.items())


@query("field_lookup", f"WITH f(field, ra, dec) AS (VALUES {FIELD_SQL}) SELECT event_id, ra::DOUBLE AS field_ra, dec::DOUBLE AS field_dec FROM events LEFT JOIN f ON field = 'field' || (user_id % 30)")
def field_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("field"), (F.col("user_id") % 30).cast("string")).alias("field"))
    return reports.with_field(e).select("event_id", "field_ra", "field_dec")


@query("photometric_hosts", "WITH e AS (SELECT user_id AS star, CASE WHEN event_id % 4 = 0 THEN 0 ELSE value END AS flux, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), s AS (SELECT star, median(flux) AS median, max(CASE WHEN flux <> 0 THEN i END) - min(CASE WHEN flux <> 0 THEN i END) + 1 AS n FROM e GROUP BY star) SELECT star, round(median, 6) AS median FROM s WHERE n >= 10 AND median >= 5")
def photometric_hosts(spark, sf_dir):
    from lumicurve.operators.series import indexed

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("star"), "event_id", F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(F.col("value")).alias("flux"))
    return reports.photometric_hosts(indexed(e, "star", "event_id"), "star", least=5.0, fewest=10).select("star", r6("median").alias("median"))


@query("shallow_kernels", "SELECT vec_id FROM embeddings WHERE list_min(embedding)::DOUBLE + 1 > 0.7")
def shallow_kernels(spark, sf_dir):
    k = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") + 1).alias("curve"))
    return reports.shallow_kernels(k, 0.7).select("vec_id")


@query("star_options", "SELECT s_suppkey AS star, 'star ' || s_suppkey || ' SNR ' || printf('%.1f', s_acctbal::DOUBLE + 0.003) || CASE WHEN s_suppkey % 2 = 0 THEN printf(' G %.2f', (s_nationkey / 2.0)::DOUBLE) ELSE '' END AS label FROM supplier WHERE s_suppkey % 2 = 0 AND s_nationkey / 2.0 BETWEEN 3 AND 9")
def star_options(spark, sf_dir):
    gmag = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey") / 2.0)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("star"), (F.col("s_acctbal").cast("double") + 0.003).alias("snr"), gmag.alias("gmag"))
    return reports.star_options(s, (3.0, 9.0)).select("star", "label")


@query("paged_stars", "WITH n AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS n FROM supplier) SELECT s_suppkey, (n // 16)::INT AS page, (n % 16)::INT AS slot FROM n")
def paged_stars(spark, sf_dir):
    return reports.paged(table(spark, sf_dir, "supplier"), [F.desc("s_acctbal"), F.col("s_suppkey")]).select("s_suppkey", "page", "slot")


@query(
    "first_frames_signal",
    "WITH d AS (SELECT o_orderdate, dense_rank() OVER (ORDER BY o_orderdate) AS k FROM orders GROUP BY o_orderdate), k AS (SELECT o_custkey AS star, o_totalprice::DOUBLE AS v FROM orders JOIN d USING (o_orderdate) WHERE k <= 900 AND o_totalprice > 0), m AS (SELECT star, median(v) AS m, count(*) AS n FROM k GROUP BY star), s AS (SELECT star, 1.4826 * median(abs(v - m)) AS s FROM k JOIN m USING (star) GROUP BY star) SELECT star, n, round(CASE WHEN n >= 5 AND s > 0 THEN m / s END, 6) AS signal FROM m JOIN s USING (star)",
)
def first_frames_signal(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("star"), "o_orderdate", F.col("o_totalprice").cast("double").alias("v"))
    return reports.event_signal(o, "star", "o_orderdate", "v", 900).select("star", "n", r6("signal").alias("signal"))


@query("outward_minutes", "SELECT n_nationkey, abs(n_nationkey - 11)::BIGINT AS distance FROM nation")
def outward_minutes(spark, sf_dir):
    return reports.outward(table(spark, sf_dir, "nation"), "n_nationkey", 11).select("n_nationkey", F.col("distance").cast("long").alias("distance"))


@query("magnitude_diagnostic", "WITH m AS (SELECT user_id AS star, median(-2.5 * log10(value)) FILTER (value > 0) AS mag FROM events GROUP BY 1) SELECT c_custkey AS star, (c_nationkey * 0.5)::DOUBLE AS gmag, round(mag, 6) AS mag FROM customer JOIN m ON star = c_custkey WHERE c_custkey % 3 > 0")
def magnitude_diagnostic(spark, sf_dir):
    from lumicurve.functions.astro import magnitude

    mags = table(spark, sf_dir, "events").select(F.col("user_id").alias("star"), magnitude(F.col("value")).alias("mag"))
    meta = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("star"), F.when(F.col("c_custkey") % 3 > 0, (F.col("c_nationkey") * 0.5).cast("double")).alias("gmag"))
    return reports.magnitude_diagnostic(mags, meta).select("star", "gmag", r6("mag").alias("mag"))


@query("position_residuals", f"WITH {STARS} SELECT star, round(0.001 * 3600 * cos(radians(dec)), 6) AS d_ra, round(-0.002 * 3600, 6) AS d_dec FROM s WHERE star % 4 > 0")
def position_residuals(spark, sf_dir):
    s = stars(spark, sf_dir).withColumn("ra0", F.when(F.col("star") % 4 > 0, F.col("ra") - 0.001)).withColumn("dec0", F.col("dec") + 0.002)
    return reports.position_residuals(s).select("star", r6("d_ra").alias("d_ra"), r6("d_dec").alias("d_dec"))


@query("aperture_sigma", "SELECT label, round(avg(2 * (embedding[1]::DOUBLE + 2) / 2.35), 6) AS sigma FROM embeddings GROUP BY label")
def aperture_sigma(spark, sf_dir):
    s = table(spark, sf_dir, "embeddings").select("label", (F.col("embedding")[0].cast("double") + 2).alias("r"))
    return reports.aperture_sigma(s, "label").select("label", r6("sigma").alias("sigma"))


@query("minute_blocks", "SELECT event_id, round(epoch_us(ts) / 1e6, 6) AS t0, round(epoch_us(ts) / 1e6 + 60, 6) AS t1, round(user_id % 3 - 0.4, 6) AS low, round(user_id % 3 + 0.4, 6) AS high FROM events")
def minute_blocks(spark, sf_dir):
    b = reports.minute_blocks(events(spark, sf_dir), "t", F.col("user_id") % 3)
    return b.select("event_id", *[r6(c).alias(c) for c in ("t0", "t1", "low", "high")])


@query("zoomed_dips", "WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, value FROM events), c AS (SELECT user_id, arg_min(t, (value, t)) AS c FROM e GROUP BY user_id) SELECT event_id, user_id FROM e JOIN c USING (user_id) WHERE t BETWEEN c - 43200 AND c + 43200")
def zoomed_dips(spark, sf_dir):
    return reports.zoomed(events(spark, sf_dir), "user_id", "t", "value", 86400.0).select("event_id", "user_id")


@query("frames_to_skip", "SELECT event_id, floor((value - 10) / 0.025)::BIGINT AS frames FROM events")
def frames_to_skip(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", reports.frames_to_skip(F.col("value"), F.lit(10.0)).alias("frames"))


@query("utc_from_lst", "SELECT o_orderkey, round(epoch_us(o_orderdate) / 1e6 + (o_custkey % 24 - 5.5) / 1.0027379 * 3600, 3) AS utc FROM orders")
def utc_from_lst(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", seconds("o_orderdate").alias("t"))
    return o.select("o_orderkey", F.round(astro.utc_from_lst(F.col("o_custkey") % 24, F.lit(5.5), F.col("t")), 3).alias("utc"))


@query(
    "rewritten_coordinates",
    "SELECT event_id AS det_id, array_to_string(list_transform(range(CASE WHEN event_id % 5 = 0 THEN 4 ELSE 9 END), lambda k: CASE WHEN k = 6 AND event_id % 3 <> 0 THEN printf('#    RA Dec Coords: %f %f', user_id / 8.0, (event_id % 90) / 4.0) ELSE '# ' || event_id || ' line ' || k END), chr(10)) AS value FROM events",
)
def rewritten_coordinates(spark, sf_dir):
    """Texts of made-up detections, some too short, whose line of coordinates is rewritten where a field was solved."""
    e = table(spark, sf_dir, "events")
    lines = F.transform(F.sequence(F.lit(0), F.when(F.col("event_id") % 5 == 0, 3).otherwise(8)), lambda k: F.concat(F.lit("# "), F.col("event_id").cast("string"), F.lit(" line "), k.cast("string")))
    texts = e.select(F.col("event_id").alias("det_id"), F.array_join(lines, "\n").alias("value"))
    solved = e.where("event_id % 3 <> 0").select(F.col("event_id").alias("det_id"), (F.col("user_id") / 8.0).alias("ra"), (F.col("event_id") % 90 / 4.0).alias("dec"))
    return sinks.with_coordinates(texts, solved)


@query("reported_matches", "SELECT event_id, 'Tier' || (event_id % 3 + 1) AS tier FROM events WHERE event_id % 3 > 0")
def reported_matches(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Tier"), (F.col("event_id") % 3 + 1).cast("string")).alias("tier"))
    return reports.reported_matches(t)


@query("attached_catalogue", "SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN (SELECT n_nationkey AS c_nationkey, n_name FROM nation WHERE n_regionkey <> 2) USING (c_nationkey)")
def attached_catalogue(spark, sf_dir):
    meta = table(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return catalogue.attached(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), meta, "c_nationkey").select("c_custkey", "c_nationkey", "n_name")
