"""Queries of the joins by nearness and of the matching operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicurve.operators import bandjoin, match, nearest
from lumicurve.plans.common import r6, seconds, table
from lumicurve.plans.registry import query

SCOPE = {"click": "green", "view": "red", "purchase": "blue"}


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of three types as detections of three telescopes, with coordinates."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin(*SCOPE))
    scope = F.create_map(*[F.lit(x) for kv in SCOPE.items() for x in kv])[F.col("event_type")]
    known = F.col("event_id") % 11 != 0
    return e.select(F.col("event_id").alias("det_id"), scope.alias("scope"), seconds("ts").alias("t"), F.when(known, F.col("event_id") % 7 * 0.001).alias("ra"), F.when(known, F.col("event_id") % 5 * 0.001).alias("dec"))


DET = """d AS (SELECT event_id AS det_id, CASE event_type WHEN 'click' THEN 'green' WHEN 'view' THEN 'red' ELSE 'blue' END AS scope, epoch_us(ts) / 1e6 AS t,
  CASE WHEN event_id % 11 <> 0 THEN event_id % 7 * 0.001 END::DOUBLE AS ra, CASE WHEN event_id % 11 <> 0 THEN event_id % 5 * 0.001 END::DOUBLE AS dec FROM events WHERE event_type IN ('click', 'view', 'purchase')),
g AS (SELECT * FROM d WHERE scope = 'green'), r AS (SELECT * FROM d WHERE scope = 'red'), b AS (SELECT * FROM d WHERE scope = 'blue'),
gr AS (SELECT g.det_id AS g, arg_min(r.det_id, (r.t, r.det_id)) AS r FROM g JOIN r ON abs(g.t - r.t) <= 60 GROUP BY g.det_id),
gb AS (SELECT g.det_id AS g, arg_min(b.det_id, (b.t, b.det_id)) AS b FROM g JOIN b ON abs(g.t - b.t) <= 60 GROUP BY g.det_id),
rb AS (SELECT r.det_id AS r, arg_min(b.det_id, (b.t, b.det_id)) AS b FROM r JOIN b ON abs(r.t - b.t) <= 60 GROUP BY r.det_id),
m AS (SELECT r AS match_id, 'green' AS scope, g AS det_id FROM gr UNION SELECT r, 'red', r FROM gr UNION SELECT r, 'blue', b FROM gr JOIN gb USING (g)
  UNION SELECT g, 'green', g FROM gb WHERE g NOT IN (SELECT g FROM gr) UNION SELECT g, 'blue', b FROM gb WHERE g NOT IN (SELECT g FROM gr) UNION SELECT r, 'red', r FROM rb UNION SELECT r, 'blue', b FROM rb),
mm AS (SELECT match_id, d.* FROM m JOIN d USING (det_id)), p AS (SELECT a.match_id, a.ra AS ra1, a.dec AS dec1, b.ra AS ra2, b.dec AS dec2, a.t AS t1, b.t AS t2 FROM mm a JOIN mm b ON a.match_id = b.match_id AND a.det_id < b.det_id)"""
TIERS = DET + """, tr AS (SELECT match_id, count(*) AS n, CASE WHEN count(*) IN (2, 3) AND match_id IN (SELECT match_id FROM p WHERE abs(t1 - t2) <= 20) THEN 'Tier' || count(*) ELSE 'Tier1' END AS tier FROM m GROUP BY match_id)"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.coincidences(detections(spark, sf_dir), 60.0)


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).join(detections(spark, sf_dir).drop("scope"), "det_id")


@query("coincidence_groups", f"WITH {DET} SELECT * FROM m")
def coincidence_groups(spark, sf_dir):
    return _groups(spark, sf_dir)


@query("coincidence_triples", f"WITH {DET} SELECT match_id, count(*) AS n FROM m GROUP BY match_id HAVING count(DISTINCT scope) = 3")
def coincidence_triples(spark, sf_dir):
    return _groups(spark, sf_dir).groupBy("match_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("scope").alias("k")).where("k = 3").drop("k")


@query("coordinate_verify", f"WITH {DET} SELECT match_id, det_id FROM m WHERE match_id IN (SELECT match_id FROM p WHERE sqrt(power((ra1 - ra2) / cos(radians(dec1)), 2) + power(dec1 - dec2, 2)) <= 0.0025)")
def coordinate_verify(spark, sf_dir):
    return match.coordinate_verified(_members(spark, sf_dir), 0.0025).select("match_id", "det_id")


@query("tiers", f"WITH {TIERS} SELECT * FROM tr")
def tiers(spark, sf_dir):
    return match.tiers(_members(spark, sf_dir), 20.0)


@query("tier_counts", f"WITH {TIERS} SELECT tier, count(*) AS groups, CAST(sum(n) AS BIGINT) AS members FROM tr GROUP BY tier")
def tier_counts(spark, sf_dir):
    return match.tiers(_members(spark, sf_dir), 20.0).groupBy("tier").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("members"))


@query("missing_scope", f"WITH {DET}, h AS (SELECT match_id, list(DISTINCT scope) AS have FROM m GROUP BY match_id), x AS (SELECT match_id, CASE WHEN NOT list_contains(have, 'red') THEN 'red' WHEN NOT list_contains(have, 'green') THEN 'green' WHEN NOT list_contains(have, 'blue') THEN 'blue' END AS scope FROM h) SELECT * FROM x WHERE scope IS NOT NULL")
def missing_scope(spark, sf_dir):
    return match.missing_scope(_groups(spark, sf_dir))


MINUTES = "WITH a AS (SELECT event_id AS m1, epoch_us(ts) / 1e6 AS t1 FROM events WHERE event_type = 'click'), b AS (SELECT event_id AS m2, epoch_us(ts) / 1e6 AS t2 FROM events WHERE event_type = 'view')"


@query("minute_pairs", MINUTES + ", p AS (SELECT *, row_number() OVER (PARTITION BY m1 ORDER BY t2, m2) AS k FROM a JOIN b ON abs(t1 - t2) < 600), q AS (SELECT *, row_number() OVER (PARTITION BY m2 ORDER BY t1, m1) AS l FROM p WHERE k = 1) SELECT m1, m2, round(t2 - t1, 6) AS dt FROM q WHERE l = 1")
def minute_pairs(spark, sf_dir):
    d = detections(spark, sf_dir)
    a = d.where("scope = 'green'").select(F.col("det_id").alias("m1"), F.col("t").alias("t1"))
    b = d.where("scope = 'red'").select(F.col("det_id").alias("m2"), F.col("t").alias("t2"))
    return match.minute_pairs(a, b, 600.0).select("m1", "m2", r6(F.col("t2") - F.col("t1")).alias("dt"))


@query(
    "best_common_minute",
    f"WITH {DET}, x AS (SELECT event_id, value FROM events), q AS (SELECT g.det_id AS minute_id, x.value AS stars, g.t, arg_min(r.det_id, (r.t, r.det_id)) AS red FROM g JOIN x ON x.event_id = g.det_id JOIN r ON abs(g.t - r.t) < 600 GROUP BY ALL), "
    "q2 AS (SELECT q.*, arg_min(b.det_id, (b.t, b.det_id)) AS blue FROM q JOIN b ON abs(q.t - b.t) < 600 GROUP BY ALL) SELECT minute_id, round(stars, 6) AS stars, red, blue FROM q2 ORDER BY q2.stars DESC, t, minute_id LIMIT 1",
)
def best_common_minute(spark, sf_dir):
    stars = table(spark, sf_dir, "events").select(F.col("event_id").alias("minute_id"), F.col("value").alias("stars"))
    m = detections(spark, sf_dir).select(F.col("det_id").alias("minute_id"), "scope", "t").join(stars, "minute_id")
    return match.best_common_minute(m, 600.0).select("minute_id", r6("stars").alias("stars"), "red", "blue")


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as stars: star, minute, x, y, ra, dec, gmag."""
    e = table(spark, sf_dir, "embeddings")
    c = lambda k: F.col("embedding")[k].cast("double")
    return e.select(F.col("vec_id").alias("star"), F.col("label").alias("minute"), c(0).alias("x"), c(1).alias("y"), F.pmod(c(0) * 20, F.lit(360.0)).alias("ra"), (c(1) * 200).alias("dec"), c(2).alias("gmag"))


STARS = "s AS (SELECT vec_id AS star, label AS minute, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, (embedding[1]::DOUBLE * 20 + 360) % 360 AS ra, embedding[2]::DOUBLE * 200 AS dec, embedding[3]::DOUBLE AS gmag FROM embeddings)"
SEP = "degrees(2 * asin(sqrt(least(1.0, power(sin(radians(b.dec - a.dec) / 2), 2) + cos(radians(a.dec)) * cos(radians(b.dec)) * power(sin(radians(b.ra - a.ra) / 2), 2)))))"
SKY = f"WITH {STARS}, a AS (SELECT * FROM s WHERE star % 2 = 0), b AS (SELECT * FROM s WHERE star % 2 = 1), j AS (SELECT a.star AS star, b.star AS source, b.gmag AS gmag, {SEP} AS sep FROM a JOIN b ON {SEP} < 2.0)"


def _sky_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = stars(spark, sf_dir)
    a = s.where("star % 2 = 0").select("star", F.col("ra").alias("ra1"), F.col("dec").alias("dec1"))
    return a, s.where("star % 2 = 1").select(F.col("star").alias("source"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2"), "gmag")


def _sky_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bandjoin.sky_join(*_sky_sides(spark, sf_dir), ("ra1", "dec1"), ("ra2", "dec2"), 2.0)


@query("cone_pairs", SKY + " SELECT star, source, round(sep, 6) AS sep FROM j")
def cone_pairs(spark, sf_dir):
    return _sky_pairs(spark, sf_dir).select("star", "source", r6("sep").alias("sep"))


@query("nearest_sky", SKY + " SELECT a.star, coalesce(arg_min(source, (sep, source)), -1) AS source, round(min(sep), 6) AS sep FROM a LEFT JOIN j USING (star) GROUP BY a.star")
def nearest_sky(spark, sf_dir):
    s = stars(spark, sf_dir)
    a, b = s.where("star % 2 = 0"), s.where("star % 2 = 1").withColumnRenamed("star", "source")
    best = nearest.nearest_on_sky(a, b, 2.0, "star").select("star", "source", r6("sep").alias("sep"))
    return a.select("star").join(best, "star", "left").select("star", F.coalesce("source", F.lit(-1).cast("long")).alias("source"), "sep")


@query("cone_brightest", SKY + " SELECT star, arg_min(source, (gmag, sep, source)) AS source, round(min(gmag), 6) AS gmag FROM j GROUP BY star")
def cone_brightest(spark, sf_dir):
    a, b = _sky_sides(spark, sf_dir)
    best = bandjoin.sky_least(a, b.where("gmag IS NOT NULL"), "star", "source", ("ra1", "dec1"), ("ra2", "dec2"), 2.0, "gmag")
    return best.select("star", "source", r6("gmag").alias("gmag"))


@query(
    "box_match_brightest",
    f"WITH {STARS}, a AS (SELECT * FROM s WHERE star % 2 = 0), b AS (SELECT * FROM s WHERE star % 2 = 1) SELECT a.star, coalesce(arg_min(b.star, (b.gmag, b.star)), -1) AS source, round(min(b.gmag), 6) AS gmag "
    "FROM a LEFT JOIN b ON abs(b.x - a.x) <= 0.02 / cos(radians(a.y)) AND abs(b.y - a.y) <= 0.02 GROUP BY a.star",
)
def box_match_brightest(spark, sf_dir):
    s = stars(spark, sf_dir)
    a = s.where("star % 2 = 0").select("star", F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = s.where("star % 2 = 1").select(F.col("star").alias("source"), F.col("x").alias("x2"), F.col("y").alias("y2"), "gmag")
    near = bandjoin.plane_join(a, b, ("x1", "y1"), ("x2", "y2"), 0.021).where("abs(x2 - x1) <= 0.02 / cos(radians(y1)) AND abs(y2 - y1) <= 0.02")
    return a.select("star").join(bandjoin.best_match(near, "star", [F.col("gmag"), F.col("source")]).select("star", "source", r6("gmag").alias("gmag")), "star", "left").select("star", F.coalesce("source", F.lit(-1).cast("long")).alias("source"), "gmag")


@query("shared_stars", f"WITH {STARS} SELECT a.star AS s1, b.star AS s2 FROM s a JOIN s b ON a.star % 2 = 0 AND b.star % 2 = 1 AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) < 0.01")
def shared_stars(spark, sf_dir):
    s = stars(spark, sf_dir)
    part = lambda k, n: s.where(F.col("star") % 2 == k).select(F.col("star").alias(f"s{n}"), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    return match.shared_stars(part(0, 1), part(1, 2), 0.01).select("s1", "s2")


HOURS = f"WITH {STARS}, t AS (SELECT *, star % 3 AS scope FROM s), k AS (SELECT minute, star FROM t a WHERE scope = 2 AND EXISTS (SELECT 1 FROM t b WHERE b.scope = 1 AND b.minute = a.minute AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) < 0.05) AND EXISTS (SELECT 1 FROM t b WHERE b.scope = 0 AND b.minute = a.minute AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) < 0.05))"


@query("star_hours", HOURS + " SELECT minute, count(*) AS stars, round(count(*) / 60.0, 6) AS star_hours FROM k GROUP BY minute")
def star_hours(spark, sf_dir):
    s = stars(spark, sf_dir)
    part = lambda k: s.where(F.col("star") % 3 == k)
    h = match.star_hours(part(2), part(1), part(0), 0.05)
    return h.select("minute", "stars", r6("star_hours").alias("star_hours"))


@query(
    "pixel_match_all_scopes",
    f"WITH {STARS}, t AS (SELECT *, star % 3 AS scope FROM s), j AS (SELECT a.star AS ref, b.scope, arg_min(b.star, (sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), b.star)) AS hit FROM t a JOIN t b ON a.scope = 0 AND b.scope > 0 AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 0.05 GROUP BY ALL) "
    "SELECT a.ref, a.hit AS one, b.hit AS two FROM j a JOIN j b ON a.ref = b.ref AND a.scope = 1 AND b.scope = 2",
)
def pixel_match_all_scopes(spark, sf_dir):
    s = stars(spark, sf_dir).select("star", "x", "y", F.element_at(F.array(F.lit("zero"), F.lit("one"), F.lit("two")), (F.col("star") % 3 + 1).cast("int")).alias("scope"))
    return match.pixel_match(s, "zero", ("one", "two"), 0.05)


CLEAN = f"""WITH {STARS}, t AS (SELECT *, star % 3 AS scope FROM s), j AS (SELECT a.star AS ref, b.scope, arg_min(b.star, (sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), b.star)) AS hit FROM t a JOIN t b ON a.scope = 0 AND b.scope > 0 AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 0.05 GROUP BY ALL),
fl AS (SELECT vec_id AS star, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings), g AS (SELECT star FROM fl GROUP BY star HAVING max(CASE WHEN abs(v) >= 0.1 THEN i END) - min(CASE WHEN abs(v) >= 0.1 THEN i END) + 1 >= 60)
SELECT a.ref, a.hit AS one, b.hit AS two FROM j a JOIN j b ON a.ref = b.ref AND a.scope = 1 AND b.scope = 2 WHERE a.ref IN (FROM g) AND a.hit IN (FROM g) AND b.hit IN (FROM g)"""


@query("clean_scope_matches", CLEAN)
def clean_scope_matches(spark, sf_dir):
    """Stars matched over three scopes and clean in all of them; faint samples count as 0."""
    name = lambda c: F.element_at(F.array(F.lit("zero"), F.lit("one"), F.lit("two")), (F.col(c) % 3 + 1).cast("int"))
    s = stars(spark, sf_dir).select("star", "x", "y", name("star").alias("scope"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("star"), name("vec_id").alias("scope"), F.posexplode("embedding").alias("i", "v"))
    samples = e.select("scope", "star", "i", F.when(F.abs(F.col("v").cast("double")) >= 0.1, F.col("v").cast("double")).otherwise(0.0).alias("flux"))
    return match.clean_matches(match.pixel_match(s, "zero", ("one", "two"), 0.05), samples, {"zero": "ref", "one": "one", "two": "two"}, 60).select("ref", "one", "two")


NEAREST = f"""WITH {STARS}, t AS (SELECT star AS target, CASE WHEN star % 5 <> 0 THEN ra END AS ra, dec, x, y FROM s WHERE star % 2 = 1), c AS (SELECT star, CASE WHEN star % 7 <> 0 THEN ra END AS ra, dec, x, y FROM s WHERE star % 2 = 0),
p AS (SELECT target, star, a.ra IS NOT NULL AS asks, b.ra IS NOT NULL AS has, {SEP} AS sep, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS far FROM t a CROSS JOIN c b)
SELECT target, arg_min(star, (sep, star)) AS star, 'sky' AS by, round(min(sep), 6) AS d FROM p WHERE asks AND has GROUP BY target
UNION ALL SELECT target, arg_min(star, (far, star)), 'pixels', round(min(far), 6) FROM p WHERE NOT asks GROUP BY target"""


@query("nearest_star", NEAREST)
def nearest_star(spark, sf_dir):
    """Stars with odd numbers look for the nearest with an even one, on the sky where both are solved, else in pixels."""
    s = stars(spark, sf_dir)
    part = lambda k, n, name: s.where(F.col("star") % 2 == k).select(F.col("star").alias(name), F.when(F.col("star") % n != 0, F.col("ra")).alias("ra"), "dec", "x", "y")
    return nearest.nearest_star(part(1, 5, "target"), part(0, 7, "star")).select("target", "star", "by", r6("d").alias("d"))


@query("asof_nearest_dark", "WITH o AS (SELECT event_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'click'), k AS (SELECT event_id AS dark, epoch_us(ts) / 1e6 AS td FROM events WHERE event_type = 'error') SELECT o.event_id, arg_min(dark, (abs(t - td), td, dark)) AS dark, round(min(abs(t - td)), 6) AS dt FROM o CROSS JOIN k GROUP BY o.event_id")
def asof_nearest_dark(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", seconds("ts").alias("t"))
    darks = e.where("event_type = 'error'").select(F.col("event_id").alias("dark"), F.col("t").alias("td"))
    near = bandjoin.asof_nearest(e.where("event_type = 'click'"), darks, "event_id", "t", "td", ["dark"])
    return near.select("event_id", "dark", r6("dt").alias("dt"))


@query("unprocessed_minutes", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unprocessed_minutes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey").join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("detections_per_minute", "SELECT o_orderkey, count(l_orderkey) AS detections FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def detections_per_minute(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "orders").join(n, "o_orderkey", "left").groupBy("o_orderkey").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("detections"))


#: Minutes of one made-up night.
NIGHT = 4


def _followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    solved = F.col("star") % 3 != 0
    s = stars(spark, sf_dir).select(
        F.floor(F.col("minute") / NIGHT).alias("night"), "minute", F.col("star").alias("local"), (F.col("x") * 20).alias("x"), (F.col("y") * 20).alias("y"), *[F.when(solved, F.col(c)).alias(c) for c in ("ra", "dec")]
    )
    return match.global_star_ids(s, "night", 2.0, 0.5)


@query("global_star_ids")
def global_star_ids(spark, sf_dir):
    return _followed(spark, sf_dir).select("night", "minute", "local", "star_id")


@query("global_stars")
def global_stars(spark, sf_dir):
    g = match.global_stars(_followed(spark, sf_dir), "night")
    return g.select("night", "star_id", "n_detections", *[r6(c).alias(c) for c in ("x", "y", "ra", "dec")])


#: The detections alone.
D = DET[: DET.index("g AS (")]

TRIPLETS = """l AS (SELECT floor(t / 86400)::BIGINT AS night, coalesce(list(t ORDER BY t) FILTER (scope = 'green'), []) AS a, coalesce(list(t ORDER BY t) FILTER (scope = 'red'), []) AS b, coalesce(list(t ORDER BY t) FILTER (scope NOT IN ('green', 'red')), []) AS c FROM d GROUP BY 1),
r AS (SELECT night, 0 AS i, 1 AS j, 1 AS k, NULL::DOUBLE AS t1, NULL::DOUBLE AS t2, NULL::DOUBLE AS t3 FROM l UNION ALL
SELECT night, i, CASE WHEN two THEN j + 1 ELSE j END, CASE WHEN two AND three THEN k + 1 ELSE k END, CASE WHEN two AND three THEN x END, CASE WHEN two AND three THEN b[j] END, CASE WHEN two AND three THEN c[k] END
FROM (SELECT *, coalesce(b[j] - x < 3600.0, false) AS two, coalesce(c[k] - x < 3600.0, false) AS three
FROM (SELECT l.night, i + 1 AS i, l.a[i + 1] AS x, l.b, l.c, j + len(list_filter(l.b[j:], lambda v: v <= l.a[i + 1] - 3600.0)) AS j,
  k + len(list_filter(l.c[k:], lambda v: v <= l.a[i + 1] - 3600.0)) AS k FROM r JOIN l USING (night) WHERE i < len(l.a))))
SELECT night, t1, t2, t3 FROM r WHERE t1 IS NOT NULL"""


@query("minute_triplets", "WITH RECURSIVE " + D + TRIPLETS)
def minute_triplets(spark, sf_dir):
    scope = F.when(F.col("scope") == "green", 1).when(F.col("scope") == "red", 2).otherwise(3)
    return match.minute_triplets(detections(spark, sf_dir).select(F.floor(F.col("t") / 86400).alias("night"), scope.alias("scope"), "t"), "night", 3600.0)
