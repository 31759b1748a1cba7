"""Queries of roll-ups, scalar functions, logs and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicurve.functions import astro, text
from lumicurve.operators import rollup
from lumicurve.operators.bandjoin import separation
from lumicurve.plans.common import r6, seconds, table
from lumicurve.plans.match import SEP, STARS, stars
from lumicurve.plans.registry import query


@query("primary_summary", "SELECT strftime(ts, '%Y%m%d_%H.%M') AS minute_key, count(*) AS stars, CAST(count_if(event_type = 'error') AS BIGINT) AS detections FROM events GROUP BY 1")
def primary_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyyMMdd_HH.mm").alias("minute_key"), "event_type")
    return rollup.primary_summary(e, e.where("event_type = 'error'"))


@query("clipped_histogram", "SELECT least(floor((least(greatest(c_acctbal / 1000.0, 0.0), 8.0) - 0.0) / 0.25), 31)::INT AS bin, count(*) AS n FROM customer GROUP BY 1")
def clipped_histogram(spark, sf_dir):
    return rollup.histogram(table(spark, sf_dir, "customer").select((F.col("c_acctbal") / 1000.0).alias("v")), "v", 0.0, 8.0, 0.25)


SIG = "g AS (SELECT o_custkey AS grp, o_totalprice AS sigma, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), sg AS (SELECT grp, max(CASE WHEN k = 1 THEN sigma END) AS sigma1, max(CASE WHEN k = 2 THEN sigma END) AS sigma2, max(CASE WHEN k = 3 THEN sigma END) AS sigma3 FROM g GROUP BY grp)"


@query("sigma_min_split", f"WITH {SIG} SELECT grp, least(sigma1, sigma2, sigma3) AS least, sigma3 IS NOT NULL AS complete FROM sg")
def sigma_min_split(spark, sf_dir):
    s = rollup.rank_sigmas(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice")
    return rollup.least_of(s, ["sigma1", "sigma2", "sigma3"]).select(F.col("o_custkey").alias("grp"), "least", "complete")


@query(
    "nightly_rollup_pivot",
    "SELECT strftime(o_orderdate, '%Y-%m') AS night, "
    + ", ".join(f"count(CASE WHEN o_orderstatus = '{s}' THEN 1 END) AS {s}_n, CAST(sum(CASE WHEN o_orderstatus = '{s}' THEN CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) END) AS DOUBLE) AS {s}_total" for s in "FOP")
    + " FROM orders GROUP BY 1",
)
def nightly_rollup_pivot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("night"), "o_orderstatus", F.round("o_totalprice", 2).cast("decimal(18,2)").alias("p"))
    out = rollup.nightly_rollup(o, "night", "o_orderstatus", "FOP", {"n": F.count(F.lit(1)), "total": F.sum("p").cast("double")})
    return out.select("night", *[c for s in "FOP" for c in (F.coalesce(f"{s}_n", F.lit(0)).alias(f"{s}_n"), F.col(f"{s}_total"))])


@query("cumulative_upsert", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_acctbal * 2 FROM customer WHERE c_custkey % 3 = 0")
def cumulative_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return rollup.upsert(c, c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") * 2), "c_custkey")


@query("night_star_hours", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS night, round(sum(o_custkey % 50) / 60.0, 6) AS star_hours FROM orders GROUP BY 1")
def night_star_hours(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("night")).agg(r6(F.sum(F.col("o_custkey") % 50) / 60.0).alias("star_hours"))


LINES = "ln AS (SELECT event_id, strftime(ts, '%a %b %d %H:%M:%S UTC %Y') || ' INFO: ' || event_type || ' Field Name: field' || (user_id % 25) AS line, ts FROM events)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.concat_ws(" ", F.lit("Mon"), F.date_format("ts", "MMM dd HH:mm:ss"), F.lit("UTC"), F.date_format("ts", "yyyy"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(stamp, F.lit(" INFO: "), "event_type", F.lit(" Field Name: field"), (F.col("user_id") % 25).cast("string")).alias("line"))


@query("parse_log_events", f"WITH {LINES} SELECT event_id, epoch_us(date_trunc('second', ts)) // 1000000 AS t, regexp_extract(line, 'Field Name: (\\w+)', 1) AS field FROM ln WHERE line LIKE '%click%' OR line LIKE '%error%'")
def parse_log_events(spark, sf_dir):
    n = _lines(spark, sf_dir).where(F.col("line").rlike("click|error"))
    return n.select("event_id", F.unix_seconds(text.log_time(F.col("line"))).alias("t"), F.regexp_extract("line", r"Field Name: (\w+)", 1).alias("field"))


@query("parse_minute_key", "SELECT event_id, strftime(ts, '%Y%m%d_%H.%M.%S.%g') AS minute_key, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%d') AS obsdate FROM events")
def parse_minute_key(spark, sf_dir):
    name = F.concat(F.lit("det_"), text.to_minute_key(F.col("ts")), F.lit("_sigma.txt"))
    k = table(spark, sf_dir, "events").select("event_id", text.minute_key(name).alias("minute_key"))
    return k.select("event_id", "minute_key", F.unix_millis(text.key_time(F.col("minute_key"))).alias("ms"), text.hyphenated(F.substring("minute_key", 1, 8)).alias("obsdate"))


@query("weather_window", "SELECT event_id, value FROM events WHERE hour(ts) > 20 OR hour(ts) < 5")
def weather_window(spark, sf_dir):
    return table(spark, sf_dir, "events").where((F.hour("ts") > 20) | (F.hour("ts") < 5)).select("event_id", "value")


@query("json_props", "SELECT event_type, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k long"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("k"))


DAY = "(epoch_us(ts) / 1e6 / 86400.0 + 2440587.5)"
LST = f"((280.46061837 + 360.98564736629 * ({DAY} - 2451545.0) + 0.000387933 * power(({DAY} - 2451545.0) / 36525.0, 2) - 81.3160233333) % 360.0)"
ALT = f"asin(sin(radians(20.0)) * sin(radians(43.1933116667)) + cos(radians(20.0)) * cos(radians(43.1933116667)) * cos(radians({LST} - user_id)))"


@query("airmass", f"SELECT event_id, round(degrees({ALT}), 5) AS alt, round(1 / cos(radians(90 - degrees({ALT}))), 4) AS airmass FROM events")
def airmass(spark, sf_dir):
    h = astro.horizontal(F.col("t"), F.col("user_id").cast("double"), F.lit(20.0))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", seconds("ts").alias("t"))
    return e.select("event_id", h["alt"].alias("a"), h["airmass"].alias("m")).select("event_id", F.round("a", 5).alias("alt"), F.round("m", 4).alias("airmass"))


TW = """WITH d AS (SELECT o_orderkey, floor(epoch_us(o_orderdate) / 1e6 / 86400.0 + 2440587.5 - 2451545.0 + 0.0008) + 81.3160233333 / 360.0 AS j FROM orders),
m AS (SELECT *, ((357.5291 + 0.98560028 * j) % 360.0 + 360.0) % 360.0 AS m FROM d), l AS (SELECT *, radians((m + 1.9148 * sin(radians(m)) + 0.02 * sin(2 * radians(m)) + 0.0003 * sin(3 * radians(m)) + 180.0 + 102.9372) % 360.0) AS l FROM m),
h AS (SELECT *, 2451545.0 + j + 0.0053 * sin(radians(m)) - 0.0069 * sin(2 * l) AS noon, sin(l) * sin(radians(23.44)) AS sd FROM l),
c AS (SELECT *, degrees(acos((sin(radians(-12.0)) - sin(radians(43.1933116667)) * sd) / (cos(radians(43.1933116667)) * cos(asin(sd))))) / 360.0 AS half FROM h)
SELECT o_orderkey, round(noon - half, 6) AS rise, round(noon + half, 6) AS "set" FROM c"""


@query("twilight", TW)
def twilight(spark, sf_dir):
    t = astro.twilight(astro.jd_from_unix(seconds("o_orderdate")))
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(t["rise"]).alias("rise"), r6(t["set"]).alias("set"))


@query("jd_to_utc", f"SELECT event_id, round({DAY}, 5) AS jd, true AS back FROM events")
def jd_to_utc(spark, sf_dir):
    jd = astro.jd_from_unix(seconds("ts"))
    return table(spark, sf_dir, "events").select("event_id", F.round(jd, 5).alias("jd"), (F.abs(astro.unix_from_jd(jd) - seconds("ts")) < 1e-3).alias("back"))


@query("angular_separation", f"WITH {STARS} SELECT a.star AS a, b.star AS b, round({SEP}, 6) AS sep FROM s a JOIN s b ON b.star = a.star + 1")
def angular_separation(spark, sf_dir):
    s = stars(spark, sf_dir)
    a = s.select(F.col("star").alias("a"), F.col("ra").alias("ra1"), F.col("dec").alias("dec1"), (F.col("star") + 1).alias("b"))
    b = s.select(F.col("star").alias("b"), F.col("ra").alias("ra2"), F.col("dec").alias("dec2"))
    return a.join(b, "b").select("a", "b", r6(separation(F.col("ra1"), F.col("dec1"), F.col("ra2"), F.col("dec2"))).alias("sep"))


COSC = "(sin(radians(10.0)) * sin(radians(y * 20)) + cos(radians(10.0)) * cos(radians(y * 20)) * cos(radians(x * 20 - 5.0)))"


@query("tan_projection", f"WITH {STARS} SELECT star, round(degrees(cos(radians(y * 20)) * sin(radians(x * 20 - 5.0)) / {COSC}), 6) AS xi, round(degrees((cos(radians(10.0)) * sin(radians(y * 20)) - sin(radians(10.0)) * cos(radians(y * 20)) * cos(radians(x * 20 - 5.0))) / {COSC}), 6) AS eta FROM s")
def tan_projection(spark, sf_dir):
    p = astro.tangent_plane(F.col("x") * 20, F.col("y") * 20, 5.0, 10.0)
    return stars(spark, sf_dir).select("star", r6(p["xi"]).alias("xi"), r6(p["eta"]).alias("eta"))


FRAMES = "f AS (SELECT label AS dir, vec_id AS frame, list_transform(embedding, lambda v: floor((v::DOUBLE + 1) * 100)::INT) AS px FROM embeddings)"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 100).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("dir"), F.col("vec_id").alias("frame"), px.alias("pixels"))


@query("median_stack", f"WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY frame) AS k FROM f), u AS (SELECT dir, unnest(px) AS v, unnest(range(64))::INT AS pixel FROM r WHERE k <= 9) SELECT dir, pixel, median(v) AS value FROM u GROUP BY dir, pixel")
def median_stack(spark, sf_dir):
    return rollup.median_stack(rollup.first_frames(_frames(spark, sf_dir), "dir", "frame", 9), "dir")


@query("dark_stats", f"WITH {FRAMES}, u AS (SELECT frame, unnest(px) AS v FROM f), c AS (SELECT frame, v, count(*) AS c FROM u GROUP BY frame, v), m AS (SELECT frame, arg_max(v, (c, -v)) AS mode FROM c GROUP BY frame) SELECT frame, round(avg(v), 6) AS mean, median(v) AS median, any_value(mode) AS mode, round(sqrt(avg(v * v)), 6) AS rms FROM u JOIN m USING (frame) GROUP BY frame")
def dark_stats(spark, sf_dir):
    return rollup.image_statistics(_frames(spark, sf_dir), "frame").select("frame", r6("mean").alias("mean"), "median", "mode", r6("rms").alias("rms"))


@query(
    "read_noise",
    f"WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY frame) - 1 AS k FROM f), p AS (SELECT a.dir, a.k // 2 AS pair, unnest(range(1, 65)) AS i, a.px AS x, b.px AS y FROM r a JOIN r b ON a.dir = b.dir AND a.k % 2 = 0 AND b.k = a.k + 1), "
    "e AS (SELECT dir, pair, stddev_pop((x[i] - y[i])::DOUBLE) * 0.82 / sqrt(2) AS s FROM p GROUP BY dir, pair) SELECT dir, round(avg(s), 6) AS read_noise, count(*) AS pairs FROM e GROUP BY dir",
)
def read_noise(spark, sf_dir):
    return rollup.read_noise(_frames(spark, sf_dir), "dir", "frame", 0.82).select("dir", r6("read_noise").alias("read_noise"), "pairs")


@query(
    "unpack_12bit",
    "WITH b AS (SELECT vec_id, list_transform(embedding, lambda v: (floor((v::DOUBLE + 1) * 100)::INT) % 256) || [0, 0] AS b FROM embeddings), p AS (SELECT vec_id, unnest(range(44)) AS i, b FROM b) SELECT vec_id, i::INT AS i, (CASE WHEN i % 2 = 0 THEN b[i // 2 * 3 + 1] * 16 + b[i // 2 * 3 + 2] // 16 ELSE (b[i // 2 * 3 + 2] % 16) * 256 + b[i // 2 * 3 + 3] END)::INT AS pixel FROM p",
)
def unpack_12bit(spark, sf_dir):
    digits = F.transform("embedding", lambda v: F.lpad(F.hex((F.floor((v.cast("double") + 1) * 100) % 256).cast("long")), 2, "0"))
    packed = table(spark, sf_dir, "embeddings").select("vec_id", F.unhex(F.concat(F.array_join(digits, ""), F.lit("0000"))).alias("data"))
    return packed.select("vec_id", F.posexplode(text.unpack12(F.col("data"))).alias("i", "pixel"))


@query("kernel_geometry", "SELECT p_partkey, round(29800.0 * (1 - sqrt(1.0 / (30 + p_size % 16))), 6) AS speed, round(p_size * 1e9 * tan(0.05 / 206265000.0 / 2), 6) AS disc, round(p_size * 20 / sqrt(5e-7 * (30 + p_size % 16) * 1.496e11 / 2), 6) AS scaled, (ceil(p_size / 3.0) - CASE WHEN ceil(p_size / 3.0) % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS frames FROM part")
def kernel_geometry(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size, dist = F.col("p_size"), 30 + F.col("p_size") % 16
    return p.select(
        "p_partkey",
        r6(astro.transverse_velocity(dist)).alias("speed"),
        r6(astro.stellar_radius(F.lit(0.05), size * 1e9)).alias("disc"),
        r6(astro.fresnel_units(size * 20, F.lit(5e-7), dist * 1.496e11)).alias("scaled"),
        astro.round_odd(size / 3.0).cast("long").alias("frames"),
    )


@query("repaired_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT') || printf('%02d', (hour(ts) + CASE WHEN event_id % 3 = 0 THEN 24 ELSE 0 END) % 24) || strftime(ts, ':%M:%S') AS fixed FROM events")
def repaired_times(spark, sf_dir):
    hour = F.hour("ts") + F.when(F.col("event_id") % 3 == 0, 24).otherwise(0)
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'"), F.format_string("%02d", hour), F.date_format("ts", ":mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", text.repaired_hour(iso).alias("fixed"))


@query("field_star_hours", "SELECT 'field' || (user_id % 25) AS field, count(*) AS frames, round(count(*) * 0.025 / 3600 * count(DISTINCT event_type), 9) AS star_hours FROM events GROUP BY 1")
def field_star_hours(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("field"), (F.col("user_id") % 25).cast("string")).alias("field"), "event_type")
    n = e.groupBy("field").agg(F.count(F.lit(1)).alias("frames"), F.count_distinct("event_type").alias("stars"))
    return n.select("field", "frames", F.round(F.col("frames") * 0.025 / 3600 * F.col("stars"), 9).alias("star_hours"))
