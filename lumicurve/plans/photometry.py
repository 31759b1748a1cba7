"""Queries of robust statistics, photometry and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicurve.operators import evaluate, nearest, numeric, quantiles, robust, series
from lumicurve.plans.common import LC, USER_LC, curves, r6, table, trend_sql
from lumicurve.plans.match import STARS, stars
from lumicurve.plans.registry import query


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales as photometry: star (supplier), frame (month), flux; a month's mean."""
    li = table(spark, sf_dir, "lineitem")
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    return li.select(F.col("l_suppkey").alias("star"), month.cast("long").alias("frame"), F.round("l_extendedprice", 2).cast("decimal(18,2)").alias("p")).groupBy("star", "frame").agg((F.sum("p").cast("double") / F.count(F.lit(1))).alias("flux"))


FR = "fr AS (SELECT l_suppkey AS star, year(l_shipdate) * 12 + month(l_shipdate) AS frame, CAST(sum(CAST(round(l_extendedprice, 2) AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS flux FROM lineitem GROUP BY ALL)"
BAND = FR + """, nf AS (SELECT count(DISTINCT frame) AS k FROM fr), md AS (SELECT star, count_if(flux > 0) / any_value(k) AS presence, median(flux) AS median_flux FROM fr CROSS JOIN nf GROUP BY star HAVING count_if(flux > 0) / any_value(k) >= 0.9),
q AS (SELECT quantile_cont(median_flux, 0.25) AS lo, quantile_cont(median_flux, 0.75) AS hi FROM md), rf AS (SELECT star, presence, median_flux FROM md CROSS JOIN q WHERE median_flux BETWEEN lo AND hi ORDER BY median_flux DESC, star LIMIT 20),
pf AS (SELECT frame, sum(flux) AS ref_sum, avg(flux) AS ref_mean, count(*) AS n_used FROM fr WHERE star IN (SELECT star FROM rf) AND flux > 0 GROUP BY frame)"""


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    n = f.select("frame").distinct().count()
    return robust.reference_band(f, n, most=20)


@query("star_summary", f"WITH {LC} SELECT star, count(flux) AS n_valid_frames, count(DISTINCT floor(t / 86400)) AS n_minutes, round(median(flux), 6) AS median_flux, round(median(flux) / stddev_pop(flux), 6) AS snr FROM lc GROUP BY star")
def star_summary(spark, sf_dir):
    c = curves(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86400))
    return robust.star_summary(c, "star", "flux", "day").select("star", "n_valid_frames", "n_minutes", r6("median_flux").alias("median_flux"), r6("snr").alias("snr"))


@query("star_snr", f"WITH {LC}, {trend_sql('lc', 'flux', 200, 'det')} SELECT star, round(median(flux) / stddev_pop(d), 6) AS snr FROM det GROUP BY star")
def star_snr(spark, sf_dir):
    s = series.indexed(curves(spark, sf_dir), "star", ["t", "event_id"])
    return robust.star_snr(s, "star", "flux").select("star", r6("snr").alias("snr"))


MAD = f"WITH {USER_LC}, c AS (SELECT *, median(flux) OVER (PARTITION BY star) AS m FROM lc)"


@query("mad_snr", MAD + " SELECT star, round(any_value(m), 6) AS center, round(1.4826 * median(abs(flux - m)), 6) AS mad_std, round(any_value(m) / (1.4826 * median(abs(flux - m))), 6) AS snr FROM c GROUP BY star")
def mad_snr(spark, sf_dir):
    m = robust.mad_std(curves(spark, sf_dir, "user_id"), "star", "flux")
    return m.select("star", r6("center").alias("center"), r6("mad_std").alias("mad_std"), r6(F.col("center") / F.col("mad_std")).alias("snr"))


CLIP = f"""WITH {USER_LC}, a AS (SELECT *, median(flux) OVER (PARTITION BY star) AS m FROM lc), b AS (SELECT *, 1.4826 * median(abs(flux - m)) OVER (PARTITION BY star) AS s FROM a),
c AS (SELECT star, event_id, CASE WHEN abs(flux - m) <= 2 * s THEN flux END AS flux FROM b), d AS (SELECT *, median(flux) OVER (PARTITION BY star) AS m FROM c),
e AS (SELECT *, 1.4826 * median(abs(flux - m)) OVER (PARTITION BY star) AS s FROM d) SELECT star, count(CASE WHEN abs(flux - m) <= 2 * s THEN 1 END) AS kept, round(avg(CASE WHEN abs(flux - m) <= 2 * s THEN flux END), 6) AS mean FROM e GROUP BY star"""


@query("sigma_clip", CLIP)
def sigma_clip(spark, sf_dir):
    c = robust.sigma_clip(curves(spark, sf_dir, "user_id"), "star", "flux", 2.0, 2)
    return c.groupBy("star").agg(F.count("flux").alias("kept"), r6(F.avg("flux")).alias("mean"))


@query("clipped_residual", "WITH a AS (SELECT c_acctbal AS v FROM customer), b AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM a), c AS (SELECT v FROM a, b WHERE v BETWEEN m - 1.5 * s AND m + 1.5 * s) SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) AS n FROM c")
def clipped_residual(spark, sf_dir):
    c = robust.clipped_mean(table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("v")), "v", 1.5, 1)
    return c.select(r6("mean").alias("mean"), r6("std").alias("std"), "n")


CHECK = f"WITH {USER_LC}, a AS (SELECT star, count(flux) AS n, median(flux) AS med, stddev_pop(flux) AS std, avg(CASE WHEN i < 20 THEN flux END) AS h, avg(CASE WHEN i >= n - 20 THEN flux END) AS t FROM lc GROUP BY star)"


@query("flux_check_codes", CHECK + " SELECT star, CASE WHEN n = 0 THEN -1 WHEN med = 0 THEN -2 WHEN abs(h - t) > std THEN -3 WHEN med / std < 5 THEN -4 ELSE 0 END AS code FROM a")
def flux_check_codes(spark, sf_dir):
    s = series.indexed(curves(spark, sf_dir, "user_id"), "star", ["t", "event_id"])
    return robust.flux_check(s, "star", "flux", "i", 20)


@query("reference_band", f"WITH {BAND} SELECT star, round(presence, 6) AS presence, round(median_flux, 6) AS median_flux FROM rf")
def reference_band(spark, sf_dir):
    return _refs(spark, sf_dir).select("star", r6("presence").alias("presence"), r6("median_flux").alias("median_flux"))


@query("ref_flux_per_frame", f"WITH {BAND} SELECT frame, round(ref_sum, 4) AS ref_sum, round(ref_mean, 4) AS ref_mean, n_used, round(-2.5 * log10(ref_mean), 6) AS ref_mag FROM pf")
def ref_flux_per_frame(spark, sf_dir):
    p = robust.reference_flux(frames(spark, sf_dir), _refs(spark, sf_dir))
    return p.select("frame", F.round("ref_sum", 4).alias("ref_sum"), F.round("ref_mean", 4).alias("ref_mean"), "n_used", r6("ref_mag").alias("ref_mag"))


@query("differential_mag", f"WITH {BAND}, j AS (SELECT fr.star, fr.frame, flux, CASE WHEN fr.star IN (SELECT star FROM rf) THEN (ref_sum - flux) / nullif(n_used - 1, 0) ELSE ref_mean END AS d FROM fr LEFT JOIN pf USING (frame)) SELECT star, frame, round(flux / d, 6) AS rel_flux, round(-2.5 * log10(flux / d), 6) AS diff_mag FROM j")
def differential_mag(spark, sf_dir):
    f, refs = frames(spark, sf_dir), _refs(spark, sf_dir)
    d = robust.differential(f, robust.reference_flux(f, refs), refs)
    return d.select("star", "frame", r6("rel_flux").alias("rel_flux"), r6("diff_mag").alias("diff_mag"))


@query("normalize_by_median", f"WITH {FR} SELECT star, frame, round(flux / median(flux) OVER (PARTITION BY star), 6) AS norm FROM fr")
def normalize_by_median(spark, sf_dir):
    return robust.normalise_by_median(frames(spark, sf_dir), "star", "flux").select("star", "frame", r6("norm").alias("norm"))


SEL = STARS + ", cd AS (SELECT a.star AS target, b.star AS ref, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d FROM s a JOIN s b ON a.star <> b.star), rk AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY d, ref) AS rank FROM cd WHERE d <= 0.1), sl AS (SELECT * FROM rk WHERE rank <= 6 AND target IN (SELECT target FROM rk GROUP BY target HAVING count(*) >= 3))"
VECTORS = "fx AS (SELECT vec_id AS star, unnest(range(64)) AS t, unnest(embedding)::DOUBLE + 1 AS flux FROM embeddings)"
NORM = "nm AS (SELECT star, t, flux / median(flux) OVER (PARTITION BY star) AS f FROM fx)"


def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stars(spark, sf_dir)
    near = nearest.k_nearest(s.withColumnRenamed("star", "target"), s.withColumnRenamed("star", "ref"), 6, ("x", "y"), "target", "ref", exclude_same=True)
    return robust.reference_selection(near.drop("rank"), 0.1, 6, 3)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("star"), "embedding").select("star", F.posexplode("embedding").alias("t", "v")).select("star", F.col("t").cast("long").alias("t"), (F.col("v").cast("double") + 1).alias("flux"))


REFERENCES = f"WITH {SEL} SELECT target, ref, rank FROM sl"


@query("reference_selection", REFERENCES)
def reference_selection(spark, sf_dir):
    return _selection(spark, sf_dir).select("target", "ref", F.col("rank").cast("long").alias("rank"))


ENSEMBLE = f"WITH {SEL}, {VECTORS}, dn AS (SELECT target, t, avg(flux) AS d FROM sl JOIN fx ON fx.star = ref GROUP BY target, t), rl AS (SELECT target, dn.t, flux / d AS rel FROM dn JOIN fx ON fx.star = target AND fx.t = dn.t WHERE d > 0) SELECT target, t, round(rel / median(rel) OVER (PARTITION BY target), 6) AS rel FROM rl"


@query("ensemble_differential", ENSEMBLE)
def ensemble_differential(spark, sf_dir):
    return numeric.ensemble(_vectors(spark, sf_dir), _selection(spark, sf_dir)).select("target", "t", r6("rel").alias("rel"))


IDL = f"""WITH {SEL}, {VECTORS}, {NORM}, e1 AS (SELECT sl.target, ref, avg(power(r.f - o.f, 2)) AS sse FROM sl JOIN nm r ON r.star = ref JOIN nm o ON o.star = target AND o.t = r.t GROUP BY sl.target, ref),
k1 AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY sse, ref) AS rank, count(*) OVER (PARTITION BY target) AS n FROM e1), p1 AS (SELECT * FROM k1 WHERE rank <= greatest(3, least(round_even(0.5 * n, 0), n))),
g AS (SELECT target, t, avg(f) AS g FROM p1 JOIN nm ON star = ref GROUP BY target, t), e2 AS (SELECT p1.target, ref, avg(power(f - g, 2)) AS sse FROM p1 JOIN nm ON star = ref JOIN g ON g.target = p1.target AND g.t = nm.t GROUP BY p1.target, ref),
k2 AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY sse, ref) AS rank, count(*) OVER (PARTITION BY target) AS n FROM e2)
SELECT target, ref, rank, round(sse, 6) AS sse FROM k2 WHERE rank <= greatest(3, least(round_even(0.5 * n, 0), n))"""


@query("idl_reference_selection", IDL)
def idl_reference_selection(spark, sf_dir):
    s = robust.similar_references(_vectors(spark, sf_dir), _selection(spark, sf_dir))
    return s.select("target", "ref", F.col("rank").cast("long").alias("rank"), r6("sse").alias("sse"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as trials: a quality label is an injected event."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    peak = F.log10(F.col("n_chars") + 1) + F.col("quality") * 0.5
    kind = F.when(F.col("quality") == 1, "inject").otherwise("null")
    return d.select(
        F.col("doc_id").alias("trial_id"), kind.alias("kind"), peak.alias("peak"), (F.col("doc_id") % 40).alias("frame"), F.lit(20).alias("center"), ((F.col("doc_id") % 97) / 97.0).alias("depth"), (F.col("n_chars") % 50).cast("double").alias("snr"), (F.col("doc_id") % 12 + 1).alias("duration")
    )


TR = "tr AS (SELECT doc_id AS trial_id, CASE WHEN quality = 1 THEN 'inject' ELSE 'null' END AS kind, log10(n_chars + 1) + quality * 0.5 AS peak, doc_id % 40 AS frame, 20 AS center, (doc_id % 97) / 97.0 AS depth, (n_chars % 50)::DOUBLE AS snr, doc_id % 12 + 1 AS duration FROM documents JOIN labels USING (doc_id))"
ROC = f"WITH {TR}, gr AS (SELECT unnest(range(80)) AS point, min(peak) AS lo, max(peak) AS hi FROM tr), th AS (SELECT point, lo + point * ((hi - lo) / 79) AS threshold FROM gr), rc AS (SELECT point, threshold, coalesce(avg(CASE WHEN kind = 'inject' THEN (peak >= threshold AND abs(frame - center) <= 12)::INT END), 0) AS completeness, coalesce(avg(CASE WHEN kind = 'null' THEN (peak >= threshold)::INT END), 0) AS far FROM tr CROSS JOIN th GROUP BY ALL)"


@query("roc_curve", ROC + " SELECT point::INT AS point, round(threshold, 6) AS threshold, round(completeness, 6) AS completeness, round(far, 6) AS far FROM rc")
def roc_curve(spark, sf_dir):
    r = evaluate.roc(trials(spark, sf_dir))
    return r.select("point", r6("threshold").alias("threshold"), r6("completeness").alias("completeness"), r6("far").alias("far"))


@query("completeness_at_far", ROC + " SELECT round(coalesce(max(CASE WHEN far <= 0.1 THEN completeness END), 0), 6) AS completeness FROM rc")
def completeness_at_far(spark, sf_dir):
    return evaluate.completeness_at_far(evaluate.roc(trials(spark, sf_dir)), 0.1).select(r6("completeness").alias("completeness"))


@query("threshold_at_far", f"WITH {TR} SELECT round(quantile_cont(peak, 0.95) FILTER (kind = 'null'), 6) AS threshold FROM tr")
def threshold_at_far(spark, sf_dir):
    return evaluate.threshold_at_far(trials(spark, sf_dir), 0.05).select(r6("threshold").alias("threshold"))


@query("completeness_map", f"WITH {TR}, b AS (SELECT least(floor(snr / (48.0 / 6)), 5)::INT AS sb, least(floor(depth / 0.2), 4)::INT AS db, (peak >= 3.6 AND abs(frame - center) <= 12)::INT AS hit FROM tr WHERE kind = 'inject' AND snr <= 48), g AS (SELECT s::INT AS snr_bin, d::INT AS depth_bin FROM range(6) a(s), range(5) b(d)) SELECT snr_bin, depth_bin, count(hit) AS n, round(avg(hit), 6) AS completeness FROM g LEFT JOIN b ON sb = snr_bin AND db = depth_bin GROUP BY ALL")
def completeness_map(spark, sf_dir):
    m = evaluate.completeness_map(trials(spark, sf_dir), 3.6, 48.0)
    return m.select("snr_bin", "depth_bin", "n", r6("completeness").alias("completeness"))


@query("completeness_logbins", f"WITH {TR}, e AS (SELECT depth * snr * sqrt(duration) AS es, (peak >= 3.6 AND abs(frame - center) <= 12)::INT AS hit FROM tr WHERE kind = 'inject'), b AS (SELECT least(floor((log10(es) - 0) / (2.0 / 12)), 11)::INT AS bin, hit FROM e WHERE es >= 1 AND es <= 100) SELECT bin, round(power(10, (bin + 0.5) * (2.0 / 12)), 6) AS center, count(*) AS n, round(avg(hit), 6) AS completeness FROM b GROUP BY bin")
def completeness_logbins(spark, sf_dir):
    t = trials(spark, sf_dir).withColumn("event_snr", evaluate.event_snr(F.col("depth"), F.col("snr"), F.col("duration")))
    b = evaluate.completeness_by_log_bins(t, 3.6, 1.0, 100.0)
    return b.select("bin", r6("center").alias("center"), "n", r6("completeness").alias("completeness"))


@query("completeness_depth", f"WITH {TR} SELECT floor(depth / 0.125)::INT AS bin, count(*) AS n, round(avg((peak >= 3.6 AND abs(frame - center) <= 12)::INT), 6) AS completeness FROM tr WHERE kind = 'inject' AND depth < 1 GROUP BY 1")
def completeness_depth(spark, sf_dir):
    return evaluate.completeness_by_depth(trials(spark, sf_dir), 3.6).select("bin", "n", r6("completeness").alias("completeness"))


@query("event_snr", f"WITH {TR} SELECT trial_id, round(depth * snr * sqrt(duration), 6) AS event_snr FROM tr WHERE kind = 'inject'")
def event_snr(spark, sf_dir):
    return trials(spark, sf_dir).where("kind = 'inject'").select("trial_id", r6(evaluate.event_snr(F.col("depth"), F.col("snr"), F.col("duration"))).alias("event_snr"))


@query("catalog_filter", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 1000 AND 5000 AND c_nationkey >= 3 AND c_nationkey <= 12")
def catalog_filter(spark, sf_dir):
    return robust.in_ranges(table(spark, sf_dir, "customer"), c_acctbal=(1000, 5000), c_nationkey=(3, 12)).select("c_custkey", "c_acctbal")


@query("top_snr", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 50")
def top_snr(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(50)


@query("edge_filter", f"WITH {STARS}, p AS (SELECT star, (x + 0.5) * 100 AS x, (y + 0.5) * 100 AS y FROM s) SELECT star FROM p WHERE x + 10 < 100 AND x - 10 > 0 AND y + 10 < 100 AND y - 10 > 0")
def edge_filter(spark, sf_dir):
    p = stars(spark, sf_dir).select("star", ((F.col("x") + 0.5) * 100).alias("x"), ((F.col("y") + 0.5) * 100).alias("y"))
    return p.where(robust.edge_mask(F.col("x"), F.col("y"), 100, 100)).select("star")


@query("full_scopes", "WITH n AS (SELECT event_type AS scope, count(*) AS n FROM events GROUP BY 1) SELECT scope, n FROM n WHERE n >= 0.99 * (SELECT max(n) FROM n)")
def full_scopes(spark, sf_dir):
    return robust.full_scopes(table(spark, sf_dir, "events").select(F.col("event_type").alias("scope")), "scope", 0.99)


@query("scopes_identical", "SELECT bool_and(abs(a.l_tax - b.l_tax) <= 1e-8 + 1e-5 * abs(b.l_tax)) AS identical, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey AND a.l_shipdate = b.l_shipdate")
def scopes_identical(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return robust.scopes_identical(li, li, ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"], "l_tax")


@query("exact_medians", "WITH m AS (SELECT l_returnflag, count(*) AS n, median(l_extendedprice) AS median FROM lineitem GROUP BY 1) SELECT l_returnflag, any_value(n) AS n, round(any_value(median), 6) AS median, round(median(abs(l_extendedprice - median)), 6) AS mad FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1")
def exact_medians(spark, sf_dir):
    """Three keys with a third of the table each, of which no buffer holds over ten thousand values."""
    d = quantiles.exact_mads(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return d.select("l_returnflag", "n", r6("median").alias("median"), r6("mad").alias("mad"))
