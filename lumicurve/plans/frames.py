"""Queries of photometry on frames: vectors as images of 8 x 8 pixels."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicurve.operators import images
from lumicurve.operators.tracking import track_stars
from lumicurve.plans.common import r6, table
from lumicurve.plans.registry import query
from lumicurve.session import work_dir
from lumicurve.sources.frame_source import frame_bands, frame_sizes, write_frames

SIDE = 8
#: Two places in each image, which depend on its label.
PLACES = "st AS (SELECT vec_id AS frame, unnest([0, 1]) AS star, unnest([2.337::DOUBLE + label % 3 * 0.5, 5.013::DOUBLE - label % 2]) AS x, unnest([3.119::DOUBLE, 4.413::DOUBLE + label % 4 * 0.25]) AS y FROM embeddings)"
PIXELS = "px AS (SELECT vec_id AS frame, unnest(range(64)) % 8 AS px, unnest(range(64)) // 8 AS py, (unnest(embedding)::DOUBLE + 1) * 100 AS v FROM embeddings)"
CIRCLE = "(SELECT count(*) / 25.0 FROM range(5) a(i), range(5) b(j) WHERE power(px + (i + 0.5) / 5 - 0.5 - x, 2) + power(py + (j + 0.5) / 5 - 0.5 - y, 2) <= {r} * {r})"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, label, t, pixels, height, width."""
    light = F.transform("embedding", lambda v: (v.cast("double") + 1) * 100)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), "label", (F.col("vec_id") * 0.025).alias("t"), light.alias("pixels"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"))


def places(f: DataFrame) -> DataFrame:
    """frame, star, x, y."""
    label = F.col("label")
    at = lambda k, x, y: F.struct(F.lit(k).alias("star"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    two = F.array(at(0, F.lit(2.337) + label % 3 * 0.5, F.lit(3.119)), at(1, F.lit(5.013) - label % 2, F.lit(4.413) + label % 4 * 0.25))
    return f.select("frame", F.inline(two))


@query("square_apertures", f"WITH {PLACES}, {PIXELS} SELECT st.frame, star::INT AS star, round(sum(v), 6) AS flux FROM st JOIN px ON px.frame = st.frame AND px BETWEEN trunc(x - 1) AND trunc(x + 2) - 1 AND py BETWEEN trunc(y - 1) AND trunc(y + 2) - 1 GROUP BY ALL")
def square_apertures(spark, sf_dir):
    f = frames(spark, sf_dir)
    pixels = f.select("frame", F.posexplode("pixels").alias("i", "v")).select("frame", (F.col("i") % SIDE).alias("px"), F.floor(F.col("i") / SIDE).cast("int").alias("py"), "v")
    return images.square_photometry(pixels, places(f), "frame", 1).select("frame", "star", r6("flux").alias("flux"))


APERTURES = f"""WITH {PLACES}, {PIXELS}, sh AS (SELECT st.frame, star, v, {CIRCLE.format(r=1.5)} AS own, {CIRCLE.format(r=3.0)} - {CIRCLE.format(r=2.0)} AS ring FROM st JOIN px ON px.frame = st.frame AND abs(px - x) < 4 AND abs(py - y) < 4),
s AS (SELECT frame, star, sum(v * own) - sum(v * ring) / sum(ring) * sum(own) AS flux FROM sh GROUP BY frame, star)
SELECT frame, star::INT AS star, round(flux, 6) AS flux, round(CASE WHEN flux > 0 THEN -2.5 * log10(flux) END, 6) AS mag FROM s"""


@query("circle_apertures", APERTURES)
def circle_apertures(spark, sf_dir):
    f = frames(spark, sf_dir)
    found = images.aperture_photometry(f, places(f), "frame", "frame", 1.5, (2.0, 3.0))
    return found.select("frame", "star", r6("flux").alias("flux"), r6("mag").alias("mag"))


FORCED = f"""WITH {PIXELS}, rq AS (SELECT label, min(vec_id) * 0.025 + 3 AS tm, 2.617::DOUBLE + label % 5 * 0.3 AS x, 3.719::DOUBLE AS y FROM embeddings GROUP BY label),
fr AS (SELECT e.vec_id AS frame, e.vec_id * 0.025 AS t, rq.* FROM embeddings e JOIN rq USING (label) WHERE e.vec_id * 0.025 BETWEEN tm - 1 AND tm + 1),
n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY t) AS n FROM fr), c AS (SELECT label, arg_min(n, (abs(t - tm), t)) AS c FROM n GROUP BY label),
f AS (SELECT n.frame, sum(v * {CIRCLE.format(r=1.5)}) AS flux FROM n JOIN px ON px.frame = n.frame AND abs(px - x) < 3 AND abs(py - y) < 3 GROUP BY n.frame)
SELECT label AS request, round(t, 6) AS t, (n - c)::INT AS "offset", round(flux, 6) AS flux FROM n JOIN c USING (label) JOIN f USING (frame)"""


@query("forced_photometry", FORCED)
def forced_photometry(spark, sf_dir):
    f = frames(spark, sf_dir)
    wanted = f.groupBy("label").agg((F.min("frame") * 0.025 + 3).alias("at")).select(F.col("label").alias("request"), "label", "at", (2.617 + F.col("label") % 5 * 0.3).alias("x"), F.lit(3.719).alias("y"))
    found = images.forced_photometry(f, wanted, "label", radius=1.5)
    return found.select("request", r6("t").alias("t"), "offset", r6("flux").alias("flux"))


DRIFT = f"""WITH {PIXELS}, st AS (SELECT vec_id AS frame, 3.007::DOUBLE + (vec_id % 40) * 0.02 AS x, 4.003::DOUBLE - (vec_id % 40) * 0.01 AS y FROM embeddings)
SELECT st.frame, round(sum(v * {CIRCLE.format(r=1.5)}), 6) AS flux FROM st JOIN px ON px.frame = st.frame AND abs(px - x) < 3 AND abs(py - y) < 3 GROUP BY st.frame"""


@query("drifting_photometry", DRIFT)
def drifting_photometry(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("field", F.floor(F.col("frame") / 40)).withColumn("t", (F.col("frame") % 40).cast("double"))
    fields = f.select("field").distinct()
    stars = fields.select("field", F.lit(0).alias("star"), F.lit(3.007).alias("x"), F.lit(4.003).alias("y"))
    drift = fields.select("field", F.lit(0.0).alias("t0"), F.lit(0.02).alias("vx"), F.lit(-0.01).alias("vy"))
    return images.drifting_photometry(f, stars, drift, "frame", "field", radius=1.5).select("frame", r6("flux").alias("flux"))


@query("dark_subtracted", f"WITH {PIXELS}, l AS (SELECT frame, px, py, v, label FROM px JOIN embeddings ON vec_id = frame), d AS (SELECT label, px, py, median(v) AS d FROM l GROUP BY ALL) SELECT frame, (py * 8 + px)::INT AS pixel, round(v - d, 6) AS value FROM l JOIN d USING (label, px, py)")
def dark_subtracted(spark, sf_dir):
    from lumicurve.operators.rollup import median_stack

    f = frames(spark, sf_dir)
    darks = median_stack(f, "label").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pixel", "value")))["value"].alias("dark"))
    less = images.subtract_dark(f, darks, "label")
    return less.select("frame", F.posexplode("pixels").alias("pixel", "v")).select("frame", "pixel", r6("v").alias("value"))


@query("star_extraction")
def star_extraction(spark, sf_dir):
    found = images.find_stars(frames(spark, sf_dir), "frame", 0.7, 2, box=SIDE)
    return found.select("frame", "star", *[r6(c).alias(c) for c in ("x", "y", "r", "flux")], "npix")


@query("frame_background")
def frame_background(spark, sf_dir):
    return images.background_level(frames(spark, sf_dir), "frame", SIDE).select("frame", r6("level").alias("level"), r6("rms").alias("rms"))


@query("refined_centroids")
def refined_centroids(spark, sf_dir):
    f = frames(spark, sf_dir)
    found = images.refined(images.with_stars(f, places(f), "frame"), "frame", 1.2)
    return found.select("frame", "star", r6("x").alias("x"), r6("y").alias("y"))


@query("registered_shifts")
def registered_shifts(spark, sf_dir):
    shifts = images.rigid_shifts(frames(spark, sf_dir), "label", "frame", 10)
    return shifts.select("label", "frame", r6("dx").alias("dx"), r6("dy").alias("dy"))


GUIDED = """WITH st AS (SELECT vec_id AS frame, label, unnest([0, 1]) AS star, unnest([2.0, 5.0]) + embedding[1]::DOUBLE AS x, unnest([3.0, 4.0]) + embedding[2]::DOUBLE AS y FROM embeddings), g AS (SELECT label, min(frame) AS f FROM st GROUP BY label),
gd AS (SELECT st.label, star AS g, x AS gx, y AS gy FROM st JOIN g ON frame = f AND st.label = g.label), nr AS (SELECT st.label, frame, g, x - gx AS dx, y - gy AS dy, row_number() OVER (PARTITION BY st.label, frame, g ORDER BY hypot(x - gx, y - gy), x - gx) AS k FROM st JOIN gd ON gd.label = st.label AND hypot(x - gx, y - gy) <= 1)
SELECT s.label, s.frame, round(coalesce(median(dx), 0), 6) AS dx, round(coalesce(median(dy), 0), 6) AS dy, count(g) AS guides FROM (SELECT DISTINCT label, frame FROM st) s LEFT JOIN nr ON nr.frame = s.frame AND nr.label = s.label AND k = 1 GROUP BY s.label, s.frame"""


@query("guided_shifts", GUIDED.replace("hypot(x - gx, y - gy)", "sqrt(power(x - gx, 2) + power(y - gy, 2))"))
def guided_shifts(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    moved = lambda k, base: (F.lit(base) + F.col("embedding")[k].cast("double"))
    two = F.array(*[F.struct(F.lit(s).alias("star"), moved(0, x).alias("x"), moved(1, y).alias("y")) for s, x, y in ((0, 2.0, 3.0), (1, 5.0, 4.0))])
    found = e.select("label", F.col("vec_id").alias("frame"), F.inline(two))
    first = found.groupBy("label").agg(F.min("frame").alias("frame"))
    shifts = images.guided_shifts(found, found.join(first, ["label", "frame"], "left_semi").select("label", "star", "x", "y"), "label", "frame", 1.0)
    return shifts.select("label", "frame", r6("dx").alias("dx"), r6("dy").alias("dy"), "guides")


def _raw_files(spark: SparkSession, sf_dir: str) -> str:
    """Every embedding written as a raw frame of 8 x 8 pixels, in a folder by label."""
    path = f"{work_dir(spark)}/raw-{uuid.uuid4().hex}"
    low = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 100).cast("int"))
    e = table(spark, sf_dir, "embeddings").select(F.format_string("m%03d", "label").alias("folder"), F.format_string("f%07d.rcd", "vec_id").alias("name"), F.lit("2025-08-30T03:04:05").alias("date_obs"), F.lit(8).alias("height"), F.lit(8).alias("width"), low.alias("low"))
    write_frames(e.withColumn("high", F.transform("low", lambda v: v * 16 + 7)), path)
    return path


RAW = "f AS (SELECT printf('m%03d', label) AS folder, vec_id, list_transform(embedding, lambda v: floor((v::DOUBLE + 1) * 100)::BIGINT) AS px FROM embeddings)"


@query("raw_frame_bands", f"WITH {RAW}, b AS (SELECT folder, unnest([0, 3, 6])::INT AS row0, unnest([px[1:24], px[25:48], px[49:64]]) AS px FROM f) SELECT folder, row0, count(*) AS frames, sum(list_sum(px))::BIGINT AS low, sum(list_sum(list_transform(px, lambda v: (v * 16 + 7) % 4096)))::BIGINT AS high, (count(*) * (384 + any_value(len(px)) * 3))::BIGINT AS bytes FROM b GROUP BY folder, row0")
def raw_frame_bands(spark, sf_dir):
    """Sums over bands of three rows, each task reading its own bytes of the files."""
    b = frame_bands(spark, _raw_files(spark, sf_dir), bandRows=3)
    total = lambda c: F.sum(F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x)).alias(c)
    return b.groupBy("folder", "row0").agg(F.count(F.lit(1)).alias("frames"), total("low"), total("high"), F.sum("bytes").alias("bytes"))


@query("raw_frame_sizes", f"WITH {RAW} SELECT folder, count(*) AS frames, 8 AS height, 8 AS width FROM f GROUP BY folder")
def raw_frame_sizes(spark, sf_dir):
    return frame_sizes(spark, _raw_files(spark, sf_dir))


@query("tracked_stars")
def tracked_stars(spark, sf_dir):
    """Vectors as stars of the field of their label, which drifts over ten frames; some are out of sight in some."""
    v = lambda k: F.element_at("embedding", k + 1).cast("double")
    e = table(spark, sf_dir, "embeddings")
    stars = e.select(F.col("label").alias("field"), F.col("vec_id").alias("star"), (v(0) * 1000).alias("x"), (v(1) * 1000).alias("y"), ((v(2) + 2) * 100).alias("flux"))
    t = F.col("frame")
    at = lambda first: F.element_at("embedding", t + first + 1).cast("double")
    sources = e.select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("frame")).where(at(23) < 0.15)
    sources = sources.select(F.col("label").alias("field"), "frame", (v(0) * 1000 + t + at(3)).alias("x"), (v(1) * 1000 - t + at(13)).alias("y"), ((v(2) + 2) * 100 * (1 + at(33) / 4)).alias("flux"))
    return track_stars(stars, sources, "field").select("field", "frame", "star", r6("x").alias("x"), r6("y").alias("y"), r6("flux").alias("flux"), "found")
