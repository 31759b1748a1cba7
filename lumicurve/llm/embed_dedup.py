"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Unit vectors are projected on Gaussian directions and the projections
quantised; several quantised projections together are the bucket of a vector
in one table. On unit vectors a cosine is a distance, so the chance that a
linked pair shares a bucket is known, and the numbers of projections and tables
follow from the count of vectors and the wanted recall. Pairs of a bucket are
checked by their cosines in double precision, in blocks of a matrix product;
large buckets are cut into chunks whose pairs are dealt out. Equal vectors are
one class from the start, and only degrees and a forest of links leave a block,
never pairs.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicurve.llm.common import bound_batches, mix64
from lumicurve.llm.components import connected_components
from lumicurve.session import materialise


def collision_chance(distance: float, width: float) -> float:
    """Chance that one quantised projection agrees for two points so far apart."""
    c = width / distance
    return math.erf(c / math.sqrt(2)) - math.sqrt(2 / math.pi) / c * (1 - math.exp(-c * c / 2))


def plan(count: int, threshold: float, recall: float, width: float, bucket: int) -> tuple[int, int]:
    """Projections per table and tables: unrelated vectors (at right angles)
    should fill buckets of about ``bucket``, and a pair just at the threshold
    should meet in some table with chance ``recall``."""
    near = collision_chance(math.sqrt(2 - 2 * threshold), width)
    far = collision_chance(math.sqrt(2), width)
    projections = max(1, math.ceil(math.log(max(1.0, count / bucket)) / -math.log(far)))
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**projections)))
    return projections, tables


def unit_vectors(raw: list[bytes]) -> np.ndarray:
    """Rows of doubles of length 1 from the bytes of equally long vectors."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, raw): the vector's doubles as bytes; null where the vector is null,
    empty, zero, or holds a null or non-finite component."""

    def run(batches):
        for b in batches:
            raw = []
            for v in b.column(1):
                x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                raw.append((x + 0.0).tobytes() if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["id", "raw"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, vector_col).mapInArrow(run, f"id {kind}, raw binary")


@lru_cache(maxsize=4)
def directions_of(seed: int, size: int, n: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """``n`` random directions for vectors of ``size`` bytes, and their shifts."""
    rng = np.random.default_rng([seed, size])
    return rng.standard_normal((size // 8, n)), rng.uniform(0, width, n)


def bucket_keys(raw: list[bytes], projections: int, tables: int, width: float, seed: int) -> np.ndarray:
    """A 64-bit bucket key for each vector and table."""
    out = np.empty((len(raw), tables), np.uint64)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        directions, shift = directions_of(seed, size, tables * projections, width)
        cells = np.floor((unit_vectors([raw[i] for i in rows]) @ directions + shift) / width).astype(np.int64).view(np.uint64)
        keys = np.full((len(rows), tables), size, np.uint64)
        for k in range(projections):
            keys = mix64(keys * np.uint64(0x100000001B3) + cells.reshape(len(rows), tables, projections)[:, :, k])
        out[rows] = keys
    return out


def _block(threshold: float, projections: int, tables: int, width: float, seed: int):
    def run(table: pa.Table) -> pa.Table:
        """Degrees and a forest of the links of one pair of chunks of a bucket."""
        t, i, j = (table.column(c)[0].as_py() for c in ("t", "i", "j"))
        raw = table.column("raw").to_pylist()
        unit = unit_vectors(raw)
        weight = table.column("m").to_numpy()
        chunk = table.column("chunk").to_numpy()
        one, two = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        degree, label = np.zeros(len(unit), np.int64), np.arange(len(unit))
        found = []
        for a in range(0, len(one), 256):
            rows = one[a : a + 256]
            x, y = np.nonzero(unit[rows] @ unit[two].T >= threshold)
            x, y = rows[x], two[y]
            keep = x < y if i == j else slice(None)
            x, y = x[keep], y[keep]
            found.append((x, y))
        # A pair counts in the first table in which it meets. Keys are made again, for linked vectors alone.
        linked = np.unique(np.concatenate([np.empty(0, np.int64), *(v for pair in found for v in pair)]))
        keys = np.zeros((len(unit), t), np.uint64)
        if t and len(linked):
            keys[linked] = bucket_keys([raw[k] for k in linked.tolist()], projections, tables, width, seed)[:, :t]
        for x, y in found:
            fresh = np.ones(len(x), bool)
            for k in range(t):
                fresh &= keys[x, k] != keys[y, k]
            np.add.at(degree, x[fresh], weight[y[fresh]])
            np.add.at(degree, y[fresh], weight[x[fresh]])
        x, y = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        while len(x):
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        ids = table.column("id").combine_chunks()
        rows = np.flatnonzero((degree > 0) | (label != np.arange(len(unit))))
        return pa.table({"id": ids.take(pa.array(rows)), "degree": pa.array(degree[rows]), "root": ids.take(pa.array(label[rows]))})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.995, width: float = 1.5, bucket: int = 256, seed: int = 17, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``vectors``.

    Pairs with a cosine of at least ``threshold`` link; a linked pair is found
    with a chance of ``recall`` at least, and no pair below the threshold ever
    links. n_links counts the other rows linked directly. Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing
    and are their own component; so are vectors of different length to each
    other. Equal vectors always link. Rows of one id are one node with all
    their links; a row without an id belongs to its equals' component, or to
    none (null). An empty table gives an empty result; other columns, labels
    among them, are not read.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = materialise(usable(vectors, id_col, vector_col), "vectors")
    classes = materialise(rows.where("raw IS NOT NULL").groupBy("raw").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m")), "vector-classes")
    nodes = classes.where("rep IS NOT NULL")
    projections, tables = plan(nodes.count(), threshold, recall, width, bucket)

    def sign(batches):
        for b in batches:
            keys = bucket_keys(b.column(0).to_pylist(), projections, tables, width, seed) if len(b) else np.empty((0, tables), np.uint64)
            yield b.append_column("keys", pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())))

    signed = materialise(nodes.select("raw", F.col("rep").alias("id"), "m").mapInArrow(sign, f"raw binary, id {kind}, m long, keys array<long>"), "signed")
    placed = signed.select("id", F.posexplode("keys").alias("t", "key"))
    counts = placed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # 128 vectors of a bucket to a chunk; from 5,120 on the chunks grow, to 2,048 at most.
    chunks = F.greatest(F.least(F.ceil(F.col("n") / 128), F.lit(40)), F.ceil(F.col("n") / 2048)).cast("int")
    dealt = placed.join(counts.select("t", "key", chunks.alias("c")), ["t", "key"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("c")).cast("int"))
    # Numbers alone find who meets; the vectors come to those that have company.
    dealt = dealt.join(signed.select("id", "m", "raw"), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    dealt = dealt.select("t", "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "id", "m", "raw")
    block = _block(threshold, projections, tables, width, seed)
    links = materialise(dealt.groupBy("t", "key", "i", "j").applyInArrow(block, f"id {kind}, degree long, root {kind}"), "links")

    degree = links.groupBy("id").agg(F.sum("degree").alias("degree"))
    component = connected_components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    label = classes.join(degree.withColumnRenamed("id", "rep"), "rep", "left").join(component.select(F.col("node").alias("rep"), "component"), "rep", "left")
    label = label.select("raw", (F.col("m") - 1 + F.coalesce("degree", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(label, "raw", "left").select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).alias("n_links"), F.when(F.col("raw").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
