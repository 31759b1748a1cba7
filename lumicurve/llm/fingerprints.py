"""Document fingerprints: the shingle hashes below a fixed fraction of all.

Since the threshold is the same for every text, fingerprints of parts merge to
that of the whole, and the share of one fingerprint found in another estimates
containment however unequal the two documents are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicurve.llm.common import in_batches, texts_of
from lumicurve.llm.ngram_join import shingle_sets

#: One of so many shingle hashes is kept; words to a shingle.
SCALE, WORDS = 8, 5
#: Bytes of input to a range of ids, and most ranges (their edges pass through the driver).
RANGE_BYTES, MOST_RANGES = 4 << 20, 16_384


def retained(hashes: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Of sorted distinct hashes those below 2^64 / scale; if there are none, the
    least, so that only a text without words has an empty fingerprint."""
    kept = hashes[: np.searchsorted(hashes, np.uint64((1 << 64) // scale))] if scale > 1 else hashes
    return kept if len(kept) else hashes[:1]


def sketches(column: pa.Array, scale: int = SCALE, n: int = WORDS) -> Iterator[np.ndarray]:
    """The retained hashes of each text, sorted."""
    for hashes in shingle_sets(column, n):
        yield retained(hashes, scale)


def encode(sketch: np.ndarray) -> str:
    """16 hex digits for each hash, in ascending order."""
    return sketch.astype(">u8").tobytes().hex()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of all shingles behind two sketches."""
    return retained(np.union1d(a, b), scale)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of ``a`` that is in ``b``: of a document's shingles in another
    document. An empty sketch is contained in an empty one alone."""
    if not len(a):
        return float(not len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def merge_fingerprints(rows: DataFrame, by: str, fingerprint_col: str = "fingerprint", scale: int = SCALE) -> DataFrame:
    """(by, fingerprint): one fingerprint for each group of fingerprints. Hashes
    are made distinct by partial aggregates first, so a group costs what its
    merged fingerprint holds. A null or empty fingerprint adds nothing."""
    at = F.sequence(F.lit(1), F.greatest(F.length(fingerprint_col) - 15, F.lit(1)), F.lit(16))
    each = rows.select(by, F.explode_outer(F.transform(at, lambda i: F.substring(F.col(fingerprint_col), i, F.lit(16)))).alias("_hash"))
    limit = f"{(1 << 64) // scale:016x}" if scale > 1 else "g"
    each = each.select(by, F.nullif("_hash", F.lit("")).alias("_hash")).distinct()
    below = F.collect_list(F.when(F.col("_hash") < limit, F.col("_hash")))
    return each.groupBy(by).agg(below.alias("_below"), F.min("_hash").alias("_least")).select(by, F.when(F.size("_below") > 0, F.array_join(F.array_sort("_below"), "")).otherwise(F.coalesce("_least", F.lit(""))).alias("fingerprint"))


def _range_of(id_col: str, edges: list[float]):
    """The number of a row's range, from the greatest ids down: how many edges
    are not below its id. Edges are looked up in two steps, so that a row is
    compared with about twice the root of their number."""
    if not edges:
        return F.lit(0)
    width = max(1, int(len(edges) ** 0.5))
    own = F.col(id_col).cast("double")
    array = lambda xs: F.expr(f"array({', '.join(f'{x!r}D' for x in xs)})")
    coarse = F.size(F.filter(array(edges[::width]), lambda e: e >= own))
    fine = F.slice(array(edges), F.greatest(coarse - 1, F.lit(0)) * width + 1, F.lit(width))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * width + F.size(F.filter(fine, lambda e: e >= own)))


def in_descending_order(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(id, text, _at, _halo) of every row with an id, and the number of ranges
    _at. Each range of ids, from the greatest down, also has the rows of the
    next range's greatest id (the last range those of the first's), marked
    _halo: so every row finds the next document in its own range. Only the
    ranges' edges and greatest ids pass through the driver."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_id IS NOT NULL")
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = min(MOST_RANGES, max(1, size // RANGE_BYTES))
    edges = rows.select(F.col("_id").cast("double").alias("x")).approxQuantile("x", [k / n for k in range(1, n)], 1 / (4 * n)) if n > 1 else []
    edges = sorted(set(edges), reverse=True)
    at = _range_of("_id", edges).cast("int")
    tops = sorted((r["at"], r["top"]) for r in rows.groupBy(at.alias("at")).agg(F.max("_id").alias("top")).collect())
    before = [(top, tops[k - 1][0]) for k, (_, top) in enumerate(tops)]
    kind = docs.schema[id_col].dataType.simpleString()
    halo = docs.sparkSession.createDataFrame(before, f"_id {kind}, _before int")
    places = F.array(F.struct(at.alias("at"), F.lit(0).alias("halo")), F.struct(F.col("_before").alias("at"), F.lit(1).alias("halo")))
    dealt = rows.join(F.broadcast(halo), "_id", "left").withColumn("_place", F.explode(F.filter(places, lambda p: p["at"].isNotNull())))
    return dealt.select("_id", "_text", F.col("_place.at").alias("_at"), F.col("_place.halo").alias("_halo")), len(edges) + 1


def edited(text: str, after: str) -> str:
    """The text with its last third replaced by the first as many code points of another."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _report(ids: pa.Array, texts: list[str], after: list[str], own: list[np.ndarray], after_own: list[np.ndarray], scale: int, n: int, names: list[str]) -> pa.RecordBatch:
    changed = [edited(t, x) for t, x in zip(texts, after, strict=True)]
    made = list(sketches(pa.array(changed, pa.large_string()), scale, n))
    columns = [
        pa.array(list(map(len, texts)), pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array(list(map(encode, own)), pa.string()),
        pa.array(list(map(encode, made)), pa.string()),
        pa.array(list(map(containment, own, made)), pa.float64()),
        pa.array(list(map(containment, own, after_own)), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays([ids, *columns], names=names)


def fingerprint_report(docs: DataFrame, scale: int = SCALE, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its length in code points, its fingerprint,
    the fingerprint and SHA-256 of its edited text (see ``edited``, with the next
    document in descending order of ids, after the last the first), and the
    containment of its fingerprint in those of the edited text and of the next
    document.

    Shingles are ``n`` words, A-Z lower-cased; a text with fewer has its words
    as one shingle; a null or empty text or one without words has none and an
    empty fingerprint, contained in an empty one alone. Ids are numbers. Rows
    that repeat an id follow each other in the order of their texts (and meet in
    one task, which streams them). A row without an id has no place in the order:
    its next document is empty. The only document is its own next one. An empty
    table gives no rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema, names = f"`{id_col}` {kind}, {COLUMNS}", [id_col, *(c.split()[0] for c in COLUMNS.split(", "))]
    dealt, ranges = in_descending_order(docs, id_col, text_col)

    def run(batches):
        held = None  # the row in front, whose next document has not come yet

        def emit(rows):
            parts = list(zip(*rows, strict=True))
            return _report(pa.array(parts[0], id_type), *map(list, parts[1:]), scale, n, names)

        for b in batches:
            id_type = b.column(0).type
            texts, places = texts_of(b.column(1)), list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
            ready = []
            for i, text, (at, halo), own in zip(b.column(0).to_pylist(), texts, places, sketches(b.column(1), scale, n), strict=True):
                if held is not None and held[0] == at:
                    ready.append((held[1], held[2], text, held[3], own))
                held = None if halo else (at, i, text, own)
            if ready:
                yield emit(ready)

    def alone(batches):
        for b in batches:
            texts, own = texts_of(b.column(1)), list(sketches(b.column(1), scale, n))
            yield _report(b.column(0), texts, [""] * len(texts), own, [np.empty(0, np.uint64)] * len(texts), scale, n, names)

    sorted_rows = dealt.repartitionById(ranges, "_at").sortWithinPartitions("_at", "_halo", F.desc("_id"), "_text")
    named = in_batches(sorted_rows, ["_id", "_text", "_at", "_halo"], run, schema)
    nameless = in_batches(docs.where(F.col(id_col).isNull()), [id_col, text_col], alone, schema)
    return named.union(nameless)
