"""What the text operators share: Arrow batches, their bytes and hashes of segments."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of one Arrow batch sent to Python. Texts are batched by bytes
#: too, so that a run of very long documents cannot fill a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20
READER_ROWS = 256


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limits on batches of rows to those of this module."""
    # A reader holds a batch of rows of every column; texts and sets are wide.
    limits = {"execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "execution.arrow.maxBytesPerBatch": BATCH_BYTES, "parquet.columnarReaderBatchSize": READER_ROWS}
    for name, most in limits.items():
        own = spark.conf.get(f"spark.sql.{name}", None)
        if own is None or not own.isdigit() or not 0 < int(own) <= most:
            spark.conf.set(f"spark.sql.{name}", most)


def in_batches(docs: DataFrame, columns: Sequence[str], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over the named columns only, in batches of bounded bytes.

    The session's limits on batches are lowered to those above where they are
    higher, and stay so: a frame is planned when it runs, so they must still
    hold then. A worker gives the memory of a task back when the task ends,
    since it lives on for tasks of other stages.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back_memory()

    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def give_back_memory() -> None:
    """Return freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Marks by which rows are told from ids they cannot be: a bit each, 64 to a row, sent to every executor (2^20 rows at most).
MARKS = 1 << 26


def split_by_ids(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` is among ``ids`` (a column of that name, without
    nulls), and all others, a null key's too. Wide rows whose id's mark none of
    the ids has are never shuffled; only the others meet the ids in a join."""
    mark = F.pmod(F.xxhash64(key), F.lit(MARKS))
    place, bit = F.shiftright(mark, 6), F.pmod(mark, F.lit(64)).cast("int")
    marks = ids.groupBy(place.alias("_place")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    seen = rows.withColumn("_place", place).join(F.broadcast(marks), "_place", "left").withColumn("_marked", F.coalesce(F.getbit("_bits", bit) == 1, F.lit(False)))
    marked, free = seen.where("_marked").select(rows.columns), seen.where("NOT _marked").select(rows.columns)
    return marked.join(ids, key, "left_semi").select(rows.columns), free.union(marked.join(ids, key, "left_anti").select(rows.columns))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of a column; a null text is the empty string."""
    return ["" if t is None else t for t in column.to_pylist()]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column in a row, and each text's start (one more
    than texts); a null text is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, starts - starts[0]


def spans_of(starts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about ``most`` bytes each, one text at least."""
    a, n = 0, len(starts) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + most, "right")) - 1)
        yield a, b
        a = b


class SegmentHash:
    """64-bit hashes of short byte segments, for whole arrays of segments at once.

    A polynomial over the bytes from prefix sums modulo 2^64 with an odd base
    (so that the power of a segment's start can be divided out), mixed with the
    segment's length. Only for segments of bounded length: from 1,024 bytes on
    there are pairs that collide whatever the base is (``word_hashes`` has none).
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def __call__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * self.up[: len(raw)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        return mix64(h ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (splitmix64's finalizer)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes of a word that are hashed by lanes; what lies behind goes through BLAKE2b.
LANE_BYTES = 256
_LANE_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte segments of any length: lanes of eight bytes are
    mixed into the hash one after the other, in rounds over all segments that
    still have one. Segments of up to eight bytes and one length never collide."""
    size = ends - starts
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    lanes = np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
    h = mix64(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, at = np.flatnonzero(size > 0), 0
    while len(live) and at < LANE_BYTES:
        left = size[live] - at
        h[live] = mix64(h[live] ^ (lanes[starts[live] + at] & _LANE_MASK[np.minimum(left, 8)]))
        live, at = live[left > 8], at + 8
    for i in live.tolist():
        rest = hashlib.blake2b(raw[starts[i] + at : ends[i]].tobytes(), digest_size=8).digest()
        h[i : i + 1] = mix64(h[i : i + 1] ^ np.frombuffer(rest, "<u8"))
    return h


#: Bytes that part words: space and the controls from tab to carriage return.
BREAK = np.zeros(256, bool)
BREAK[[*range(9, 14), 32]] = True


def words_of(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of the texts begin and end, and each text's first word
    (one more than texts). Words part at ``BREAK`` bytes."""
    inside = ~BREAK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[starts] = True
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    behind = np.zeros(len(raw), bool)
    behind[:-1] = inside[1:]
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~behind | edge[1:])) + 1
    return begin, end, np.searchsorted(begin, starts)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words from their hashes; empty if there are fewer."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = (total + words[k : len(words) - n + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(total)
