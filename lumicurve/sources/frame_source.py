"""Frames as a Spark data source: raw camera files and FITS images, by row bands.

``spark.read.format("frame_bands")`` gives one row for each file and band of
image rows. A task opens a file, reads its header and the bytes of its own band
and nothing else, so no task, batch or cell ever holds a whole frame. Ranges of
folders, times and rows, as options or as pushed filters, decide which files and
bands are read at all. As a stream the source advances by minute folders.
``frame_files`` writes raw files.

Filters are pushed only with the option pushFilters (Spark also wants
spark.sql.python.filterPushdown.enabled), and then each filtered frame must come
from a ``load`` of its own: Spark 4.1 keeps what was pushed last with the table
behind a DataFrame, for all of its uses. The ranges have no such trap.

Files are opened through Arrow's file systems, so a path may be a folder that all
executors see or a URI of a store.
"""

from __future__ import annotations

import posixpath
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "folder string, name string, modified timestamp, date_obs string, gps_lock boolean, height int, width int, row0 int, rows int, low array<int>, high array<int>, bytes long"
HEADERS = "folder string, name string, modified timestamp, date_obs string, gps_lock boolean, height int, width int, bytes long"

# A raw file's header, and where in it are width, height (two bytes
# each, the first one the higher), binning, control byte and time of observation.
RAW_HEADER, RAW_WIDTH, RAW_HEIGHT, RAW_BINNING, RAW_CONTROL, RAW_TIME = 384, 81, 83, 100, 140, 152
RAW_TIME_BYTES, RAW_LOCKED, RAW_SIZE = 29, 96, 2048

# Blocks and cards of a FITS header, and numbers by BITPIX.
FITS_BLOCK, FITS_CARD = 2880, 80
FITS_KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


@dataclass(frozen=True)
class File:
    folder: str
    name: str
    path: str
    modified: int  # microseconds
    size: int


@dataclass(frozen=True)
class Band(InputPartition):
    """Some files of a folder, and the image rows to read of each; ``stop`` is
    None for the last band, which goes to the image's end."""

    files: tuple[File, ...]
    start: int
    stop: int | None

    @property
    def value(self):
        return (self.start, self.stop)


def _filesystem(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listing(path: str) -> list[File]:
    """The raw and FITS files below a folder, by folder and name."""
    from pyarrow import fs

    system, base = _filesystem(path)
    found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    files = [x for x in found if x.is_file and x.base_name.lower().endswith((".rcd", ".fits", ".fit", ".fts"))]
    root = base.rstrip("/")
    rows = [File(posixpath.dirname(x.path)[len(root) :].strip("/"), x.base_name, x.path, x.mtime_ns // 1000, x.size) for x in files]
    return sorted(rows, key=lambda f: (f.folder, f.name))


@dataclass
class Header:
    """What a header says, and where its image lies: bytes in front, bytes of an image row."""

    date_obs: str | None
    gps_lock: bool | None
    height: int
    width: int
    offset: int
    row_bytes: int
    kind: str | None = None  # numbers of a FITS image; None for packed pixels
    scale: float = 1.0
    zero: float = 0.0
    read: int = 0


def raw_header(head: bytes) -> Header:
    number = lambda at, n: int.from_bytes(head[at : at + n], "big")
    binning = number(RAW_BINNING, 1) or 1
    width, height = (number(at, 2) // binning or RAW_SIZE for at in (RAW_WIDTH, RAW_HEIGHT))
    stamp = head[RAW_TIME : RAW_TIME + RAW_TIME_BYTES].split(b"\0")[0].decode("ascii", "replace").strip()
    # A row of the image is two rows of the file: low gain, then high gain.
    return Header(stamp or None, head[RAW_CONTROL : RAW_CONTROL + 1] == bytes([RAW_LOCKED]), height, width, RAW_HEADER, 2 * width * 3 // 2, read=len(head))


def fits_header(handle) -> Header:
    cards: dict[str, str] = {}
    at, ended = 0, False
    while not ended:
        block = handle.read_at(FITS_BLOCK, at)
        if len(block) < FITS_BLOCK:
            raise ValueError("a FITS header without an end")
        at += FITS_BLOCK
        for k in range(0, FITS_BLOCK, FITS_CARD):
            card = block[k : k + FITS_CARD].decode("latin-1")
            if card[:8].strip() == "END":
                ended = True
                break
            if card[8:10] == "= ":
                text = card[10:].strip()
                cards.setdefault(card[:8].strip(), text[1:].split("'")[0].strip() if text.startswith("'") else text.split("/")[0].strip())
    shape = [int(cards[f"NAXIS{k}"]) for k in range(int(cards.get("NAXIS", "0")), 0, -1)]
    width = shape[-1] if shape else 0
    kind = FITS_KINDS[int(cards["BITPIX"])]
    return Header(cards.get("DATE-OBS"), None, int(np.prod(shape[:-1])) if shape else 0, width, at, width * np.dtype(kind).itemsize, kind, float(cards.get("BSCALE", 1)), float(cards.get("BZERO", 0)), at)


def header_of(handle, name: str) -> Header:
    return raw_header(handle.read_at(RAW_HEADER, 0)) if name.lower().endswith(".rcd") else fits_header(handle)


def unpacked(data: bytes, width: int) -> np.ndarray:
    """Rows of ``width`` pixels from packed pixels, two in three bytes."""
    d = np.frombuffer(data, np.uint8).astype(np.int32).reshape(-1, 3)
    return np.column_stack([(d[:, 0] << 4) | (d[:, 1] >> 4), ((d[:, 1] & 15) << 8) | d[:, 2]]).reshape(-1, width)


def packed(pixels: np.ndarray) -> bytes:
    """The inverse of ``unpacked``, for an even number of pixels."""
    a, b = (np.asarray(pixels).reshape(-1, 2).T.astype(np.uint16)[k] & 4095 for k in (0, 1))
    return np.column_stack([a >> 4, ((a & 15) << 4) | (b >> 8), b & 255]).astype(np.uint8).tobytes()


def read_band(handle, name: str, start: int, stop: int | None) -> tuple[Header, int, np.ndarray | None, np.ndarray | None]:
    """(header, rows, low, high) of the rows of a file from ``start`` on; the
    images of FITS files are low, without a high one. A file that ends early has
    fewer rows."""
    h = header_of(handle, name)
    stop = h.height if stop is None else min(stop, h.height)
    data = handle.read_at(max(0, stop - start) * h.row_bytes, h.offset + start * h.row_bytes) if stop > start else b""
    h.read += len(data)
    data = data[: len(data) // h.row_bytes * h.row_bytes] if h.row_bytes else b""
    if h.kind is None:
        px = unpacked(data, h.width) if data else np.empty((0, h.width), np.int32)
        return h, len(px) // 2, px[0::2].reshape(-1), px[1::2].reshape(-1)
    values = np.frombuffer(data, h.kind) * h.scale + h.zero
    return h, len(values) // h.width if h.width else 0, np.rint(values).astype(np.int32), None


@dataclass
class Pushed:
    """Ranges that filters leave of the columns folder, modified and row0."""

    tests: list[tuple[str, str, object]] = field(default_factory=list)

    OPERATORS = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}

    def take(self, f: Filter) -> bool:
        """Whether the filter can be answered before anything is read."""
        operator = self.OPERATORS.get(type(f))
        if operator is None or f.attribute not in (("folder",), ("modified",), ("row0",)):
            return False
        self.tests.append((f.attribute[0], operator, f.value))
        return True

    def __call__(self, column: str, value: object) -> bool:
        for name, operator, other in self.tests:
            if name != column:
                continue
            others = [_microseconds(x) if column == "modified" else x for x in (other if operator == "in" else [other])]
            ok = {"==": value == others[0], ">": value > others[0], ">=": value >= others[0], "<": value < others[0], "<=": value <= others[0]}[operator] if operator != "in" else value in others
            if not ok:
                return False
        return True


def _microseconds(x: object) -> int:
    if isinstance(x, datetime):
        x = x if x.tzinfo else x.astimezone()
        delta = x - datetime(1970, 1, 1, tzinfo=timezone.utc)
        return (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds
    return int(x)


#: Options that bound what is read: of folders, of times (ISO, with their zone) and of the rows that bands begin with.
RANGES = (("fromFolder", "folder", ">="), ("toFolder", "folder", "<="), ("fromTime", "modified", ">="), ("toTime", "modified", "<="), ("fromRow", "row0", ">="), ("toRow", "row0", "<="))


class _Bands:
    """Planning and reading, shared by batches and streams."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.band_rows = int(options.get("bandrows", 256))
        self.task_bytes = int(options.get("taskbytes", 64 << 20))
        self.headers = options.get("headersonly", "false").lower() == "true"
        self.pushed = Pushed()
        for option, column, operator in RANGES:
            value = options.get(option.lower())
            if value is not None:
                self.pushed.tests.append((column, operator, value if column == "folder" else int(value) if column == "row0" else datetime.fromisoformat(value)))

    def bands(self, files: Sequence[File]) -> list[Band]:
        """Tasks of about ``task_bytes`` of one folder's files and one band. The
        first file of a folder tells how many bands there are; the last band
        takes what other files may have more."""
        out: list[Band] = []
        system, _ = _filesystem(self.path)
        by_folder: dict[str, list[File]] = {}
        for f in files:
            if self.pushed("folder", f.folder) and self.pushed("modified", f.modified):
                by_folder.setdefault(f.folder, []).append(f)
        for own in by_folder.values():
            if self.headers:
                spans, share = [(0, 0)], RAW_HEADER
            else:
                with system.open_input_file(own[0].path) as handle:
                    h = header_of(handle, own[0].name)
                starts = list(range(0, max(h.height, 1), self.band_rows))
                spans = [(a, None if a == starts[-1] else a + self.band_rows) for a in starts if self.pushed("row0", a)]
                share = max(1, min(self.band_rows, h.height) * h.row_bytes)
            n = max(1, self.task_bytes // share)
            out += [Band(tuple(own[k : k + n]), a, b) for a, b in spans for k in range(0, len(own), n)]
        return out

    def rows(self, band: Band | None) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.path)
        for f in band.files if band else ():  # without partitions Spark asks for one all the same
            with system.open_input_file(f.path) as handle:
                if self.headers:
                    h, rows, low, high = header_of(handle, f.name), None, None, None
                else:
                    h, rows, low, high = read_band(handle, f.name, band.start, band.stop)
            head = [pa.array([f.folder]), pa.array([f.name]), pa.array([f.modified], pa.timestamp("us", "UTC")), pa.array([h.date_obs], pa.string()), pa.array([h.gps_lock], pa.bool_()), pa.array([h.height], pa.int32()), pa.array([h.width], pa.int32())]
            names = ["folder", "name", "modified", "date_obs", "gps_lock", "height", "width"]
            if not self.headers:
                kind = pa.list_(pa.int32())
                head += [pa.array([band.start], pa.int32()), pa.array([rows], pa.int32()), pa.array([low], kind), pa.array([high], kind)]
                names += ["row0", "rows", "low", "high"]
            yield pa.RecordBatch.from_arrays([*head, pa.array([h.read], pa.int64())], names=[*names, "bytes"])


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.source = _Bands(options)

    def partitions(self) -> list[Band]:
        return self.source.bands(listing(self.source.path))

    def read(self, partition: Band) -> Iterator[pa.RecordBatch]:
        yield from self.source.rows(partition)


class FilteringReader(FrameReader):
    """Takes filters on folder, modified and row0 from Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.source.pushed.take(f):
                yield f


class FrameStream(DataSourceStreamReader):
    """Offsets are the names of minute folders, which sort by time. A folder is
    taken once its last file is ``settleSeconds`` old or a later folder has
    begun, and at most ``foldersPerBatch`` at a time."""

    def __init__(self, options: dict[str, str]):
        self.source = _Bands(options)
        self.settle = float(options.get("settleseconds", 60))
        self.most = int(options.get("foldersperbatch", 1 << 30))
        self.given = ""

    def initialOffset(self) -> dict:
        return {"folder": ""}

    def latestOffset(self) -> dict:
        last: dict[str, int] = {}
        for f in listing(self.source.path):
            last[f.folder] = max(f.modified, last.get(f.folder, 0))
        folders = sorted(last)
        ready = [k for k, x in enumerate(folders) if k + 1 < len(folders) or time.time() - last[x] / 1e6 >= self.settle]
        new = [folders[k] for k in ready if folders[k] > self.given][: self.most]
        self.given = new[-1] if new else self.given
        return {"folder": self.given}

    def partitions(self, start: dict, end: dict) -> list[Band]:
        self.given = max(self.given, end["folder"])
        return self.source.bands([f for f in listing(self.source.path) if start["folder"] < f.folder <= end["folder"]])

    def read(self, partition: Band) -> Iterator[pa.RecordBatch]:
        yield from self.source.rows(partition)


class FrameBands(DataSource):
    """Options: path; bandRows (rows of a band, 256), taskBytes (64 MB),
    headersOnly (no pixels are read), pushFilters, fromFolder to toRow (see ``RANGES``); for
    streams settleSeconds (60) and foldersPerBatch."""

    @classmethod
    def name(cls) -> str:
        return "frame_bands"

    def schema(self) -> str:
        return HEADERS if self.options.get("headersOnly", "false").lower() == "true" else SCHEMA

    def _options(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema: StructType) -> FrameReader:
        options = self._options()
        return FilteringReader(options) if options.get("pushfilters", "false").lower() == "true" else FrameReader(options)

    def streamReader(self, schema: StructType) -> FrameStream:
        return FrameStream(self._options())


class FrameWriter(DataSourceArrowWriter):
    """Writes (folder, name, date_obs, height, width, low, high), a raw file each.
    A file is written beside its place and then moved there, so a task that is
    repeated, or runs twice, leaves whole files of the same bytes."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import uuid

        system, base = _filesystem(self.path)
        for batch in iterator:
            for r in batch.to_pylist():
                folder = posixpath.join(base, r["folder"])
                system.create_dir(folder, recursive=True)
                part = posixpath.join(folder, f".{r['name']}.{uuid.uuid4().hex}")
                with system.open_output_stream(part) as out:
                    out.write(raw_file(r["date_obs"], r["height"], r["width"], r["low"], r["high"]))
                system.move(part, posixpath.join(folder, r["name"]))
        return WriterCommitMessage()


def raw_file(date_obs: str | None, height: int, width: int, low: Sequence[int], high: Sequence[int]) -> bytes:
    """A raw file of an image in both gains."""
    head = bytearray(RAW_HEADER)
    head[RAW_WIDTH : RAW_WIDTH + 2], head[RAW_HEIGHT : RAW_HEIGHT + 2] = width.to_bytes(2, "big"), height.to_bytes(2, "big")
    head[RAW_BINNING], head[RAW_CONTROL] = 1, RAW_LOCKED
    stamp = (date_obs or "").encode("ascii")[:RAW_TIME_BYTES]
    head[RAW_TIME : RAW_TIME + len(stamp)] = stamp
    rows = np.stack([np.asarray(low).reshape(height, width), np.asarray(high).reshape(height, width)], axis=1)
    return bytes(head) + packed(rows.reshape(-1))


class FrameFiles(DataSource):
    """Sink of raw files; option path."""

    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def writer(self, schema: StructType, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    spark.dataSource.register(FrameBands)
    spark.dataSource.register(FrameFiles)


def frame_bands(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Bands of all frames below a folder (see ``FrameBands``)."""
    register(spark)
    return spark.read.format("frame_bands").options(path=path, **options).load()


def write_frames(frames: DataFrame, path: str) -> None:
    """Write (folder, name, date_obs, height, width, low, high) as raw files."""
    register(frames.sparkSession)
    cast = {"folder": "string", "name": "string", "date_obs": "string", "height": "int", "width": "int", "low": "array<int>", "high": "array<int>"}
    frames.select(*[F.col(c).cast(k).alias(c) for c, k in cast.items()]).write.format("frame_files").option("path", path).mode("append").save()


def frame_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(folder, frames, height, width): how many frames a folder has, and the
    size that the header of its first one gives. Only headers are read."""
    h = frame_bands(spark, path, headersOnly="true")
    first = F.min_by(F.struct("height", "width"), "name")
    return h.groupBy("folder").agg(F.count(F.lit(1)).alias("frames"), first.alias("_s")).select("folder", "frames", F.col("_s.height").alias("height"), F.col("_s.width").alias("width"))
