"""Packing of tokenised documents into sequences by bounded-space best fit.

Texts become ids, end with one end-of-text id and are cut into pieces of at
most a sequence's length, the first of which may be shorter. Pieces then arrive
at packers in a fixed order; a packer keeps a fixed number of open sequences in
a bitset keyed by their free space, puts each piece where it fits best, and
closes the fullest sequence when too many are open.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicurve.llm.byte_bpe import MatrixBPE, TextEncoder
from lumicurve.llm.common import in_batches
from lumicurve.session import materialise

# The pre-token pattern of a byte-level tokenizer file with use_regex.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODERS: dict[str, "FileEncoder"] = {}


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others take code points from 256
    up, in order.
    """
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class FileEncoder:
    """Ids as a byte-level BPE tokenizer file gives them, without added tokens.

    Texts that hold one of the file's added tokens go to the tokenizers library
    itself, which cuts them out as it does by default.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        raw = {t: bytes(alphabet[c] for c in t) for t in vocab if all(c in alphabet for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            raise ValueError("ids must rise with the merges, so that an id is its merge's rank")
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.path = path
        pairs = [(vocab[a], vocab[b], i) for (a, b), i in zip(merges, made, strict=True)]
        self.encoder = TextEncoder(MatrixBPE({raw[t]: i for t, i in vocab.items() if t in raw}, pairs=pairs), BYTE_LEVEL_PATTERN)

    @classmethod
    def of(cls, path: str) -> "FileEncoder":
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        special = np.zeros(len(column), bool)
        for token in self.added:
            special |= np.asarray(pc.fill_null(pc.match_substring(column, token), False))
        if not special.any():
            yield from self.encoder.encode(column)
            return
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        plain = self.encoder.encode(pc.if_else(pa.array(special), "", column))
        for text, ids, odd in zip(column.to_pylist(), plain, special, strict=True):
            yield np.array(library.encode(text, add_special_tokens=False).ids, np.uint32) if odd else ids


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and a number of its
    own (with ids: the ids as little-endian unsigned 32-bit bytes too)."""

    def run(batches):
        encoder = FileEncoder.of(tokenizer_path)
        made = TaskContext.get().partitionId() << 40
        for b in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, ids in enumerate(encoder.encode(b.column(1).cast(pa.string()))):
                raw = np.append(ids, np.uint32(end_id)).astype("<u4")
                n = len(raw)
                edges = [0, *range(n - (n - 1) // capacity * capacity, n + 1, capacity)]
                for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                    row.append(i)
                    piece.append(k)
                    start.append(x)
                    length.append(y - x)
                    own = raw[x:y].tobytes()
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        kept.append(own)
            numbers = range(made, made + len(row))
            made += len(row)
            columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc, numbers))]
            names = [id_col, "piece", "start", "length", "ids_crc32", "_row"]
            if with_ids:
                columns.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, _row long" + ", ids binary" * with_ids
    return in_batches(docs, [id_col, text_col], run, schema)


class BoundedBestFit:
    """Online best fit with at most ``open_bins`` open sequences.

    Bit f of the bitset is set while some open sequence has f free places, so
    the best fit for a piece of s places is the lowest set bit from s up, and
    the fullest open sequence is the lowest set bit of all.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bin_ = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_

    def put(self, size: int) -> tuple[int, int]:
        """The sequence that takes the piece, and the piece's place in it."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, self.made
            self.made += 1
        left = free - size
        if left:
            self.by_free[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return bin_, self.capacity - free


def pack_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, open_bins: int = 1024, lot: int = 1024, pieces_per_packer: int = 200_000, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset in it.

    A null text is empty and gives one piece, the end id alone. Ids may be null
    or repeat: each row is packed on its own. An empty table gives an empty
    result; other columns are not read.

    The pieces (numbers only) are written to the shared folder, dealt by the
    hash of piece and row to one packer per ``pieces_per_packer``, and packed in
    the order of that hash. With a ``lot`` of 1 that is online best fit; with
    more, each ``lot`` of pieces is taken longest first, a look-ahead beside the
    method that fills sequences better. ``open_bins`` bounds a packer's memory. Sequences
    are filled from offset 0 without gaps. ``with_ids`` adds the ids (bytes of
    little-endian unsigned 32-bit numbers); they never go to the few packers,
    their places are joined to them.
    """
    pieces = materialise(cut_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces", wide_cells=with_ids)
    packers = max(1, -(-pieces.count() // pieces_per_packer))
    order = F.xxhash64(F.col(f"`{id_col}`"), "piece", "ids_crc32", "_row")
    light = pieces.drop("ids")
    dealt = light.withColumn("_order", order).repartition(packers, "_order").sortWithinPartitions("_order", "_row").drop("_order")

    def run(batches):
        fit = BoundedBestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40

        def place(table: pa.Table) -> pa.Table:
            sizes = table.column("length").to_numpy()
            bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            for i in np.argsort(-sizes, kind="stable").tolist():
                bins[i], offsets[i] = fit.put(int(sizes[i]))
            return table.append_column("sequence_id", pa.array(base + bins)).append_column("offset", pa.array(offsets))

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            table = pa.Table.from_batches(held)
            whole = len(table) // lot * lot
            for a in range(0, whole, lot):
                yield from place(table.slice(a, lot).combine_chunks()).to_batches()
            held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield from place(pa.Table.from_batches(held).combine_chunks()).to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in light.schema.fields)
    placed = dealt.mapInArrow(run, f"{fields}, sequence_id long, offset long")
    if not with_ids:
        return placed.drop("_row")
    placed = materialise(placed.select("_row", "sequence_id", "offset"), "places")
    return pieces.join(placed, "_row").drop("_row")
