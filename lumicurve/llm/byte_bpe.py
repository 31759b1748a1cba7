"""Byte-level BPE over padded matrices of token ids.

Pre-tokens are bucketed by length and laid out as rows of a padded matrix. In
each round every row merges its leftmost pair of minimum rank: pair ranks come
from an open-addressing hash table probed for whole arrays at once, the merged
cell takes the new id, the rest of the row moves up one place, and rows that
have no pair left are compacted away.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumicurve.llm.chunk_table import ChunkTable
from lumicurve.llm.common import in_batches, text_bytes

NONE = np.int32(2**31 - 1)
_NOTHING = np.empty(0, np.uint32)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Ranks of token pairs in an open-addressing hash table of numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        size = 1 << self.bits
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.full(size, NONE, np.int32)
        self.probes = 1
        slot = self._home(keys)
        todo = np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = self.ranks[at] == NONE
            # Of the keys that want one free slot, the last one written has it.
            self.keys[at[free]], self.ranks[at[free]] = keys[todo[free]], rank[todo[free]]
            lost = self.keys[at] != keys[todo]
            todo = todo[lost]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
            self.probes += bool(len(todo))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MULTIPLIER) >> np.uint64(64 - self.bits)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE for a pair that never merges or with a pad (-1)."""
        keys = (left.astype(np.uint32).astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32).astype(np.uint64)
        slot = self._home(keys)
        found = np.where(self.keys[slot] == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.ranks[slot] != NONE))
        flat_slot, flat_keys = slot.reshape(-1), keys.reshape(-1)
        flat, todo = found.reshape(-1), open_
        for _ in range(self.probes):
            if not len(todo):
                break
            at = (flat_slot[todo] + np.uint64(1)) & self.mask
            flat_slot[todo] = at
            hit = self.keys[at] == flat_keys[todo]
            flat[todo[hit]] = self.ranks[at[hit]]
            todo = todo[~hit & (self.ranks[at] != NONE)]
        return found


class MatrixBPE:
    """Ids of byte strings under a table of ranks (token bytes to id).

    Rows of over ``widest`` bytes are not moved up as a whole in each round: they
    are folded into blocks with the least rank of each block beside them, and
    places point to their neighbours, so that a round touches a few blocks.
    """

    def __init__(self, ranks: dict[bytes, int], widest: int = 4096, cells: int = 1 << 20, pairs: list[tuple[int, int, int]] | None = None):
        """``pairs``: (left, right, id) of the merges; without, every pair whose
        bytes together are a token merges into it."""
        self.widest, self.cells = widest, cells
        self.token = {i: t for t, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        splits = pairs or [(a, b, i) for t, i in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None]
        left, right, rank = np.array(splits, np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, rank.astype(np.int32))

    @classmethod
    def from_file(cls, path: str) -> "MatrixBPE":
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(i) for t, i in map(bytes.split, f)})

    def encode_many(self, items: list[bytes]) -> list[np.ndarray]:
        """Ids of each item (uint32), as merging its pairs lowest rank and leftmost first gives."""
        out: list[np.ndarray] = [_NOTHING] * len(items)
        lengths = np.fromiter(map(len, items), np.int64, len(items))
        order = np.argsort(lengths, kind="stable")
        width, start = 2, int(np.searchsorted(lengths[order], 1))
        while start < len(items):
            width = max(width, 1 << int(lengths[order[start]] - 1).bit_length())
            if width > self.widest:
                for i in order[start:]:
                    out[i] = self._merge_folded(items[i])
                break
            end = int(np.searchsorted(lengths[order], width, "right"))
            step = max(1, self.cells // width)
            for a in range(start, end, step):
                rows = order[a : min(end, a + step)]
                for i, ids in zip(rows, self._merge([items[i] for i in rows], lengths[rows]), strict=True):
                    out[i] = ids
            start, width = end, width * 2
        return out

    def _merge(self, items: list[bytes], lengths: np.ndarray) -> list[np.ndarray]:
        n, width = len(items), int(lengths.max())
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(items), np.uint8)]
        ranks = self.pairs.lookup(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((n, 1), NONE, np.int32)
        row, length = np.arange(n), lengths.copy()
        done: list[np.ndarray] = [_NOTHING] * n
        while True:
            best = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(ranks)), best]
            ended = rank == NONE
            if ended.any():
                over = ids[ended].astype(np.uint32)
                for k, (r, size) in enumerate(zip(row[ended].tolist(), length[ended].tolist(), strict=True)):
                    done[r] = over[k, :size]
                live = ~ended
                ids, ranks, row, length, best, rank = ids[live], ranks[live], row[live], length[live], best[live], rank[live]
                if not len(row):
                    return done
                most = int(length.max())
                ids, ranks = ids[:, :most], ranks[:, : most - 1]
            at = np.arange(len(row))
            behind = np.arange(ids.shape[1]) > best[:, None]
            moved = np.full_like(ids, -1)
            moved[:, :-1] = ids[:, 1:]
            ids = np.where(behind, moved, ids)
            ids[at, best] = rank
            length -= 1
            moved_ranks = np.full_like(ranks, NONE)
            moved_ranks[:, :-1] = ranks[:, 1:]
            ranks = np.where(behind[:, : ranks.shape[1]], moved_ranks, ranks)
            ahead = np.where(best + 1 < ids.shape[1], ids[at, np.minimum(best + 1, ids.shape[1] - 1)], -1)
            ranks[at, best] = self.pairs.lookup(rank, ahead)
            before = np.flatnonzero(best > 0)
            ranks[before, best[before] - 1] = self.pairs.lookup(ids[before, best[before] - 1], rank[before])

    def _merge_folded(self, item: bytes) -> np.ndarray:
        """Ids of one long row, folded into a matrix of blocks. Each round takes
        the leftmost pair of minimum rank; when half of the places are merged
        away, the row is compacted and folded anew."""
        ids = self.byte_ids[np.frombuffer(item, np.uint8)]
        pair = np.empty((2, 2), np.int32)
        while True:
            n = len(ids)
            width = max(8, int(n**0.5))
            ranks = np.full((-(-n // width), width), NONE, np.int32)
            flat = ranks.reshape(-1)
            flat[: n - 1] = self.pairs.lookup(ids[:-1], ids[1:])
            least = ranks.min(axis=1)
            after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
            alive = np.ones(n, bool)
            for left in range(n - 1, max(n // 2, 1) - 1, -1):
                block = int(least.argmin())
                rank = int(least[block])
                if rank == NONE:
                    return ids[alive].astype(np.uint32)
                i = block * width + int(ranks[block].argmin())
                j = int(after[i])
                k, h = int(after[j]), int(before[i])
                ids[i], alive[j], flat[j] = rank, False, NONE
                after[i] = k
                if k < n:
                    before[k] = i
                pair[:] = -1
                pair[0] = rank, ids[k] if k < n else -1
                if h >= 0:
                    pair[1] = ids[h], rank
                found = self.pairs.lookup(pair[:, 0], pair[:, 1])
                flat[i] = found[0]
                if h >= 0:
                    flat[h] = found[1]
                for x in {i // width, j // width, max(h, 0) // width}:
                    least[x] = ranks[x].min()
            ids = ids[alive]
            if len(ids) < 2:
                return ids.astype(np.uint32)

    def decode(self, ids: list[int]) -> bytes:
        """Bytes that the ids stand for."""
        return b"".join(map(self.token.__getitem__, ids))


class TextEncoder:
    """Texts to ids: chunks to pre-tokens by the pattern, these by the matrices."""

    loaded: dict[tuple[str, str], "TextEncoder"] = {}

    def __init__(self, bpe: MatrixBPE, pattern: str):
        self.bpe = bpe
        self.table = ChunkTable(pattern, lambda words: bpe.encode_many([w.encode() for w in words]))

    @classmethod
    def of(cls, ranks_path: str, pattern: str) -> "TextEncoder":
        if (ranks_path, pattern) not in cls.loaded:
            cls.loaded[ranks_path, pattern] = cls(MatrixBPE.from_file(ranks_path), pattern)
        return cls.loaded[ranks_path, pattern]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string column, in order."""
        for ids, starts in self.table.ids(*text_bytes(column)):
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                yield ids[a:b]


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every text and decode its ids: n_tokens, ids_sha256, decoded_sha256.

    ids_sha256 is the hex digest of the decimal ids joined by one space,
    decoded_sha256 that of the decoded bytes. With ``with_ids`` the ids come
    too, as array<int>. A null text is empty: 0 tokens and the digests of
    nothing. Each row gets a result, also where ids repeat or are null; an
    empty table gives an empty result; other columns are not read.
    """

    def run(batches):
        encoder = TextEncoder.of(ranks_path, pattern)
        text_of_id = {i: str(i) for i in encoder.bpe.token}
        for b in batches:
            tokens, ids_hex, back_hex, all_ids = [], [], [], []
            for ids in map(np.ndarray.tolist, encoder.encode(b.column(1))):
                tokens.append(len(ids))
                ids_hex.append(hashlib.sha256(" ".join(map(text_of_id.__getitem__, ids)).encode()).hexdigest())
                back_hex.append(hashlib.sha256(encoder.bpe.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            columns = [b.column(0), pa.array(tokens, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(back_hex, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs, [id_col, text_col], run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
