"""Token ids of whole Arrow batches through a table of hashed chunks.

A text is cut at places where a GPT-2 style pre-token pattern always cuts, so
that ids of a chunk depend on the chunk alone. Chunks are hashed and looked up
for a whole batch at once; only chunks the table lacks are pre-tokenised and
encoded one by one. The table is bounded and holds about 30 bytes a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import regex

from lumicurve.llm.common import SegmentHash, spans_of

# The code points that a tokenizer's \s stands for (White_Space).
SPACE_CLASS = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Bytes that are white space or may begin a white-space code point.
_SPACEY = np.zeros(256, bool)
_SPACEY[[*range(9, 14), 32, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII bytes that are no white space.
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(33, 127)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord(",")]] = True


def compile_pattern(pattern: str) -> regex.Pattern:
    """A pre-token pattern with white space as the tokenizers' own engine has it."""
    return regex.compile(pattern.replace(r"(?!\S)", f"(?![^{SPACE_CLASS}])").replace(r"[^\s", f"[^{SPACE_CLASS}").replace(r"\s", f"[{SPACE_CLASS}]"))


def chunk_starts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks begin: at each text, before a space that a non-space
    follows, around a line end that stands between ASCII characters, and
    between an ASCII letter and a full stop or comma."""
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        space, line = raw == 32, raw == 10
        cut[: n - 1] |= space[:-1] & ~_SPACEY[raw[1:]]
        cut[1:n] |= _STOP[raw[1:]] & _LETTER[raw[:-1]]
        if n > 2:
            alone = line[1:-1] & _PLAIN[raw[:-2]] & _PLAIN[raw[2:]]
            cut[1 : n - 1] |= alone
            cut[2:n] |= alone
    last = starts[1:][starts[1:] > starts[:-1]] - 1
    # A text's last byte has nothing behind it in its own text: neither a
    # trailing space nor a trailing line end begins a chunk there.
    cut[last] &= ~np.isin(raw[last], [32, 10]) if len(last) else False
    cut[starts] = True
    return np.flatnonzero(cut[:n])


class ChunkTable:
    """Ids of texts; ``encode_many`` gives ids (numpy uint32) of pre-tokens.

    At ``most`` chunks the table is emptied. Chunks over ``longest`` bytes are
    encoded each time and never kept.
    """

    def __init__(self, pattern: str, encode_many: Callable[[list[str]], list[np.ndarray]], most: int = 1_500_000, longest: int = 48, block: int = 1 << 20):
        self.find, self.encode_many = compile_pattern(pattern).findall, encode_many
        self.most, self.longest, self.block = most, longest, block
        self.hash = SegmentHash()
        self._empty(1 << 16)

    def _empty(self, slots: int) -> None:
        self.slots, self.shift = slots, np.uint64(64 - slots.bit_length() + 1)
        self.keys, self.index = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self.n, self.used = 0, 0
        self.start, self.pool = np.zeros(1 << 16, np.int64), np.empty(1 << 18, np.uint32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 where the table lacks it."""
        slot = (keys >> self.shift).astype(np.int64)
        entry = self.index[slot]
        out = np.where(self.keys[slot] == keys, entry, -1)
        todo = np.flatnonzero((out < 0) & (entry >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (self.slots - 1)
            entry = self.index[slot]
            hit = (entry >= 0) & (self.keys[slot] == keys[todo])
            out[todo[hit]] = entry[hit]
            more = (entry >= 0) & ~hit
            todo, slot = todo[more], slot[more]
        return out

    def _place(self, keys: np.ndarray, entries: np.ndarray) -> None:
        slot = (keys >> self.shift).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = self.index[at] < 0
            self.index[at[free]], self.keys[at[free]] = entries[todo[free]], keys[todo[free]]
            todo = todo[self.keys[at] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & (self.slots - 1)

    def _add(self, keys: np.ndarray, ids: list[np.ndarray]) -> None:
        if (self.n + len(keys)) * 2 > self.slots:
            held, entry = self.keys[self.index >= 0], self.index[self.index >= 0]
            self.slots = 1 << int((self.n + len(keys)) * 2 - 1).bit_length()
            self.shift = np.uint64(64 - self.slots.bit_length() + 1)
            self.keys, self.index = np.zeros(self.slots, np.uint64), np.full(self.slots, -1, np.int32)
            self._place(held, entry)
        flat, sizes = np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))
        while self.n + len(keys) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.start[self.n + 1 : self.n + 1 + len(keys)] = self.used + np.cumsum(sizes)
        self._place(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n, self.used = self.n + len(keys), self.used + len(flat)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of chunks, through the distinct pre-tokens of them all."""
        cut = [(t,) if t.isalpha() or (t[0] == " " and t[1:].isalpha()) else self.find(t) for t in texts]
        distinct = list(set().union(*cut))
        ids = dict(zip(distinct, self.encode_many(distinct), strict=True))
        return [ids[c[0]] if len(c) == 1 else np.concatenate([ids[w] for w in c]) for c in cut]

    def ids(self, raw: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For ranges of texts in order: their ids in a row, and each text's start in them."""
        for a, b in spans_of(starts, self.block):
            yield self._block(raw[starts[a] : starts[b]], starts[a : b + 1] - starts[a])

    def _block(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.empty(0, np.uint32), np.zeros(len(starts), np.int64)
        begin = chunk_starts(raw, starts)
        end = np.append(begin[1:], len(raw))
        keys = self.hash(raw, begin, end)
        keys[keys == 0] = 1
        if self.n > self.most:
            self._empty(1 << 16)
        entry = self._find(keys)
        missing = np.flatnonzero(entry < 0)
        long = missing[(end - begin)[missing] > self.longest]
        missing = missing[(end - begin)[missing] <= self.longest]
        data = raw.tobytes()
        if len(missing):
            fresh, first = np.unique(keys[missing], return_index=True)
            at = missing[first]
            self._add(fresh, self._encode([data[x:y].decode() for x, y in zip(begin[at].tolist(), end[at].tolist(), strict=True)]))
            entry[missing] = self._find(keys[missing])
        if len(long):
            own = self._encode([data[x:y].decode() for x, y in zip(begin[long].tolist(), end[long].tolist(), strict=True)])
        at = np.where(entry >= 0, self.start[entry], 0)
        size = np.where(entry >= 0, self.start[entry + 1] - at, 0)
        if len(long):
            size[long] = [len(x) for x in own]
        ends = np.cumsum(size)
        into = ends - size
        out = self.pool[np.repeat(at - into, size) + np.arange(ends[-1])] if not len(long) else self._gather(at, size, into, long, own)
        return out, np.append(into, ends[-1])[np.searchsorted(begin, starts)]

    def _gather(self, at, size, into, long, own) -> np.ndarray:
        # Long chunks read anything first and are then written over.
        at = at.copy()
        at[long] = 0
        where = np.repeat(at - into, size) + np.arange(int(size.sum()))
        out = self.pool[np.minimum(where, len(self.pool) - 1)]
        for k, ids in zip(long.tolist(), own, strict=True):
            out[into[k] : into[k] + len(ids)] = ids
        return out
