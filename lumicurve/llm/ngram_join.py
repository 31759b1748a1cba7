"""Exact Jaccard join of documents on word n-grams, with set relations skipped.

1. One pass hashes each text to its set of n-gram hashes and deals them, packed
   four bytes each, to buckets where those in several documents are found; they
   fill a sketch of bounded size that orders n-grams from rare to frequent, and
   first of all those that one document holds alone. (Any order gives the same
   links; a good one gives few candidates.)
2. A second pass gives each set's size and fingerprint (documents of one
   fingerprint are one class) and the first n-grams of it in that order, as many
   as two linked sets must share one of, but for those that no other set holds.
   Only sets that are left with some are kept. Each document of an n-gram's list
   is tied to the list's least one, its head: partial minima and an equi-join,
   so a long list is never gathered, and its ties are linear in it.
3. Sets tied to one head are compared by all their elements in a kernel. A
   group is cut into chunks, each of which also gets a few pivots, members that
   are the same for all of its chunks, so that what is alike is linked at a cost
   linear in the group. Members that this leaves outside the group's largest
   component are then compared with all the others, chunk by chunk. The
   kernel keeps lists sorted by the places left behind a position and skips the
   blocks whose bound is too low, passes over sets that are joined already, and
   derives the overlaps of a set from those of a highly similar set by the
   elements in which the two differ. It gives a spanning forest of the links.
4. Components of the links are found with star steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicurve.llm.common import in_batches, mix64, spans_of, text_bytes, window_hashes, word_hashes, words_of
from lumicurve.llm.components import connected_components
from lumicurve.session import drop_materialised, materialise

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Most slots of the frequency sketch (a byte each), which is sent to every
#: executor, with as many bytes of bits for repeats that find no slot.
SKETCH_SLOTS = 1 << 26


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text, A-Z lower-cased. A text
    with fewer words has its whole sequence as its only n-gram; one without
    words or text has none."""
    raw, starts = text_bytes(column)
    raw = _LOWER[raw]
    for a, b in spans_of(starts, 1 << 20):
        part, at = raw[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
        begin, end, first = words_of(part, at)
        words = word_hashes(part, begin, end)
        for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if y == x:
                yield np.empty(0, np.uint64)
            else:
                yield np.unique(window_hashes(words[x:y], min(n, y - x)))


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set, as signed integers."""
    one = int(s.sum(dtype=np.uint64)) if len(s) else 0
    two = int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(s) else 0
    return one - (1 << 64) * (one >> 63), two - (1 << 64) * (two >> 63)


def bucket_bits(docs: DataFrame) -> int:
    """Bits of a hash that choose its bucket: a bucket for each MB of input."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(20, max(4, (size >> 20).bit_length()))


def dealt_ngrams(docs: DataFrame, n: int, bits: int, text_col: str) -> DataFrame:
    """Rows of a bucket each with, for some of a task's documents, the n-grams
    of that bucket: the 32 bits behind the bucket's own of those in one document,
    and of those in several with their numbers. Texts with equal sets count once
    in such a lot of documents."""

    def run(batches):
        lot: dict[tuple[int, int], np.ndarray] = {}
        held = 0

        def emit():
            tokens, counts = np.unique(np.concatenate([*lot.values(), np.empty(0, np.uint64)]), return_counts=True)
            edges = np.searchsorted(tokens >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            short = ((tokens << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
            times = np.minimum(counts, 65535).astype("<u2")
            rows = [(k, short[x:y], times[x:y]) for k, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if y > x]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([r[1][r[2] == 1].tobytes() for r in rows], pa.binary()),
                    pa.array([r[1][r[2] > 1].tobytes() for r in rows], pa.binary()),
                    pa.array([r[2][r[2] > 1].tobytes() for r in rows], pa.binary()),
                ],
                names=["bucket", "once", "more", "times"],
            )

        for b in batches:
            for s in shingle_sets(b.column(0), n):
                p = fingerprint(s)
                if len(s) and p not in lot:
                    lot[p] = s
                    held += len(s)
                    if held > 1 << 20:
                        yield emit()
                        lot.clear()
                        held = 0
        if lot:
            yield emit()

    return in_batches(docs, [text_col], run, "bucket int, once binary, more binary, times binary")


def _repeated(table: pa.Table) -> pa.Table:
    """The n-grams of one bucket that several documents hold, each with its
    level (eighths of doublings of their number), and how many have each level."""
    once, more, times = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("once", "<u4"), ("more", "<u4"), ("times", "<u2")))
    tokens, at = np.unique(np.concatenate([once, more]), return_inverse=True)
    number = np.bincount(at, np.concatenate([np.ones(len(once)), times]), len(tokens))
    keep = number > 1
    level = np.minimum(255, np.floor(np.log2(number[keep]) * 8)).astype(np.uint8)
    return pa.table({"bucket": table.column("bucket").slice(0, 1), "tokens": pa.array([tokens[keep].astype("<u4").tobytes()], pa.binary()), "levels": pa.array([level.tobytes()], pa.binary())})


def slot_of(bucket: np.ndarray | int, short: np.ndarray, slots: int) -> np.ndarray:
    """Slots of n-grams by their bucket and the 32 bits behind it."""
    return ((np.uint64(bucket) << np.uint64(32) | short.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - slots.bit_length() + 1)


@dataclass
class Sketch:
    """How frequent n-grams are, a byte for each slot of their hashes.

    Level 0 is least frequent: an n-gram of it is in one document (or its exact
    copies) alone. Where the repeated ones are more than there is room for, the
    least frequent have no level of their own but a bit each, chosen by the first
    bits of their hashes, and come between those and the others. An n-gram that
    only seems to be repeated costs candidates but no links.
    """

    levels: np.ndarray
    bits: int
    repeated: np.ndarray | None = None

    def of(self, s: np.ndarray) -> np.ndarray:
        levels = self.levels[slot_of_hash(s, self.bits, len(self.levels))]
        if self.repeated is None:
            return levels
        at = s >> np.uint64(64 - 3 - (len(self.repeated).bit_length() - 1))
        return np.maximum(levels, (self.repeated[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1))


def slot_of_hash(s: np.ndarray, bits: int, slots: int) -> np.ndarray:
    return ((s >> np.uint64(32 - bits)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - slots.bit_length() + 1)


def frequency_sketch(dealt: DataFrame, bits: int, most_slots: int = SKETCH_SLOTS) -> Sketch:
    """The sketch of all rows of ``dealt_ngrams``. What reaches the driver is at
    most a quarter of ``most_slots`` n-grams, the most frequent ones, and as
    many bytes as ``most_slots`` of bits for the others."""
    spark = dealt.sparkSession
    found = materialise(dealt.groupBy("bucket").applyInArrow(_repeated, "bucket int, tokens binary, levels binary"), "repeated", wide_cells=True)

    def count(batches):
        total = np.zeros(256, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(x, np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total)], names=["level", "n"])

    by_level = np.zeros(256, np.int64)
    for r in found.select("levels").mapInArrow(count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        by_level[r["level"]] = r["n"]
    from_top = np.cumsum(by_level[::-1])[::-1]
    least = int(np.argmax(from_top <= most_slots // 4))
    slots = min(most_slots, 1 << max(10, int(4 * from_top[least]).bit_length()))
    own = max(3, most_slots.bit_length() + 2 - bits)  # bits of a hash behind the bucket's that choose its bit

    def cut(batches):
        for b in batches:
            out = []
            for bucket, t, v in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                level = np.frombuffer(v, np.uint8)
                at = slot_of(bucket, np.frombuffer(t, "<u4")[level >= least], slots).astype("<u4")
                out.append((at.tobytes(), level[level >= least].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["slots", "levels"])

    def mark(batches):
        for b in batches:
            out = []
            for t, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                mask = np.zeros(1 << own, bool)
                mask[np.frombuffer(t, "<u4")[np.frombuffer(v, np.uint8) < least] >> np.uint32(32 - own)] = True
                out.append(np.packbits(mask, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["bucket", "bits"])

    kept = found.mapInArrow(cut, "slots binary, levels binary").toArrow()
    levels = np.zeros(slots, np.uint8)
    for b in kept.to_batches():
        for at, level in zip(b.column(0), b.column(1), strict=True):
            np.maximum.at(levels, np.frombuffer(at.as_buffer(), "<u4"), np.frombuffer(level.as_buffer(), np.uint8))
    del kept
    repeated = None
    if by_level[:least].sum():
        repeated = np.zeros((1 << bits, 1 << own - 3), np.uint8)
        for b in found.mapInArrow(mark, "bucket int, bits binary").toArrow().to_batches():
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                repeated[k] = np.frombuffer(x.as_buffer(), np.uint8)
        repeated = repeated.ravel()
    drop_materialised(spark, found)
    return Sketch(levels, bits, repeated)


def prefix_length(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    """How many first elements hold one that a linked set shares."""
    return size - (percent * size + 99) // 100 + 1


def describe(docs: DataFrame, n: int, percent: int, sketch, id_col: str, text_col: str) -> DataFrame:
    """(id, size, f1, f2, prefix, elements) of each row: the prefix has the first
    elements of its set from rare to frequent, without those that no other set
    holds. Where any are left the elements follow, as bytes of sorted hashes;
    other sets have null for both."""

    def run(batches):
        order = sketch.value
        for b in batches:
            size, f1, f2, first, elements = [], [], [], [], []
            for s in shingle_sets(b.column(1), n):
                p = fingerprint(s)
                size.append(len(s))
                f1.append(p[0])
                f2.append(p[1])
                level = order.of(s)
                by = np.lexsort((s, level))[: prefix_length(len(s), percent)] if len(s) else np.empty(0, np.int64)
                left = s[by[level[by] > 0]]
                first.append(left.view(np.int64) if len(left) else None)
                elements.append(s.tobytes() if len(left) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (size, f1, f2)), pa.array(first, pa.list_(pa.int64())), pa.array(elements, pa.binary())], names=["id", "size", "f1", "f2", "prefix", "elements"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs, [id_col, text_col], run, f"id {kind}, size long, f1 long, f2 long, prefix array<long>, elements binary")


class SetLinker:
    """Links among some sets: a spanning forest of the pairs (i, j) with
    100 * common >= percent * union."""

    def __init__(self, sets: list[np.ndarray], percent: int, joined: np.ndarray | None = None):
        """``joined``: a number for each set; sets of one number are joined already."""
        self.percent = percent
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate([*sets, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets)), self.size)
        _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
        # Each set from its locally rarest element on; position counts all of its elements.
        order = np.lexsort((token, count[token], owner))
        start = np.cumsum(self.size) - self.size
        position = np.arange(len(flat)) - start[owner]
        token = token[order]
        keep = count[token] > 1
        self.token, self.position, owner = token[keep], position[keep], owner[keep]
        self.start = np.searchsorted(owner, np.arange(len(sets) + 1))
        # All lists, by token.
        by = np.argsort(self.token, kind="stable")
        self.list_owner = owner[by]
        self.list_start = np.searchsorted(self.token[by], np.arange(len(count) + 1))
        # Lists of prefix elements, by token and then by the places left, most first.
        first = np.flatnonzero(self.position < prefix_length(self.size[owner], percent))
        left = self.size[owner[first]] - self.position[first]
        self.span = int(self.size.max(initial=0)) + 1
        key = self.token[first] * self.span + (self.span - 1 - left)
        by = np.argsort(key, kind="stable")
        self.block_key, self.block_owner = key[by], owner[first][by]
        self.parent = np.arange(len(sets))
        if joined is not None:
            _, first, at = np.unique(joined, return_index=True, return_inverse=True)
            self.parent = first[at]
        self.known: dict[int, np.ndarray] = {}

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def candidates(self, i: int) -> np.ndarray:
        """Owners in the lists of i's prefix elements; blocks of a list with too
        few places left for a set linked to i are skipped."""
        a, b = self.start[i], self.start[i + 1]
        n = int(self.size[i])
        own = self.token[a:b][self.position[a:b] < prefix_length(n, self.percent)]
        least = -(-self.percent * n // 100)
        low = np.searchsorted(self.block_key, own * self.span)
        high = np.searchsorted(self.block_key, own * self.span + (self.span - 1 - least), "right")
        if not len(own) or not (high > low).any():
            return np.empty(0, np.int64)
        return np.unique(np.concatenate([self.block_owner[x:y] for x, y in zip(low, high, strict=True)]))

    def possible(self, i: int, near: np.ndarray) -> np.ndarray:
        """The candidates that have enough elements in several sets to link with
        i: what a set alone holds is common with none."""
        shared = self.start[1:] - self.start[:-1]
        most = np.minimum(shared[i], shared[near])
        return near[100 * most >= self.percent * (self.size[i] + self.size[near] - most)]

    def _postings(self, tokens: np.ndarray) -> np.ndarray:
        low, size = self.list_start[tokens], self.list_start[tokens + 1] - self.list_start[tokens]
        ends = np.cumsum(size)
        at = np.repeat(low - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.list_owner[at], minlength=len(self.size))

    def overlaps(self, i: int) -> np.ndarray:
        """Common elements of i with every set, from a known similar set's if one
        of its component differs in less than it holds."""
        own = self.token[self.start[i] : self.start[i + 1]]
        base = self.known.get(self.root(i))
        if base is not None:
            like = self.token[self.start[base[0]] : self.start[base[0] + 1]]
            more, less = np.setdiff1d(own, like, True), np.setdiff1d(like, own, True)
            if len(more) + len(less) < len(own):
                return base[1] + self._postings(more) - self._postings(less)
        return self._postings(own)

    def links(self) -> list[tuple[int, int]]:
        out = []
        for i in np.argsort(self.size, kind="stable").tolist():
            near = self.possible(i, self.candidates(i))
            root = self.root(i)
            near = near[[self.root(j) != root for j in near.tolist()]] if len(near) else near
            if not len(near):
                continue
            common = self.overlaps(i)
            self.known[root] = (i, common)
            union = self.size[i] + self.size[near] - common[near]
            for j in near[100 * common[near] >= self.percent * union].tolist():
                a, b = self.root(i), self.root(j)
                if a != b:
                    out.append((i, j))
                    self.parent[b] = a
                    self.known.pop(b, None)
            self.known[self.root(i)] = (i, common)
        return out


def _compare(percent: int):
    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").combine_chunks()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("elements").to_pylist()]
        links = SetLinker(sets, percent, table.column("joined").to_numpy()).links()
        pick = lambda k: nodes.take(pa.array([x[k] for x in links], pa.int64()))
        return pa.table({"a": pick(0), "b": pick(1)})

    return run


#: Sets to a chunk of the first pass, and how many of a group are its pivots (about).
CHUNK, PIVOTS = 64, 12


def first_links(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links inside chunks of each group (head, m, node), pivots in all of its chunks."""
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    pivot = F.pmod(F.xxhash64("head", "node"), F.col("m")) < PIVOTS
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    at = F.when(pivot & (chunks > 1), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(own))
    dealt = groups.where("m > 1").select("head", "node", at.alias("at")).join(sets, "node").select("head", F.explode("at").alias("i"), "node", "elements", F.col("node").alias("joined"))
    return dealt.groupBy("head", "i").applyInArrow(_compare(percent), "a long, b long")


def outsiders(groups: DataFrame, component: DataFrame) -> DataFrame:
    """(head, node, joined, own, other): the members of groups of several chunks
    with several components. ``own`` is a member's chunk, ``other`` the chunks
    it must still be compared with: pairs of a chunk outside the group's largest
    component with any chunk."""
    wide = groups.where(F.col("m") > CHUNK).select("head", "node")
    held = materialise(wide.join(component, "node", "left").select("head", "node", F.coalesce("component", "node").alias("joined")), "wide")
    of = held.groupBy("head", "joined").agg(F.count(F.lit(1)).alias("n"))
    main = of.groupBy("head").agg(F.max(F.struct("n", "joined")).alias("main"), F.sum("n").alias("m"))
    main = main.select("head", F.col("main.joined").alias("main"), F.col("main.n").alias("inside"), (F.col("m") - F.col("main.n")).alias("outside")).where("outside > 0")
    size = F.least(F.greatest(F.lit(64), F.ceil((F.col("inside") + F.col("outside")) / 40)), F.lit(2048))
    parts = main.select("head", "main", F.ceil(F.col("outside") / size).cast("int").alias("co"), F.ceil(F.col("inside") / size).cast("int").alias("ci"))
    dealt = held.join(parts, "head").withColumn("out", F.col("joined") != F.col("main"))
    own = F.when(F.col("out"), F.pmod(F.xxhash64("node"), F.col("co"))).otherwise(F.col("co") + F.pmod(F.xxhash64("node"), F.col("ci"))).cast("int")
    other = F.when(F.col("out"), F.sequence(F.lit(0), F.col("co") + F.col("ci") - 1)).otherwise(F.sequence(F.lit(0), F.col("co") - 1))
    return dealt.select("head", "node", "joined", own.alias("own"), other.alias("other"))


def cross_links(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of what ``outsiders`` deals out."""
    dealt = dealt.join(sets, "node").withColumn("other", F.explode("other"))
    dealt = dealt.select("head", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "elements", "joined")
    return dealt.groupBy("head", "i", "j").applyInArrow(_compare(percent), "a long, b long")


def ties_of_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): ties between the sets of each id that has several."""
    rows = rows.where("size > 0 AND id IS NOT NULL")
    mark = F.xxhash64("f1", "f2", "size")
    several = materialise(rows.groupBy("id").agg(F.min(mark).alias("x"), F.max(mark).alias("y")).where("x <> y").select("id"), "several")
    sets = rows.join(several, "id").join(classes, ["f1", "f2", "size"]).select("id", "node").distinct()
    return sets.join(sets.groupBy("id").agg(F.min("node").alias("b")), "id").select(F.col("node").alias("a"), "b")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``.

    Two documents link when 100 * |common n-grams| >= percent * |all n-grams|;
    the component is the least id reachable by links, the row's own included. A
    null or empty text has no n-grams and links with nothing, not even with
    another of its kind. Rows of one id are one document: with different texts
    it has the links of them all. Rows without an id link like others, but their
    component has the least id of those that have one, or is null. An empty
    table gives an empty result; other columns are not read. Sets are compared
    by 64-bit hashes of their elements.
    """
    spark = docs.sparkSession
    bits = bucket_bits(docs)
    sketch = spark.sparkContext.broadcast(frequency_sketch(dealt_ngrams(docs, n, bits, text_col), bits))
    # Rows are numbered, and the numbers written, so that they cannot change.
    described = describe(docs, n, percent, sketch, id_col, text_col).withColumn("node", F.monotonically_increasing_id())
    described = materialise(described, "described", wide_cells=True)
    sketch.destroy()
    rows = described.select("id", "size", "f1", "f2")
    # A class is a set, however many rows have it; its node is one of them.
    key = ["f1", "f2", "size"]
    classes = materialise(described.where("size > 0").groupBy(*key).agg(F.min("id").alias("rep"), F.min("node").alias("node")), "classes")

    firsts = described.where("prefix IS NOT NULL").select("node", "prefix").join(classes.select("node"), "node", "left_semi")
    firsts = materialise(firsts, "prefixes")
    tokens = firsts.select(F.explode("prefix").alias("token"), "node")
    heads = tokens.groupBy("token").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = materialise(tokens.join(heads.select("token", "head"), "token").select("head", "node").distinct(), "groups")
    groups = materialise(groups.join(groups.groupBy("head").agg(F.count(F.lit(1)).alias("m")), "head"), "groups")
    sets = described.where("elements IS NOT NULL").select("node", "elements")

    links = materialise(first_links(groups, sets, percent), "links")
    component = materialise(connected_components(links.union(ties_of_ids(rows, classes))), "components")
    dealt = materialise(outsiders(groups, component), "outsiders")
    if not dealt.isEmpty():
        cross = materialise(cross_links(dealt, sets, percent), "links")
        ends = [component.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in")) for c in "ab"]
        cross = cross.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
        joined = connected_components(cross).select(F.col("node").alias("component"), F.col("component").alias("new"))
        lone = joined.join(component.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("new").alias("component"))
        moved = component.join(joined, "component", "left").select("node", F.coalesce("new", "component").alias("component"))
        component = materialise(moved.union(lone), "components")

    named = component.join(classes.select("node", "rep"), "node")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = classes.join(named.select("node", "component").join(least, "component").select("node", "component_id"), "node", "left").select(*key, F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.join(label, key, "left")
    out = materialise(out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")), "labelled")
    for spent in (described, classes, firsts, groups):
        drop_materialised(spark, spent)
    return out
