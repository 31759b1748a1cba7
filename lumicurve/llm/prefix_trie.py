"""The trie of conversation prefixes: what a cache of shared prefixes would save.

1. Turns are numbered, and their digest and words taken, in one pass over the
   texts, which are never shuffled: what follows moves some numbers per turn.
2. Conversations are rebuilt on the first turns of another one.
3. A numpy scan gives every prefix a polynomial fingerprint modulo 2^61 - 1.
   Its sums add up, so long conversations are scanned by blocks.
4. Prefixes of one length and fingerprint are a candidate group. Each is held
   against its representative turn by turn: if the digest of every member's last
   turn is the representative's, in every group, then whole prefixes are equal,
   since a fingerprint and its last turn give the fingerprint in front of it.
   Groups that hold different turns are split by a further fingerprint.
5. The rollup needs no walk over levels. A node belongs to its least member, who
   then also owns all deeper nodes of its own path. So sums over a subtree are
   sums over the members of its top, each giving what it owns from there on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumicurve.llm.common import in_batches, mix64
from lumicurve.llm.filter_audit import words
from lumicurve.session import materialise

#: The fingerprints' modulus, a prime.
PRIME = (1 << 61) - 1
#: Turn numbers to a block that is put in order, turns to a block that is scanned, ids to a piece of a list that is digested.
ORDER_BLOCK, SCAN_BLOCK, LIST_BLOCK = 512, 4096, 4096
_LANES = ["t0", "t1", "t2", "t3"]


def multiply(a: np.ndarray, b: np.ndarray, prime: int) -> np.ndarray:
    """a * b modulo ``prime``, which is 2^61 - 1 or less than 2^32."""
    if prime != PRIME:
        return a * b % np.uint64(prime)
    low, p = np.uint64(0xFFFFFFFF), np.uint64(PRIME)
    al, ah, bl, bh = a & low, a >> np.uint64(32), b & low, b >> np.uint64(32)
    ll, mid = al * bl, al * bh + ah * bl
    s = ((ah * bh) << np.uint64(3)) + (mid >> np.uint64(29)) + ((mid & np.uint64((1 << 29) - 1)) << np.uint64(32)) + (ll & p) + (ll >> np.uint64(61))
    s = (s & p) + (s >> np.uint64(61))
    return np.where(s >= p, s - p, s)


def running_sums(x: np.ndarray, prime: int) -> np.ndarray:
    """Running sums modulo ``prime``, by halves of 30 bits that cannot overflow."""
    half, p = np.uint64(30), np.uint64(prime)
    high, low = np.cumsum(x >> half) % p, np.cumsum(x & np.uint64((1 << 30) - 1)) % p
    return (multiply(high, np.uint64((1 << 30) % prime), prime) + low) % p


class Scan:
    """Fingerprints of prefixes from turns in order, batch by batch."""

    def __init__(self, seed: int, prime: int):
        self.prime, self.seed = prime, np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        self.base = int(mix64(np.array([self.seed]))[0]) % (prime - 3) + 2
        self.powers = np.ones(1, np.uint64)
        while len(self.powers) < SCAN_BLOCK + 1:
            step = np.uint64(pow(self.base, len(self.powers), prime))
            self.powers = np.concatenate([self.powers, multiply(self.powers, step, prime)])

    def terms(self, lanes: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Each turn's digest, brought below the modulus, times its depth's power."""
        turn = mix64(lanes[:, 0] ^ mix64(lanes[:, 1] ^ self.seed)) % np.uint64(self.prime)
        block, rest = np.divmod(depth, SCAN_BLOCK)
        each, at = np.unique(block, return_inverse=True)
        far = np.array([pow(self.base, int(k) * SCAN_BLOCK, self.prime) for k in each.tolist()], np.uint64)
        return multiply(multiply(turn, self.powers[rest], self.prime), far[at], self.prime)


def _numbered(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(c, n, dig, words, h, m, size) of each turn: its number in its conversation,
    how many turns are taken from another one (h, of which m exist) and the
    rebuilt size; and (c, p, m, size) of each conversation."""
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in (role_col, text_col))
    # Turn numbers are dealt by blocks, so that no task needs a whole long conversation.
    block = F.coalesce(F.floor(F.col(turn_col) / ORDER_BLOCK), F.lit(-(1 << 62))).cast("long")
    turns = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), block.alias("block"), role.alias("role"), text.alias("text"))
    counts = turns.groupBy("c", "block").agg(F.count(F.lit(1)).alias("rows"))
    convs = counts.groupBy("c").agg(F.sum("rows").alias("own")).withColumn("h", F.crc32(F.col("c").cast("string")) % 4).withColumn("p", F.expr("c - c % 20"))
    convs = convs.join(convs.select(F.col("c").alias("p"), F.col("own").alias("p_own")), "p", "left")
    convs = convs.withColumn("m", F.least("h", F.coalesce("p_own", F.lit(0).cast("long")))).withColumn("size", F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("long")))
    convs = materialise(convs.select("c", "p", "h", "m", "size"), "conversations")
    ahead = F.coalesce(F.sum("rows").over(Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    places = counts.select("c", "block", ahead.alias("ahead")).join(convs.select("c", "h", "m", "size"), "c")
    slim = turns.select("c", "block", "turn", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("dig"), F.size(words(F.col("text"))).cast("long").alias("words"))
    in_order = F.row_number().over(Window.partitionBy("c", "block").orderBy(F.asc_nulls_first("turn"), "dig"))
    rows = slim.join(places, ["c", "block"]).select("c", (F.col("ahead") + in_order).alias("n"), "dig", "words", "h", "m", "size")
    return materialise(rows, "turns"), convs


def _rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(c, d, dig, words, size): the turns of the rebuilt conversations by depth."""
    own = turns.where("n > h").select("c", (F.col("n") - F.col("h") + F.col("m")).alias("d"), "dig", "words", "size")
    heads = turns.where("n <= 3 AND c % 20 = 0").select(F.col("c").alias("p"), F.col("n").alias("d"), "dig", "words")
    taken = heads.join(convs.select("c", "p", "m", "size"), "p").where("d <= m").select("c", "d", "dig", "words", "size")
    return own.unionByName(taken)


def _scanned(rebuilt: DataFrame, seeds: int, prime: int) -> DataFrame:
    """(c, d, size, u, w, t0 to t3, f0, ...): words of the turn and of the prefix,
    the turn's digest, and the prefix's fingerprints."""
    prints = [f"f{k}" for k in range(seeds)]
    names = ["c", "d", "size", "u", "w", *_LANES, *prints]

    def run(batches):
        scans = [Scan(k, prime) for k in range(seeds)]
        last, carry = None, np.zeros(seeds + 1, np.uint64)
        for b in batches:
            if not len(b):
                continue
            c, d, u = (b.column(k).to_numpy() for k in (0, 1, 4))
            block = (d - 1) // SCAN_BLOCK
            lanes = np.frombuffer(b"".join(b.column(3).to_pylist()), "<u8").reshape(-1, 4)
            change = np.flatnonzero((c[1:] != c[:-1]) | (block[1:] != block[:-1])) + 1
            start = np.concatenate([[0], change])
            run_of = np.repeat(start, np.diff(np.concatenate([start, [len(c)]])))
            sums = [running_sums(s.terms(lanes, d), prime) for s in scans] + [np.cumsum(u).astype(np.uint64)]
            out = []
            for k, total in enumerate(sums):
                before = np.concatenate([[np.uint64(0)], total])[run_of]
                own = total - before if k == seeds else (total + np.uint64(prime) - before) % np.uint64(prime)
                if last == (c[0], block[0]):
                    first = run_of == 0
                    own[first] = own[first] + carry[k] if k == seeds else (own[first] + carry[k]) % np.uint64(prime)
                carry[k] = own[-1]
                out.append(pa.array(own.view(np.int64)))
            last = (c[-1], block[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), out[-1], *(pa.array(lanes[:, k].view(np.int64)) for k in range(4)), *out[:-1]], names=names)

    dealt = rebuilt.withColumn("block", F.expr(f"(d - 1) div {SCAN_BLOCK}")).repartition("c", "block").sortWithinPartitions("c", "d")
    rows = materialise(in_batches(dealt, ["c", "d", "size", "dig", "words"], run, ", ".join(f"{x} long" for x in names)), "prefixes")
    # What the blocks in front of a long conversation's block add.
    block = F.expr(f"(d - 1) div {SCAN_BLOCK}").alias("block")
    long = rows.where(F.col("size") > SCAN_BLOCK)
    ahead = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = long.groupBy("c", block).agg(F.max("w").alias("w"), *[F.max_by(f, "d").alias(f) for f in prints])
    before = [F.coalesce(F.sum(F.col(x).cast("decimal(38,0)")).over(ahead), F.lit(0)).alias(f"{x}_before") for x in ["w", *prints]]
    moved = long.withColumn("block", block).join(blocks.select("c", "block", *before), ["c", "block"])
    moved = moved.withColumn("w", (F.col("w") + F.col("w_before")).cast("long"))
    for f in prints:
        moved = moved.withColumn(f, ((F.col(f) + F.col(f"{f}_before")) % F.lit(prime)).cast("long"))
    return rows.where(F.col("size") <= SCAN_BLOCK).union(moved.select(names))


def _digests(ends: DataFrame, key: list[str]) -> DataFrame:
    """(key, ends_sha256) from (key, c): ids are joined by pieces, which are digested as they stream by."""
    pieces = ends.groupBy(*key, F.expr(f"c div {LIST_BLOCK}").alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches):
        now, digest = None, None
        for b in batches:
            done = []
            for *own, ids in zip(*(b.column(k).to_pylist() for k in range(len(key))), b.column(len(key)).to_pylist(), strict=True):
                if own == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = own, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in done])
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*now, digest.hexdigest()), strict=True))])

    names = [*key, "ends_sha256"]
    dealt = pieces.repartition(*key).sortWithinPartitions(*key, "piece")
    return in_batches(dealt, [*key, "ids"], run, ", ".join(f"{k} long" for k in key) + ", ends_sha256 string")


COLUMNS = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def prefix_trie(conversations: DataFrame, prime: int = PRIME, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv_id (its
    least member), depth, parent_conv_id (the parent's least member, null at the
    root), n_convs, n_children, n_leaves (childless nodes in its subtree),
    saved_tokens (over its subtree, words of a node's turn for each member but
    one), ends_sha256 (of the members that end there).

    Conversation c is rebuilt from the first h turns of conversation c - c % 20
    (the remainder has c's sign) and its own turns after its first h, h being
    the CRC-32 of c's digits modulo 4. Turns are ordered by turn, null first, then
    by the SHA-256 of role and text; repeated rows are turns of their own. Null
    roles and texts are empty. Rows without a conv_id belong to no conversation.
    An empty table has no nodes, not even a root; other columns are not read.
    Turns are equal when their SHA-256 is. ``prime`` is for tests.
    """
    turns, convs = _numbered(conversations, conv_col, turn_col, role_col, text_col)
    root = convs.agg(F.min("c")).collect()[0][0]
    if root is None:
        return conversations.sparkSession.createDataFrame([], COLUMNS)
    for seeds in range(1, 1000):
        key = ["d", *(f"f{k}" for k in range(seeds))]
        rows = _scanned(_rebuilt(turns, convs), seeds, prime)
        ends = [f(x).alias(f"{x}_{f.__name__}") for x in _LANES for f in (F.min, F.max)]
        groups = materialise(rows.groupBy(key).agg(F.min("c").alias("rep"), F.max("size").alias("deepest"), *ends), "prefix-groups")
        differ = " OR ".join(f"{x}_min <> {x}_max" for x in _LANES)
        if groups.where(differ).isEmpty():
            break
    rows = materialise(rows.select("c", "size", "u", "w", *key).join(groups.select(*key, "rep", "deepest"), key), "prefix-rows")

    # What a conversation owns: from which depth on, words in front of it, whose path it leaves there, whether its end is a leaf.
    mine = F.col("rep") == F.col("c")
    owned = rows.groupBy("c").agg(
        F.min(F.when(mine, F.col("d"))).alias("s"),
        F.min(F.when(mine, F.col("w") - F.col("u"))).alias("w_s"),
        F.max(F.when(~mine, F.col("rep"))).alias("from"),
        F.max(F.when(mine & (F.col("d") == F.col("size")) & (F.col("deepest") == F.col("d")), 1).otherwise(0)).alias("leaf"),
        F.max("w").alias("w_all"),
    )
    owned = materialise(convs.select("c", "size").join(owned, "c", "left").select("c", "size", "s", "w_s", "from", F.coalesce("leaf", F.lit(0)).alias("leaf"), F.coalesce("w_all", F.lit(0).cast("long")).alias("w_all")), "owned")
    tops = owned.select("c", "s", "w_s", "from", "leaf", "w_all", "size", *[F.lit(0).cast("long").alias(k) for k in key], F.lit(root).cast("long").alias("rep"), F.lit(0).cast("long").alias("before"))
    members = rows.join(owned.drop("size"), "c").select("c", "s", "w_s", "from", "leaf", "w_all", "size", *key, "rep", (F.col("w") - F.col("u")).alias("before")).union(tops)
    own_words = F.when(F.col("s").isNotNull(), F.col("w_all") - F.greatest("before", "w_s")).otherwise(0)
    parent = F.when(mine & (F.col("d") > 0), F.when(F.col("d") > F.col("s"), F.col("c")).otherwise(F.coalesce("from", F.lit(root))))
    nodes = members.groupBy(key).agg(
        F.min("rep").alias("conv_id"),
        F.max(parent).alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.when((F.col("s") <= F.col("d") + 1) & (F.col("d") < F.col("size")), 1).otherwise(0)).cast("long").alias("n_children"),
        F.greatest(F.sum("leaf").cast("long"), F.lit(1).cast("long")).alias("n_leaves"),
        F.sum(F.col("w_all") - F.col("before") - own_words).cast("long").alias("saved_tokens"),
    )
    at_end = members.where("d = size").select(*key, "c")
    nodes = nodes.join(_digests(at_end, key), key, "left")
    none = F.lit(hashlib.sha256().hexdigest())
    return nodes.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
