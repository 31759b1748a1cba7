"""The trie of conversation prefixes against one built by hand, forced collisions, long conversations, edges."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lumicurve.llm import prefix_trie as trie


def brute_force(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        p = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = own.get(p, [])[:h] + said[h:]
    members = {}
    for c, said in whole.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    out = []
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[x] for x in below) or 1
        saved[path] = sum(saved[x] for x in below) + ((len(members[path]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0)
        ends = ",".join(str(c) for c in sorted(members[path]) if len(whole[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(members[path]), len(path), parent, len(members[path]), len(below), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def trie_of(spark, rows, **options):
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, c long, n_convs int").repartition(3)
    return sorted(map(tuple, trie.prefix_trie(table, **options).collect()))


def talk(seed, convs, longest=7):
    """Conversations over few different turns, so that prefixes are shared."""
    r = random.Random(seed)
    rows = []
    for c in convs:
        for turn in range(r.randint(1, longest)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", r.choice(["hello", "yes no", "", "a b  c", "x"][: 2 + turn % 4])))
    return rows


def test_against_brute_force(spark):
    rows = talk(1, range(-45, 160))
    r = random.Random(2)
    r.shuffle(rows)
    assert trie_of(spark, rows) == brute_force(rows)


def test_collisions_are_split(spark):
    """Fingerprints modulo a small prime collide; verification splits the groups."""
    rows = talk(3, range(90), longest=5)
    assert trie_of(spark, rows, prime=101) == brute_force(rows)


def test_long_conversations_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "ORDER_BLOCK", 8)
    monkeypatch.setattr(trie, "SCAN_BLOCK", 16)
    monkeypatch.setattr(trie, "LIST_BLOCK", 4)
    said = [(turn, "user", f"{turn % 5} w") for turn in range(100)]
    rows = [(c, turn, role, text if (turn, c) != (70, 3) else "other") for c in (3, 4, 5) for turn, role, text in said] + [(c, 0, "user", "0 w") for c in range(20, 60)]
    assert trie_of(spark, rows) == brute_force(rows)


def test_edges(spark):
    """Null turns, roles and texts, ties, repeated rows, no id, turnless conversations, texts that join alike."""
    rows = [(1, None, None, None), (1, None, "a", "b"), (1, 3, "a", "b"), (1, 3, "a", "b"), (1, 3, "ab", ""), (1, 3, "", "ab")]
    rows += [(None, 0, "user", "no conversation"), (7, 0, "u", "é 漢 \x00 word" * 2000), (-7, 0, "u", "x"), (-27, 1, "u", "x"), (2, -(2**40), "u", "early"), (2, 2**40, "u", "late")]
    assert trie_of(spark, rows) == brute_force(rows)
    lone = [(c, 0, "u", "x") for c in range(1, 60) if zlib.crc32(str(c).encode()) % 4 and c % 20]
    assert trie_of(spark, lone) == brute_force(lone) and len(brute_force(lone)) == 1
    assert trie_of(spark, []) == []


@pytest.mark.parametrize("prime", [trie.PRIME, 101, (1 << 31) - 1])
def test_arithmetic(prime):
    r = random.Random(prime)
    a, b = ([r.choice([0, 1, prime - 1, r.randrange(prime)]) for _ in range(500)] for _ in range(2))
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    assert trie.multiply(x, y, prime).tolist() == [i * j % prime for i, j in zip(a, b, strict=True)]
    sums = np.cumsum(np.array(a, object)) % prime
    assert trie.running_sums(x, prime).tolist() == sums.tolist()
