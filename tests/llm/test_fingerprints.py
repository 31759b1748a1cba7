"""Fingerprints: order and edits by brute force, exact containment at scale 1, estimates, merging, edges."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from lumicurve.llm import fingerprints as fp
from lumicurve.llm.queries import QUERIES

from samples import noise, odd_rows


def shingles(text, n=fp.WORDS):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_force(rows):
    """What stands in a report of ``rows`` (id, text) with every shingle retained."""
    key = lambda r: (-r[0], r[1] or "")
    named = sorted((r for r in rows if r[0] is not None), key=key)
    out = []
    for (i, t), (_, after) in [*zip(named, named[1:] + named[:1], strict=True), *(((i, t), (None, "")) for i, t in rows if i is None)]:
        t, after = t or "", after or ""
        k = len(t) // 3
        changed = t[: len(t) - k] + after[:k]
        a, b, c = shingles(t), shingles(changed), shingles(after)
        share = lambda x, a=a: round(len(a & x) / len(a), 9) if a else float(not x)
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), share(b), share(c)))
    return sorted(out, key=repr)


def rows_of(report):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in report), key=repr)


@pytest.mark.parametrize("range_bytes", [1 << 30, 500])
def test_against_brute_force(spark, monkeypatch, range_bytes):
    """One range and many, ids with gaps, negative and repeated ones, odd texts, no ids."""
    monkeypatch.setattr(fp, "RANGE_BYTES", range_bytes)
    texts = noise(4, 200, ["a ", "bb ", "C ", "é\n", "dd\t"], 80)
    rows = [(k * k - 50, t) for k, t in enumerate(texts)] + odd_rows() + [(7, "one more"), (7, None), (7, "one more"), (None, "a b c"), (-(2**40), "last of all")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, fingerprint string, _at int").repartition(5)
    assert rows_of(fp.fingerprint_report(docs, scale=1).collect()) == brute_force(rows)


def test_query_reports_every_document(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op13_fingerprints"](spark, sf).collect()
    expected = {r[0]: r for r in brute_force(rows)}
    assert [(r[0], r[1], r[2]) for r in rows_of(found)] == [(r[0], r[1], r[2]) for r in brute_force(rows)]
    text = dict(rows)
    by_text = {}
    for r in found:
        by_text.setdefault(text[r.doc_id], set()).add(r.fingerprint)
        assert len(r.fingerprint) % 16 == 0 and bool(r.fingerprint) == bool(shingles(text[r.doc_id]))
    assert all(len(x) == 1 for x in by_text.values()) and len(by_text) < len(found)
    # Estimates stay near the true containments: within four deviations of a share of k retained hashes.
    wide = [r for r in found if len(r.fingerprint) >= 16 * 30]
    off = [abs(r.near_edited - expected[r.doc_id][3]) * (len(r.fingerprint) / 16) ** 0.5 for r in wide]
    assert len(wide) > 400 and max(off) < 4 * 0.5 and np.mean(off) < 0.6
    assert np.mean([r.near_next for r in wide]) < 0.01


def test_retained_share_and_merging(spark):
    r = np.random.default_rng(3)
    words = [f"w{k}" for k in range(5000)]
    parts = [" ".join(r.choice(words, 4000)) for _ in range(6)]
    every = [np.sort(x) for x in fp.sketches(pa.array(parts), scale=1)]
    kept = list(fp.sketches(pa.array(parts)))
    assert all(abs(len(k) / len(e) - 1 / fp.SCALE) < 0.03 for k, e in zip(kept, every, strict=True))
    assert all((fp.decode(fp.encode(k)) == k).all() for k in kept)
    merged = kept[0]
    for k in kept[1:]:
        merged = fp.merge(merged, k)
    assert (merged == fp.retained(np.unique(np.concatenate(every)))).all()
    assert fp.containment(kept[0], merged) == 1.0 and abs(fp.containment(merged, kept[0]) - 1 / 6) < 0.05
    rows = [("all", fp.encode(k)) for k in kept] + [("all", None), ("none", ""), ("none", None), ("small", "ff" * 8), ("small", "fe" * 8)]
    out = dict(map(tuple, fp.merge_fingerprints(spark.createDataFrame(rows, "part string, fingerprint string").repartition(3), "part").collect()))
    assert out == {"all": fp.encode(merged), "none": "", "small": "fe" * 8}


def test_no_rows_and_one_row(spark, no_docs):
    assert fp.fingerprint_report(no_docs).collect() == []
    one = spark.createDataFrame([(5, "a b c d e f g h i")], "doc_id long, text string")
    assert rows_of(fp.fingerprint_report(one, scale=1).collect()) == brute_force([(5, "a b c d e f g h i")])


def test_words_that_collide_under_polynomials():
    """Thue-Morse words of 2,048 letters collide under every polynomial modulo 2^64."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    a, b = fp.sketches(pa.array([word, other]), scale=1)
    assert a[0] != b[0]
