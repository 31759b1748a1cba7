"""The filter audit against a brute-force count."""

import re
from collections import Counter
from itertools import permutations

from lumicurve.llm.filter_audit import filter_audit

from samples import noise, odd_rows


def brute_force(rows, labels):
    least, good, toxic = {}, set(), set()
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if x == 1 else set()
    parts = {}
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > least[t],
        }
        mark = i is not None
        parts.setdefault(part or "", []).append((fails, mark and i in good, mark and i in toxic))
    out = {}
    for part, docs in parts.items():
        every = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, name in enumerate(order, 1):
                here = [d for d in left if d[0][name]]
                left = [d for d in left if not d[0][name]]
                every[name] += len(here)
                failing = sum(d[0][name] for d in docs)
                alone = sum(d[0][name] and sum(d[0].values()) == 1 for d in docs)
                out[part, "".join(order), step] = [len(left), len(here), failing - len(here), alone, sum(d[1] for d in here), sum(d[2] for d in here)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(every[order[step - 1]])
    return out


def report(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, p, "x", 1) for i, t, p in rows], "doc_id long, text string, source string, part string, mask int").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit(docs, marks).collect()
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in out}
    assert len(found) == len(out)
    return found


def test_against_brute_force(spark):
    texts = noise(5, 150, ["aa ", "b\n", "C ", "dd\t", "#", "É "], 120)
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(texts + texts[:40] + ["same text"] * 60)]
    labels = [(k, k % 2, int(k % 7 == 0)) for k in range(0, 300, 3)] + [(3, 0, 1), (6, None, None), (None, 1, 1), (999, 1, 1)]
    assert report(spark, rows, labels) == brute_force(rows, labels)


def test_edges(spark):
    """Odd texts, null and repeated ids, null and empty parts, label rows that disagree."""
    rows = [(i, t, [None, "", "s"][k % 3]) for k, (i, t) in enumerate(odd_rows())]
    rows += [(None, "a row without an id", None), (200, "other text", "s")]
    labels = [(0, 1, 0), (0, 0, 1), (200, 1, 1), (None, 1, 1)]
    assert report(spark, rows, labels) == brute_force(rows, labels)


def test_no_rows(spark, no_docs):
    assert filter_audit(no_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
