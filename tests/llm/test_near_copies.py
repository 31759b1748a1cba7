"""The pipeline's n-gram stage against five-word brute force."""

import re
from itertools import combinations

import corpus_pipeline

from samples import DATA

LOWER = {c: c + 32 for c in range(65, 91)}


def five_grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_stay(texts):
    """Ids that are the least of their component, links at a similarity of 0.8 or more."""
    sets = {i: five_grams(t) for i, t in texts.items()}
    lists = {}
    for i, s in sets.items():
        for x in s:
            lists.setdefault(x, []).append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in {p for ids in lists.values() for p in combinations(sorted(ids), 2)}:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i for i in sets if root(i) == i}


def test_stage_drops_copies_from_a_similarity_of_four_fifths(spark):
    base = [f"w{k}" for k in range(100)]
    edited = ["x" if k == 30 else "y" if k == 60 else w for k, w in enumerate(base)]
    other = [f"v{k}" for k in range(100)]
    texts = {1: base, 2: edited, 3: other, 4: other + [f"u{k}" for k in range(22)], 5: other + [f"t{k}" for k in range(30)]}
    texts = {i: " ".join(t) for i, t in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    out = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, DATA).collect()}
    assert out == brute_stay(texts) == {1, 3, 5}


def test_stage_equals_brute_force_on_documents(spark, sample_texts):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, DATA).collect()}
    assert out == brute_stay(sample_texts)


def test_stage_on_odd_rows(spark):
    """Null and repeated ids, null and empty texts, copies of each other."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(50))
    rows = [(1, text(1)), (2, text(1)), (None, text(1)), (None, text(2)), (None, text(2)), (None, text(2) + " end"), (3, text(3)), (3, text(4)), (5, text(4)), (6, None), (7, None), (8, ""), (None, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.one_of_each_group(spark, docs, DATA)
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    nameless = [t for i, t in got if i == 0]
    assert len(nameless) == 2 and "" in nameless and nameless[1] in (text(2), text(2) + " end")
    assert [r for r in got if r[0]] == [(1, text(1)), (3, text(3)), (6, ""), (7, ""), (8, "")]


def test_stage_with_string_ids(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(50))
    rows = [("b", text(1)), ("a", text(1)), (None, text(1)), (None, text(2)), (None, text(2)), ("z", text(3)), ("10", text(3)), ("9", None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id string, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.one_of_each_group(spark, docs, DATA)
    assert sorted((r.doc_id or "", r.text or "") for r in out.collect()) == [("", text(2)), ("10", text(3)), ("9", ""), ("a", text(1))] and out.columns == docs.columns


def test_all_stages_on_odd_rows(spark, odd):
    docs = odd.selectExpr("doc_id", "text", "'en' AS lang", "source", "doc_id AS n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns, name
        docs = out if name != "quality_rules" else docs
    assert out.count() > 0
