"""Language, quality, personal data and urls: brute force, accuracy, edges."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from lumicurve.llm import language_id, pii, quality, url_filter
from lumicurve.llm.queries import QUERIES

from samples import DATA, noise, odd_rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def language_model(docs):
    return language_id.train(docs, per_language=150)


def test_language_held_out_accuracy(docs, language_model):
    out = language_id.identify_languages(docs, language_model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (out[out.held_out].lang_pred == out[out.held_out].lang).mean() > 0.95
    assert out.score.between(0, 1).all()


def test_language_edges(spark, odd, no_docs, language_model):
    out = {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in language_id.identify_languages(odd, language_model).collect()}
    by_id = {i: lang for i, lang, _ in out}
    assert by_id[0] == by_id[1] == by_id[2] == "und" and by_id[4] != "und"
    assert language_id.identify_languages(no_docs, language_model).collect() == []
    assert language_id.train(no_docs) is None
    assert {r.lang_pred for r in language_id.identify_languages(odd, None).collect()} == {"und"}
    kept = language_id.language_filter(odd, language_model, least=0.0)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()


def test_many_languages_fit_in_bounded_memory(spark):
    """A hundred languages, some with a single row: all can be predicted, the sample stays bounded."""
    import random

    r = random.Random(2)
    vocabulary = {f"l{k}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)] for k in range(100)}
    rows = [(i, " ".join(r.choice(vocabulary[f"l{i % 100}"]) for _ in range(60)), f"l{i % 100}", 0) for i in range(3000)]
    rows += [(10**6 + k, "seldom written words " * 9, "rare", 0) for k in range(8)] + [(5, "repeated", "l5", 0)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _hash int").repartition(4)
    model = language_id.train(docs, sample_rows=1000)
    out = language_id.identify_languages(docs, model).join(docs.select("doc_id", "lang").where("doc_id <> 5").distinct(), "doc_id").where("held_out").toPandas()
    assert set(model.families) == {f"l{k}" for k in range(100)} | {"rare"}
    assert (out.lang_pred == out.lang).mean() > 0.95


def base_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    mark = [False] * len(words)
    for k in range(len(words) - 7):
        if seen[tuple(words[k : k + 8])] > 1:
            mark[k : k + 8] = [True] * 8
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    n, rep = len(words), sum(mark)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, rep, n < 20 or 100 * rep > 30 * n


def test_quality_base_equals_brute_force(odd, no_docs, sample_texts, spark):
    texts = dict(odd_rows())
    for r in quality.quality_report(odd, None).collect():
        text = texts[r.doc_id] or ""
        assert tuple(r)[1:7] == base_quality(text) and r.kept == (not r.base_failed)
    real = spark.createDataFrame(list(sample_texts.items()), "doc_id long, text string")
    for r in quality.quality_report(real, None).collect():
        assert tuple(r)[1:7] == base_quality(sample_texts[r.doc_id])
    assert quality.quality_report(no_docs, None).collect() == []


def test_quality_trees_separate_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    out = quality.quality_report(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").toPandas()
    assert (out.kept == (out.quality == 1)).mean() > 0.95
    assert quality.train(docs, labels.limit(0)) is None


def test_node_arrays_equal_walking_each_tree():
    import numpy as np

    rng = np.random.default_rng(7)
    x = rng.uniform(size=(500, 4))
    model = quality.grow(x, (x[:, 0] + x[:, 1] * rng.uniform(size=500) > 0.8).astype(float), np.array([1, 0, -1, 0]), trees=15)

    def walk(row):
        total = model.bias
        for node in model.roots.tolist():
            while model.left[node] != node:
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            total += model.value[node]
        return 1 / (1 + np.exp(-total))

    fresh = rng.uniform(-0.2, 1.2, size=(400, 4))
    assert model.score(fresh) == pytest.approx([walk(row) for row in fresh])


def test_first_split_is_the_best_one():
    """The root of the first tree against every cut of every statistic, written out."""
    import numpy as np

    rng = np.random.default_rng(3)
    x, penalty = rng.integers(0, 12, size=(300, 3)).astype(float), 1.0
    y = (x[:, 1] > 7).astype(float)
    model = quality.grow(x, y, np.zeros(3, int), trees=1, depth=1, bins=48)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + penalty)
    best = max(((gain(x[:, f] <= t) + gain(x[:, f] > t), f) for f in range(3) for t in range(11)), key=lambda c: c[0])
    root = model.roots[0]
    assert model.feature[root] == best[1] == 1 and 7 <= model.threshold[root] < 8


def test_trees_are_monotone():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.uniform(size=(800, 2))
    y = ((x[:, 0] + rng.normal(0, 0.4, 800) < 0.5)).astype(float)
    model = quality.grow(x, y, np.array([-1, 0]), trees=20)
    for other in (0.1, 0.9):
        line = np.column_stack([np.linspace(0, 1, 200), np.full(200, other)])
        assert (np.diff(model.score(line)) <= 1e-12).all()


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    found = [(m.start(), k, m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if good(k, m.group())]
    return sorted(found, key=lambda s: (s[0], list(PATTERNS).index(s[1])))


@pytest.mark.parametrize("alphabet", ["ab1@.-% ", "01.2 ", "12345-6 +().", "a@b.c1+ -0", "0123456789 -"])
def test_base_spans_equal_brute_force(alphabet):
    for text in noise(7, 4000, alphabet):
        assert pii.base_spans(text) == brute_spans(text), text


def test_base_spans_are_linear():
    import time

    t = time.time()
    pii.base_spans("a" * 300_000 + " " + "1" * 300_000 + " +1" + " " * 300_000 + "1.1.1." * 30_000 + "@" * 1000)
    assert time.time() - t < 10


def test_personal_data_query(odd, no_docs, docs):
    texts = dict(odd_rows())
    out = pii.find_personal_data(odd).collect()
    assert len(out) == len(odd_rows())
    for r in out:
        base = brute_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for _, k, _ in base) for kind in PATTERNS)
    assert pii.find_personal_data(no_docs).collect() == []


def test_patterns_find_secrets(docs):
    """Keys, tokens and passwords, that no base expression describes, are found by their contexts and forms."""
    rows = docs.select("doc_id", "text").collect()
    secrets = {(r.doc_id, m.start(1)) for r in rows for m in re.finditer(r"(?:token = \"|password=)(\w+)", r.text)}
    found = {(r.doc_id, int(s.split(":")[1])) for r in pii.find_personal_data(docs, support=2).collect() for s in r.spans.split(",") if s.startswith("id:")}
    assert len(secrets & found) >= 0.8 * len(secrets)


def test_pattern_scores_equal_the_graph_written_out(spark):
    import random

    r = random.Random(4)
    edges = [(f"p{r.randint(0, 9)}", r.randint(0, 30), False) for _ in range(120)]
    edges = [(p, i, i % 7 == 0) for p, i, _ in edges]
    totals = {f"p{k}": r.randint(1, 60) for k in range(0, 10, 2)}
    out = pii.score_patterns(spark.createDataFrame(edges, "pattern string, instance long, seed boolean"), spark.createDataFrame(list(totals.items()), "pattern string, total long"), rounds=3)
    n, score = Counter((p, i) for p, i, _ in edges), {i: float(i % 7 == 0) for _, i, _ in edges}
    for _ in range(3):
        of = {}
        for p in {p for p, _ in n}:
            total = max(sum(m for (q, _), m in n.items() if q == p), totals.get(p, 0))
            of[p] = sum(m * score[i] for (q, i), m in n.items() if q == p) / (total + 1)
        for i in score:
            miss = 1.0
            for p in {q for q, j in n if j == i}:
                miss *= max(1 - of[p], 1e-9)
            score[i] = 1.0 if i % 7 == 0 else 1 - miss
    assert {x.pattern: x.score for x in out.collect()} == pytest.approx(of)


def test_personal_data_stages_on_odd_rows(odd):
    """Redaction and the quality filter: nulls stay null or go, columns and other values are kept."""
    texts = dict(odd_rows())
    out = pii.redact_personal_data(odd).collect()
    assert len(out) == len(odd_rows()) and out[0].__fields__ == odd.columns
    for x in out:
        text = texts[x.doc_id]
        assert (x.text is None) == (text is None) and not (x.text and brute_spans(x.text))
        assert x.text == text or brute_spans(text)
    kept = quality.quality_filter(odd, None)
    assert kept.columns == odd.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, t in odd_rows() if t and not base_quality(t)[5])


def test_redaction_leaves_no_base_span():
    text = "mail a.b@c.example.com, call +1 (543) 555-1435 now"
    assert pii.redact(text, frozenset()) == "mail <EMAIL>, call <PHONE> now"


def brute_url(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = re.search("[/?#]", rest)
        host = (rest[: cut.start()] if cut else rest).translate({c: c + 32 for c in range(65, 91)})
        path = re.split("[?#]", rest[len(host) :])[0]
    best = None
    for verdict, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://NET/x", "http://a.net", "http://a.net/", "https://Example.NET/en/1?x#y", "http://xexample.net/en/", "http://b.example.com/de/", "http://a.org/fr/1", "http://é.org?x", "http://x.org#/fr/"]
    urls += [r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    html = [None, "<p>the free bets</p>"] * len(urls)
    rows = [(k, u, html[k], "x") for k, u in enumerate(urls)] + [(None, "http://a.net/x", "", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    out = url_filter.judge_urls(pages).collect()
    assert len(out) == len(rows)
    for r in out:
        host, path, rule = brute_url("http://a.net/x" if r.page_id is None else urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        assert r.verdict == rule[1] if rule else r.verdict in ("allow", "block")
    assert url_filter.judge_urls(pages.limit(0)).collect() == []


def brute_split(name, counts):
    """Cheapest of all splits into words and unknown stretches (of which no two touch)."""
    from functools import cache
    from math import inf, log

    total = sum(counts.values())
    dear = log(total + 1)

    @cache
    def cost(at, loose):
        if at == len(name):
            return 0.0
        out = inf
        for end in range(at + 1, len(name) + 1):
            word = name[at:end]
            if word in counts:
                out = min(out, dear - log(counts[word]) + cost(end, False))
            if not loose:
                out = min(out, dear + (end - at) * log(26) + cost(end, True))
        return out

    return cost(0, False)


def test_segmentation_equals_all_splits():
    import random
    from math import log

    r = random.Random(5)
    counts = {"".join(r.choice("abc") for _ in range(r.randint(2, 4))): r.randint(1, 60) for _ in range(25)}
    total = sum(counts.values())
    for name in [x for x in noise(6, 300, "abcd", 10) if x]:
        found = [(i, n, counts[name[i : i + n]]) for i in range(len(name)) for n in range(2, len(name) - i + 1) if name[i : i + n] in counts]
        words = url_filter.split_name(name, found, total)
        assert "".join(words) == name
        cost = sum(log(total + 1) + (-log(counts[w]) if w in counts else len(w) * log(26)) for w in words)
        assert cost == pytest.approx(brute_split(name, counts)), (name, words)
    good = {"cheap": 50, "pills": 50, "the": 900, "other": 100, "free": 40, "bets": 40}
    split = lambda x: url_filter.split_name(x, [(i, n, good[x[i : i + n]]) for i in range(len(x)) for n in range(2, len(x) - i + 1) if x[i : i + n] in good], 1180)
    assert split("cheappills") == ["cheap", "pills"] and split("theother") == ["the", "other"]
    assert split("zzqx") == ["zzqx"] and split("freezzqx") == ["free", "zzqx"]


def brute_bayes(urls, listed, smoothing=0.5):
    """Scores by counts written out: first model without listed words, then every token by the others."""
    from math import log

    bare = lambda t: t.lstrip("/")

    def model(labels, tokens):
        bad, good = Counter(t for t, b in tokens if b), Counter(t for t, b in tokens if not b)
        kinds = set(bad) | set(good)
        total = [sum(c.values()) + smoothing * (len(kinds) + 1) for c in (bad, good)]
        odds = {t: log((bad[t] + smoothing) / total[0]) - log((good[t] + smoothing) / total[1]) for t in kinds}
        return log((sum(labels) + smoothing) / (len(labels) - sum(labels) + smoothing)), odds

    hit = [{bare(t) for t in u if bare(t) in listed} for u in urls]
    prior, odds = model([bool(h) for h in hit], [(t, bool(h)) for u, h in zip(urls, hit, strict=True) for t in u if bare(t) not in listed])
    score = [prior + sum(odds.get(t, 0) for t in u if bare(t) not in listed) for u in urls]
    tokens = []
    for u, h, s in zip(urls, hit, score, strict=True):
        for t in u:
            own = u.count(t) * odds.get(t, 0) if bare(t) not in listed else 0
            tokens.append((t, bool(h - {bare(t)}) or s - own > 0))
    prior, odds = model([bool(h) or s > 0 for h, s in zip(hit, score, strict=True)], tokens)
    return [prior + sum(odds[t] for t in u) for u in urls]


def test_verdicts_equal_counts_written_out(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    out = url_filter.judge_urls(pages).collect()
    expect = brute_bayes([list(r.words) for r in out], url_filter.UNWANTED_WORDS)
    assert [r.score for r in out] == pytest.approx(expect)
    assert all(r.rule is not None or r.verdict == ("block" if r.score > 0 else "allow") for r in out)


def test_words_learn_from_their_neighbours(spark):
    """Words outside the lexicon get their weight from urls that it marks, and then mark urls without it."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    lone = [(10**9 + k, f"http://{h}.example.com/en/{k}", "") for k, h in enumerate(["farm", "m.win", "cheap", "plainname", "www.thther"])]
    out = url_filter.judge_urls(pages.union(spark.createDataFrame(lone, pages.schema)))
    said = {r.page_id: r.verdict for r in out.where("page_id >= 1000000000").collect()}
    assert [said[10**9 + k] for k in range(5)] == ["block", "block", "block", "allow", "allow"]
    # Held out: urls that taught nothing, judged by the words that are not in the lexicon.
    rows = out.select(F.col("page_id").alias("row"), F.col("words").alias("tokens")).where("row < 1000000000")
    first, _ = url_filter.train_bayes(rows.where("crc32(cast(row AS string)) % 4 <> 2"))
    held = rows.where("crc32(cast(row AS string)) % 4 = 2")
    bare = lambda t: F.ltrim(t, F.lit("/"))
    is_bad = F.exists("tokens", lambda t: bare(t).isin(*url_filter.UNWANTED_WORDS))
    left = held.select("row", F.explode(F.filter("tokens", lambda t: ~bare(t).isin(*url_filter.UNWANTED_WORDS))).alias("token"))
    both = held.select("row", is_bad.alias("bad")).join(url_filter.scores(left, first), "row").toPandas()
    assert len(both) > 400
    assert (both.bad == (both.score > 0)).mean() >= 0.95 and (both.score[both.bad] > 0).mean() >= 0.7
