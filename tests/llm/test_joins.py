"""N-gram join, vectors, components, chats and the pipeline against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
import public_tokenizers as P
import pyarrow as pa
from lumicurve.llm import chat_format, language_id, ngram_join, pii, quality
from lumicurve.llm.byte_bpe import TextEncoder
from lumicurve.llm.chat_format import chat_windows, escape, read_back, unescape
from lumicurve.llm.components import connected_components
from lumicurve.llm.embed_dedup import bucket_keys, near_duplicates, plan
from lumicurve.llm.ngram_join import SetLinker, jaccard_components

from samples import DATA, noise, odd_rows

@pytest.fixture(scope="module")
def bpe():
    return TextEncoder.of(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute_components(texts, percent=85):
    sets = {i: shingles(t) for i, t in texts.items()}
    lists = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for j, o in Counter(j for x in s for j in lists[x] if j > i).items():
            if 100 * o >= percent * (len(s) + len(sets[j]) - o):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def check_components(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, n=4, percent=85).collect()}
    assert out == brute_components(texts)


def test_ngram_join_on_documents(spark, sample_texts):
    check_components(spark, sample_texts)


def test_ngram_join_on_edited_copies(spark):
    """Chains of copies, each a little further off, shared passages, and a frequent passage."""
    rng = np.random.default_rng(4)
    word = lambda: "w" + str(rng.integers(0, 10**6))
    texts, k = {}, 0
    passage = [word() for _ in range(60)]
    for _ in range(6):
        base = [word() for _ in range(120)]
        for _ in range(25):
            texts[k] = " ".join(base)
            k += 1
            base = list(base)
            for _ in range(int(rng.integers(0, 4))):
                base[int(rng.integers(0, len(base)))] = word()
    for _ in range(40):
        texts[k] = " ".join([word() for _ in range(100)] + passage)
        k += 1
    check_components(spark, texts)


def test_ngram_join_edges(spark, odd, no_docs):
    out = jaccard_components(odd, n=4, percent=85).collect()
    assert len(out) == len(odd_rows())
    by_id = {r.doc_id: r for r in out}
    assert by_id[0].n_shingles == by_id[3].n_shingles == 0 and by_id[100].component_id == 100
    assert by_id[6].component_id == 5 and by_id[105].component_id == 5 and by_id[200].component_id == 200
    assert by_id[None].component_id is None
    assert jaccard_components(no_docs).collect() == []


def test_ngram_join_keeps_links_of_repeated_ids(spark):
    """Rows of one id with different texts have the links of both texts; rows without an id link too."""
    word = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [r for k in range(20) for r in ((1000 + k, word(2 * k)), (1000 + k, word(2 * k + 1)), (2000 + k, word(2 * k) + " end"), (3000 + k, word(2 * k + 1) + " end"))]
    rows += [(None, word(0) + " tail"), (None, word(99)), (None, word(99)), (None, word(99) + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = jaccard_components(docs).collect()
    assert len(out) == len(rows)
    got = {(r.doc_id, r.component_id) for r in out}
    assert got == {(i + k, 1000 + k) for k in range(20) for i in (1000, 2000, 3000)} | {(None, 1000), (None, None)}


def test_ngram_join_of_large_groups(spark):
    """Groups of many chunks: near copies in two clusters that a passage ties together, and texts that only share the passage."""
    rng = np.random.default_rng(8)
    word = lambda: "w" + str(rng.integers(0, 10**7))
    passage = " ".join(f"p{k}" for k in range(12))
    texts = {}
    for cluster in range(3):
        base = [word() for _ in range(90)]
        for _ in range(200):
            own = list(base)
            for _ in range(int(rng.integers(0, 3))):
                own[int(rng.integers(0, 90))] = word()
            texts[len(texts)] = " ".join(own) + " " + passage
    for _ in range(250):
        texts[len(texts)] = " ".join([word() for _ in range(20)]) + " " + passage
    for _ in range(4):
        twin = " ".join(word() for _ in range(70))
        texts[len(texts)] = twin + " " + passage
        texts[len(texts)] = twin + " x " + passage
    check_components(spark, texts)


def test_ngram_join_of_many_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 6)
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    test_ngram_join_on_edited_copies(spark)
    test_ngram_join_of_large_groups(spark)


def test_ngram_join_of_more_repeats_than_the_sketch_holds(spark, monkeypatch):
    """Passages in two texts each, more than have a level of their own: texts that only share one are not compared."""
    monkeypatch.setattr(ngram_join.frequency_sketch, "__defaults__", (1 << 12,))
    rows, write = Counter(), ngram_join.materialise

    def counted(df, label, **k):
        out = write(df, label, **k)
        rows[label] += out.count()
        return out

    monkeypatch.setattr(ngram_join, "materialise", counted)
    rng = np.random.default_rng(12)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    texts = {}
    for _ in range(300):
        passage = words(20)
        for _ in range(2):
            texts[len(texts)] = words(150) + " " + passage
    for k in range(20):
        texts[len(texts)] = texts[30 * k] + " " + words(2)
    check_components(spark, texts)
    assert 20 <= rows["groups"] < 200


def test_near_copies_go_without_a_shuffle_of_all_texts(spark, monkeypatch):
    """Of texts of long words few bytes are shuffled where few are copies, and what stays is right, repeated ids too."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return sum(s.shuffleWriteBytes() for s in gateway.jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)))

    rng = np.random.default_rng(5)
    words = lambda n: " ".join(rng.bytes(24).hex() for _ in range(n))
    texts = [(k, words(120)) for k in range(300)]
    copies = [(1000 + k, texts[k][1] + " end") for k in range(15)]
    rows = [*texts, *copies, (1003, None), (20, "more of it"), (None, words(9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        frame = corpus_pipeline.materialise(docs, "docs")
        before = shuffled()
        kept = {r.doc_id: r.text for r in corpus_pipeline.one_of_each_group(spark, frame, "").collect()}
        assert kept == dict(texts) | {20: min(texts[20][1], "more of it"), 1003: None, None: rows[-1][1]}
        assert shuffled() - before < 0.5 * sum(len(t or "") for _, t in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_set_linker_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        base = rng.choice(500, 60, replace=False)
        sets = []
        for _ in range(30):
            s = set(base.tolist())
            for x in rng.choice(base, int(rng.integers(0, 9)), replace=False).tolist():
                s.discard(x)
            s |= set(rng.choice(2000, int(rng.integers(0, 6))).tolist())
            sets.append(np.array(sorted(s), np.uint64))
        linker = SetLinker(sets, 85)
        linker.links()
        parent = list(range(len(sets)))

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(len(sets)):
            for j in range(i):
                o = len(np.intersect1d(sets[i], sets[j]))
                if 100 * o >= 85 * (len(sets[i]) + len(sets[j]) - o):
                    parent[root(i)] = root(j)
        groups = lambda f: {frozenset(j for j in range(len(sets)) if f(j) == f(i)) for i in range(len(sets))}
        assert groups(linker.root) == groups(root)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    out = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert out == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + rng.normal(0, 0.06, (20, 16)), np.repeat(base[:1], 30, 0) + rng.normal(0, 0.02, (30, 16)), base[5:7], rng.normal(size=(100, 16))]).astype(np.float32)
    rows = [(int(k), [float(v) for v in r], 1) for k, r in enumerate(x)]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [1.0, None] * 8, 1), (1003, [float("nan")] * 16, 1), (1004, [], 1), (1005, [1.0, 2.0], 1), (1006, [2.0, 4.0], 1), (None, [1.0, 2.0], 1)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(4)
    out = near_duplicates(vectors, recall=0.9999).collect()
    assert len(out) == len(rows) + len(odd)
    got = {r.vec_id: r for r in out}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    assert [got[k].n_links for k in range(len(x))] == (linked.sum(axis=1) - 1).tolist()
    label = np.arange(len(x))
    while True:
        new = np.array([label[linked[k]].min() for k in range(len(x))])
        if (new == label).all():
            break
        label = new
    assert [got[k].component_id for k in range(len(x))] == label.tolist()
    assert all(got[k].n_links == 0 and got[k].kept for k in range(1000, 1005))
    assert got[1006].component_id == 1005 and got[1005].n_links == got[1006].n_links == 2
    assert near_duplicates(vectors.limit(0)).collect() == []


def test_plan_grows_with_the_count():
    assert plan(100, 0.95, 0.99, 1.5, 256)[0] == 1
    few, many = plan(10**5, 0.95, 0.99, 1.5, 256), plan(10**9, 0.95, 0.99, 1.5, 256)
    assert many[0] > few[0] and many[1] > few[1]


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST] \\ <s> \\\\ <\\s> [\\INST] é🎉\n"
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", said), (1, 2, "assistant", said * 40), (1, 3, "user", None), (1, 4, "assistant", ""), (2, 0, "assistant", "x" * 9000), (2, 0, "assistant", "x" * 9000), (3, 0, None, None), (None, None, "user", "no id")]
    rows += [(4, t, "assistant" if t % 2 else "user", f"turn {t} " + said * (t % 7)) for t in range(120)]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, window string")
    windows = chat_windows(turns, budget=700, system_tokens=100, history_tokens=200)
    got = {r.conv_id: r for r in read_back(windows).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] or 0, r[2] or "", r[3] or ""))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    w = windows.collect()
    assert sum(len(r.text) for r in w if r.conv_id == 4) == got[4].formatted_chars
    assert all(r.n_tokens <= 700 or r.over_budget for r in w)
    assert all(r.repeated <= 3 for r in w) and max(r.repeated for r in w if r.conv_id == 4) == 2
    assert all(r.text.startswith("<s>system[INST]be brief") for r in w if r.conv_id == 1)
    assert read_back(chat_windows(turns.limit(0))).collect() == []


def test_windows_do_not_depend_on_blocks(spark, monkeypatch):
    said = ["a short one", "é🎉 " * 40, "word " * 90, "", "</s> x"]
    rows = [(c, None if t == 0 and c == 2 else t // 2, ("system", "user", "assistant")[(t > 0) + t % 2 * (t > 0)], said[(t + (c or 7)) % 5]) for c in (1, 2, None) for t in range(60)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    turns = turns.union(spark.createDataFrame([(5, 0, "user", "hi")], turns.schema))
    windows = lambda **o: sorted(map(str, chat_windows(turns, budget=900, system_tokens=100, history_tokens=300, **o).collect()))
    whole = windows()
    monkeypatch.setattr(chat_format, "BLOCK_TURNS", 3)
    assert windows(most_turns=10) == whole and len(whole) > 30


def test_windows_stay_within_their_budget(spark, bpe):
    """No window has more ids than its bound says, so none over the budget is left unmarked."""
    odd = [(10**6 + k, t, "user", text) for k, text in enumerate(noise(21, 60, "漢字é🎉<s>[/INST]\\ a", 400)) for t in range(3)]
    turns = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet").select("conv_id", "turn", "role", "text").union(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"))
    for budget, parts in ((4096, 1024), (1024, 256)):
        w = chat_windows(turns, budget=budget, system_tokens=parts, history_tokens=parts).select("text", "n_tokens", "over_budget").collect()
        ids = [len(x) for x in bpe.encode(pa.array([r.text for r in w]))]
        assert all(n <= r.n_tokens for n, r in zip(ids, w, strict=True))
        assert all(r.over_budget == (r.n_tokens > budget) for r in w) and not all(r.over_budget for r in w)


def test_recall_of_pairs_at_the_threshold():
    """Pairs whose cosine is 0.95 meet in a bucket, with the projections and tables planned for few and for very many vectors."""
    rng = np.random.default_rng(12)
    n, size = 1500, 64
    x = rng.normal(size=(n, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(n, size))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    for count in (51_282, 10**6, 10**9):
        projections, tables = plan(count, 0.95, 0.995, 1.5, 256)
        keys = [bucket_keys([r.tobytes() for r in v], projections, tables, 1.5, 17) for v in (x, y)]
        assert (keys[0] == keys[1]).any(axis=1).mean() >= 0.985, (count, projections, tables)


def test_vectors_with_clashing_columns(spark):
    rows = [(k, [1.0, float(k // 3)], "x", [1], 2, 3) for k in range(9)]
    out = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, raw string, keys array<int>, t int, id int")).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in out} == {(k, 2, k // 3 * 3) for k in range(9)}


def test_escape_is_reversible(spark):
    from pyspark.sql import functions as F

    texts = noise(11, 500, ["<", "s>", "/", "[", "INST]", "\\", "a", "</s>", "[INST]", "\n"])
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]"))


@pytest.fixture(scope="module")
def stage_inputs(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    return docs, language_id.train(docs), quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))


def redacted(text, spans):
    """The text with each span replaced by its kind in angle brackets, spans that overlap as one (of the first one's kind)."""
    out, end = [], 0
    for kind, start, stop in sorted(((k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)), key=lambda s: (s[1], s[2])):
        if start >= end:
            out += [text[end:start], f"<{kind.upper()}>"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def test_pipeline_equals_brute_force(spark, stage_inputs):
    """Every stage again: five-word sets compared pair by pair, spans cut out of
    the texts, and the tokenizer's own library; of the learned stages the
    verdicts are taken, and what no model decides is looked at apart."""
    import public_tokenizers
    import tokenizers
    from test_near_copies import brute_stay

    docs, model, _ = stage_inputs
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    langs = {r.doc_id: r for r in language_id.identify_languages(docs, model).collect()}
    assert all((langs[i].lang_pred == "und") == (not any(c.isalpha() for c in t)) for i, t in texts.items())
    texts = {i: t for i, t in texts.items() if any(c.isalpha() for c in t) and langs[i].score >= 0.3}
    left = docs.where(docs.doc_id.isin(list(texts)))
    verdicts = {r.doc_id: r for r in quality.quality_report(left, quality.train(left, spark.read.parquet(f"{DATA}/labels.parquet"))).collect()}
    assert not any(verdicts[i].kept for i, t in texts.items() if len(re.findall(r"[^\x20\x09-\x0D]+", t)) < 20)
    texts = {i: t for i, t in texts.items() if verdicts[i].kept}
    stay = brute_stay(texts)
    group = docs.where(docs.doc_id.isin(list(stay)))
    spans = {r.doc_id: r.spans for r in pii.find_personal_data(group).collect()}
    shown = {r.doc_id: r.text for r in pii.redact_personal_data(group).collect()}
    for i in stay:
        assert shown[i] == redacted(texts[i], spans[i]), i
    assert any(shown[i] != texts[i] for i in stay)
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = corpus_pipeline.run(spark, DATA).toPandas()
    assert set(out.doc_id) == stay and len(corpus_pipeline.STAGES) == 5
    for i, own in out.sort_values("piece").groupby("doc_id"):
        ids = [*tokenizer.encode(shown[i], add_special_tokens=False).ids, 0]
        assert [x for piece in own["ids"] for x in np.frombuffer(piece, "<u4").tolist()] == ids
        for r in own.itertuples():
            piece = ids[r.start : r.start + r.length]
            assert np.frombuffer(r.ids, "<u4").tolist() == piece and r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        assert (own["length"] == 2048).sum() >= len(own) - 1
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1].tolist()] and own["length"].sum() <= 2048


def test_pipeline_stages_keep_columns_and_take_empty_tables(spark, stage_inputs):
    docs = stage_inputs[0]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30), DATA).columns == docs.columns, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
