"""Personal data: base expressions, and identifiers found by bootstrapping.

Entities that the base expressions find, and strings that only keys and
passwords look like, are seeds. They induce lexical patterns: the word and
separators in front of an identifier, and an identifier's own prefix and shape.
Spark scores the graph of patterns and instances in rounds: a pattern by the
scores of the instances among all its occurrences in the corpus, an instance by
the patterns it occurs with. Patterns of high confidence then mark identifiers
that no expression describes.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicurve.llm.common import in_batches, texts_of
from lumicurve.session import materialise

#: Kinds of spans in their order at one start; the last one is what patterns find.
KINDS = ("email", "ip", "card", "phone", "id")

# The base expressions. Those of ip and email are anchored at the
# start of a run (of digits; at the @) so that no run is scanned twice.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

#: Strings that may be identifiers, if they hold a digit, and their runs.
_CANDIDATE = re.compile("[A-Za-z0-9_+/-]{8,}")
_TURNS = re.compile("[A-Za-z]+|[0-9]+")
#: A word with the separators behind it: what may stand in front of an identifier.
_CUE = re.compile(r"[^\W\d_]+[^\w\n]{1,4}")
_CUE_END = re.compile(r"[^\W\d_]{1,32}[^\w\n]{1,4}\Z")

#: The column that holds a text's key, and in how many parts the rows of one key or pattern are joined.
_KEY, SALTS = "_pii_key", 8

#: Most patterns that are sent to executors; more are joined.
MOST_PATTERNS = 20_000

#: Most entries that a task counts before it hands them on.
MOST_COUNTED = 1 << 18

Span = tuple[int, str, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base expressions, in order."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if m and start < at:
            out.append((start, "email", m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), "ip", m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), "card", m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((m.start(), "phone", m.end()))
    out.sort(key=lambda s: (s[0], KINDS.index(s[1])))
    return out


def cue_before(text: str, start: int) -> str | None:
    """The word and separators that end at ``start``, lower-cased."""
    m = _CUE_END.search(text, max(0, start - 36), start)
    return "c:" + " ".join(m.group().lower().split(" ")) if m else None


def form_of(s: str) -> str:
    """Prefix and shape: four characters, kinds of letters and the length."""
    kinds = "".join(k for k, has in (("A", any("A" <= c <= "Z" for c in s)), ("a", any("a" <= c <= "z" for c in s))) if has)
    return f"f:{s[:4]}:{kinds}:{len(s)}"


def looks_secret(s: str) -> bool:
    """Long, and changing between letters and digits again and again."""
    return len(s) >= 16 and len(_TURNS.findall(s)) >= 5


def candidates(text: str, base: list[Span]) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(start, end, seed, cue, form) of strings outside base spans that may be identifiers."""
    if not _DIGIT.search(text):
        return
    i = 0
    by_start = sorted((s, e) for s, _, e in base)
    reach = 0
    for m in _CANDIDATE.finditer(text):
        while i < len(by_start) and by_start[i][0] < m.end():
            reach = max(reach, by_start[i][1])
            i += 1
        s = m.group()
        if reach <= m.start() and _DIGIT.search(s):
            yield m.start(), m.end(), looks_secret(s), cue_before(text, m.start()), form_of(s)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def text_key(text_col: str):
    """A hash that stands for a text where rows are joined."""
    return F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)


def extract(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Base results of each row, the key of its text, and its edges of the graph:
    for each base span and candidate its pattern(s), the hash of its string,
    whether it is a seed."""

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for text in texts_of(b.column(1)):
                base = base_spans(text)
                n = Counter(kind for _, kind, _ in base)
                digest = lambda s: int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "little", signed=True)
                edges = [{"pattern": c, "instance": digest(text[s:e]), "seed": True} for s, _, e in base if (c := cue_before(text, s))]
                found = list(candidates(text, base))
                for s, e, seed, cue, form in found:
                    edges += [{"pattern": p, "instance": digest(text[s:e]), "seed": seed} for p in (cue, form) if p]
                row = (*(n[k] for k in KINDS[:4]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base), [{"start": s, "end": e, "cue": c, "form": f} for s, e, _, c, f in found], edges)
                for col, v in zip(cols, row, strict=True):
                    col.append(v)
            edge = pa.struct([("pattern", pa.string()), ("instance", pa.int64()), ("seed", pa.bool_())])
            found_type = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("cue", pa.string()), ("form", pa.string())])
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(found_type), pa.list_(edge)]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, kinds), b.column(2)], names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "found", "edges", _KEY])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, found array<struct<start:long,end:long,cue:string,form:string>>, edges array<struct<pattern:string,instance:long,seed:boolean>>, {_KEY} string"
    return in_batches(docs.withColumn(_KEY, text_key(text_col)), [id_col, text_col, _KEY], run, schema)


def cue_totals(docs: DataFrame, cues: frozenset[str] | None, text_col: str) -> DataFrame:
    """(pattern, total): how often each of the cues, or any cue at all, stands in the corpus."""

    def run(batches):
        totals: Counter = Counter()
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(["c:" + c for c in totals], pa.string()), pa.array(list(totals.values()), pa.int64())], names=["pattern", "n"])
        for b in batches:
            for text in texts_of(b.column(0)):
                totals.update(c for c in _CUE.findall(text.lower()) if cues is None or "c:" + c in cues)
                if len(totals) > MOST_COUNTED:
                    yield emit()
                    totals.clear()
        yield emit()

    return in_batches(docs, [text_col], run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("total"))


def score_patterns(edges: DataFrame, totals: DataFrame, rounds: int = 3, prior: float = 1.0) -> DataFrame:
    """(pattern, score, instances): scores of patterns after some rounds.

    A pattern's score is the summed score of its occurrences over all of its
    occurrences plus ``prior``; an instance's is 1 for a seed, else the chance
    that not all of its patterns are wrong.
    """
    graph = materialise(edges.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")), "pii-graph")
    seeds = graph.groupBy("instance").agg(F.max("seed").alias("seed"))
    size = graph.groupBy("pattern").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("instances"))
    size = materialise(size.join(totals, "pattern", "left").select("pattern", "instances", F.greatest("n", F.coalesce("total", "n")).alias("total")), "pii-patterns")
    scores = materialise(seeds.select("instance", F.col("seed").cast("double").alias("s")), "pii-scores")
    for k in range(rounds):
        patterns = graph.join(scores, "instance").groupBy("pattern").agg(F.sum(F.col("n") * F.col("s")).alias("hits")).join(size, "pattern").select("pattern", "instances", (F.col("hits") / (F.col("total") + prior)).alias("score"))
        patterns = materialise(patterns, "pii-patterns")
        if k + 1 < rounds:
            miss = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9))))
            of = graph.join(patterns, "pattern").groupBy("instance").agg(F.max("seed").alias("seed"), miss.alias("miss"))
            scores = materialise(of.select("instance", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("miss")).alias("s")), "pii-scores")
    return patterns


def few(patterns: DataFrame, most: int) -> frozenset[str] | None:
    """The patterns, if there are ``most`` at most."""
    rows = patterns.select("pattern").limit(most + 1).collect()
    return frozenset(r["pattern"] for r in rows) if len(rows) <= most else None


def learn_patterns(extracted: DataFrame, docs: DataFrame, text_col: str = "text", support: int = 5, confidence: float = 0.6, most_patterns: int = MOST_PATTERNS) -> DataFrame:
    """(pattern) of at least ``support`` different instances and the given
    confidence. Up to ``most_patterns`` cues are sent to the executors to be
    counted; if there are more, all cues are counted and joined."""
    edges = extracted.select(F.explode("edges").alias("e")).select("e.*")
    induced = edges.where("seed").groupBy("pattern").agg(F.count_distinct("instance").alias("seeds")).where(F.col("seeds") >= support)
    induced = materialise(induced.select("pattern"), "pii-induced")
    cues = induced.where(F.col("pattern").startswith("c:"))
    known = few(cues, most_patterns)
    totals = cue_totals(docs, known, text_col)
    totals = totals if known is not None else totals.join(cues, "pattern", "left_semi")
    edges = edges.join(induced, "pattern", "left_semi")
    good = score_patterns(edges, totals).where((F.col("score") >= confidence) & (F.col("instances") >= support))
    return materialise(good.select("pattern"), "pii-good")


def spots_of_texts(extracted: DataFrame, good: DataFrame) -> DataFrame:
    """(key, salt, spots) of each text with candidates that the patterns mark,
    once for each salt; for patterns too many to be sent to executors."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    found = extracted.select(_KEY, F.explode("found").alias("f")).select(_KEY, "f.*").dropDuplicates([_KEY, "start"])
    found = found.withColumn("salt", F.pmod(F.xxhash64(_KEY, "start"), F.lit(SALTS)).cast("int"))
    tied = found.select(_KEY, "start", "end", "salt", F.explode(F.array("cue", "form")).alias("pattern")).where("pattern IS NOT NULL")
    tied = tied.join(good.select("pattern", salts.alias("salt")), ["pattern", "salt"]).select(_KEY, "start", "end").distinct()
    return tied.groupBy(_KEY).agg(F.collect_list(F.struct("start", "end")).alias("spots")).select(_KEY, salts.alias("salt"), "spots")


def with_spots(rows: DataFrame, id_col: str, spots: DataFrame) -> DataFrame:
    """The rows, which have their texts' keys, with the spots of their texts."""
    salt = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(SALTS)).cast("int")
    spots = spots.select(F.col(_KEY).alias("_of"), F.col("salt").alias("_salt"), F.col("spots").alias("_pii_spots"))
    return rows.join(spots, (rows[_KEY] == F.col("_of")) & (salt == F.col("_salt")), "left").drop("_of", "_salt")


def with_found(base: list[Span], found: list[tuple[int, int]]) -> list[Span]:
    return sorted(base + [(s, "id", e) for s, e in found], key=lambda s: (s[0], KINDS.index(s[1])))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id) of every row.

    What patterns can mark (kind ``id``) are runs of eight or more letters,
    digits and _+/- that hold a digit; shorter ones, and those of letters alone,
    are never taken for identifiers. A null text is empty: no spans. Ids may be
    null or repeat, each row has its own result; an empty table gives an empty
    result; other columns are not read. ``options`` go to ``learn_patterns``.
    """
    extracted = materialise(extract(docs, id_col, text_col), "pii-extracted")
    learnt = learn_patterns(extracted, docs, text_col, **options)
    patterns = few(learnt, options.get("most_patterns", MOST_PATTERNS))
    good = None if patterns is None else docs.sparkSession.sparkContext.broadcast(patterns)

    def run(batches):
        for b in batches:
            spans, n_id = [], []
            for base, found in zip(b.column(6).to_pylist(), b.column(7).to_pylist(), strict=True):
                own = [(int(s), k, int(e)) for k, s, e in (x.split(":") for x in base.split(",") if x)]
                new = [(x["start"], x["end"]) for x in found or () if good is None or x["cue"] in good.value or x["form"] in good.value]
                spans.append(joined(with_found(own, new)))
                n_id.append(len(new))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(spans, pa.string()), pa.array(n_id, pa.int64())], names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_id"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_id long"
    columns = [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base"]
    if good is None:
        marked = with_spots(extracted.drop("edges", "found"), id_col, spots_of_texts(extracted, learnt))
        return in_batches(marked, [*columns, "_pii_spots"], run, schema)
    return in_batches(extracted, [*columns, "found"], run, schema)


def redact(text: str, good: frozenset[str]) -> str:
    """The text with its spans replaced by their kinds in angle brackets;
    overlapping spans are replaced together, by the first one's kind."""
    base = base_spans(text)
    return replaced(text, with_found(base, [(s, e) for s, e, _, c, f in candidates(text, base) if c in good or f in good]))


def replaced(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, personal data in the texts
    replaced. Null texts stay null; n_chars, if there, is not changed."""
    extracted = materialise(extract(docs, id_col, text_col), "pii-extracted")
    learnt = learn_patterns(extracted, docs, text_col, **options)
    patterns = few(learnt, options.get("most_patterns", MOST_PATTERNS))
    at = docs.columns.index(text_col)
    if patterns is None:

        def mark(batches):
            for b in batches:
                spots = ([(x["start"], x["end"]) for x in s or ()] for s in b.column(len(docs_columns)).to_pylist())
                texts = [None if t is None else replaced(t, with_found(base_spans(t), s)) for t, s in zip(b.column(at).to_pylist(), spots, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, b.column(at).type) if k == at else b.column(k) for k in range(len(docs_columns))], names=docs_columns)

        docs_columns = docs.columns
        marked = with_spots(docs.withColumn(_KEY, text_key(text_col)), id_col, spots_of_texts(extracted, learnt))
        return in_batches(marked, [*docs_columns, "_pii_spots"], mark, docs.schema)
    good = docs.sparkSession.sparkContext.broadcast(patterns)

    def run(batches):
        for b in batches:
            texts = [None if t is None else redact(t, good.value) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.column(at).type))

    return in_batches(docs, docs.columns, run, docs.schema)
