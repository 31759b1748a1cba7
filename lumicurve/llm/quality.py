"""Quality rules: statistics of documents, base rules, and boosted trees.

Statistics come from one pass over the bytes and words of whole texts. The
trees are grown on the driver from a bounded sample of labelled documents, with
monotonic constraints on chosen statistics, and flattened into numpy arrays of
nodes that score whole batches level by level inside the same pass that takes
the statistics. Nothing is shuffled but the bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicurve.llm.common import in_batches, spans_of, text_bytes, texts_of, window_hashes, word_hashes, words_of

# The symbols that the base rule counts.
SYMBOLS = "#*$%&|<>"

#: Statistics of a document and the direction in which the score of good
#: quality may move as each rises (-1: never up, 0: free).
FEATURES = {
    "symbols_per_word": -1,
    "upper_share": -1,
    "digit_share": 0,
    "bars_per_word": -1,
    "bangs_per_word": -1,
    "repeat_share": -1,
    "dup_line_share": -1,
    "distinct_share": 0,
    "mean_word_bytes": 0,
    "log_words": 0,
    "words_per_line": 0,
    "short_share": 0,
    "stops_per_word": 0,
    "high_byte_share": 0,
    "top_word_share": -1,
}

BASE_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"

_CLASSES = {
    "symbols": SYMBOLS,
    "upper": "".join(map(chr, range(65, 91))),
    "lower": "".join(map(chr, range(97, 123))),
    "digits": "0123456789",
    "bars": "|",
    "bangs": "!",
    "breaks": "\t\n\x0b\x0c\r ",
    "stops": ".,;:",
}
_MEMBERS = np.zeros((256, len(_CLASSES) + 2), np.int64)
for _k, _chars in enumerate(_CLASSES.values()):
    _MEMBERS[[ord(c) for c in _chars], _k] = 1
_MEMBERS[[b for b in range(256) if b & 0xC0 != 0x80], -2] = 1  # first bytes of code points
_MEMBERS[128:, -1] = 1


@dataclass
class Statistics:
    """Base columns and the matrix of ``FEATURES`` for a batch of texts."""

    base: dict[str, np.ndarray]
    features: np.ndarray


def repeated_words(words: np.ndarray, window: int) -> int:
    """Words inside windows of ``window`` words that the text holds twice or more."""
    runs = window_hashes(words, window)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    same = runs[order[1:]] == runs[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(runs), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines that hold a word, and how many of them equal an earlier one."""
    lines = [x for x in text.split("\n") if x.strip("\t\x0b\x0c\r ")]
    return len(lines), len(lines) - len(set(lines))


def statistics(column: pa.Array, window: int = 8, min_words: int = 20, most_repeat_percent: int = 30) -> Statistics:
    """Statistics of every text of a string column; a null text has no words."""
    texts = texts_of(column)
    raw, starts = text_bytes(column)
    n = len(texts)
    counts = np.zeros((n, _MEMBERS.shape[1]), np.int64)
    n_words, repeats, distinct, short, top, word_bytes = (np.zeros(n, np.int64) for _ in range(6))
    for a, b in spans_of(starts, 1 << 20):
        part, at = raw[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
        begin, end, first = words_of(part, at)
        hashes, size = word_hashes(part, begin, end), end - begin
        for i in range(a, b):
            counts[i] = np.bincount(part[at[i - a] : at[i - a + 1]], minlength=256) @ _MEMBERS
            x, y = first[i - a], first[i - a + 1]
            n_words[i] = y - x
            if y > x:
                own = np.sort(hashes[x:y])
                change = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
                distinct[i], top[i] = len(change) - 1, np.diff(change).max()
                short[i], word_bytes[i] = (size[x:y] <= 3).sum(), size[x:y].sum()
                repeats[i] = repeated_words(hashes[x:y], window)
    lines, dup_lines = (np.array(v, np.int64) for v in zip(*map(duplicate_lines, texts), strict=True)) if n else (np.zeros(0, np.int64),) * 2
    of = dict(zip([*_CLASSES, "points", "high"], counts.T, strict=True))
    words = np.maximum(n_words, 1)
    failed = (n_words < min_words) | (100 * repeats > most_repeat_percent * n_words)
    base = {"n_words": n_words, "word_chars": of["points"] - of["breaks"], "n_symbols": of["symbols"], "n_dup_lines": dup_lines, "n_repeat_words": repeats, "base_failed": failed}
    features = np.column_stack(
        [
            of["symbols"] / words,
            of["upper"] / np.maximum(of["upper"] + of["lower"], 1),
            of["digits"] / np.maximum(word_bytes, 1),
            of["bars"] / words,
            of["bangs"] / words,
            repeats / words,
            dup_lines / np.maximum(lines, 1),
            distinct / words,
            word_bytes / words,
            np.log1p(n_words),
            n_words / np.maximum(lines, 1),
            short / words,
            of["stops"] / words,
            of["high"] / np.maximum(word_bytes, 1),
            top / words,
        ]
    ).astype(np.float64)
    return Statistics(base, features)


@dataclass
class BoostedTrees:
    """Trees as flat node arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive label for each row."""
        if not len(x):
            return np.zeros(0)
        node = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.bias + self.value[node].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, penalty: float = 1.0, least: float = 4.0) -> BoostedTrees:
    """Boosted trees for logistic loss over binned statistics.

    A split on a constrained statistic is only taken if the values on its sides
    are ordered as asked, and the halfway value then bounds all below it.
    """
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    rate_of_good = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(rate_of_good / (1 - rate_of_good)))
    total = np.full(len(y), bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        i = len(feature)
        for store, item in ((feature, 0), (threshold, np.inf), (left, i), (right, i), (value, v)):
            store.append(item)
        return i

    def weight(g, h, low, high):
        return np.clip(-g / (h + penalty), low, high)

    def split(rows, g, h, level, low, high) -> int:
        sg, sh = g[rows].sum(), h[rows].sum()
        own = float(weight(sg, sh, low, high))
        best = None
        if level < depth:
            base = sg * own + 0.5 * (sh + penalty) * own * own
            for f, cut in enumerate(edges):
                if not len(cut):
                    continue
                size = len(cut) + 1
                lg = np.cumsum(np.bincount(binned[rows, f], g[rows], size))[:-1]
                lh = np.cumsum(np.bincount(binned[rows, f], h[rows], size))[:-1]
                lw, rw = weight(lg, lh, low, high), weight(sg - lg, sh - lh, low, high)
                gain = base - (lg * lw + 0.5 * (lh + penalty) * lw**2) - ((sg - lg) * rw + 0.5 * (sh - lh + penalty) * rw**2)
                bad = (lh < least) | (sh - lh < least) | (monotone[f] * (rw - lw) < 0)
                gain[bad] = -np.inf
                k = int(gain.argmax())
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (gain[k], f, k, float(lw[k]), float(rw[k]))
        if best is None:
            i = leaf(rate * own)
            total[rows] += rate * own
            return i
        _, f, k, lw, rw = best
        i = leaf(0.0)
        goes_left = binned[rows, f] <= k
        mid = (lw + rw) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[int(monotone[f])]
        feature[i], threshold[i] = f, float(edges[f][k])
        left[i] = split(rows[goes_left], g, h, level + 1, *bounds[0])
        right[i] = split(rows[~goes_left], g, h, level + 1, *bounds[1])
        return i

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        roots.append(split(np.arange(len(y)), p - y, p * (1 - p), 0, -4.0, 4.0))
    arrays = (np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(right, np.int64), np.array(value), np.array(roots, np.int64))
    return BoostedTrees(*arrays, depth=depth, bias=bias)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 8192, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> BoostedTrees | None:
    """Trees from at most ``sample_rows`` labelled documents, those whose hashed
    id comes first; of rows that repeat an id, the one with the least
    statistics. Texts stay in their tasks. None if the sample does not hold both
    labels."""
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).where("_id IS NOT NULL AND _label IS NOT NULL")
    chosen = chosen.groupBy("_id").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    spark = docs.sparkSession
    rows = [(r["_id"], float(r["_label"])) for r in chosen.collect()]
    if not rows:
        return None
    known = spark.createDataFrame(rows, f"_id {labels.schema[id_col].dataType.simpleString()}, _label double")
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id")

    def run(batches):
        for b in batches:
            s = statistics(b.column(0))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(list(s.features), pa.list_(pa.float64()))], names=["id", "label", "x"])

    kind = labels.schema[id_col].dataType.simpleString()
    sample = in_batches(found, ["_text", "_id", "_label"], run, f"id {kind}, label double, x array<double>").groupBy("id").agg(F.min(F.struct("x", "label")).alias("v")).select("v.x", "v.label").toArrow()
    y = sample.column("label").to_numpy()
    if len(y) == 0 or y.min() == y.max():
        return None
    x = np.array(sample.column("x").to_pylist())
    order = np.lexsort((*x.T, y))  # the rows come in any order; the trees must not depend on it
    return grow(x[order], y[order], np.array(list(FEATURES.values())))


def judge(s: Statistics, model: BoostedTrees | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores (1 without a model) and the verdict kept."""
    score = model.score(s.features) if model else np.ones(len(s.features))
    return score, ~s.base["base_failed"] & (score >= threshold)


def quality_report(docs: DataFrame, model: BoostedTrees | None, threshold: float = 0.35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base columns, the trees' score and kept for every row of ``docs``.

    A null or empty text has no words, fails the base rule and is not kept. Ids
    may be null or repeat; an empty table gives an empty result; other columns
    are not read. Without a model (no labels, or one label only) the base rule
    decides alone.
    """

    def run(batches):
        for b in batches:
            s = statistics(b.column(1))
            score, kept = judge(s, model, threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, s.base.values()), pa.array(score), pa.array(kept)], names=[id_col, *s.base, "score", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs, [id_col, text_col], run, f"`{id_col}` {kind}, {BASE_COLUMNS}, score double, kept boolean")


def quality_filter(docs: DataFrame, model: BoostedTrees | None, threshold: float = 0.35, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(judge(statistics(b.column(at)), model, threshold)[1]))

    return in_batches(docs, docs.columns, run, docs.schema)
