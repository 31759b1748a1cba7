"""Language identification in two levels: family first, language within it.

Whole texts become hashed byte n-gram frequencies. One-versus-rest linear
support vector machines choose the language family; within it one-versus-one
machines separate the languages and vote. The machines are fitted on the driver
to a bounded sample of labelled documents; prediction is one pass without a
shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicurve.llm.common import in_batches, spans_of, text_bytes, texts_of

UNKNOWN = "und"

# Languages of a family; a language that is in none is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "baltic": ("lt", "lv"),
    "finnic": ("fi", "et"),
    "indic": ("hi", "bn", "ur", "pa", "mr", "gu", "ne"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "sinitic": ("zh", "yue"),
    "semitic": ("ar", "he", "mt", "am"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

#: Features: hashed byte trigrams and four-grams, half of the buckets for each.
BUCKETS = 2048
#: Features, which are 0 to 1, leave tasks in steps of this fraction.
UNIT = 65535

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_COMMON_LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]")


def has_letter(text: str) -> bool:
    return _COMMON_LETTER.search(text) is not None or any(map(str.isalpha, text))


def features(column: pa.Array, buckets: int = BUCKETS) -> np.ndarray:
    """Square roots of n-gram shares for each text (rows of unit length)."""
    padded = pc.binary_join_element_wise("", pc.utf8_lower(pc.fill_null(column, "").cast(pa.string())), "", " ")
    raw, starts = text_bytes(padded)
    half = buckets // 2
    shift = np.uint32(32 - (half.bit_length() - 1))
    out = np.zeros((len(column), buckets), np.float32)
    for a, b in spans_of(starts, 1 << 20):
        part = _FOLD[raw[starts[a] : starts[b]]].astype(np.uint32)
        at = (starts[a : b + 1] - starts[a]).tolist()
        three = part[:-2] | (part[1:-1] << np.uint32(8)) | (part[2:] << np.uint32(16)) if len(part) > 2 else np.empty(0, np.uint32)
        four = three[:-1] | (part[3:] << np.uint32(24)) if len(part) > 3 else np.empty(0, np.uint32)
        index3 = ((three * np.uint32(0x9E3779B1)) >> shift).astype(np.int64)
        index4 = ((four * np.uint32(0x85EBCA6B)) >> shift).astype(np.int64)
        for i in range(a, b):
            x, y = at[i - a], at[i - a + 1]
            out[i, :half] = np.bincount(index3[x : max(x, y - 2)], minlength=half)
            out[i, half:] = np.bincount(index4[x : max(x, y - 3)], minlength=half)
    return np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1))


def linear_svms(x: np.ndarray, positive: np.ndarray, penalty: float = 1e-4, steps: int = 250) -> np.ndarray:
    """Weights (the last one the bias) of a machine for each column of
    ``positive``, for squared hinge loss, classes balanced, by accelerated
    gradient descent; all machines take each step together."""
    ones = np.ones(positive.shape[1], np.float32)
    sign = np.where(positive, 1.0, -1.0).astype(np.float32)
    good = positive.sum(axis=0)
    weight = np.where(positive, 0.5 / np.maximum(1, good), 0.5 / np.maximum(1, len(x) - good)).astype(np.float32)
    score = lambda w: x @ w[:-1] + w[-1]
    back = lambda v: np.vstack([x.T @ v, v.sum(axis=0)])
    probe = np.ones((x.shape[1] + 1, len(ones)), np.float32)
    for _ in range(12):
        probe = back(weight * score(probe))
        top = np.linalg.norm(probe, axis=0)
        probe /= np.maximum(top, 1e-12)
    rate = (1 / (penalty + 2.2 * top)).astype(np.float32)
    w = ahead = np.zeros_like(probe)
    t = 1.0
    for _ in range(steps):
        gap = np.maximum(0, 1 - sign * score(ahead))
        new = ahead - rate * (penalty * ahead - 2 * back(weight * sign * gap))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + np.float32((t - 1) / t_new) * (new - w)
        w, t = new, t_new
    return w


@dataclass
class LanguageModel:
    """Weights of the family machines and of the pairs inside each family."""

    mean: np.ndarray
    families: list[str]
    family_weights: np.ndarray  # one column for each family
    languages: dict[str, list[str]]
    pair_weights: dict[str, np.ndarray]  # of each family, a column for each pair

    @classmethod
    def fit(cls, x: np.ndarray, langs: np.ndarray) -> "LanguageModel":
        mean = x.mean(axis=0)
        x -= mean
        family = np.array([FAMILY_OF.get(lang, lang) for lang in langs])
        names = sorted(set(family.tolist()))
        weights = linear_svms(x, family[:, None] == np.array(names)) if len(names) > 1 else np.zeros((x.shape[1] + 1, 1), np.float32)
        languages, pairs = {}, {}
        for f in names:
            own = family == f
            languages[f] = sorted(set(langs[own].tolist()))
            columns = [linear_svms(x[m], (langs[m] == a)[:, None]) for a, b in combinations(languages[f], 2) for m in [own & np.isin(langs, [a, b])]]
            pairs[f] = np.hstack(columns) if columns else np.zeros((x.shape[1] + 1, 0), np.float32)
        return cls(mean, names, weights, languages, pairs)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """A language and a score (0 to 1) for each row: how sure the family is
        times how sure the language is in it."""
        x = np.column_stack([x - self.mean, np.ones(len(x), np.float32)])
        out, score = np.empty(len(x), object), np.ones(len(x))
        margin = x @ self.family_weights
        chosen = margin.argmax(axis=1)
        if len(self.families) > 1:
            two = np.sort(margin, axis=1)[:, -2:]
            score *= _sure(two[:, 1] - two[:, 0])
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(chosen == k)
            langs = self.languages[f]
            if len(langs) == 1 or not len(rows):
                out[rows] = langs[0]
                continue
            votes, sums = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            for m, (i, j) in zip((x[rows] @ self.pair_weights[f]).T, combinations(range(len(langs)), 2), strict=True):
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                sums[:, i] += m
                sums[:, j] -= m
            best = (votes + 1e-3 * np.tanh(sums)).argmax(axis=1)
            out[rows] = np.array(langs, object)[best]
            score[rows] *= _sure(2 * sums[np.arange(len(rows)), best] / (len(langs) - 1))
        return out.tolist(), score


def _sure(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-2.0 * np.clip(margin, -15, 15)))


def held_out(id_col: str = "doc_id", fold: int = 2, folds: int = 4) -> Column:
    """Whether crc32 of the id's text falls into the fold that is never learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def train(docs: DataFrame, per_language: int = 1200, sample_rows: int = 9600, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """A model of all languages outside the held-out fold. None if there are none.

    The sample is bounded: about ``per_language`` documents of each language, or
    as many fewer as ``sample_rows`` in all asks for, but one at least. It takes
    those with the least hashes of id and text; repeated rows count once. Texts
    stay in their tasks, only their features leave them.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where(F.col("_id").isNotNull() & F.col("_text").isNotNull() & F.col("_lang").isNotNull() & ~held_out("_id"))
    rows = rows.select("_lang", "_text", F.xxhash64("_id", "_text").alias("_hash"))
    span = float(2**64)
    # The least hash of each language and its number of rows; shares of the range of hashes then bound the sample.
    counts = [(r["_lang"], r["n"], r["least"]) for r in rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n"), F.min("_hash").alias("least")).orderBy("_lang").collect()]
    if not counts:
        return None
    each = max(1, min(per_language, sample_rows // len(counts)))
    top = {lang: max(least, int(-(2**63) + span * min(1.0, each / n)) - 1) for lang, n, least in counts}
    limits = rows.sparkSession.createDataFrame([(lang, min(x, 2**63 - 1)) for lang, x in top.items()], "_lang string, _top long")
    chosen = rows.join(F.broadcast(limits), "_lang").where("_hash <= _top").select("_text", "_lang", "_hash")

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            fresh = [k for k, h in enumerate(b.column(2).to_pylist()) if h not in seen and not seen.add(h)]
            b = b.take(pa.array(fresh, pa.int64()))
            steps = np.round(features(b.column(0)) * UNIT).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([r.tobytes() for r in steps], pa.binary())], names=["lang", "hash", "x"])

    found = in_batches(chosen, ["_text", "_lang", "_hash"], run, "lang string, hash long, x binary").dropDuplicates(["lang", "hash"])
    sample = found.toArrow().sort_by([("lang", "ascending"), ("hash", "ascending")])
    if not len(sample):
        return None
    x = np.empty((len(sample), BUCKETS), np.float32)
    for k, v in enumerate(sample.column("x")):
        x[k] = np.frombuffer(v.as_buffer(), np.uint16)
    return LanguageModel.fit(x / np.float32(UNIT), np.array(sample.column("lang").to_pylist(), object))


def predict_batch(column: pa.Array, model: LanguageModel | None) -> tuple[list[str], np.ndarray]:
    """``UNKNOWN`` with score 0 where a text is null, has no letters, or there is no model."""
    known = np.fromiter(map(has_letter, texts_of(column)), bool, len(column))
    if model is None or not len(column):
        return [UNKNOWN] * len(column), np.zeros(len(column))
    langs, score = model.predict(features(column))
    return [lang if k else UNKNOWN for lang, k in zip(langs, known, strict=True)], np.where(known, score, 0.0)


def identify_languages(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred and score for every row of ``docs``.

    Ids may repeat (each row gets its own result) or be null (held_out is
    false, and the row was not learned from). An empty table gives an empty
    result; other columns are not read.
    """

    def run(batches):
        for b in batches:
            langs, score = predict_batch(b.column(2), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(score)], names=[id_col, "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(id_col, held_out(id_col).alias("_held"), F.col(text_col).alias("_text"))
    return in_batches(narrow, [id_col, "_held", "_text"], run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def language_filter(docs: DataFrame, model: LanguageModel | None, keep: Iterable[str] | None = None, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is known (and in
    ``keep``, if given) with a score of at least ``least``."""
    at, wanted = docs.columns.index(text_col), None if keep is None else set(keep)

    def run(batches):
        for b in batches:
            langs, score = predict_batch(b.column(at), model)
            yield b.filter(pa.array([lang != UNKNOWN and s >= least and (wanted is None or lang in wanted) for lang, s in zip(langs, score, strict=True)]))

    return in_batches(docs, docs.columns, run, docs.schema)
