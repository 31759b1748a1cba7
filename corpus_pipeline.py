"""A corpus pipeline: language, quality, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet to the shared folder and reads again for the next one. All
stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumicurve.llm import language_id, quality
from lumicurve.llm.common import split_by_ids
from lumicurve.llm.ngram_join import jaccard_components
from lumicurve.llm.packing import pack_sequences
from lumicurve.llm.pii import redact_personal_data
from lumicurve.session import materialise


#: What stand-ins for missing ids begin with where ids are strings: the last code point.
LAST = "\U0010ffff"


def identified_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; texts without letters, empty or null go."""
    return language_id.language_filter(docs, language_id.train(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_filter(docs, quality.train(docs, labels))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (Jaccard similarity of 0.8 or more over
    five-word n-grams) the document with the least id; of rows that repeat an
    id, the one with the least text. Rows without an id are documents of their
    own, behind all that have one. Ids are whole numbers below 2^62 or strings."""
    named, nameless = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    if nameless.isEmpty():
        return _first_of_groups(named)
    # Stand-ins that sort behind all real ids, written so that they cannot change.
    number = F.monotonically_increasing_id()
    if isinstance(docs.schema["doc_id"].dataType, StringType):
        stand_in, is_real = F.concat(F.lit(LAST), F.lpad(number.cast("string"), 20, "0")), ~F.startswith("doc_id", F.lit(LAST))
    else:
        stand_in, is_real = (F.lit(1 << 62) + number).cast(docs.schema["doc_id"].dataType), F.col("doc_id") < (1 << 62)
    numbered = materialise(nameless.withColumn("doc_id", stand_in), "nameless")
    kept = _first_of_groups(named.unionByName(numbered))
    return kept.withColumn("doc_id", F.when(is_real, F.col("doc_id")))


def _first_of_groups(docs: DataFrame) -> DataFrame:
    linked = jaccard_components(docs, n=5, percent=80)
    # Those that go are fewer than those that stay; texts of the others are not shuffled.
    gone = materialise(linked.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays")).where("NOT stays").select("doc_id"), "gone")
    named = split_by_ids(docs, gone, "doc_id")[1]
    repeated = materialise(linked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "several")
    if repeated.isEmpty():
        return named
    several, once = split_by_ids(named, repeated, "doc_id")
    row = F.struct("text", *[c for c in docs.columns if c != "text"])
    first = several.groupBy("doc_id").agg(F.min(row).alias("row"))
    return once.union(first.select([F.col("row")[c].alias(c) for c in docs.columns]))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return redact_personal_data(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2,048 tokens, with their ids."""
    return pack_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0, with_ids=True)


STAGES = [
    ("language_id", identified_language),
    ("quality_rules", good_quality),
    ("ngram_jaccard_join", one_of_each_group),
    ("personal_data", without_personal_data),
    ("best_fit_packing", packed),
]

#: SQL cannot express the learned stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
