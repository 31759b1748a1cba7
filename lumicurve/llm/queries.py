"""The queries of the text operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumicurve.llm import language_id, quality
from lumicurve.llm.byte_bpe import bpe_round_trip
from lumicurve.llm.chat_format import chat_windows, read_back
from lumicurve.llm.embed_dedup import near_duplicates
from lumicurve.llm.filter_audit import filter_audit
from lumicurve.llm.fingerprints import fingerprint_report
from lumicurve.llm.ngram_join import jaccard_components
from lumicurve.llm.packing import pack_sequences
from lumicurve.llm.pii import find_personal_data
from lumicurve.llm.prefix_trie import prefix_trie
from lumicurve.llm.token_counts import token_counts
from lumicurve.llm.url_filter import judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify_languages(docs, language_id.train(docs))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return read_back(chat_windows(rows, budget=4096))


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), a AS (
  SELECT *, strlen(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'))
    + strlen(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) + 20 AS tok FROM t
), b AS (
  SELECT *, row_number() OVER w AS n, sum(tok) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), c AS (
  SELECT *, (upto - 1) // 1024 AS stride, lag((upto - 1) // 1024) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM b
), d AS (
  SELECT *, sum(CASE WHEN before <> stride THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS span FROM c
), e AS (
  SELECT *, max(span) OVER (PARTITION BY conv_id) AS last_span, max(n) OVER (PARTITION BY conv_id, span) AS span_n,
    max(upto) OVER (PARTITION BY conv_id, span) AS span_upto FROM d
), f AS (
  SELECT *, CASE WHEN n = 1 AND role = 'system' THEN 1 + last_span
    WHEN span < last_span AND span_n - n < 2 AND span_upto - upto + tok <= 1024 THEN 2 ELSE 1 END AS times,
    length(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'))
    + length(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) + 20 AS chars FROM e
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(times * chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
""".replace("\\\\", "\\")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS grams FROM w
), x AS (
  SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM x a JOIN x b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM c WHERE 100 * common >= 85 * (na + nb - common) UNION ALL SELECT b, a FROM c WHERE 100 * common >= 85 * (na + nb - common)
), reach AS (
  SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
)
SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.b, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = s.doc_id
"""


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.95
), reach AS (
  SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(m.b, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(m.b, v.vec_id)) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = v.vec_id LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = v.vec_id
"""


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_report(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT c, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(strlen(role)::VARCHAR || ':' || role || text)) AS said FROM t GROUP BY c
), h AS (
  SELECT c, said, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda crc, x: list_reduce(list_prepend(xor(crc, x), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda v, y: xor(v >> 1, 3988292384::UBIGINT * (v & 1)))), 4294967295::UBIGINT)::BIGINT % 4 AS h FROM o
), w AS (
  SELECT h.c, list_concat(coalesce(p.said, [])[1:h.h], h.said[h.h + 1:]) AS path FROM h LEFT JOIN o p ON p.c = h.c - h.c % 20
), e AS (
  SELECT c, len(path) AS size, unnest(range(0, len(path) + 1)) AS d, path FROM w
), k AS (
  SELECT c, size, d, path[1:d] AS key, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) END AS words FROM e
), n AS (
  SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, max(size) AS deepest, (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = d), '')) AS ends_sha256 FROM k GROUP BY d, key
), up AS (
  SELECT n.conv_id, n.d, a.d AS top_d, b.conv_id AS top, n.saved, n.deepest FROM n JOIN k a ON a.c = n.conv_id AND a.d <= n.d JOIN n b ON b.d = a.d AND b.key = a.key
), s AS (
  SELECT top, top_d, sum(saved) AS saved_tokens, count(*) FILTER (deepest = d) AS n_leaves, count(*) FILTER (d = top_d + 1) AS n_children FROM up GROUP BY top, top_d
)
SELECT n.conv_id, n.d AS depth, p.top AS parent_conv_id, n.n_convs, CAST(s.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.top = n.conv_id AND s.top_d = n.d LEFT JOIN up p ON p.conv_id = n.conv_id AND p.d = n.d AND p.top_d = n.d - 1
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT w.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic, [
    len(words) < 50,
    100 * len(list_distinct(words)) < 65 * len(words),
    100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t),
    regexp_matches(t, '[#$%&*|]'),
    coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS f
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id
), one AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM one a, one b, one c, one d, one e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, strpos('ABCDE', filter_order[step]) AS own, list_transform(range(1, step), lambda k: strpos('ABCDE', filter_order[k])) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), cells AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, f
), r AS (
  SELECT *, f[own] AS fails, list_bool_or(list_concat([false], list_transform(before, lambda k: f[k]))) AS gone FROM cells, steps
), s AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, any_value(own) AS own,
    CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (fails AND len(list_filter(f, lambda y: y)) = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM r GROUP BY part, filter_order, step
)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM s
"""


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_language_id": op1_language_id,
    "op2_personal_data": op2_personal_data,
    "op3_token_counts": op3_token_counts,
    "op4_url_filters": op4_url_filters,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_filter_audit": op12_filter_audit,
    "op13_fingerprints": op13_fingerprints,
}

ORACLES: dict[str, str] = {
    "op6_ngram_jaccard_join": OP6_SQL,
    "op7_chat_formatting": OP7_SQL,
    "op8_embedding_near_dedup": OP8_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
