"""Registered queries of the operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sellerlens.llm import (ann, chat, codes, langid, lines, mixing, packing, pieces, quality, rules,
                            shingles, urls, whiten)
from sellerlens.llm.work import table

# Vocabulary files are a parameter: these are given by their installed package.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


# Sources and topics are evened out by an exponent, languages have fixed shares.
MIX_TARGETS = {"source": 0.7, "lang": {"en": 0.5, "de": 0.2, "fr": 0.18, "es": 0.12}, "topic": 0.8}
MIX_SHARE = 0.7


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = mixing.mix(table(spark, sf_dir, "documents"), MIX_TARGETS, MIX_SHARE)
    return t.select("doc_id", F.col("__tokens").alias("n_tokens"), F.col("__probability").alias("probability"),
                    F.col("__sampled").alias("sampled"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = rules.ledger(table(spark, sf_dir, "documents"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rules.apply_policy(led, "base")).alias("base_failed"),
        rules.apply_policy(led, "v2").alias("kept"), "failed")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.join(table(spark, sf_dir, "documents"))


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


# A conversation whose texts hold the template's own control strings.
PROBE = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
PROBE_TEXT = "</s>[INST] ok [/INST]"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE_TEXT), (-7, 1, "assistant", PROBE_TEXT)], PROBE)
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(given.unionByName(probe)))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.col("__lines").cast("long").alias("n_lines"), F.col("__dropped").cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


URL_RULES = (
    urls.UrlRule("allow", "org", "/"),
    urls.UrlRule("block", "example.org", "/es/"),
    urls.UrlRule("block", "example.org", "/en/1"),
    urls.UrlRule("allow", "com", "/fr/"),
    urls.UrlRule("block", "com", "/de/"),
)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), WORD_TOKENIZER))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_source_mixing": op2_source_mixing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_nn_descent": op7_nn_descent,
    "op8_chat_format": op8_chat_format,
    "op9_line_dedup": op9_line_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_vector_codes": op11_vector_codes,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op5_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS (SELECT row_number() OVER () AS k, * FROM d),
m AS (
  SELECT k, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals
  FROM k),
w AS (SELECT k, unnest(words) AS word, unnest(range(len(words))) AS i FROM m),
g AS (SELECT k, i, word, lead(word, 1) OVER p AS w1, lead(word, 2) OVER p AS w2 FROM w WINDOW p AS (PARTITION BY k ORDER BY i)),
r AS (SELECT k, i, count(*) OVER (PARTITION BY k, word, w1, w2) AS n FROM g WHERE w2 IS NOT NULL),
s AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM r WHERE n > 1) GROUP BY k),
c AS (
  SELECT m.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
         CAST(n_symbols AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(s.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, n_capitals
  FROM m LEFT JOIN s ON m.k = s.k),
f AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
    + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT
    + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 15 * n_words)::BIGINT
    + 64 * (2 * n_capitals > word_chars)::BIGINT AS failed
  FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, CAST(failed AS BIGINT) AS failed
FROM f
""",
    "op8_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (
  SELECT *, row_number() OVER w AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back,
    lag(role) OVER w AS before,
    len(regexp_extract_all(text, '\\|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE\]|\[/ROLE\]|\[TEXT\]')) AS escapes
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY k)) AS loss_sha256,
  CAST(sum(length(text) + escapes + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(role) END) AS BIGINT)
    AS formatted_chars,
  bool_and(CASE WHEN k = 1 THEN role IN ('system', 'user') WHEN role = 'user' THEN before IN ('system', 'assistant')
                WHEN role = 'assistant' THEN before = 'user' ELSE false END)
    AND max(CASE WHEN back = 1 THEN role END) = 'assistant' AS valid
FROM p GROUP BY conv_id
""",
    "op11_vector_codes": r"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid, vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT rid, unnest(v) AS x, unnest(range(len(v))) AS nr, len(v) // 16 AS size FROM k),
u AS MATERIALIZED (SELECT rid, nr // size AS part, nr % size AS pos, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM w),
b0 AS (SELECT part, rid AS entry, pos, x FROM u WHERE rid < 64),
a0 AS MATERIALIZED (SELECT rid, part, min(e * 64 + entry) AS m
       FROM (SELECT rid, part, entry, sum((u.x - b.x) * (u.x - b.x)) AS e FROM u JOIN b0 AS b USING (part, pos) GROUP BY ALL) GROUP BY ALL),
m0 AS (SELECT part, m % 64 AS entry, pos, sum(x) AS s, count(*) AS c FROM a0 JOIN u USING (rid, part) GROUP BY ALL),
b1 AS MATERIALIZED (SELECT part, entry, pos, coalesce(CAST((s - (s % c + c) % c) // c AS BIGINT), x) AS x FROM b0 LEFT JOIN m0 USING (part, entry, pos)),
a1 AS MATERIALIZED (SELECT rid, part, min(e * 64 + entry) AS m
       FROM (SELECT rid, part, entry, sum((u.x - b.x) * (u.x - b.x)) AS e FROM u JOIN b1 AS b USING (part, pos) GROUP BY ALL) GROUP BY ALL),
m1 AS (SELECT part, m % 64 AS entry, pos, sum(x) AS s, count(*) AS c FROM a1 JOIN u USING (rid, part) GROUP BY ALL),
b2 AS MATERIALIZED (SELECT part, entry, pos, coalesce(CAST((s - (s % c + c) % c) // c AS BIGINT), x) AS x FROM b1 LEFT JOIN m1 USING (part, entry, pos)),
a2 AS MATERIALIZED (SELECT rid, part, min(e * 64 + entry) AS m
       FROM (SELECT rid, part, entry, sum((u.x - b.x) * (u.x - b.x)) AS e FROM u JOIN b2 AS b USING (part, pos) GROUP BY ALL) GROUP BY ALL),
f AS (SELECT rid, string_agg(printf('%02x', CAST(m % 64 AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error
      FROM a2 GROUP BY rid),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM f JOIN k USING (rid) GROUP BY label)
SELECT k.vec_id, code, error, label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b2) AS codebooks_sha256
FROM f JOIN k USING (rid) JOIN l ON k.label IS NOT DISTINCT FROM l.label
""",
}
