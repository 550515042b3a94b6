"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import license_scan, media_fingerprint, near_dedup, packing, pii, quality_classifier, quality_rules, token_counts, warc, wfst


#: The target mixture of op4: these sources' weights, and that of all others together.
MIXTURE, OTHERS = {"src0": 30, "src1": 6, "src2": 4}, 60


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_fingerprint.match(_read(spark, sf_dir, "embeddings"))


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), weights=MIXTURE, others=OTHERS, with_ids=False)


def op5_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_read(spark, sf_dir, "documents"))


def op6_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op7_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_read(spark, sf_dir, "pages"))


def op8_wfst_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfst.encode_decode(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op10_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(_read(spark, sf_dir, "documents"))
    base = ~quality_rules.kept("base")
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & quality_rules.kept("v1")).alias("kept"), "failed_bits")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_token_counts, op3_media_fingerprints, op4_mixture_packing, op5_pii_boosting, op6_setsketch_near_dedup,
        op7_warc_dictionary, op8_wfst_sentencepiece, op9_license_scan, op10_rule_ledger, pipeline,
    )
}

#: Words are runs of characters other than space and 9 to 13; windows of three words are
#: counted within their document, and a word counts once if any of its windows repeats.
_OP10 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
lines AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS nth
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^ \x09-\x0D]')),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (nth > 1) AS n_dup_lines FROM lines GROUP BY doc_id),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times
  FROM (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d))),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE times > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines,
         len(list_filter(ws, lambda w: length(w) > 1 AND w = upper(w) AND w <> lower(w))) AS shout
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
       + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
       + (CASE WHEN 100 * n_symbols > 6 * word_chars THEN 4 ELSE 0 END)
       + (CASE WHEN n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
       + (CASE WHEN 100 * shout > 40 * n_words THEN 16 ELSE 0 END)
       + (CASE WHEN word_chars > 30 * n_words THEN 32 ELSE 0 END) AS bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, bits::BIGINT AS failed_bits
FROM f
"""

_OP7 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN last IS NOT NULL AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last IS NOT NULL AND page_id <> last THEN last END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""

ORACLE_SQL: dict[str, str] = {"op7_warc_dictionary": _OP7, "op10_rule_ledger": _OP10}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
