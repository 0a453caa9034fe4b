"""Queries over the operators on texts that run numpy or tokenizer libraries inside tasks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake.llm import fill_in_middle, fingerprints, packing, quality, sharding, simhash, substring_dedup, token_counts
from evidence_lake.llm.registry import query, table


@query("op1_sampled_splitter_shards")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, 8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op2_document_fingerprints")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, folder, "documents").select("doc_id", "text"))


SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (
  SELECT doc_id, p, array_to_string(w[p : p + 19], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS k FROM x),
g AS (SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, unnest(range(p, p + 20)) AS q FROM r WHERE k > 1) GROUP BY doc_id),
k AS (
  SELECT d.doc_id, string_agg(word, ' ' ORDER BY q) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d) d
  LEFT JOIN (SELECT doc_id, unnest(gone) AS q FROM g) g USING (doc_id, q) WHERE g.q IS NULL GROUP BY d.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@query("op3_substring_dedup", SUBSTRING_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.dedup_passages(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op4_best_fit_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


@query("op8_quality_classifier")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality.score_documents(docs, table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op9_token_counts")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = docs.withColumn(
        "n_tokens", token_counts.token_count(spark, public_tokenizers.path("piece_bpe_32k.model"), F.col("text"))
    )
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return counted.select(
        "doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit")
    )


FILL_IN_MIDDLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || doc_id) AS h
  FROM documents),
c AS (
  SELECT doc_id, text, w, len(w) AS n, [('0x' || h[8 * k + 1 : 8 * k + 8])::BIGINT FOR k IN range(4)] AS h FROM d),
f AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM c),
p AS (
  SELECT *, array_to_string(w[1 : a], '') AS prefix, array_to_string(w[a + 1 : b], '') AS middle, array_to_string(w[b + 1 : n], '') AS suffix
  FROM f)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


@query("op12_fill_in_middle", FILL_IN_MIDDLE_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    moved = fill_in_middle.fill_in_middle(docs)
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    return moved.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored, 256).alias("restored_sha256"),
    )
