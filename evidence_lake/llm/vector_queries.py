"""Queries over the operators on vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake.llm import code_compression, graph_search
from evidence_lake.llm.registry import query, table

# op11 -----------------------------------------------------------------------------------------


def _near_sql(parts: str, books: str) -> str:
    """The nearest entry of each part (vec_id, part, x): ties go to the lower number."""
    return f"""
SELECT vec_id, part, x, arg_min(entry, d * 64 + entry) AS entry, min(d * 64 + entry) // 64 AS d
FROM (SELECT p.*, b.entry, list_sum([(p.x[i] - b.e[i]) * (p.x[i] - b.e[i]) FOR i IN range(1, len(p.x) + 1)])::BIGINT AS d
  FROM {parts} p JOIN {books} b USING (part)) GROUP BY vec_id, part, x"""


def _mean_sql(near: str, books: str) -> str:
    """Floored means; unused entries stay."""
    return f"""
SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM {books} b LEFT JOIN (
  SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e
  FROM (SELECT part, entry, i, sum(x[i])::BIGINT AS s, count(*) AS n
    FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM {near}) GROUP BY part, entry, i) GROUP BY part, entry) m USING (part, entry)"""


CODES_SQL = f"""
WITH k AS (
  SELECT vec_id, label, [floor(256 * v::DOUBLE)::BIGINT FOR v IN embedding] AS z FROM embeddings
  WHERE embedding IS NOT NULL AND len([v FOR v IN embedding IF v IS NULL OR NOT isfinite(v)]) = 0),
p AS (SELECT vec_id, part, z[part * len(z) // 16 + 1 : (part + 1) * len(z) // 16] AS x FROM (SELECT *, unnest(range(16)) AS part FROM k)),
b0 AS (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x AS e FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)),
a0 AS MATERIALIZED ({_near_sql("p", "b0")}), b1 AS MATERIALIZED ({_mean_sql("a0", "b0")}),
a1 AS MATERIALIZED ({_near_sql("p", "b1")}), b2 AS MATERIALIZED ({_mean_sql("a1", "b1")}),
a2 AS MATERIALIZED ({_near_sql("p", "b2")}),
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM c JOIN k USING (vec_id), h
"""


@query("op11_vector_code_compression", CODES_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    coded, books = code_compression.compress_vectors(vectors)
    return coded.select("vec_id", "code", "error", "label_error", F.lit(code_compression.digest(books)).alias("codebooks_sha256"))


# op13 -----------------------------------------------------------------------------------------


@query("op13_nearest_neighbours")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return graph_search.nearest_vectors(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)
