"""Retrieval, claims, evidence, confidence and provenance on the supplied tables.

Vectors are matched to the document of the same number, which then is a chunk of one
page: first line as title, DOI from the text's digest.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake import fixed_values as V
from evidence_lake.operators import claims as C
from evidence_lake.operators import confidence, evidence, grounding, prompts, provenance, retrieval, validation
from evidence_lake.operators.model_calls import ModelError, ModelProvider, ReplyLedger, complete, prompt_digest
from evidence_lake.plans import evidence_flow
from evidence_lake.plans.document_queries import EMBEDDED_SQL, PLAIN_CHUNKS_SQL, LetterCounts, plain_chunks
from evidence_lake.plans.registry import query, sql_collapse, table
from evidence_lake.session import new_table_path, write_out

_MIN = 0.2  # the supplied vectors are far apart; the usual 0.7 finds only equal ones


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("idx"),
        "embedding", F.col("label"),
    )


def _hits(spark: SparkSession, folder: str, **options) -> DataFrame:
    vectors = _vectors(spark, folder)
    return retrieval.retrieve(
        vectors.select("query_id", "embedding"), vectors.select("chunk_id", "idx", "embedding"), min_score=_MIN, **options
    )


_SCORES_SQL = """
    v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, x.vec_id AS chunk_id, q.label, list_cosine_similarity(q.e, x.e) AS score
          FROM v q JOIN v x ON list_cosine_similarity(q.e, x.e) >= 0.2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS INTEGER) AS rank,
            CAST(count(*) OVER (PARTITION BY query_id) AS BIGINT) AS total_found FROM s)
"""


@query("cosine_topk", f"""
    WITH {_SCORES_SQL}
    SELECT query_id, rank, chunk_id, round(score, 6) AS score, total_found FROM r WHERE rank <= 5""")
def run_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder).withColumn("score", F.round("score", 6))


@query("retrieval_totals", """
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    q AS (SELECT vec_id, CASE WHEN vec_id IN (SELECT vec_id FROM embeddings WHERE label = 3) THEN [e[1]] ELSE e END AS e FROM v),
    s AS (SELECT q.vec_id FROM q JOIN v x ON len(q.e) = 64 AND list_cosine_similarity(
            CASE WHEN len(q.e) = 64 THEN q.e ELSE x.e END, x.e) >= 0.2)
    SELECT vec_id AS query_id, CAST(count(s.vec_id) AS BIGINT) AS total_found FROM v LEFT JOIN s USING (vec_id) GROUP BY 1""")
def run_totals(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _vectors(spark, folder)
    # questions with a cut vector cannot match anything and keep their row
    cut = F.when(F.col("label") == 3, F.slice("embedding", 1, 1)).otherwise(F.col("embedding"))
    questions = vectors.select("query_id", cut.alias("embedding"))
    hits = retrieval.retrieve(questions, vectors.select("chunk_id", "idx", "embedding"), min_score=_MIN)
    return retrieval.retrieval_totals(questions, hits)


@query("topk_per_query", f"""
    WITH {_SCORES_SQL}
    SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 1 + label""")
def run_topk_per_query(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _vectors(spark, folder)
    questions = vectors.select("query_id", "embedding", (F.col("label") + 1).alias("k"))
    hits = retrieval.retrieve(questions, vectors.select("chunk_id", "idx", "embedding"), min_score=_MIN)
    return hits.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query("topk_blocks", f"""
    WITH {_SCORES_SQL}
    SELECT query_id, rank, chunk_id, round(score, 6) AS score, total_found FROM r WHERE rank <= 5""")
def run_topk_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """More questions than fit the budget of a block: several blocks, all in one scan."""
    return _hits(spark, folder, query_bytes=1 << 17).withColumn("score", F.round("score", 6))


@query("pruned_topk", f"""
    WITH {_SCORES_SQL.replace(">= 0.2", ">= 0.7")}
    SELECT query_id, rank, chunk_id, round(score, 6) AS score, total_found FROM r WHERE rank <= 5""")
def run_pruned_topk(spark: SparkSession, folder: str) -> DataFrame:
    """From a stored index, whose clusters out of reach of every question are not opened."""
    vectors = _vectors(spark, folder)
    path = new_table_path(spark, "stored-index")
    retrieval.write_index(vectors.select("chunk_id", "idx", "embedding"), path, clusters=64)
    hits = retrieval.StoredIndex(spark, path).retrieve(vectors.select("query_id", "embedding"), min_score=0.7)
    return hits.withColumn("score", F.round("score", 6))


def _chunk_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as one-page chunks."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.concat(F.lit("d"), "doc_id").alias("document_id"),
        F.when(F.col("lang") != "de", F.length("lang") - 1).alias("page_number"),
        F.when(F.col("lang") != "fr", F.concat(F.lit("it's "), "source")).alias("section"),
        F.split("text", "\n")[0].alias("document_title"),
        "text",
    )


_CHUNK_SQL = """
    ch AS (SELECT doc_id AS chunk_id, 'd' || doc_id AS document_id, CASE WHEN lang <> 'de' THEN CAST(length(lang) - 1 AS INTEGER) END AS page_number,
             CASE WHEN lang <> 'fr' THEN 'it''s ' || source END AS section, string_split(text, chr(10))[1] AS document_title, text FROM documents)
"""


@query("retrieved_chunks", f"""
    WITH {_SCORES_SQL}, {_CHUNK_SQL}
    SELECT query_id, rank, chunk_id, document_id, page_number, section, document_title, md5(text) AS text_digest
    FROM r JOIN ch USING (chunk_id) WHERE rank <= 5""")
def run_retrieved(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.with_payload(_hits(spark, folder), _chunk_rows(spark, folder)).select(
        "query_id", "rank", "chunk_id", "document_id", "page_number", "section", "document_title",
        F.md5("text").alias("text_digest"),
    )


# --- claims -------------------------------------------------------------------------------


def _conversation_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation is a question; its chunks are the documents numbered as it and its turns."""
    turns = table(spark, folder, "conversations")
    return (
        turns.select(F.col("conv_id").alias("query_id"), (F.col("conv_id") + F.col("turn")).alias("chunk_id"), (F.col("turn") + 1).alias("rank"))
        .join(_chunk_rows(spark, folder), "chunk_id")
    )


def _conversation_drafts(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as drafts citing their own document, the first, a foreign one and none at all."""
    draft = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("query_id"),
        F.col("turn").cast("int").alias("ordinal"),
        F.when(F.col("role") == "system", F.lit(" \n ")).otherwise(F.col("text")).alias("text"),
        F.array(F.lit(-1).cast("bigint"), F.col("conv_id") + F.col("turn") * 2, F.col("conv_id"), F.col("conv_id") + F.col("turn")).alias("chunk_ids"),
    )
    return draft


_CONV_SQL = f"""
    {_CHUNK_SQL},
    rt AS (SELECT conv_id AS query_id, turn + 1 AS rank, ch.* FROM conversations JOIN ch ON chunk_id = conv_id + turn),
    dr AS (SELECT conv_id AS query_id, CAST(turn AS INTEGER) AS ordinal, text, pos, u AS chunk_id FROM (
             SELECT *, unnest(ids) AS u, generate_subscripts(ids, 1) AS pos FROM (
               SELECT *, [-1, conv_id + turn * 2, conv_id, conv_id + turn] AS ids FROM conversations WHERE role <> 'system'))),
    ok AS (SELECT dr.*, rt.document_id, rt.page_number FROM dr JOIN rt USING (query_id, chunk_id)),
    cl AS (SELECT query_id, ordinal, any_value(text) AS text, list(chunk_id ORDER BY pos) AS chunk_ids,
             arg_min(document_id, pos) AS document_id, min_by(coalesce(page_number, -1), pos) AS page0 FROM ok GROUP BY query_id, ordinal),
    cm AS (SELECT sha1(from_hex('6f2f6e0a9d3f4b8a9c0a9a2e5b7d5a1e') || encode(query_id || ':' || ordinal || ':' || text)) AS h,
             *, nullif(page0, -1) AS page_number FROM cl)
"""
_UUID_OF = """substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-'
      || translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"""


@query("claim_filter", f"""
    WITH {_CONV_SQL}
    SELECT {_UUID_OF.format(h="h")} AS claim_id, query_id, ordinal, text, array_to_string(chunk_ids, ',') AS chunk_ids, document_id, page_number
    FROM cm""")
def run_claim_filter(spark: SparkSession, folder: str) -> DataFrame:
    claims = C.filter_claims(_conversation_drafts(spark, folder), _conversation_chunks(spark, folder))
    return claims.withColumn("chunk_ids", F.array_join(F.col("chunk_ids").cast("array<string>"), ","))


@query("claim_totals", f"""
    WITH {_CONV_SQL}
    SELECT c.query_id, CAST(count(cm.h) AS BIGINT) AS total_claims
    FROM (SELECT DISTINCT conv_id AS query_id FROM conversations) c LEFT JOIN cm USING (query_id) GROUP BY 1""")
def run_claim_totals(spark: SparkSession, folder: str) -> DataFrame:
    questions = table(spark, folder, "conversations").select(F.col("conv_id").alias("query_id")).distinct()
    return C.claim_totals(
        questions, C.filter_claims(_conversation_drafts(spark, folder), _conversation_chunks(spark, folder))
    )


def _sql_text(template: str, **values: str) -> str:
    pieces = re.split(r"\{(\w+)\}", template)
    literal = lambda p: "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return " || ".join(values[p] if i % 2 else literal(p) for i, p in enumerate(pieces))


_QUOTED_SQL = """CASE WHEN contains({x}, '''') AND NOT contains({x}, '"') THEN '"' || {x} || '"' ELSE '''' || replace({x}, '''', '\\''') || '''' END"""
_BLOCK_SQL = (
    "'[chunk_id: ' || chunk_id || '] (page ' || coalesce(CAST(page_number AS VARCHAR), 'None') || ')'"
    " || coalesce(', section=' || " + _QUOTED_SQL.format(x="section") + ", '')"
    " || CASE WHEN document_title <> '' THEN ', title=' || " + _QUOTED_SQL.format(x="document_title") + " ELSE '' END"
    " || chr(10) || text"
)


@query("claim_prompts", f"""
    WITH {_SCORES_SQL}, {_CHUNK_SQL},
    q AS (SELECT doc_id AS query_id, string_split(text, chr(10))[1] AS question FROM documents),
    b AS (SELECT query_id, string_agg({_BLOCK_SQL}, chr(10) ORDER BY rank) AS chunks FROM r JOIN ch USING (chunk_id) WHERE rank <= 5 GROUP BY 1)
    SELECT query_id, md5({_sql_text(V.CLAIM_PROMPT, question="question", chunks="chunks")}) AS prompt_digest FROM q JOIN b USING (query_id)""")
def run_claim_prompts(spark: SparkSession, folder: str) -> DataFrame:
    questions = table(spark, folder, "documents").select(F.col("doc_id").alias("query_id"), F.split("text", "\n")[0].alias("question"))
    retrieved = retrieval.with_payload(_hits(spark, folder), _chunk_rows(spark, folder))
    return prompts.claim_prompts(questions, retrieved).select("query_id", F.md5("prompt").alias("prompt_digest"))


@query("evidence_prompts", f"""
    WITH {_CONV_SQL},
    b AS (SELECT h, string_agg({_BLOCK_SQL}, chr(10) ORDER BY rank) AS chunks
          FROM (SELECT DISTINCT h, query_id, unnest(chunk_ids) AS chunk_id FROM cm) JOIN rt USING (query_id, chunk_id) GROUP BY 1)
    SELECT {_UUID_OF.format(h="h")} AS claim_id, md5({_sql_text(V.EVIDENCE_PROMPT, claim="cm.text", chunks="chunks")}) AS prompt_digest
    FROM cm JOIN b USING (h)""")
def run_evidence_prompts(spark: SparkSession, folder: str) -> DataFrame:
    retrieved = _conversation_chunks(spark, folder)
    claims = C.filter_claims(_conversation_drafts(spark, folder), retrieved)
    built = prompts.evidence_prompts(claims, evidence.referenced_chunks(claims, retrieved))
    return built.select("claim_id", F.md5("prompt").alias("prompt_digest"))


# --- evidence -----------------------------------------------------------------------------


def _cited(index: Column) -> Column:
    """The chunk that chunk ``index`` is cited from: itself, the one before, or one halfway up."""
    halfway = F.floor(index / 2)
    return F.when(index % 3 == 0, index).when(index % 3 == 1, index - 1).otherwise(halfway).cast("string")


def _line_drafts(chunks: DataFrame) -> DataFrame:
    """Every chunk of a document cited as evidence, from some chunk of the document."""
    return chunks.select(
        F.col("document_id").alias("claim_id"),
        F.col("index").alias("ordinal"),
        # spaces for line breaks: verbatim only up to whitespace
        F.regexp_replace("text", "\n+", "  ").alias("text"),
        F.concat("document_id", F.lit("/"), _cited(F.col("index"))).alias("chunk_id"),
        F.when(F.length("text") > 500, "supported").when(F.length("text") > 100, "inconclusive").otherwise("unsupported").alias("status"),
    )


def _source_chunks(chunks: DataFrame) -> DataFrame:
    """All chunks of a document, which its claim refers to."""
    return chunks.select(
        F.col("document_id").alias("claim_id"), F.concat("document_id", F.lit("/"), "index").alias("chunk_id"),
        "document_id", "page_number", "text",
    )


_GROUND_SQL = f"""
    {PLAIN_CHUNKS_SQL},
    pairs AS (SELECT c.document_id AS claim_id, c.index AS ordinal, regexp_replace(c.text, chr(10) || '+', '  ', 'g') AS text,
                f.text AS source, f.index AS cited, CASE WHEN length(c.text) > 500 THEN 'supported' WHEN length(c.text) > 100 THEN 'inconclusive' ELSE 'unsupported' END AS status
              FROM chunks c JOIN chunks f ON f.document_id = c.document_id
                AND f.index = CASE c.index % 3 WHEN 0 THEN c.index WHEN 1 THEN c.index - 1 ELSE c.index // 2 END),
    tok AS (SELECT *, {sql_collapse("text")} AS ne, {sql_collapse("source")} AS ns,
              regexp_extract_all(lower({sql_collapse("text")}), '[\\p{{L}}\\p{{N}}_]+') AS te,
              list_distinct(regexp_extract_all(lower({sql_collapse("source")}), '[\\p{{L}}\\p{{N}}_]+')) AS ts FROM pairs),
    gr AS (SELECT *, contains(ns, ne) OR (len(te) > 0 AND len(list_filter(te, lambda t: list_contains(ts, t))) / len(te) >= 0.6) AS grounded FROM tok),
    ev AS (SELECT claim_id, ordinal, grounded, CASE WHEN grounded THEN text END AS text,
             CASE WHEN grounded THEN claim_id || '/' || cited END AS chunk_id, CASE WHEN grounded THEN claim_id END AS document_id,
             CASE WHEN grounded THEN 1 END AS page_number,
             CASE WHEN NOT grounded AND status = 'supported' THEN 'unsupported' ELSE status END AS status,
             sha1(from_hex('6f2f6e0a9d3f4b8a9c0a9a2e5b7d5a1e') || encode('evidence:' || claim_id || ':' || ordinal)) AS eh FROM gr)
"""


def _line_evidence(spark: SparkSession, folder: str) -> DataFrame:
    chunks = write_out(plain_chunks(spark, folder), "chunks")
    return evidence.ground(_line_drafts(chunks), _source_chunks(chunks))


@query("grounding", f"""
    WITH RECURSIVE {_GROUND_SQL} SELECT claim_id, ordinal, grounded FROM gr""")
def run_grounding(spark: SparkSession, folder: str) -> DataFrame:
    chunks = write_out(plain_chunks(spark, folder), "chunks")
    source = F.col("text")
    sources = _source_chunks(chunks).select("claim_id", "chunk_id", source.alias("source"), evidence.source_words(source).alias("words"))
    pairs = _line_drafts(chunks).join(sources, ["claim_id", "chunk_id"])
    grounded = evidence.is_grounded(F.col("text"), F.col("source"), F.col("words"))
    return pairs.select("claim_id", "ordinal", grounded.alias("grounded"))


@query("grounded_anywhere", rf"""
    WITH RECURSIVE {PLAIN_CHUNKS_SQL},
    places AS (SELECT document_id || '/' || index AS chunk_id, {sql_collapse("text")} AS source FROM chunks),
    items AS (SELECT CAST(item_id AS VARCHAR) AS passage_id, {sql_collapse("text")} AS passage FROM benchmark),
    said AS (SELECT passage_id, unnest(regexp_extract_all(lower(passage), '[\p{{L}}\p{{N}}_]+')) AS word FROM items),
    known AS (SELECT passage_id, word, count(*) AS times, sum(count(*)) OVER (PARTITION BY passage_id) AS size FROM said GROUP BY passage_id, word),
    there AS (SELECT chunk_id, unnest(list_distinct(regexp_extract_all(lower(source), '[\p{{L}}\p{{N}}_]+'))) AS word FROM places),
    enough AS (SELECT passage_id, chunk_id FROM known JOIN there USING (word) GROUP BY passage_id, chunk_id, size HAVING sum(times) / size >= 0.6)
    SELECT passage_id, chunk_id FROM enough UNION SELECT passage_id, chunk_id FROM items JOIN places ON contains(source, passage) WHERE passage <> ''""")
def run_grounded_anywhere(spark: SparkSession, folder: str) -> DataFrame:
    """All chunks of all documents in which each benchmark item is found."""
    items = table(spark, folder, "benchmark").select(F.col("item_id").cast("string").alias("passage_id"), "text")
    chunks = plain_chunks(spark, folder).select(F.concat("document_id", F.lit("/"), "index").alias("chunk_id"), "text")
    return grounding.ground_everywhere(items, chunks)


@query("grounded_evidence", f"""
    WITH RECURSIVE {_GROUND_SQL}
    SELECT {_UUID_OF.format(h="eh")} AS evidence_id, claim_id, ordinal, md5(text) AS text_digest, chunk_id, document_id, page_number, status FROM ev""")
def run_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return _line_evidence(spark, folder).withColumn("text", F.md5("text")).withColumnRenamed("text", "text_digest")


@query("final_statuses", f"""
    WITH RECURSIVE {_GROUND_SQL}
    SELECT CAST(doc_id AS VARCHAR) AS claim_id,
      coalesce(CASE max(CASE status WHEN 'supported' THEN 2 WHEN 'inconclusive' THEN 1 ELSE 0 END) WHEN 2 THEN 'supported' WHEN 1 THEN 'inconclusive' END, 'unsupported') AS final_status
    FROM documents LEFT JOIN ev ON claim_id = CAST(doc_id AS VARCHAR) GROUP BY 1""")
def run_final_statuses(spark: SparkSession, folder: str) -> DataFrame:
    claims = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("claim_id"))
    return evidence.final_statuses(claims, _line_evidence(spark, folder))


@query("referenced_chunks", f"""
    WITH {_CONV_SQL}
    SELECT DISTINCT {_UUID_OF.format(h="h")} AS claim_id, query_id, chunk_id, rank
    FROM (SELECT h, query_id, unnest(chunk_ids) AS chunk_id FROM cm) JOIN rt USING (query_id, chunk_id)""")
def run_referenced(spark: SparkSession, folder: str) -> DataFrame:
    retrieved = _conversation_chunks(spark, folder)
    claims = C.filter_claims(_conversation_drafts(spark, folder), retrieved)
    return evidence.referenced_chunks(claims, retrieved).select("claim_id", "query_id", "chunk_id", "rank")


@query("validation_prompts", f"""
    SELECT doc_id AS evidence_id, md5({_sql_text(V.VALIDATION_PROMPT, claim="source || ' says'", evidence="text")}) AS prompt_digest FROM documents""")
def run_validation_prompts(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    claims = documents.select(F.col("doc_id").alias("claim_id"), F.concat("source", F.lit(" says")).alias("text"))
    found = documents.select(F.col("doc_id").alias("evidence_id"), F.col("doc_id").alias("claim_id"), "text")
    return prompts.validation_prompts(claims, found).select("evidence_id", F.md5("prompt").alias("prompt_digest"))


class LengthJudge(ModelProvider):
    """A stand-in judge: rates by the length of the passage it reads in the prompt."""

    model = "length-judge"

    def complete(self, prompt: str) -> str:
        passage = prompt.split('evidence from the document: "', 1)[1].rsplit('"\n\nDoes', 1)[0]
        status = "supported" if len(passage) > 700 else "partially_supported" if len(passage) > 300 else "unsupported"
        return json.dumps({"status": status, "reasoning": f"{len(passage)} characters"})


@query("resumed_replies", """
    SELECT doc_id AS evidence_id, CASE WHEN length(text) > 700 THEN 'supported' WHEN length(text) > 300 THEN 'partially_supported' ELSE 'unsupported' END AS status,
      length(text) || ' characters' AS reasoning,
      (source, text) IN (SELECT (source, text) FROM documents WHERE doc_id % 2 = 0) AS reused
    FROM documents""")
def run_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the documents are judged, then all: only prompts without a reply are asked."""
    documents = table(spark, folder, "documents")
    claims = documents.select(F.col("doc_id").alias("claim_id"), F.concat("source", F.lit(" says")).alias("text"))
    found = documents.select(F.col("doc_id").alias("evidence_id"), F.col("doc_id").alias("claim_id"), "text")
    asked = prompts.validation_prompts(claims, found)
    ledger, judge = ReplyLedger(new_table_path(spark, "judge-ledger")), LengthJudge()
    complete(asked.where("evidence_id % 2 = 0"), judge, validation.VALIDATION_RESPONSE, ledger=ledger)
    known = write_out(ledger.replies(spark).select("digest", F.lit(True).alias("reused")), "known-replies")
    answered = complete(
        asked.withColumn("digest_of", prompt_digest(judge.model)), judge, validation.VALIDATION_RESPONSE, ledger=ledger
    ).withColumnRenamed("digest_of", "digest")
    reused = F.coalesce("reused", F.lit(False)).alias("reused")
    return answered.join(known, "digest", "left").select("evidence_id", "response.status", "response.reasoning", reused)


@query("validations", f"""
    WITH RECURSIVE {_GROUND_SQL}
    SELECT {_UUID_OF.format(h="eh")} AS evidence_id, claim_id,
      CASE WHEN length(text) > 700 THEN 'supported' WHEN length(text) > 300 THEN 'partially_supported' ELSE 'unsupported' END AS status,
      CASE WHEN text IS NULL THEN '{V.NO_EVIDENCE_REASON}' ELSE length(text) || ' characters' END AS reasoning, 'length-judge' AS model_used
    FROM ev""")
def run_validations(spark: SparkSession, folder: str) -> DataFrame:
    claims = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("claim_id"), "text")
    found = write_out(_line_evidence(spark, folder), "evidence")
    judged = validation.validate_evidence(claims, found, LengthJudge())
    return judged.select("evidence_id", "claim_id", "status", "reasoning", "model_used")


# --- confidence and provenance -----------------------------------------------------------------

_LABEL_STATUS = "CASE WHEN quality = 1 THEN 'supported' WHEN toxic = 1 THEN 'inconclusive' ELSE 'unsupported' END"


def _cited_claims(spark: SparkSession, folder: str) -> DataFrame:
    """One claim per document, citing it twice and the next document once."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("claim_id"),
        F.col("source").alias("query_id"),
        F.array(F.col("doc_id"), F.col("doc_id") + 1, F.col("doc_id")).alias("chunk_ids"),
        F.concat(F.lit("claim of "), "source").alias("text"),
    )


def _labelled_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Every label speaks for the claim on its document and the one on the document before."""
    status = F.when(F.col("quality") == 1, "supported").when(F.col("toxic") == 1, "inconclusive").otherwise("unsupported")
    return table(spark, folder, "labels").select(
        F.explode(F.array(F.col("doc_id"), F.col("doc_id") - 1)).alias("claim_id"), F.col("doc_id").alias("chunk_id"), status.alias("status"),
        F.lit(None).cast("string").alias("text"), F.concat(F.lit("d"), "doc_id").alias("document_id"),
    ).withColumn("evidence_id", F.concat_ws("/", F.lit("e"), F.col("claim_id").cast("string"), F.col("chunk_id").cast("string")))


_CONFIDENCE_SQL = f"""
    c AS (SELECT doc_id AS claim_id, source, CASE WHEN lang <> 'es' THEN CAST((50 + (length(lang || source) * 7 + n_chars) % 50) / 100 AS DOUBLE) END AS score FROM documents),
    a AS (SELECT c.claim_id, CASE WHEN c.score IS NOT NULL AND n.score IS NOT NULL THEN (c.score + n.score + c.score) / 3
                               WHEN c.score IS NOT NULL THEN (c.score + c.score) / 2 ELSE n.score END AS avg
          FROM c LEFT JOIN c n ON n.claim_id = c.claim_id + 1 AND n.source = c.source),
    e AS (SELECT unnest([doc_id, doc_id - 1]) AS claim_id, doc_id AS chunk_id, {_LABEL_STATUS} AS status FROM labels),
    t AS (SELECT claim_id, max(CASE status WHEN 'supported' THEN 2 WHEN 'inconclusive' THEN 1 ELSE 0 END) AS strength,
            count(*) FILTER (status = 'supported') AS supported FROM e GROUP BY 1),
    m AS (SELECT DISTINCT claim_id, coalesce(strength, 0) AS strength, coalesce(supported, 0) AS supported, avg FROM c LEFT JOIN t USING (claim_id) LEFT JOIN a USING (claim_id)),
    r AS (SELECT *, CASE strength WHEN 2 THEN 0.6::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0::DOUBLE END
            + CASE WHEN avg > 0.85 THEN 0.2::DOUBLE WHEN avg > 0.7 THEN 0.1::DOUBLE ELSE 0::DOUBLE END
            + CASE WHEN supported >= 2 THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS raw FROM m),
    l AS (SELECT *, CASE WHEN raw >= 0.75 THEN 'HIGH' WHEN raw >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM r),
    scored AS (SELECT claim_id, level, round(raw, 4) AS score,
      CASE strength WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS evidence_strength,
      CASE WHEN avg IS NULL THEN 'n/a' WHEN avg > 0.85 THEN 'HIGH' WHEN avg > 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS retrieval_score,
      CASE WHEN supported >= 2 THEN 'multiple' WHEN supported = 1 THEN 'single' ELSE 'none' END AS coverage,
      CASE level WHEN 'LOW' THEN '{V.LOW_REASON}' ELSE level || ' confidence: '
        || CASE WHEN supported > 0 THEN 'based on ' || supported || ' supporting evidence item(s)' ELSE 'based on inconclusive evidence' END
        || coalesce(' and retrieval similarity ' || printf('%.2f', avg), '') || '.' END AS reasoning FROM l)
"""


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    """Similarities by source; Spanish documents have none."""
    score = (F.lit(50) + (F.length(F.concat("lang", "source")) * 7 + F.col("n_chars")) % 50) / 100
    return table(spark, folder, "documents").filter("lang <> 'es'").select(
        F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_id"), score.alias("score")
    )


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return confidence.score_claims(
        _cited_claims(spark, folder), _labelled_evidence(spark, folder), _scores(spark, folder), on="query_id"
    )


@query("confidence", f"""
    WITH {_CONFIDENCE_SQL} SELECT * FROM scored""")
def run_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("claim_id", "level", "score", "reasoning", "factors.*")


@query("packaged_scores", f"""
    WITH {_CONFIDENCE_SQL}
    SELECT claim_id, 'claim of ' || source AS claim_text, 3 AS n_cited, level, scored.score AS score,
      'e/' || claim_id || '/' || chunk_id AS evidence_id, status AS evidence_status
    FROM c JOIN scored USING (claim_id) LEFT JOIN e USING (claim_id)""")
def run_packaged(spark: SparkSession, folder: str) -> DataFrame:
    packed = confidence.package_scores(
        _cited_claims(spark, folder), _labelled_evidence(spark, folder), _scored(spark, folder)
    )
    return packed.select(
        "claim_id", "claim_text", F.size("chunk_ids").alias("n_cited"), "level", "score", "evidence_id", "evidence_status"
    )


def _label_chains(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Labels as evidence of their document: quality 0 leaves it without a chunk."""
    documents = table(spark, folder, "documents")
    claims = documents.select(
        F.concat(F.lit("c"), "doc_id").alias("claim_id"), F.when(F.col("lang") != "es", F.col("lang")).alias("text"),
        F.concat(F.lit("d"), "doc_id").alias("document_id"),
        F.when(F.col("lang") != "de", F.array("doc_id")).otherwise(F.array().cast("array<bigint>")).alias("chunk_ids"),
    )
    grounded = F.col("quality") == 1
    found = table(spark, folder, "labels").select(
        F.concat(F.lit("e"), "doc_id").alias("evidence_id"), F.concat(F.lit("c"), "doc_id").alias("claim_id"),
        F.when(grounded, F.concat(F.lit("toxic "), "toxic")).alias("text"), F.when(grounded, F.col("doc_id")).alias("chunk_id"),
        F.when(grounded, F.concat(F.lit("d"), "doc_id")).alias("document_id"),
    )
    return claims, found


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("document_id"),
        F.when(F.col("lang") != "de", F.split("text", "\n")[0]).alias("title"),
        F.when(F.col("n_chars") > 500, F.concat(F.lit("https://example.org/"), "doc_id")).alias("url"),
        F.when(F.col("lang") != "fr", F.concat(F.lit("10.1000/"), "doc_id")).alias("doi"),
    )


@query("provenance_chains", """
    WITH d AS (SELECT doc_id, lang, n_chars, text, CASE WHEN lang <> 'de' THEN string_split(text, chr(10))[1] END AS title FROM documents),
    j AS (SELECT * FROM labels JOIN d USING (doc_id)),
    p AS (SELECT *, coalesce(CASE WHEN lang <> 'de' THEN CAST(length(lang) - 1 AS VARCHAR) END, 'None') AS page FROM j)
    SELECT 'c' || doc_id AS claim_id, 'e' || doc_id AS evidence_id, quality = 1 AND lang <> 'fr' AS is_complete,
      md5('claim|c' || doc_id || '|' || CASE WHEN lang <> 'es' THEN lang ELSE 'Claim' END
        || ';evidence|e' || doc_id || '|' || CASE WHEN quality = 1 THEN 'toxic ' || toxic ELSE 'Evidence' END
        || CASE WHEN quality = 1 THEN ';chunk|' || doc_id || '|Page ' || page || ': ' || text
             || ';page|page-' || page || '|Page ' || page || ' of ''' || coalesce(nullif(title, ''), 'the document') || '''' ELSE '' END
        || ';document|d' || doc_id || '|' || coalesce(nullif(title, ''), 'Document')
        || CASE WHEN lang <> 'fr' THEN ';source|10.1000/' || doc_id || '|DOI: 10.1000/' || doc_id
             || CASE WHEN n_chars > 500 THEN ' — URL: https://example.org/' || doc_id ELSE '' END ELSE '' END) AS chain_digest
    FROM p""")
def run_provenance(spark: SparkSession, folder: str) -> DataFrame:
    claims, found = _label_chains(spark, folder)
    chains = provenance.resolve(claims, found, _chunk_rows(spark, folder), _sources(spark, folder))
    flat = F.array_join(F.transform("chain", lambda x: F.concat_ws("|", x["level"], x["id"], x["description"])), ";")
    return chains.select("claim_id", "evidence_id", "is_complete", F.md5(flat).alias("chain_digest"))


@query("missing_provenance", """
    SELECT 'claim' AS kind, 'c' || doc_id AS id FROM documents WHERE lang = 'de'
    UNION ALL SELECT 'evidence', 'e' || doc_id FROM labels WHERE quality <> 1""")
def run_missing(spark: SparkSession, folder: str) -> DataFrame:
    return provenance.missing_provenance(*_label_chains(spark, folder))


# --- everything together -------------------------------------------------------------------------

_BLOCK = re.compile(r"^\[chunk_id: (\d+)\] \(page [^)]*\)(?:, section=.*)?\n(.*)$", re.MULTILINE)


class QuotingModel(ModelProvider):
    """A stand-in model.  As claim writer it claims the first line of every chunk it is shown,
    citing that chunk and one it was not shown; as evidence finder it quotes the first line of
    the first chunk, and makes something up about the second."""

    model = "quoting"

    def complete(self, prompt: str) -> str:
        blocks = _BLOCK.findall(prompt.split("Source chunks:\n", 1)[1])
        if prompt.startswith("You are a research assistant extracting"):
            return json.dumps({"claims": [{"text": line, "chunk_ids": [i, "-5", i]} for i, line in blocks]})
        made_up = {"text": "zzz yyy xxx", "chunk_id": blocks[0][0], "status": "supported"}
        quoted = {"text": blocks[0][1], "chunk_id": blocks[0][0], "status": "supported"}
        return json.dumps({"evidence": [quoted, made_up]})


# the index holds vectors of documents, and only documents ask
_INDEX_SCORES_SQL = _SCORES_SQL.replace("FROM embeddings)", "FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))")


@query("traced_claims", f"""
    WITH {_INDEX_SCORES_SQL},
    d AS (SELECT doc_id AS chunk_id, string_split(text, chr(10))[1] AS line, lang, n_chars FROM documents),
    h AS (SELECT r.*, d.* EXCLUDE (chunk_id) FROM r JOIN d USING (chunk_id) WHERE rank <= 5),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS ordinal FROM h),
    x AS (SELECT *, regexp_matches(line, '[\\p{{L}}\\p{{N}}_]') AS said,
            sha1(from_hex('6f2f6e0a9d3f4b8a9c0a9a2e5b7d5a1e') || encode(query_id || ':' || ordinal || ':' || line)) AS hh,
            0.6::DOUBLE + CASE WHEN score > 0.85 THEN 0.2::DOUBLE WHEN score > 0.7 THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS raw
          FROM o)
    SELECT {_UUID_OF.format(h="hh")} AS claim_id, query_id, line AS claim, 'supported' AS final_status,
      CASE WHEN raw >= 0.75 THEN 'HIGH' ELSE 'MEDIUM' END AS level, round(raw, 4) AS score,
      CAST(2 AS BIGINT) AS n_evidence, CAST(CASE WHEN lang <> 'fr' THEN 1 ELSE 0 END AS BIGINT) AS n_complete
    FROM x""")
def run_traced(spark: SparkSession, folder: str) -> DataFrame:
    """Questions are documents; claims about their nearest documents are made, checked, scored and traced."""
    vectors = _vectors(spark, folder).drop("label")
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("query_id"), F.split("text", "\n")[0].alias("question"))
    questions = vectors.select("query_id", "embedding").join(texts, "query_id")
    chunks = _chunk_rows(spark, folder).withColumns(
        {"document_title": F.lit(None).cast("string"), "section": F.lit(None).cast("string"), "chunk_id": F.col("chunk_id").cast("string")}
    )
    index = vectors.select(F.col("chunk_id").cast("string").alias("chunk_id"), "idx", "embedding").join(chunks, "chunk_id")
    result = evidence_flow.trace(questions, index, _sources(spark, folder), QuotingModel(), QuotingModel(), min_score=_MIN)
    per_claim = result.chains.groupBy("claim_id").agg(
        F.count("*").alias("n_evidence"), F.count_if("is_complete").alias("n_complete")
    )
    return (
        result.claims.select("claim_id", "query_id", F.col("text").alias("claim"))
        .join(result.statuses, "claim_id")
        .join(result.confidence, "claim_id")
        .join(per_claim, "claim_id")
        .select("claim_id", "query_id", "claim", "final_status", "level", "score", "n_evidence", "n_complete")
    )


_SHOWN = re.compile(r"^\[chunk_id: ([^\]]+)\] \(page [^\n]*\n(.*?)(?=\n\[chunk_id: |\Z)", re.MULTILINE | re.DOTALL)


def _shown(prompt: str) -> list[tuple[str, str]]:
    """(chunk id, whole text) of the chunks in a prompt."""
    return _SHOWN.findall(prompt.split("Source chunks:\n", 1)[1])


class SpreadCounts(LetterCounts):
    """Letter counts beside a constant, so that texts of other lengths do not point the same way."""

    model, dimension = "spread-counts", 5

    def embed_batch(self, texts):
        return [[*v, 10.0] for v in super().embed_batch(texts)]


class LastLines(ModelProvider):
    """A stand-in claim writer: one claim per chunk, its last line; some cite only a chunk it was not shown."""

    model = "last-lines"

    def complete(self, prompt: str) -> str:
        claims = [
            {"text": text.split("\n")[-1], "chunk_ids": ["elsewhere"] if len(text) % 3 == 0 else [i, "elsewhere", i]}
            for i, text in _shown(prompt)
        ]
        return json.dumps({"claims": claims})


class WholeChunks(ModelProvider):
    """A stand-in evidence finder: quotes the whole first chunk, rated by its length, unless the length is
    a multiple of five, and makes something up besides."""

    model = "whole-chunks"

    def complete(self, prompt: str) -> str:
        i, text = _shown(prompt)[0]
        status = ("inconclusive", "unsupported", "supported", "supported")[len(text) % 4]
        quoted = {"text": text.replace("\n\n", "  "), "chunk_id": i, "status": status}
        made_up = {"text": "zzz yyy xxx", "chunk_id": i, "status": "supported"}
        return json.dumps({"evidence": [made_up] if len(text) % 5 == 0 else [quoted, made_up]})


class StrictJudge(LengthJudge):
    """Rates by length like its parent, but refuses some passages and answers others in a wrong form."""

    model = "strict-judge"

    def complete(self, prompt: str) -> str:
        reply = super().complete(prompt)
        length = int(json.loads(reply)["reasoning"].split()[0])
        if length % 7 == 0:
            raise ModelError("the model refused")
        return reply[:-1] if length % 11 == 0 else reply.replace('"status"', '"verdict"') if length % 13 == 0 else reply


@query("document_trace", f"""
    WITH RECURSIVE {EMBEDDED_SQL},
    vec AS (
      SELECT h, document_id, index, text, CAST(document_id AS BIGINT) * 67108864 + index AS idx,
        [length(text), length(text) - length(replace(text, 'e', '')), length(text) - length(replace(text, 'n', '')),
          length(text) - length(replace(text, chr(10), '')), 10]::DOUBLE[] AS v FROM judged WHERE NOT failed),
    ask AS (
      SELECT doc_id AS query_id, [length(q), length(q) - length(replace(q, 'e', '')), length(q) - length(replace(q, 'n', '')), 0, 10]::DOUBLE[] AS v
      FROM (SELECT doc_id, string_split(text, chr(10))[1] AS q FROM documents) WHERE NOT contains(q, 'thanedble') AND NOT contains(q, 'ingonen') AND q <> ''),
    near AS (SELECT query_id, list_cosine_similarity(ask.v, vec.v) AS score, vec.* FROM ask JOIN vec ON list_cosine_similarity(ask.v, vec.v) >= 0.9),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, idx) AS rank FROM near QUALIFY rank <= 5),
    claimed AS (
      SELECT *, string_split(text, chr(10))[-1] AS claim, length(text) AS size,
        sha1(from_hex('6f2f6e0a9d3f4b8a9c0a9a2e5b7d5a1e') || encode(query_id || ':' || (rank - 1) || ':' || string_split(text, chr(10))[-1])) AS ch
      FROM top WHERE length(text) % 3 <> 0),
    rated AS (
      SELECT *, size % 5 <> 0 AS quoted, CASE WHEN size % 5 = 0 THEN 'unsupported' ELSE ['inconclusive', 'unsupported', 'supported', 'supported'][size % 4 + 1] END AS status
      FROM claimed),
    raws AS (
      SELECT *, CASE status WHEN 'supported' THEN 0.6::DOUBLE WHEN 'inconclusive' THEN 0.5::DOUBLE ELSE 0::DOUBLE END
        + CASE WHEN score > 0.85 THEN 0.2::DOUBLE WHEN score > 0.7 THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS raw,
        quoted AND (size % 7 = 0 OR size % 11 = 0 OR size % 13 = 0) AS refused FROM rated)
    SELECT {_UUID_OF.format(h="ch")} AS claim_id, query_id, md5(claim) AS claim_digest, status AS final_status,
      CASE WHEN raw >= 0.75 THEN 'HIGH' WHEN raw >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS level, round(raw, 4) AS score,
      CAST(CASE WHEN quoted THEN 2 ELSE 1 END AS BIGINT) AS n_evidence,
      CAST(CASE WHEN quoted AND lang <> 'fr' THEN 1 ELSE 0 END AS BIGINT) AS n_complete,
      CAST(CASE WHEN quoted AND NOT refused AND size > 700 THEN 1 ELSE 0 END AS BIGINT) AS n_confirmed,
      CAST(CASE WHEN refused THEN 1 ELSE 0 END AS BIGINT) AS n_failed
    FROM raws JOIN documents ON doc_id = CAST(document_id AS BIGINT)""")
def run_document_trace(spark: SparkSession, folder: str) -> DataFrame:
    """From whole texts: chunks, embeddings (some batches fail), index, retrieval, claims, evidence,
    a second judgement, scores and chains.  Questions are the first lines of all documents."""
    texts = table(spark, folder, "documents")
    documents = texts.select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("title of "), "doc_id").alias("title"),
        F.lit(None).cast("string").alias("url"),
        F.when(F.col("lang") != "fr", F.concat(F.lit("10.1000/"), "doc_id")).alias("doi"),
        "text",
    )
    line = F.split("text", "\n")[0]
    refused = F.contains(line, F.lit("thanedble")) | F.contains(line, F.lit("ingonen"))
    questions = texts.where(~refused & (line != "")).select(F.col("doc_id").alias("query_id"), line.alias("question"))
    result = evidence_flow.trace_texts(
        documents, questions, SpreadCounts(), LastLines(), WholeChunks(), StrictJudge(), min_score=0.9, batch_size=5
    )
    per_claim = result.chains.groupBy("claim_id").agg(F.count("*").alias("n_evidence"), F.count_if("is_complete").alias("n_complete"))
    judged = result.validations.groupBy("claim_id").agg(
        F.count_if(F.col("status") == "supported").alias("n_confirmed"), F.count("error").alias("n_failed")
    )
    return (
        result.claims.select("claim_id", "query_id", F.md5("text").alias("claim_digest"))
        .join(result.statuses, "claim_id")
        .join(result.confidence, "claim_id")
        .join(per_claim, "claim_id")
        .join(judged, "claim_id")
        .select(
            "claim_id", "query_id", "claim_digest", "final_status", "level", "score", "n_evidence", "n_complete", "n_confirmed", "n_failed"
        )
    )
