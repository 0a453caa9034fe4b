"""Files, structure, chunks and embeddings of the supplied documents and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake import fixed_values as V
from evidence_lake.operators import chunking, quality, structure
from evidence_lake.operators.embedding import EmbeddingError, EmbeddingProvider, embed_chunks
from evidence_lake.plans.registry import query, sql_collapse, sql_strip, table, texts
from evidence_lake.session import new_table_path
from evidence_lake.sources import files, storage

# --- files ---------------------------------------------------------------------------


def fetched_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as a fetch log: status and headers vary with language and size."""
    lang = F.regexp_extract("url", "://[^/]+/([a-z]+)/", 1)
    return table(spark, folder, "pages").select(
        "page_id",
        F.encode("html", "UTF-8").alias("content"),
        F.when(lang == "fr", 404).otherwise(200).alias("status"),
        F.when(lang == "es", "").when(lang == "de", "image/png").otherwise(" Text/HTML ; charset=utf-8").alias("header"),
        (F.length("html") * 3).cast("string").alias("announced"),
    )


@query("fetch_checks", r"""
    WITH p AS (SELECT *, regexp_extract(url, '://[^/]+/([a-z]+)/', 1) AS lang FROM pages)
    SELECT page_id, CASE WHEN lang = 'fr' THEN 'http_404' WHEN lang = 'es' THEN 'content_type_missing'
      WHEN lang = 'de' THEN 'content_type_refused' WHEN length(html) * 3 > 9000 THEN 'announced_too_large'
      WHEN octet_length(encode(html)) > 2500 THEN 'too_large' END AS problem
    FROM p""")
def run_fetch_checks(spark: SparkSession, folder: str) -> DataFrame:
    log = fetched_pages(spark, folder)
    # two limits, so that both size checks are seen at work
    announced = files.fetch_problem(F.col("status"), F.col("header"), F.col("announced"), F.lit(0), 9000)
    actual = files.fetch_problem(F.col("status"), F.col("header"), F.lit(None).cast("string"), F.octet_length("content"), 2500)
    return log.select("page_id", F.coalesce(announced, actual).alias("problem"))


@query("file_manifest", """
    WITH p AS (SELECT page_id, encode(html) AS content, octet_length(encode(html)) AS size FROM pages)
    SELECT page_id, CAST(size AS INTEGER) AS size, CASE WHEN size > 4000 THEN 'too_large' END AS problem,
      CASE WHEN size <= 4000 THEN sha256(content) END AS sha256, size <= 4000 AS intact
    FROM p""")
def run_file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    pages = fetched_pages(spark, folder).withColumn("content_type", F.lit(" Application/PDF "))
    kept = files.manifest(pages, max_bytes=4000)
    intact = F.coalesce(files.hash_matches(F.col("content"), F.col("sha256")), F.lit(False))
    return kept.select("page_id", "size", "problem", "sha256", intact.alias("intact"))


@query("read_files", """
    WITH f AS (SELECT page_id // 10 AS file, string_agg(html || chr(10), '' ORDER BY page_id) AS content FROM pages GROUP BY 1),
    s AS (SELECT *, octet_length(encode(content)) AS size FROM f)
    SELECT file, CAST(size AS BIGINT) AS size, CASE WHEN size > 30000 THEN 'too_large' END AS problem,
      CASE WHEN size <= 30000 THEN sha256(content) END AS sha256 FROM s""")
def run_read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Ten pages to a landed file; files over the limit come as rows without content."""
    path = new_table_path(spark, "landed-pages")
    pages = table(spark, folder, "pages").select(F.floor(F.col("page_id") / 10).alias("file"), "page_id", "html")
    ordered = pages.repartition("file").sortWithinPartitions("file", "page_id")
    ordered.select("file", "html").write.partitionBy("file").text(path)
    found = files.read_files(spark, f"{path}/*/*.txt", max_bytes=30000)
    number = F.regexp_extract("path", "file=([0-9]+)", 1).cast("bigint")
    return found.select(number.alias("file"), "size", "problem", F.sha2("content", 256).alias("sha256"))


# --- structure -------------------------------------------------------------------------


def _sql_decoded(x: str) -> str:
    for name, character in V.HTML_ENTITIES.items():
        x = f"replace({x}, '&{name};', chr({ord(character)}))"
    return x


_HTML_INLINE = rf"(?i)</?({'|'.join(V.HTML_INLINE)})\b[^>]*>"
_HTML_SQL = rf"""
    WITH c AS (
      SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<template\b[^>]*>.*?</template\s*>|<title\b[^>]*>.*?</title\s*>', ' ', 'g') AS html
      FROM pages),
    m AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?i)(<table\b)', chr(1) || '\1', 'g'), '(?i)(</table>)', '\1' || chr(1), 'g') AS html FROM c),
    p AS (SELECT page_id, i AS a, parts[i] AS part FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT page_id, string_split(html, chr(1)) AS parts FROM m))),
    q AS (
      SELECT page_id, a, string_split(CASE WHEN lower(part[1:6]) = '<table' THEN part
        ELSE regexp_replace(part, '(?i)(</?({'|'.join(V.HTML_BLOCKS)})\b)', chr(2) || '\1', 'g') END, chr(2)) AS blocks FROM p),
    b AS (SELECT page_id, a, i AS n, blocks[i] AS block FROM (SELECT *, unnest(range(1, len(blocks) + 1)) AS i FROM q)),
    t AS (
      SELECT page_id, a, n, lower(regexp_extract(block, '^<([A-Za-z0-9]+)', 1)) AS tag,
        {sql_collapse(_sql_decoded(f"regexp_replace(regexp_replace(block, '{_HTML_INLINE}', '', 'g'), '</?[A-Za-z!][^>]*(>|$)', ' ', 'g')"))} AS text
      FROM b)
    SELECT CAST(page_id AS VARCHAR) AS document_id, 1 AS page_number,
      CAST(row_number() OVER (PARTITION BY page_id ORDER BY a, n) - 1 AS INTEGER) AS position,
      CASE WHEN regexp_full_match(tag, 'h[1-6]') THEN 'heading' WHEN tag = 'table' THEN 'table' ELSE 'paragraph' END AS type,
      CASE WHEN regexp_full_match(tag, 'h[1-6]') THEN CAST(tag[2] AS INTEGER) END AS level, text
    FROM t WHERE text <> ''"""


@query("html_elements", _HTML_SQL)
def run_html_elements(spark: SparkSession, folder: str) -> DataFrame:
    return structure.html_elements(texts(spark, folder, "pages"))


@query("page_totals", """
    SELECT source AS document_id, CAST(count(*) AS BIGINT) AS total_pages, CAST(sum(length(text)) AS BIGINT) AS total_chars
    FROM documents GROUP BY source""")
def run_page_totals(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "documents").select(F.col("source").alias("document_id"), "text")
    return structure.page_totals(pages)


# Every line of a text becomes fragments of one sentence each, sinking by 0.6 per
# fragment: with a tolerance of 1.0 from a line's first fragment, two share a line.
_FRAGMENT_SQL = f"""
    l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS line_at FROM (
            SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
    f AS (SELECT doc_id, line_at, unnest(s) AS piece, generate_subscripts(s, 1) AS piece_at FROM (
            SELECT doc_id, line_at, string_split(line, '. ') AS s FROM l)),
    u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_at ORDER BY piece_at) - 1 AS k FROM f WHERE {sql_strip("piece")} <> '')
"""


@query("assembled_lines", f"""
    WITH {_FRAGMENT_SQL},
    g AS (SELECT doc_id, line_at, k // 2 AS half, {sql_strip("string_agg(piece, '' ORDER BY k)")} AS text,
            CAST(max(10 + k) AS DOUBLE) AS font_size FROM u GROUP BY ALL)
    SELECT CAST(doc_id AS VARCHAR) AS document_id, 1 AS page_number,
      CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_at, half) - 1 AS INTEGER) AS line_no, text, font_size
    FROM g""")
def run_assembled_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = texts(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_at", "line"))
    pieces = F.filter(F.split("line", r"\. "), lambda p: F.btrim(p) != "")
    fragments = lines.select("doc_id", "line_at", F.posexplode(pieces).alias("k", "text")).select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.lit(1).alias("page_number"),
        F.struct("line_at", "k").alias("seq"),
        "text",
        (F.lit(1e6) - F.col("line_at") * 1000 - F.col("k") * 0.6).alias("y"),
        (F.col("k") + 10).cast("double").alias("size"),
    )
    return structure.assemble_lines(fragments)


def sized_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents with a larger font for short ones, so that there are headings."""
    size = F.when(F.length("text") < 40, 18.0).when(F.length("text") < 60, 15.0).otherwise(12.0)
    # commas stand in for column gaps
    wide = F.regexp_replace("text", ", ", "    ")
    lines = structure.text_lines(texts(spark, folder, "documents"))
    return lines.withColumn("font_size", size).withColumn("text", wide)


def _elements_sql(document: str = "CAST(doc_id AS VARCHAR)", page: str = "1") -> str:
    return f"""
    l0 AS (SELECT {document} AS document_id, CAST({page} AS INTEGER) AS page_number, unnest(s) AS line, generate_subscripts(s, 1) AS line_no FROM (
             SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
    l1 AS (SELECT document_id, page_number, line_no, {sql_strip("line")} AS t FROM l0 WHERE {sql_strip("line")} <> ''),
    l2 AS (SELECT document_id, page_number, line_no, replace(t, ', ', '    ') AS text,
             CASE WHEN length(t) < 40 THEN 18.0 WHEN length(t) < 60 THEN 15.0 ELSE 12.0 END AS size FROM l1),
    l3 AS (SELECT *, size >= median(size) OVER (PARTITION BY document_id, page_number) * 1.15 AS big FROM l2),
    l4 AS (SELECT *, dense_rank() OVER (PARTITION BY document_id, page_number ORDER BY CASE WHEN big THEN size END DESC NULLS LAST) AS rk,
             CASE WHEN big AND length(text) <= 120 THEN 'heading'
                  WHEN len(regexp_split_to_array(text, ' {{3,}}')) >= 3 THEN 'table' ELSE 'paragraph' END AS type FROM l3),
    l5 AS (SELECT *, CASE WHEN type = 'heading' OR coalesce(lag(type) OVER (PARTITION BY document_id, page_number ORDER BY line_no) <> type, true)
             THEN 1 ELSE 0 END AS opens FROM l4),
    l6 AS (SELECT *, sum(opens) OVER (PARTITION BY document_id, page_number ORDER BY line_no) AS run FROM l5),
    elements AS (
      SELECT document_id, page_number, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_number, run) - 1 AS INTEGER) AS position, type,
        CASE WHEN type = 'heading' THEN CAST(min(rk) AS INTEGER) END AS level,
        CASE WHEN type = 'table' THEN string_agg(text, chr(10) ORDER BY line_no)
          ELSE string_agg(text, ' ' ORDER BY line_no) END AS text
      FROM l6 GROUP BY document_id, page_number, run, type)
"""


_ELEMENTS_SQL = _elements_sql()
# four documents in a row as the pages of one
_PAGES_SQL = _elements_sql("CAST(doc_id // 4 AS VARCHAR)", "doc_id % 4 + 1")


@query("text_structure", f"WITH {_ELEMENTS_SQL} SELECT document_id, page_number, position, type, level, text FROM elements")
def run_text_structure(spark: SparkSession, folder: str) -> DataFrame:
    return structure.detect_elements(sized_lines(spark, folder))


def paged_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The sized lines with four documents in a row as the pages of one."""
    number = F.col("document_id").cast("bigint")
    return sized_lines(spark, folder).withColumns(
        {"document_id": F.floor(number / 4).cast("string"), "page_number": (number % 4 + 1).cast("int")}
    )


@query("page_structure", f"WITH {_PAGES_SQL} SELECT document_id, page_number, position, type, level, text FROM elements")
def run_page_structure(spark: SparkSession, folder: str) -> DataFrame:
    return structure.detect_elements(paged_lines(spark, folder))


# --- chunks ----------------------------------------------------------------------------

_UUID_SQL = """
    substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
      || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12)"""
_NAMESPACE_SQL = "from_hex('6f2f6e0a9d3f4b8a9c0a9a2e5b7d5a1e')"

# one step per element of a document: e = elements in order, cut = chunk number of each
_PACK_SQL = """
    c AS (
      SELECT document_id, n, 1 AS chunk, length(text) AS filled FROM e WHERE n = 1
      UNION ALL
      SELECT e.document_id, e.n,
        CASE WHEN e.type = 'heading' OR c.filled + 2 + length(e.text) > 1000 THEN c.chunk + 1 ELSE c.chunk END,
        CASE WHEN e.type = 'heading' OR c.filled + 2 + length(e.text) > 1000 THEN length(e.text) ELSE c.filled + 2 + length(e.text) END
      FROM c JOIN e ON e.document_id = c.document_id AND e.n = c.n + 1),
    g AS (
      SELECT document_id, CAST(chunk - 1 AS INTEGER) AS index, string_agg(text, chr(10) || chr(10) ORDER BY n) AS text,
        arg_max(page_number, n) AS page_number, arg_max(section, n) AS section
      FROM c JOIN s USING (document_id, n) GROUP BY document_id, chunk),
    chunks AS (
      SELECT *, CAST(length(text) AS INTEGER) AS char_count,
        sha1(""" + _NAMESPACE_SQL + """ || encode(document_id || ':' || index || ':' || text)) AS h FROM g)
"""

PLAIN_CHUNKS_SQL = f"""
    e0 AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, unnest(s) AS line, generate_subscripts(s, 1) AS line_no FROM (
             SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
    e AS (SELECT document_id, 'paragraph' AS type, {sql_strip("line")} AS text,
            row_number() OVER (PARTITION BY document_id ORDER BY line_no) AS n FROM e0 WHERE {sql_strip("line")} <> ''),
    s AS (SELECT *, 1 AS page_number, CAST(NULL AS VARCHAR) AS section FROM e),
    {_PACK_SQL}
"""


def plain_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_texts(texts(spark, folder, "documents"))


@query("chunk_documents", f"""
    WITH RECURSIVE {PLAIN_CHUNKS_SQL}
    SELECT {_UUID_SQL} AS chunk_id, document_id, text, page_number, section, index, char_count FROM chunks""")
def run_chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return plain_chunks(spark, folder)


@query("chunk_elements", f"""
    WITH RECURSIVE {_ELEMENTS_SQL},
    e AS (SELECT document_id, page_number, type, {sql_strip("text")} AS text, position + 1 AS n FROM elements),
    s AS (SELECT *, last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS)
            OVER (PARTITION BY document_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section FROM e),
    {_PACK_SQL}
    SELECT {_UUID_SQL} AS chunk_id, document_id, text, page_number, section, index, char_count FROM chunks""")
def run_chunk_elements(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk(structure.detect_elements(sized_lines(spark, folder)))


@query("page_chunks", f"""
    WITH RECURSIVE {_PAGES_SQL},
    e AS (SELECT document_id, page_number, type, {sql_strip("text")} AS text, position + 1 AS n FROM elements),
    s AS (SELECT *, last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS)
            OVER (PARTITION BY document_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section FROM e),
    {_PACK_SQL}
    SELECT {_UUID_SQL} AS chunk_id, document_id, text, page_number, section, index, char_count FROM chunks""")
def run_page_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks and sections that run on over the borders of pages."""
    return chunking.chunk(structure.detect_elements(paged_lines(spark, folder)))


def one_per_element(elements: DataFrame, _: int) -> DataFrame:
    """Another chunking strategy: every element is a chunk."""
    return elements.select(
        "document_id", F.col("position").alias("index"), "text", "page_number", F.lit(None).cast("string").alias("section")
    )


@query("element_chunks", f"""
    WITH {_PAGES_SQL},
    k AS (SELECT *, sha1({_NAMESPACE_SQL} || encode(document_id || ':' || position || ':' || text)) AS h FROM elements)
    SELECT {_UUID_SQL} AS chunk_id, document_id, text, page_number, CAST(NULL AS VARCHAR) AS section, position AS index,
      CAST(length(text) AS INTEGER) AS char_count FROM k""")
def run_element_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk(structure.detect_elements(paged_lines(spark, folder)), strategy=one_per_element)


@query("chunk_totals", f"""
    WITH RECURSIVE {PLAIN_CHUNKS_SQL}
    SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(coalesce(n, 0) AS BIGINT) AS total_chunks, 'structure_aware' AS strategy
    FROM documents LEFT JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY document_id) t
      ON t.document_id = CAST(doc_id AS VARCHAR)""")
def run_chunk_totals(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.text_chunk_totals(texts(spark, folder, "documents"))


@query("repeated_texts", """
    SELECT md5(text) AS digest, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def run_repeated(spark: SparkSession, folder: str) -> DataFrame:
    digests = table(spark, folder, "documents").select(F.md5("text").alias("digest"))
    return quality.repeated_keys(digests, "digest")


# --- embeddings ---------------------------------------------------------------------------


class LetterCounts(EmbeddingProvider):
    """A stand-in model: counts of a few letters.  One word makes it refuse, another answer in part."""

    model = "letter-counts"
    dimension = 4

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        if any("thanedble" in text for text in texts):
            raise EmbeddingError("batch refused")
        if any("ingonen" in t for t in texts):  # a model that answers for the first text only
            texts = texts[:1]
        return [[float(len(t)), float(t.count("e")), float(t.count("n")), float(t.count("\n"))] for t in texts]


EMBEDDED_SQL = f"""
    {PLAIN_CHUNKS_SQL},
    keyed AS (SELECT *, {_UUID_SQL} AS chunk_id FROM chunks),
    placed AS (SELECT *, (row_number() OVER (ORDER BY document_id, index) - 1) // 5 AS batch FROM keyed),
    calls AS (
      SELECT *, bool_or(contains(text, 'thanedble')) OVER call AS refused, bool_or(contains(text, 'ingonen')) OVER call AS short,
        count(*) OVER call AS size FROM placed WINDOW call AS (PARTITION BY batch)),
    judged AS (SELECT *, refused OR (short AND size > 1) AS failed FROM calls)
"""


@query("embed_chunks", f"""
    WITH RECURSIVE {EMBEDDED_SQL}
    SELECT chunk_id, NOT failed AS success,
      CASE WHEN refused THEN 'batch refused' WHEN failed THEN 'Provider returned 1 vectors for ' || size || ' chunks' END AS error,
      CASE WHEN NOT failed THEN 'letter-counts' END AS model, CASE WHEN NOT failed THEN 4 END AS dimension,
      CASE WHEN NOT failed THEN length(text) || ',' || (length(text) - length(replace(text, 'e', ''))) || ','
        || (length(text) - length(replace(text, 'n', ''))) || ',' || (length(text) - length(replace(text, chr(10), ''))) END AS vector
    FROM judged""")
def run_embed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    results = embed_chunks(plain_chunks(spark, folder), LetterCounts(), batch_size=5)
    vector = F.array_join(F.transform("embedding", lambda x: x.cast("bigint").cast("string")), ",")
    return results.select("chunk_id", "success", "error", "model", "dimension", vector.alias("vector"))


# --- storage ----------------------------------------------------------------------------


@query("stored_chunk_index", f"""
    WITH RECURSIVE {PLAIN_CHUNKS_SQL}
    SELECT {_UUID_SQL} AS chunk_id, document_id, index, CAST(length(text) AS INTEGER) AS first_value,
      CASE WHEN length(string_split(d.text0, chr(10))[1]) <= 1000 THEN string_split(d.text0, chr(10))[1] END AS document_title
    FROM chunks JOIN (SELECT CAST(doc_id AS VARCHAR) AS document_id, text AS text0 FROM documents) d USING (document_id)""")
def run_stored_index(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and chunks through the sinks, then the index scan over what was stored.

    Documents that break a field rule (titles over the limit) are kept out of the store.
    """
    chunk_path, document_path = new_table_path(spark, "chunks"), new_table_path(spark, "documents")
    chunks = plain_chunks(spark, folder).withColumn("embedding", F.array(F.col("char_count").cast("double")))
    storage.write_chunks(chunks, chunk_path)
    documents = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "source",
        F.split("text", "\n")[0].alias("title"), F.lit("pending").alias("status"),
    )
    valid, _ = quality.quarantine(documents, quality.document_rules(documents.columns))
    storage.append_documents(valid, document_path)
    index = storage.index_scan(spark, chunk_path, document_path)
    return index.select(
        "chunk_id", "document_id", "index", F.col("embedding")[0].cast("int").alias("first_value"), "document_title"
    )
