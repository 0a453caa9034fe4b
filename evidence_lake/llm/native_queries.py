"""Queries over the operators that are DataFrame functions throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake.llm import decontamination, line_dedup, url_filter
from evidence_lake.llm.registry import query, table

# op5 ------------------------------------------------------------------------------------------

_WORDS = r"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="text")} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format(text="text")} AS w FROM benchmark),
spans AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS span
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM spans),
windows AS (
  SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS span
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, p, n, item_id FROM windows JOIN spans USING (n, span)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op5_benchmark_decontamination", CONTAMINATION_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


# op7 ------------------------------------------------------------------------------------------

SITE_RULES = tuple(
    url_filter.site_rule(verdict, name)
    for verdict, name in (
        ("allow", "com/"),
        ("block", "example.com/en/"),
        ("allow", "www.example.com/en/"),
        ("block", "net/es/"),
        ("block", "net/fr/"),
    )
)


def _site_sql(name: str) -> str:
    host, _, path = name.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"


_BY_LENGTH = sorted(SITE_RULES, key=lambda r: -len(r.name))
def _any(column: str, *expressions: str) -> str:
    return f"regexp_matches({column}, '{'|'.join(expressions)}')"


# what the method's own rules block, written as conditions of their own
_OWN_SQL = " OR ".join(
    (
        f"len(list_intersect(string_split_regex(host || path, '[^A-Za-z0-9]+'), {list(url_filter.WORDS)})) > 0",
        f"len(list_intersect([string_split(x, '=')[1] FOR x IN string_split(query, '&')], {list(url_filter.QUERY_KEYS)})) > 0",
        _any("host", r"^[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]*)?$", r"^\[[0-9a-f:.]*\](:[0-9]*)?$"),
        _any("host", r"^ads\.", r"\.ads\.", r"^tracking\."),
        _any("path", "^/cgi-bin/", "^/wp-admin/", "/login$", "/checkout$"),
        _any("url", "[?&]page=[0-9]{3,}"),
    )
)

URL_SQL = rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
r AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM p),
h AS (
  SELECT page_id, url,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(rest, '^[^/?#]*[^?#]*\?([^#]*)', 1) AS query
  FROM r),
m AS (SELECT *, CASE {" ".join(f"WHEN {_site_sql(r.name)} THEN '{r.name}'" for r in _BY_LENGTH)} END AS rule FROM h)
SELECT page_id, host, path, rule,
  CASE {" ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in SITE_RULES)}
    WHEN {_OWN_SQL} THEN 'block' ELSE 'allow' END AS verdict
FROM m
"""


@query("op7_url_filters", URL_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    judged = url_filter.judge_urls(pages, SITE_RULES + url_filter.DEFAULT_RULES)
    listed = F.col("rule").isin([r.name for r in SITE_RULES])
    return judged.select("page_id", "host", "path", F.when(listed, F.col("rule")).alias("rule"), "verdict")


# op10 -----------------------------------------------------------------------------------------

LINE_DEDUP_SQL = """
WITH d AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
w AS (
  SELECT doc_id, p, lines[p : p + 2] AS win
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS p FROM d WHERE len(lines) >= 3)
  WHERE trim(array_to_string(lines[p : p + 2], ''), ' ') <> ''),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS k FROM w),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 3)) AS line FROM r WHERE k > 1),
a AS (SELECT doc_id, list(line) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, len(lines)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(
    CASE WHEN gone IS NULL THEN lines ELSE [lines[i] FOR i IN range(1, len(lines) + 1) IF NOT list_contains(gone, i)] END, chr(10)), '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""


@query("op10_line_dedup", LINE_DEDUP_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", kept)
