"""Table operations and field rules on the supplied tables."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake.functions import maps
from evidence_lake.operators import quality, tables
from evidence_lake.plans.registry import query, sql_strip, table
from evidence_lake.plans.works_queries import clean_works
from evidence_lake.session import new_table_path
from evidence_lake.sources import versions

# --- listing and lookup -----------------------------------------------------------------


@query("newest_orders", """
    SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20""")
def run_newest(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return tables.newest(orders, "o_orderdate", "o_orderkey", limit=50, offset=20)


@query("newest_per_customer", """
    SELECT o_custkey, CAST(place AS INTEGER) AS place, o_orderkey FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders)
    WHERE place BETWEEN 2 AND 6""")
def run_newest_of(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    page = tables.newest_of_each(orders, "o_custkey", "o_orderdate", "o_orderkey", limit=5, offset=1)
    return page.select("o_custkey", "place", "o_orderkey")


@query("lookup_customers", """
    SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def run_lookup(spark: SparkSession, folder: str) -> DataFrame:
    urgent = table(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'")
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    return tables.lookup(customers, urgent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


# --- changes ----------------------------------------------------------------------------


@query("saved_documents", f"""
    WITH w AS (SELECT *, string_split(text, chr(10))[1] AS line FROM documents)
    SELECT source || '/' || lang AS research_id, doc_id AS seq,
      coalesce(nullif({sql_strip("CASE WHEN length(line) > 20 THEN line END")}, ''), '(sem título)') AS title, 'pending' AS status,
      (source || '/' || lang) NOT IN (SELECT DISTINCT d.source || '/' || d.lang FROM documents d JOIN labels USING (doc_id) WHERE quality = 1) AS rejected
    FROM w""")
def run_saved(spark: SparkSession, folder: str) -> DataFrame:
    """Works of every source; only sources with a document of good quality count as researches."""
    documents = table(spark, folder, "documents")
    group = documents.select(F.col("doc_id").alias("seq"), F.concat_ws("/", "source", "lang").alias("research_id"))
    works = clean_works(spark, folder).join(group, "seq")
    good = table(spark, folder, "labels").filter("quality = 1").select(F.col("doc_id").alias("seq"))
    researches = group.join(good, "seq", "left_semi").select(F.col("research_id").alias("id")).distinct()
    stamp = F.lit("2026-01-01").cast("timestamp")
    stored, rejected = tables.to_documents(works, researches, stamp)
    ids = works.select("seq", tables.document_id(F.col("research_id"), F.col("seq")).alias("id"))
    kept = stored.join(ids, "id").select("research_id", "seq", "title", "status", F.lit(False).alias("rejected"))
    missed = rejected.select(
        "research_id", "seq", F.coalesce("title", F.lit("(sem título)")).alias("title"),
        F.lit("pending").alias("status"), F.lit(True).alias("rejected"),
    )
    return quality.strip_strings(kept.unionByName(missed))


@query("patched_orders", """
    SELECT o_orderkey, CASE WHEN n.o_orderkey IS NOT NULL AND o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
      CASE WHEN n.o_orderkey IS NOT NULL AND o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS o_orderpriority,
      n.o_orderkey IS NOT NULL AND (o_orderstatus = 'P' OR o_orderpriority = '5-LOW') AS touched
    FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_returnflag = 'R') n USING (o_orderkey)""")
def run_patch(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a returned item: pending ones are closed, low priorities are cleared, others keep all."""
    before = F.lit("2020-01-01").cast("timestamp")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", before.alias("updated_at"))
    returned = table(spark, folder, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    pending, low = F.col("o_orderstatus") == "P", F.col("o_orderpriority") == "5-LOW"
    changes = orders.join(returned, "o_orderkey", "left_semi").select(
        "o_orderkey",
        F.array_compact(F.array(F.when(pending, "o_orderstatus"), F.when(low, "o_orderpriority"))).alias("present"),
        F.lit(1).alias("seq"),
        F.lit("F").alias("o_orderstatus"),
        F.lit(None).cast("string").alias("o_orderpriority"),
    )
    stored = versions.BucketTable.create(orders, new_table_path(spark, "orders"), "o_orderkey", buckets=16)
    stored.patch(changes, at=F.lit("2026-01-01").cast("timestamp"))
    return stored.read().select("o_orderkey", "o_orderstatus", "o_orderpriority", (F.col("updated_at") > before).alias("touched"))


@query("committed_documents", """
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS first_version, md5(text) AS text_digest,
      CAST(count(*) OVER (PARTITION BY doc_id) AS BIGINT) AS n, 2 AS newest FROM documents""")
def run_committed(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the documents, a save that fails on a long source, all of them, and all of them again."""
    documents = table(spark, folder, "documents").select("doc_id", "source", "text")
    path = new_table_path(spark, "documents")
    stored = versions.BucketTable.create(documents.where("doc_id % 2 = 0"), path, "doc_id", buckets=16)
    rules = quality.document_rules(["source"])
    flawed = documents.withColumn("source", F.when(F.col("doc_id") % 7 == 3, F.repeat("source", 60)).otherwise(F.col("source")))
    try:
        stored.append(flawed, rules)
    except PySparkException:
        pass  # nothing of it is stored
    for _ in range(2):  # as when an append is tried again
        stored.append(documents, rules)
    first = stored.read(1).select("doc_id", F.lit(1).alias("first_version"))
    rows = stored.read()
    counted = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    return (
        rows.join(first, "doc_id", "left")
        .join(counted, "doc_id")
        .select("doc_id", F.coalesce("first_version", F.lit(2)).alias("first_version"), F.md5("text").alias("text_digest"), "n",
                F.lit(stored.version().number).alias("newest"))
    )


@query("changed_documents", """
    WITH c AS (
      SELECT doc_id, CASE WHEN lang = 'de' THEN NULL WHEN lang = 'fr' THEN '' ELSE text END AS title,
        CASE WHEN lang = 'es' THEN 'archived' ELSE 'processed' END AS status, lang <> 'en' OR n_chars > 2000 AS titled FROM documents),
    v AS (
      SELECT *, list_filter([CASE WHEN titled AND title IS NULL THEN 'title_missing' END, CASE WHEN titled AND title = '' THEN 'title_too_short' END,
        CASE WHEN titled AND length(title) > 1000 THEN 'title_too_long' END, CASE WHEN status = 'archived' THEN 'status_unknown' END], lambda x: x IS NOT NULL) AS broken
      FROM c)
    SELECT doc_id, array_to_string(broken, ',') AS violations, CASE WHEN len(broken) = 0 THEN status ELSE 'pending' END AS status,
      md5(CASE WHEN len(broken) = 0 AND titled THEN title ELSE 'first' END) AS title_digest
    FROM v""")
def run_changed(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts as new titles: changes that break a field rule are set aside, the others made."""
    documents = table(spark, folder, "documents")
    title = F.when(F.col("lang") == "fr", "").when(F.col("lang") != "de", F.col("text"))
    titled = (F.col("lang") != "en") | (F.col("n_chars") > 2000)
    changes = documents.select(
        "doc_id",
        F.when(titled, F.array(F.lit("title"), F.lit("status"))).otherwise(F.array(F.lit("status"))).alias("present"),
        F.lit(1).alias("seq"),
        title.alias("title"),
        F.when(F.col("lang") == "es", "archived").otherwise("processed").alias("status"),
    )
    rules = quality.document_rules(["title", "status"])
    good, bad = quality.quarantine(changes, quality.change_rules(rules))
    before = documents.select("doc_id", F.lit("first").alias("title"), F.lit("pending").alias("status"))
    after = tables.patch(before, good, "doc_id", None, rules=rules)
    broken = bad.select("doc_id", F.array_join("violations", ",").alias("broken"))
    return after.join(broken, "doc_id", "left").select(
        "doc_id", F.coalesce("broken", F.lit("")).alias("violations"), "status", F.md5("title").alias("title_digest")
    )


@query("document_statuses", """
    SELECT doc_id, CASE WHEN quality = 1 THEN 'processed' WHEN quality = 0 THEN 'failed' ELSE 'pending' END AS status
    FROM documents LEFT JOIN labels USING (doc_id)""")
def run_statuses(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", F.lit("pending").alias("status"))
    # all labelled documents are downloaded first and judged afterwards
    labels = table(spark, folder, "labels")
    first = labels.select("doc_id", F.lit("downloaded").alias("status"), F.lit(1).alias("seq"))
    second = labels.select("doc_id", F.when(F.col("quality") == 1, "processed").otherwise("failed").alias("status"), F.lit(2).alias("seq"))
    return tables.set_status(documents, first.unionByName(second), "doc_id", updated=None)


@query("cascade_delete", """
    WITH c AS (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING'),
    o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')),
    l AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')))
    SELECT 'customer' AS name, CAST(count(*) AS BIGINT) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM c
    UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM o
    UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM l""")
def run_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of one segment go, with their orders and the orders' items."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    create = versions.BucketTable.create
    stored = (
        create(customers, new_table_path(spark, "customers"), "c_custkey", buckets=16),
        create(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), new_table_path(spark, "orders"), "o_orderkey", "o_custkey", 16),
        create(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"), new_table_path(spark, "items"), "l_linenumber", "l_orderkey", 16),
    )
    versions.cascade_delete(*stored, customers.filter("c_mktsegment = 'BUILDING'"))
    after = [s.read() for s in stored]
    parts = [
        rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(key).alias("keys"))
        for rows, name, key in zip(after, ("customer", "orders", "lineitem"), ("c_custkey", "o_orderkey", "l_orderkey"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- rules ------------------------------------------------------------------------------


@query("document_violations", f"""
    WITH t AS (SELECT doc_id, lang, source, {sql_strip("string_split(text, chr(10))[1]")} AS title,
        CASE WHEN n_chars > 300 THEN {sql_strip("string_split(text, chr(10))[2]")} END AS external_id,
        CASE lang WHEN 'de' THEN 'archived' ELSE 'pending' END AS status FROM documents)
    SELECT doc_id, concat_ws(',', CASE WHEN length(source) < 1 THEN 'source_too_short' END,
      CASE WHEN length(external_id) > 500 THEN 'external_id_too_long' END,
      CASE WHEN length(title) < 1 THEN 'title_too_short' END, CASE WHEN length(title) > 1000 THEN 'title_too_long' END,
      CASE WHEN status = 'archived' THEN 'status_unknown' END) AS violations
    FROM t""")
def run_document_violations(spark: SparkSession, folder: str) -> DataFrame:
    lines = F.split("text", "\n")
    rows = table(spark, folder, "documents").select(
        "doc_id", "source", F.get(lines, F.lit(0)).alias("title"),
        F.when(F.col("n_chars") > 300, F.get(lines, F.lit(1))).alias("external_id"),
        F.when(F.col("lang") == "de", "archived").otherwise("pending").alias("status"),
    )
    clean = quality.strip_strings(rows)
    checked = quality.check(clean, quality.document_rules(clean.columns))
    return checked.select("doc_id", F.array_join("violations", ",").alias("violations"))


@query("research_violations", f"""
    WITH t AS (SELECT conv_id, turn, CASE WHEN role <> 'system' THEN {sql_strip("text")} END AS title,
        {sql_strip("string_split(text, chr(10))[2]")} AS objective, {sql_strip("string_split(text, chr(10))[1]")} AS question,
        CASE role WHEN 'user' THEN 'READY' ELSE upper(role) END AS status FROM conversations)
    SELECT conv_id, turn, concat_ws(',', CASE WHEN title IS NULL THEN 'title_missing' END, CASE WHEN length(title) > 200 THEN 'title_too_long' END,
      CASE WHEN objective IS NULL THEN 'objective_missing' END, CASE WHEN length(objective) < 1 THEN 'objective_too_short' END,
      CASE WHEN length(question) < 1 THEN 'question_too_short' END, CASE WHEN length(question) > 2000 THEN 'question_too_long' END,
      CASE WHEN status <> 'READY' THEN 'status_unknown' END) AS violations,
      concat_ws(';', CASE WHEN coalesce(objective, '') = '' THEN 'objective=Objetivo é obrigatório.' END,
        CASE WHEN coalesce(question, '') = '' THEN 'question=Pergunta é obrigatória.' END,
        CASE WHEN coalesce(title, '') = '' THEN 'title=Título é obrigatório.' WHEN length(title) > 200 THEN 'title=Título deve ter no máximo 200 caracteres.' END) AS form_errors
    FROM t""")
def run_research_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as research questions: text as title, second line as objective, first as question."""
    lines = F.split("text", "\n")
    rows = table(spark, folder, "conversations").select(
        "conv_id", "turn",
        F.when(F.col("role") != "system", F.col("text")).alias("title"),
        F.get(lines, F.lit(1)).alias("objective"),
        F.get(lines, F.lit(0)).alias("question"),
        F.when(F.col("role") == "user", "READY").otherwise(F.upper("role")).alias("status"),
    )
    clean = quality.strip_strings(rows)
    return quality.check(clean, quality.research_rules(clean.columns)).select(
        "conv_id", "turn",
        F.array_join("violations", ",").alias("violations"),
        maps.printable_map(quality.research_form_errors()).alias("form_errors"),
    )


@query("first_errors", """
    WITH e AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
    SELECT event_id, concat_ws(';', CASE WHEN k < 20 THEN '_=root' END,
        CASE WHEN k < 50 THEN 'k=first ' || k ELSE 'k=second ' || event_type END, 'type=' || event_type) AS errors
    FROM e""")
def run_first_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Events as error reports of several items per field."""
    k = F.get_json_object("props", "$.k").cast("int")

    def item(message, *loc: str):
        path = F.array(*[F.lit(part) for part in loc]) if loc else F.array().cast("array<string>")
        return F.struct(path.alias("loc"), message.alias("msg"))

    detail = F.array(
        item(F.when(k < 50, F.concat(F.lit("first "), k.cast("string"))), "body", "k"),
        item(F.concat(F.lit("second "), "event_type"), "body", "k"),
        item(F.col("event_type"), "type"),
        item(F.lit("late"), "body", "type"),
        item(F.when(k < 20, F.lit("root"))),
        item(F.lit(""), "unused"),
    )
    errors = maps.printable_map(quality.first_errors(detail))
    return table(spark, folder, "events").select("event_id", errors.alias("errors"))


@query("orphans", """
    SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1""")
def run_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Items without an open order."""
    open_orders = table(spark, folder, "orders").filter("o_orderstatus <> 'F'")
    items = table(spark, folder, "lineitem").select("l_orderkey")
    lost = quality.orphans(items, open_orders, "l_orderkey", "o_orderkey")
    return lost.groupBy("l_orderkey").agg(F.count("*").alias("n"))
