"""Batch forms of the table operations.

Tables are immutable snapshots: a change yields the next snapshot as a DataFrame,
which is written to a path of its own (see :mod:`evidence_lake.sources.storage`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_lake import fixed_values as V
from evidence_lake.functions import ids
from evidence_lake.functions import text as T
from evidence_lake.operators import quality


def newest(rows: DataFrame, created: str, id_col: str, limit: int = V.LIST_LIMIT, offset: int = 0) -> DataFrame:
    """One page, newest first; ids break ties so that pages do not overlap."""
    _check_page(limit, offset)
    return rows.orderBy(F.col(created).desc(), F.col(id_col)).offset(offset).limit(limit)


def _check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= V.LIST_MAX or offset < 0:
        raise ValueError(f"limit must be in 1..{V.LIST_MAX} and offset not negative")


def newest_of(rows: DataFrame, parent: str, value, created: str, id_col: str, limit: int = V.LIST_LIMIT, offset: int = 0) -> DataFrame:
    """One page of the rows that belong to one parent."""
    return newest(rows.filter(F.col(parent) == value), created, id_col, limit, offset)


def newest_of_each(rows: DataFrame, parent: str, created: str, id_col: str, limit: int = V.LIST_LIMIT, offset: int = 0) -> DataFrame:
    """The same page for every parent at once; Spark drops rows past the page before the shuffle."""
    _check_page(limit, offset)
    order = Window.partitionBy(parent).orderBy(F.col(created).desc(), F.col(id_col))
    placed = rows.withColumn("place", F.row_number().over(order))
    return placed.filter(F.col("place") <= offset + limit).filter(F.col("place") > offset)


def lookup(rows: DataFrame, wanted: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is among ``wanted``; Spark broadcasts the ids when they are few."""
    return rows.join(wanted.select(id_col), id_col, "left_semi")


def document_id(research_id: Column, seq: Column) -> Column:
    """Id of the document stored for the work at place ``seq`` of a research's list."""
    return ids.uuid5(F.concat_ws(":", F.lit("document"), research_id.cast("string"), seq.cast("string")))


def to_documents(works: DataFrame, researches: DataFrame, created_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """works(research_id, ...) -> (documents to store, works whose research does not exist).

    Ids follow from research and list position, so a retried write stores the same rows.
    """
    parents = researches.select(F.col("id").alias("research_id"))
    known = works.join(parents, "research_id", "left_semi")
    stamp = F.current_timestamp() if created_at is None else created_at
    documents = known.select(
        document_id(F.col("research_id"), F.col("seq")).alias("id"),
        "research_id",
        "source",
        "external_id",
        F.coalesce(T.blank_to_null(F.col("title")), F.lit(V.UNTITLED)).alias("title"),
        "authors", "publication_year", "doi", "url", "abstract", "metadata",
        F.lit("pending").alias("status"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
    )
    return quality.strip_strings(documents), works.join(parents, "research_id", "left_anti")


def patch(
    rows: DataFrame, changes: DataFrame, id_col: str, updated: str | None = "updated_at", at: Column | None = None,
    rules: quality.Rules | None = None,
) -> DataFrame:
    """Next snapshot after partial changes.

    ``changes(id, present array<string>, seq, <fields>...)``: only the fields named in
    ``present`` change, also to NULL; later changes (by ``seq``) of a row win field by
    field; an empty ``present`` changes nothing, not even ``updated``.  With ``rules`` (see
    ``quality.document_rules``) a change of a field that breaks one fails the query; changes that
    should be set aside instead go through ``quality.quarantine(changes, quality.change_rules(rules))``.
    """
    if rules:
        changes = quality.enforce(changes, quality.change_rules(rules))
    fields = [c for c in changes.columns if c in rows.columns and c not in (id_col, updated)]
    has = lambda f: F.array_contains("present", f)
    # a struct, so that a change to NULL is told from no change
    last = changes.groupBy(id_col).agg(
        *[F.max_by(F.struct(F.col(f).alias("v")), F.when(has(f), F.col("seq"))).alias(f"new_{f}") for f in fields],
    )
    joined = rows.join(last, id_col, "left")
    changed = F.lit(False)
    for f in fields:
        changed = changed | F.col(f"new_{f}").isNotNull()
    patched = {f: F.when(F.col(f"new_{f}").isNotNull(), F.col(f"new_{f}")["v"]).otherwise(F.col(f)) for f in fields}
    if updated in rows.columns:
        stamp = F.current_timestamp() if at is None else at
        patched[updated] = F.when(changed, stamp).otherwise(F.col(updated))
    return joined.withColumns(patched).select(*rows.columns)


def set_status(documents: DataFrame, changes: DataFrame, id_col: str = "id", at: Column | None = None, status: str = "status", updated: str | None = "updated_at") -> DataFrame:
    """changes(id, status, seq): any known status may follow any other; an unknown one fails the query."""
    named = changes.withColumn("present", F.array(F.lit(status)))
    rules = {f"{status}_unknown": ~F.coalesce(F.col(status).isin(*V.DOCUMENT_STATUSES), F.lit(False))}
    return patch(documents, named, id_col, updated, at, rules)


def cascade_delete(
    researches: DataFrame, documents: DataFrame, chunks: DataFrame, doomed: DataFrame,
    keys: tuple[str, str, str, str] = ("id", "research_id", "id", "document_id"),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Next snapshots of all three tables after deleting ``doomed`` researches.

    ``keys``: research id, its name in documents, document id, its name in chunks.
    """
    research_id, research_fk, document_id, document_fk = keys
    gone = doomed.select(F.col(research_id))
    gone_documents = documents.join(
        gone.select(F.col(research_id).alias(research_fk)), research_fk, "left_semi"
    ).select(F.col(document_id).alias(document_fk))
    return (
        researches.join(gone, research_id, "left_anti"),
        documents.join(gone.select(F.col(research_id).alias(research_fk)), research_fk, "left_anti"),
        chunks.join(gone_documents, document_fk, "left_anti"),
    )
