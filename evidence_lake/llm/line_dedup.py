"""Removal of repeated lines by overlapping windows of three consecutive lines.

Each window is hashed; hashes that occur more than once keep their first occurrence in order of
(doc_id, line), and the lines that later occurrences cover are removed.  All DataFrame functions.
Occurrences are counted with map-side aggregation and joined with one row per repeated hash, so a
window that half of all documents share is never gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_lake.llm.columns import let, others, text_key, upto
from evidence_lake.session import write_out

WINDOW = 3


def _windows(lines: Column, size: int) -> Column:
    def of(x: Column) -> Column:
        def window(i: Column) -> Column:
            part = F.slice(x, i + 1, size)
            blank = F.trim(F.concat_ws("", part)) == ""
            hashes = F.struct(i.alias("pos"), F.xxhash64(part).alias("h1"), F.xxhash64(F.lit("b"), part).alias("h2"))
            return F.when(~blank, hashes)

        return F.transform(upto(F.size(x) - (size - 1)), window)

    return let(lines, of)


def later_lines(docs: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, removed): the line numbers, from 0, that later occurrences of windows cover."""
    windows = write_out(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            text_key(F.col(text)).alias("text_key"),
            F.explode_outer(_windows(F.split(text, "\n"), size)).alias("w"),
        )
        .where("w is not null")
        .select("doc_id", "text_key", "w.*"),
        "line-windows",
    )
    place = F.struct("doc_id", "text_key", "pos")
    repeated = (
        windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    later = windows.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return (
        later.select("doc_id", "text_key", F.explode(F.sequence("pos", F.col("pos") + (size - 1))).alias("line"))
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set("line").alias("removed"))
    )


def dedup_lines(docs: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` reduced to its kept lines, and n_lines and n_removed.

    Lines are what newlines separate; a window is ``size`` consecutive lines of one document that are
    not all blank, so texts with fewer lines stay as they are.  NULL texts have no lines and stay NULL;
    an empty text is one empty line.  NULL doc_ids come first in the order.  Rows that repeat a doc_id
    are ordered by a hash of their texts; rows equal in both count as one document.  Other columns are
    kept; columns named n_lines or n_removed (in any letter case) are replaced.
    """
    new = ("n_lines", "n_removed")
    names = [n for n in docs.columns if n.lower() not in new]
    removed = later_lines(docs, size, doc_id, text).withColumnsRenamed({"doc_id": "found_id", "text_key": "found_key"})
    split = docs.select(
        F.struct(*others(docs, (*new, text))).alias("row"),
        F.col(doc_id).alias("id"),
        text_key(F.col(text)).alias("key"),
        F.split(text, "\n").alias("lines"),
    )
    same = F.col("id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key"))
    lines, gone = F.col("lines"), F.col("removed")
    kept = F.transform(F.array_except(upto(F.size(lines)), gone), lambda i: F.get(lines, i))
    shown = F.when(gone.isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(kept, "\n"))
    return split.join(removed, same, "left").select(
        *[shown.alias(n) if n.lower() == text.lower() else F.col("row")[n].alias(n) for n in names],
        F.when(lines.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
    )
