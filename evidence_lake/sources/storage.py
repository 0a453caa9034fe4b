"""Parquet snapshots of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake.operators import quality


def append_documents(documents: DataFrame, path: str) -> None:
    """Append rows to a plain folder; one that breaks a rule fails the write job.

    For saves that are one step for readers, and store nothing twice when tried again, see
    :class:`evidence_lake.sources.versions.BucketTable`.
    """
    quality.enforce(documents, quality.document_rules(documents.columns)).write.mode("append").parquet(path)


def write_snapshot(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write the next version of a table; an existing path is an error, never overwritten."""
    writer = rows.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_chunks(chunks: DataFrame, path: str, buckets: int = 0, table: str | None = None) -> None:
    """Store chunks; with ``buckets`` as a table bucketed by chunk_id, so that the evidence and
    provenance joins on chunk_id need no shuffle of the chunk side."""
    if buckets and table:
        chunks.write.bucketBy(buckets, "chunk_id").sortBy("chunk_id").option("path", path).saveAsTable(table)
    else:
        write_snapshot(chunks, path)


def index_scan(spark: SparkSession, chunks_path: str, documents_path: str) -> DataFrame:
    """Embedded chunks with their document's title, ready to be searched."""
    chunks = read_table(spark, chunks_path).filter(F.col("embedding").isNotNull())
    titles = read_table(spark, documents_path).select(
        F.col("id").alias("document_id"), F.col("title").alias("document_title")
    )
    return chunks.join(titles, "document_id", "left")
