"""Fetched files: acceptance checks and integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake import fixed_values as V
from evidence_lake.functions import text as T


def read_files(spark: SparkSession, path: str, max_bytes: int = V.MAX_FILE_BYTES) -> DataFrame:
    """Landed files as (path, content, size, modified, problem).

    Files over ``max_bytes`` come with NULL content and ``too_large``; the size is known from the listing,
    so they are never opened.
    """
    files = spark.read.format("binaryFile").load(path)
    columns = ["path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    good = files.filter(F.col("length") <= max_bytes).select(*columns, "content", F.lit(None).cast("string").alias("problem"))
    bad = files.filter(F.col("length") > max_bytes).select(
        *columns, F.lit(None).cast("binary").alias("content"), F.lit("too_large").alias("problem")
    )
    return good.unionByName(bad).select("path", "content", "size", "modified", "problem")


def content_type_of(header: Column) -> Column:
    """The media type of a Content-Type header, without parameters."""
    return F.lower(T.strip(F.substring_index(F.coalesce(header, F.lit("")), ";", 1)))


def fetch_problem(
    status: Column, content_type: Column, content_length: Column, size: Column,
    max_bytes: int = V.MAX_FILE_BYTES, allowed: Sequence[str] = V.FETCH_CONTENT_TYPES,
) -> Column:
    """Why a fetched answer is refused, NULL if it is not.  Cheap checks come first."""
    media = content_type_of(content_type)
    names = [a.strip().lower() for a in allowed]
    announced = T.strip(content_length).try_cast("bigint")
    return (
        F.when(status >= 400, F.concat(F.lit("http_"), status.cast("string")))
        .when(media == "", "content_type_missing")
        .when(~media.isin(names), "content_type_refused")
        .when(announced > max_bytes, "announced_too_large")
        .when(size > max_bytes, "too_large")
    )


def store_problem(
    content_type: Column, size: Column,
    max_bytes: int = V.MAX_FILE_BYTES, allowed: Sequence[str] = V.STORE_CONTENT_TYPES,
) -> Column:
    """Why a file is not stored, NULL if it is; the limit itself is still accepted."""
    media = F.lower(T.strip(F.coalesce(content_type, F.lit(""))))
    return F.when(~media.isin([a.lower() for a in allowed]), "invalid_type").when(size > max_bytes, "too_large")


def manifest(
    files: DataFrame, content: str = "content", content_type: str = "content_type",
    max_bytes: int = V.MAX_FILE_BYTES, allowed: Sequence[str] = V.STORE_CONTENT_TYPES,
) -> DataFrame:
    """Adds size, SHA-256 and the refusal reason; the hash is only computed for accepted files."""
    size = F.octet_length(content)
    problem = store_problem(F.col(content_type), size, max_bytes, allowed)
    return files.withColumns(
        {"size": size, "problem": problem, "sha256": F.when(problem.isNull(), F.sha2(F.col(content), 256))}
    )


def hash_matches(content: Column, expected: Column) -> Column:
    """Does the content still have the recorded hash?"""
    return F.sha2(content, 256) == expected
