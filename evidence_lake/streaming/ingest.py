"""Landed payloads as a stream: the same row-wise readers, run incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidence_lake import fixed_values as V
from evidence_lake.sources.works import PROVIDERS, UnknownProvider


def stream_works(spark: SparkSession, landing: str, provider: str = V.DEFAULT_PROVIDER) -> DataFrame:
    """Normalized works of payload files as they land.

    A stream has no list order, so there is no ``seq``; number the stored works with
    :func:`evidence_lake.sources.works.number_works` before merging them.
    """
    if provider not in PROVIDERS:
        raise UnknownProvider(provider)
    payloads = spark.readStream.format("text").load(landing).select(
        F.lit(0).cast("bigint").alias("payload_id"), F.col("value").alias("payload")
    )
    return PROVIDERS[provider](payloads).drop("seq")


def ingest(works: DataFrame, target: str, progress: str) -> StreamingQuery:
    """Append a works stream to parquet exactly once; ``progress`` is the stream's checkpoint folder."""
    return (
        works.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
