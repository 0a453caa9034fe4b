"""Arrow batches of bounded size."""

from __future__ import annotations

from pyspark.sql import SparkSession

_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep batches of texts to 32 MB (Spark's own default is 2 GB), unless the session asks for less."""
    try:
        now = int(spark.conf.get(_KEY))
    except Exception:  # unset, or written with a unit by the user
        now = 2**31 - 1
    if now > BATCH_BYTES:
        spark.conf.set(_KEY, str(BATCH_BYTES))
