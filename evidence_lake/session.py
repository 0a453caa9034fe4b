"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "evidence_lake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Hand this package to the Python workers, which need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_evidence_lake_shipped", False):
        return spark
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="evidence_lake-"), "evidence_lake")
    archive = shutil.make_archive(target, "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(archive)
    context._evidence_lake_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables.

    Taken from ``spark.checkpoint.dir``.  Only a local master, where driver and
    executors are one process, may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="evidence_lake-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/evidence_lake/{label}-{uuid.uuid4().hex}"


def write_out(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage to ``df`` and lives outside the executors, so losing
    executors costs nothing that was already computed.
    """
    spark = df.sparkSession
    path = new_table_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete what ``write_out`` wrote, once nothing reads it any more; other DataFrames are left alone."""
    for table in tables:
        path = getattr(table, "_written_to", None)
        if path:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores when its files give fewer splits than there are cores.

    For expensive row-wise work on a few unsplittable files; larger inputs stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
