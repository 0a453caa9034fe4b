"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next one's ``docs``.  All but the last return the columns of ``documents``.

1. quality          rejected documents go (labels of ``sf_dir``, held-out ones not learned from)
2. lines            lines covered by repeated windows of three lines go; n_chars follows the text
3. near_duplicates  of each group of linked SimHash fingerprints the smallest doc_id stays; of these, in order of
                    doc_id, what is similar to none that stays
4. benchmark        documents with a passage of a benchmark item go
5. packing          what is left is packed into sequences of at most 2048 tokens
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake.llm import decontamination, line_dedup, packing, quality, simhash
from evidence_lake.session import ship_package, write_out

#: No SQL: scores, fingerprints and token ids cannot be expressed in it.
ORACLE_SQL = None

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = ship_package(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(docs, labels)
    return docs.where(quality.score(model, F.col("text")) >= quality.THRESHOLD)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    reduced = line_dedup.dedup_lines(docs)
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast("long")
    return reduced.withColumn("n_chars", n_chars).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.keep_one_of_each(docs, bits=simhash.BITS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.find_contamination(docs, benchmark).where("n_hit = 0").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality", keep_good),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to the packed pieces."""
    docs = ship_package(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_out(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
