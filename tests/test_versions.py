"""Stored tables: changes in one step, on the buckets they touch."""

import os
import threading

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evidence_lake.operators import quality
from evidence_lake.sources import versions
from evidence_lake.sources.versions import BucketTable, Conflict

SCHEMA = "id int, source string, n int"


def numbered(spark, low, high):
    return spark.range(low, high).select(F.col("id").cast("int"), F.concat(F.lit("s"), "id").alias("source"), F.lit(0).alias("n"))


def ids(table, number=None):
    return sorted(r.id for r in table.read(number).collect())


def folders(version):
    return {f for of in version.folders.values() for f in of}


def test_appending_again_stores_nothing_twice(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = BucketTable.create(numbered(spark, 0, 50), path, "id", buckets=8)
    table.append(numbered(spark, 40, 60))
    again = table.append(numbered(spark, 40, 60))
    assert again.number == 2 and ids(table) == list(range(60)) and ids(table, 1) == list(range(50))
    twice = numbered(spark, 60, 61)
    nameless = twice.select(F.lit(None).cast("int").alias("id"), "source", "n")
    table.append(twice.unionByName(twice).unionByName(nameless))
    assert [r.id for r in table.read().where("id is null or id = 60").orderBy("id").collect()] == [None, 60]
    assert table.append(numbered(spark, 0, 0)).number == 3
    assert BucketTable(spark, path).read().count() == 62
    with pytest.raises(Conflict):
        BucketTable.create(numbered(spark, 0, 1), path, "id")


def test_a_failed_append_is_never_seen(spark, tmp_path):
    table = BucketTable.create(numbered(spark, 0, 20), f"{tmp_path}/t", "id", buckets=4)
    seen = []
    flawed = numbered(spark, 20, 40).withColumn("source", F.when(F.col("id") == 33, F.repeat(F.lit("x"), 51)).otherwise(F.col("source")))
    with pytest.raises(PySparkException, match="source_too_long"):
        table.append(flawed, quality.document_rules(["source"]))
    assert (table.versions(), ids(table)) == ([1], list(range(20)))

    # half of the job is written, then it dies
    put = BucketTable._put
    try:
        BucketTable._put = lambda self, version: (seen.append(ids(self)), os.listdir(f"{tmp_path}/t/rows"), 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.append(numbered(spark, 20, 40))
    finally:
        BucketTable._put = put
    assert seen == [list(range(20))] and ids(table) == list(range(20))
    left = set(os.listdir(f"{tmp_path}/t/rows"))
    table.append(numbered(spark, 20, 40))
    assert ids(table) == list(range(40))
    table.forget()
    assert table.versions() == [2] and ids(table) == list(range(40))
    assert set(os.listdir(f"{tmp_path}/t/rows")) == folders(table.version()) and len(left) == 2


def test_readers_see_a_whole_version_while_others_change_it(spark, tmp_path):
    table = BucketTable.create(numbered(spark, 0, 30), f"{tmp_path}/t", "id", buckets=4)
    before = table.read()
    table.delete(spark.range(0, 10).select(F.col("id").cast("int")))
    assert before.count() == 30 and ids(table) == list(range(10, 30))


def test_of_two_changes_at_a_time_none_is_lost(spark, tmp_path):
    table = BucketTable.create(numbered(spark, 0, 10), f"{tmp_path}/t", "id", buckets=4)
    failed = []

    def add(low):
        try:
            BucketTable(spark, f"{tmp_path}/t").append(numbered(spark, low, low + 10))
        except Exception as error:  # into the main thread
            failed.append(error)

    threads = [threading.Thread(target=add, args=(low,)) for low in (10, 20, 30)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and ids(table) == list(range(40)) and table.versions() == [1, 2, 3, 4]


def test_a_patch_rewrites_the_buckets_it_touches(spark, rows, tmp_path):
    table = BucketTable.create(numbered(spark, 0, 400), f"{tmp_path}/t", "id", buckets=16)
    first = table.version()
    changes = rows("id int, present array<string>, seq int, n int", (7, ["n"], 1, 5), (7, ["n"], 2, 6), (9, ["n"], 1, 4), (999, ["n"], 1, 1))
    after = table.patch(changes, updated=None)
    touched = [b for b in after.folders if after.folders[b] != first.folders[b]]
    assert 1 <= len(touched) <= 3
    (new,) = folders(after) - folders(first)
    written = {n for n in os.listdir(f"{tmp_path}/t/rows/{new}") if n.startswith("bucket=")}
    assert written == {f"bucket={b}" for b in touched}
    assert {r.id: r.n for r in table.read().where("n > 0").collect()} == {7: 6, 9: 4} and table.read().count() == 400
    # files of other buckets are not opened: they may be anything
    (old,) = folders(first)
    for name in os.listdir(f"{tmp_path}/t/rows/{old}"):
        if name.startswith("bucket=") and int(name[7:]) not in touched:
            for file in os.listdir(f"{tmp_path}/t/rows/{old}/{name}"):
                if file.endswith(".parquet"):
                    with open(f"{tmp_path}/t/rows/{old}/{name}/{file}", "wb") as out:
                        out.write(b"not a table")
    table.patch(rows("id int, present array<string>, seq int, n int", (7, ["n"], 1, 8)), updated=None)
    assert table.patch(rows("id int, present array<string>, seq int, n int").limit(0), updated=None).number == 3


def test_cascade(spark, rows, tmp_path):
    researches = BucketTable.create(spark.range(0, 40).select(F.col("id").cast("int")), f"{tmp_path}/r", "id", buckets=16)
    documents = spark.range(0, 200).select(F.concat(F.lit("d"), "id").alias("id"), (F.col("id") % 40).cast("int").alias("research_id"))
    chunks = spark.range(0, 1000).select("id", F.concat(F.lit("d"), F.col("id") % 200).alias("document_id"))
    documents = BucketTable.create(documents, f"{tmp_path}/d", "id", "research_id", 16)
    chunks = BucketTable.create(chunks, f"{tmp_path}/c", "id", "document_id", 64)
    before = [t.version() for t in (researches, documents, chunks)]
    after = versions.cascade_delete(researches, documents, chunks, rows("id int", (3,), (77,)))
    assert [t.read().count() for t in (researches, documents, chunks)] == [39, 195, 975]
    touched = [sum(b.folders[k] != a.folders.get(k) for k in b.folders) for b, a in zip(before, after)]
    assert touched[0] <= 2 and touched[1] <= 2 and touched[2] <= 5
    again = versions.cascade_delete(researches, documents, chunks, rows("id int", (3,), (77,)))
    assert again[1].number == after[1].number or documents.read().count() == 195
