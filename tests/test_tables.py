import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evidence_lake.operators import quality, tables
from evidence_lake.sources import storage

DAY = datetime.datetime(2026, 1, 1)


def test_pages_are_newest_first(rows):
    table = rows("id int, parent string, created timestamp", *[(i, "ab"[i % 2], DAY + datetime.timedelta(days=i // 2)) for i in range(10)])
    assert [r.id for r in tables.newest(table, "created", "id", 3, 1).collect()] == [9, 6, 7]
    assert [r.id for r in tables.newest_of(table, "parent", "a", "created", "id", 2).collect()] == [8, 6]
    each = tables.newest_of_each(table, "parent", "created", "id", 2, 1)
    assert sorted((r.parent, r.place, r.id) for r in each.collect()) == [("a", 2, 6), ("a", 3, 4), ("b", 2, 7), ("b", 3, 5)]
    for limit, offset in ((0, 0), (201, 0), (1, -1)):
        with pytest.raises(ValueError):
            tables.newest(table, "created", "id", limit, offset)
    assert {r.id for r in tables.lookup(table, rows("id int", (1,), (99,)), "id").collect()} == {1}


def test_patch_changes_only_what_is_present(rows):
    table = rows("id int, a string, b int, updated_at timestamp", (1, "x", 1, DAY), (2, "y", 2, DAY), (3, "z", 3, DAY))
    changes = rows(
        "id int, present array<string>, seq int, a string, b int",
        (1, ["a"], 1, "first", 9), (1, ["a", "b"], 2, None, 7), (2, [], 1, "no", 0), (9, ["a"], 1, "nobody", 0),
    )
    later = DAY + datetime.timedelta(days=1)
    got = tables.patch(table, changes, "id", at=F.lit(later)).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, None, 7, later), (2, "y", 2, DAY), (3, "z", 3, DAY)]
    documents = rows("id int, status string", (1, "pending"), (2, "failed"))
    got = tables.set_status(documents, rows("id int, status string, seq int", (2, "pending", 1)), "id", updated=None)
    assert {r.id: r.status for r in got.collect()} == {1: "pending", 2: "pending"}


def test_cascade(rows):
    kept = tables.cascade_delete(
        rows("id int", (1,), (2,)), rows("id string, research_id int", ("a", 1), ("b", 2), ("c", 2)),
        rows("chunk_id int, document_id string", (10, "a"), (11, "b"), (12, "c"), (13, "a")), rows("id int", (1,)),
    )
    assert [df.count() for df in kept] == [1, 2, 2] and {r.document_id for r in kept[2].collect()} == {"b", "c"}


def test_saving_works(rows, spark, tmp_path):
    schema = "research_id string, seq bigint, source string, external_id string, title string, authors array<string>, publication_year int, doi string, url string, abstract string, metadata map<string,string>"
    works = rows(schema, ("r1", 0, "openalex", None, None, [], None, None, None, None, {}), ("r2", 1, "crossref", None, " t ", [], 2000, None, None, None, {}))
    stored, lost = tables.to_documents(works, rows("id string", ("r1",)))
    row = stored.first()
    assert (stored.count(), row.title, row.status, [r.seq for r in lost.collect()]) == (1, "(sem título)", "pending", [1])
    path = str(tmp_path / "documents")
    storage.append_documents(stored, path)
    storage.append_documents(stored, path)  # saving twice stores twice
    assert storage.read_table(spark, path).count() == 2
    bad = stored.unionByName(stored.withColumn("source", F.repeat(F.lit("x"), 51)))
    with pytest.raises(PySparkException, match="source_too_long"):
        storage.append_documents(bad, path)
    assert storage.read_table(spark, path).count() == 2  # nothing of a failed save stays
    with pytest.raises(PySparkException):
        storage.write_snapshot(stored, path)


def test_rules(rows):
    research = quality.strip_strings(rows("title string, objective string, question string, status string", ("  ", "o", None, "DONE"), ("t", "o" * 5001, "q", "READY"), (" t ", "o", "q", "DRAFT")))
    rules = quality.research_rules(research.columns)
    assert [r.violations for r in quality.check(research, rules).collect()] == [["title_too_short", "question_missing", "status_unknown"], ["objective_too_long"], []]
    good, bad = quality.quarantine(research, rules)
    assert (good.count(), bad.count(), good.first().title) == (1, 2, "t")
    with pytest.raises(PySparkException, match="objective_too_long|title_too_short"):
        quality.enforce(research, rules).collect()
    assert quality.enforce(good, rules).count() == 1
    form = [r.e for r in research.select(quality.research_form_errors().alias("e")).collect()]
    assert form == [{"title": "Título é obrigatório.", "question": "Pergunta é obrigatória."}, {"objective": "Objetivo deve ter no máximo 5000 caracteres."}, {}]


def test_first_error_per_field(rows):
    detail = [(["body", "title"], "one"), (["title"], "two"), ([], "root"), (["a"], None), (["a"], ""), (["a"], "late"), (None, "again")]
    df = rows("d array<struct<loc:array<string>,msg:string>>", (detail,), (None,))
    assert [r.e for r in df.select(quality.first_errors(F.col("d")).alias("e")).collect()] == [{"title": "one", "_": "root", "a": "late"}, {}]


def test_references_and_keys(rows):
    child, parent = rows("id int, p int", (1, 1), (2, 5), (3, 5)), rows("id int", (1,))
    assert {r.id for r in quality.orphans(child, parent, "p", "id").collect()} == {2, 3}
    assert [tuple(r) for r in quality.repeated_keys(child, "p").collect()] == [(5, 2)]
    known = rows("s string", ("openalex",), ("x",)).select(quality.is_known_source(F.col("s")).alias("k")).collect()
    assert [r.k for r in known] == [True, False]


def test_changes_keep_to_the_field_rules(rows):
    documents = rows("id int, source string, title string, status string", (1, "s", "t", "pending"))
    schema = "id int, present array<string>, seq int, source string, title string, status string"
    changes = rows(
        schema,
        (1, ["title"], 1, None, "new", None), (1, ["title"], 2, None, "", None), (1, ["title"], 3, None, None, None),
        (1, ["status"], 4, None, None, "odd"), (1, ["source"], 5, "x" * 51, None, None), (1, [], 6, None, None, None),
    )
    rules = quality.document_rules(documents.columns)
    good, bad = quality.quarantine(changes, quality.change_rules(rules))
    assert sorted(r.seq for r in good.collect()) == [1, 6]
    assert sorted((r.seq, tuple(r.violations)) for r in bad.collect()) == [
        (2, ("title_too_short",)), (3, ("title_missing",)), (4, ("status_unknown",)), (5, ("source_too_long",))
    ]
    assert tables.patch(documents, good, "id", None, rules=rules).first().title == "new"
    with pytest.raises(Exception, match="title_too_short"):
        tables.patch(documents, changes.filter("seq = 2"), "id", None, rules=rules).collect()
    with pytest.raises(Exception, match="status_unknown"):
        tables.set_status(documents, rows("id int, status string, seq int", (1, "odd", 1)), "id", updated=None).collect()


def test_strings_in_lists_are_stripped_too(rows):
    got = quality.strip_strings(rows("a string, b array<string>", (" x ", [" y", None, "z\t"]))).first()
    assert (got.a, got.b) == ("x", ["y", None, "z"])
