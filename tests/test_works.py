import json

import pytest
from pyspark.sql import functions as F

from evidence_lake.operators.dedup import deduplicate
from evidence_lake.operators.normalize import normalize_works
from evidence_lake.sources import works as W
from evidence_lake.streaming.ingest import ingest, stream_works


def payloads(rows, *answers):
    return rows("payload_id bigint, payload string", *[(i, a if isinstance(a, str) else json.dumps(a)) for i, a in enumerate(answers)])


FULL = {
    "id": "https://openalex.org/W77", "doi": "https://doi.org/10.4000/reefs.12", "title": "Tides and reefs", "publication_year": 2009,
    "type": "book", "cited_by_count": 3, "authorships": [{"author": {"display_name": "Noor"}}, {"author": {"display_name": ""}}, {"author": None}],
    "abstract_inverted_index": {"the": [1, 4], "Under": [0], "moon,": [2], "reefs": [5], "and": [3]},
}


def test_openalex(rows):
    works = W.openalex_works(payloads(rows, {"results": [FULL, 5, "x", {"id": "https://openalex.org/W5"}, {"id": "i", "publication_year": 30000}]}))
    full, minimal, odd = works.orderBy("seq").collect()
    assert (full.title, full.authors, full.abstract) == ("Tides and reefs", ["Noor"], "Under the moon, and the reefs")
    assert (full.doi, full.url, full.publication_year) == ("10.4000/reefs.12", FULL["doi"], 2009)
    assert full.metadata == {"type": '"book"', "cited_by_count": "3"}
    assert (minimal.title, minimal.abstract, minimal.publication_year, minimal.doi, minimal.authors, minimal.metadata) == (None, None, None, None, [], {})
    assert minimal.url == minimal.external_id == "https://openalex.org/W5"
    assert odd.publication_year is None and odd.metadata["raw_publication_year"] == "30000"
    assert odd.url is None and odd.metadata["raw_url"] == '"i"'


def test_abstract_collisions_and_gaps(rows):
    index = {"late": [7], "first": [0, 2], "wins": [2]}
    works = W.openalex_works(payloads(rows, {"results": [{"id": "x", "abstract_inverted_index": index}]}))
    assert works.first().abstract == "first wins late"


def test_malformed_answers_are_set_aside(rows):
    answers = payloads(rows, {"results": []}, {"x": 1}, "no json", {"results": {"a": 1}})
    assert [r.payload_id for r in W.malformed_payloads(answers, "openalex").orderBy("payload_id").collect()] == [1, 2, 3]
    assert W.openalex_works(answers).count() == 0
    answers = payloads(rows, {"message": {"items": []}}, {"message": []}, {"items": []})
    assert W.malformed_payloads(answers, "crossref").count() == 2


def test_crossref(rows):
    full = {
        "DOI": "10.4000/tide.9", "title": ["Low water", "b"], "type": "report", "is-referenced-by-count": 11,
        "abstract": "<jats:p>Salt</jats:p>", "author": [{"given": "Noor", "family": "Berg"}, {"family": "Only"}, {"name": "Harbour Board"}, {"given": ""}],
        "published": {"date-parts": [[2011, 2]]}, "created": {"date-parts": [[2010]]},
        "resource": {"primary": {"URL": "https://tides.example/low"}}, "link": [{"URL": "https://tides.example/other"}],
    }
    linked = {"DOI": "10.4000/l", "link": [{}, {"URL": "https://tides.example/other"}], "created": {"date-parts": [[2010]]}, "published": {"date-parts": [[0]]}}
    a, b, c = W.crossref_works(payloads(rows, {"message": {"items": [full, linked, {"DOI": "10.4000/bare"}]}})).orderBy("seq").collect()
    assert (a.title, a.abstract, a.url, a.publication_year) == ("Low water", "<jats:p>Salt</jats:p>", "https://tides.example/low", 2011)
    assert a.external_id == a.doi == "10.4000/tide.9" and a.authors == ["Noor Berg", "Only", "Harbour Board"]
    assert a.metadata == {"type": '"report"', "is_referenced_by_count": "11"}
    assert (b.url, b.publication_year) == ("https://tides.example/other", 2010)
    assert (c.url, c.title, c.publication_year) == ("https://doi.org/10.4000/bare", None, None)


def test_normalizing_twice_changes_nothing(rows):
    schema = "seq bigint, source string, title string, authors array<string>, abstract string, publication_year string, doi string, url string, external_id string, metadata map<string,string>"
    raw = rows(schema, (0, "s", " t ", [" a ", ""], " ", "30000", "bad", "ftp://x", None, {"raw_doi": '"kept"'}), (1, "s", None, None, None, "2020", None, None, None, None))
    once = normalize_works(raw)
    twice = normalize_works(once)
    assert once.orderBy("seq").collect() == twice.orderBy("seq").collect()
    first = once.orderBy("seq").first()
    assert first.metadata == {"raw_doi": '"kept"', "raw_publication_year": "30000", "raw_url": '"ftp://x"'}


def test_search_and_union(rows):
    answers = payloads(rows, {"results": [FULL]})
    with pytest.raises(W.UnknownProvider):
        W.search(answers, "nowhere")
    found = W.search(answers, deduplicate=False)
    both = W.union_works(found, found)
    assert [(r.seq.list, r.seq.place.answer, r.seq.place.pos) for r in both.orderBy("seq").collect()] == [(0, 0, 0), (1, 0, 0)]


def test_malformed_answers_fail_a_search(rows):
    answers = payloads(rows, {"results": [FULL]}, {"nothing": 1})
    with pytest.raises(Exception, match="without a list of works"):
        W.search(answers, deduplicate=False).collect()
    assert W.search(answers, deduplicate=False, malformed="skip").count() == 1
    with pytest.raises(ValueError):
        W.search(answers, malformed="guess")


def test_long_answers_keep_their_places(rows):
    """More works in an answer than any fixed number of bits would leave room for."""
    first = {"results": ["{not an object", *[{"id": f"a{k}", "doi": f"10.1234/a{k}"} for k in range(5000)]]}
    second = {"results": [{"id": f"b{k}", "doi": "10.1234/a4500" if k == 3 else f"10.1234/b{k}"} for k in range(1000)]}
    found = W.search(payloads(rows, first, second))
    assert found.count() == 5999
    assert found.filter("external_id = 'b904'").count() == 1 and found.filter("external_id = 'b3'").count() == 0


def test_two_works_at_one_place_fail(rows):
    works = W.openalex_works(payloads(rows, {"results": [FULL]}))
    with pytest.raises(Exception, match="several works at the place"):
        deduplicate(works.unionByName(works)).collect()


def test_merging_does_not_depend_on_splits(spark, tmp_path):
    for k in range(3):
        lines = [json.dumps({"results": [{"id": f"i{k}-{n}", "doi": f"10.1234/{n % 7}", "title": f"t{k}-{n}"}]}) for n in range(40)]
        (tmp_path / f"answers-{k}.json").write_text("\n".join(lines) + "\n")
    results = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "700b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            payload = W.read_payloads(spark, str(tmp_path))
            merged = W.search(payload).orderBy("ord").select("title", "external_id", "doi").collect()
            results.append((payload.rdd.getNumPartitions(), merged))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (few, one), (many, other) = results
    assert few < many and one == other and len(one) == 7


def test_streamed_payloads_give_the_same_works(spark, rows, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"results": [FULL]}) + "\n" + json.dumps({"results": [{"id": "x"}]}) + "\n")
    run = ingest(stream_works(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "progress"))
    run.awaitTermination(60)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = W.openalex_works(W.read_payloads(spark, str(tmp_path / "in")))
    pick = lambda df: sorted(map(str, df.select(*W.WORK_COLUMNS[1:]).collect()))
    assert pick(streamed) == pick(batch) and streamed.count() == 2
    numbered = W.number_works(streamed)
    assert set(numbered.columns) == set(W.WORK_COLUMNS) and numbered.select("seq").distinct().count() == 2
    again = ingest(stream_works(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "progress"))
    again.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2  # landed files count once


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("malformed", ["fail", "skip"])
def test_answers_and_works_are_parsed_once(rows, malformed):
    """Whatever is asked of the works; a filter on abstracts rebuilds them, ``with_abstract`` does not."""
    answers = rows("payload_id int, payload string", (1, '{"results":[{"id":"w","title":" t ","abstract_inverted_index":{"b":[1],"a":[0]}},{"id":"v"},7]}'))
    works = W.search(answers, "openalex", deduplicate=False, malformed=malformed)
    for asked in (works, works.where("doi is null and title like 't%'"), works.where("abstract is not null"), W.with_abstract(works)):
        assert _plan(asked).count("from_json(") == 2
    assert _plan(W.with_abstract(works)).count("map_entries(") == 1
    assert _plan(works).count("map_entries(") == 1
    assert [r.abstract for r in W.with_abstract(works).collect()] == ["a b"]
    assert W.with_abstract(works).columns == works.columns
    assert works.count() == 2


def test_landing_sets_malformed_answers_apart(spark, rows, tmp_path):
    good = '{"results":[{"id":"w","title":"t"}]}'
    answers = rows("payload_id struct<file: string, line: bigint>, payload string",
                   (("a", 1), good), (("a", 2), "{"), (("b", 1), None), (("b", 2), '{"results":[]}'), (("b", 3), '{"message":{}}'))
    landed = W.land_answers(answers, "openalex", f"{tmp_path}/answers")
    assert (landed.accepted, landed.refused) == (2, 3)
    assert sorted(tuple(r.payload_id) for r in landed.malformed().collect()) == [("a", 2), ("b", 1), ("b", 3)]
    works = W.search(landed.payloads(), "openalex", deduplicate=False).collect()
    assert [(tuple(r.seq.answer), r.title) for r in works] == [(("a", 1), "t")]
    empty = W.land_answers(answers.limit(0), "crossref", f"{tmp_path}/none")
    assert (empty.accepted, empty.refused, empty.payloads().count()) == (0, 0, 0)
    with pytest.raises(W.UnknownProvider):
        W.land_answers(answers, "elsewhere", f"{tmp_path}/x")


def test_landing_reads_answers_once(spark, rows, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    answers = rows("payload_id int, payload string", (1, '{"results":[]}'), (2, "x"), (3, '{"results":[]}'))
    from pyspark.sql import functions as F

    watched = answers.select("payload_id", F.udf(seen, "string")("payload").alias("payload"))
    W.land_answers(watched, "openalex", f"{tmp_path}/answers")
    assert read.value == 3


def test_inverted_index_row_by_row(rows):
    from evidence_lake.plans.works_queries import _inverted_index

    texts = ["b a  b\nc b", "", " \n ", None, "é", "a a a"]
    indexed = rows("id int, text string", *enumerate(texts)).select("id", _inverted_index(F.col("text")).alias("index"))
    got = {r.id: r["index"] and {w: list(at) for w, at in r["index"].items()} for r in indexed.collect()}
    assert got == {0: {"a": [1], "b": [0, 2, 4], "c": [3]}, 1: None, 2: None, 3: None, 4: {"é": [0]}, 5: {"a": [0, 1, 2]}}


def test_openalex_answers_without_sending_words(spark):
    from evidence_lake.plans.works_queries import openalex_payloads

    plan = openalex_payloads(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
