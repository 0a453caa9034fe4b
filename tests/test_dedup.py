import random

import pytest
from fold_model import fold

from evidence_lake.operators import dedup

NAMES = ("seq", "source", "title", "authors", "abstract", "publication_year", "doi", "url", "external_id", "metadata")
SCHEMA = (
    "seq bigint, source string, title string, authors array<string>, abstract string, publication_year int, "
    "doi string, url string, external_id string, metadata map<string,string>"
)


def work(seq, source="openalex", **given):
    blank = dict(title=None, authors=[], abstract=None, publication_year=None, doi=None, url=None, external_id=None, metadata={})
    return {**blank, **given, "seq": seq, "source": source}


def run(rows, works, preference=("openalex", "crossref")):
    table = rows(SCHEMA, *[tuple(w[n] for n in NAMES) for w in works])
    merged = dedup.deduplicate(table, preference).orderBy("ord").drop("ord").collect()
    return [r.asDict(recursive=True) for r in merged]


def test_named_cases_give_the_walk(rows):
    """Every case uses keys of its own, so one run covers them all."""
    cases = [
        [dict(doi="10.1/a", title="A"), dict(doi="10.1/a", title="B")],
        [dict(external_id="e1", title="C"), dict(external_id="e1", title="D")],
        [dict(url="http://h.org/x", title="E"), dict(url="https://h.org/x/?q=1", title="F")],
        [dict(title="G g", publication_year=2000, authors=["Ana"]), dict(title="g  G", publication_year=2000, authors=["ana"])],
        [dict(title="H", publication_year=2000), dict(title="H", publication_year=2001)],
        [dict(title="I", publication_year=2000, authors=["x"]), dict(title="I", publication_year=2000, authors=["y"])],
        [dict(title="J"), dict(title="J")],
        # bridge: the third work joins the first; the second stays although it shares a key with the third
        [dict(doi="10.1/k"), dict(external_id="e2"), dict(doi="10.1/k", external_id="e2")],
        # masked: the record keeps its first DOI, so the third work does not match it
        [dict(doi="10.1/l1", external_id="e3"), dict(doi="10.1/l2", external_id="e3"), dict(doi="10.1/l2")],
        # title and year come from different works
        [dict(publication_year=2019, external_id="e4"), dict(title="M", publication_year=2020, external_id="e4"), dict(title="M", publication_year=2019)],
        # the hash changes once the record gets authors
        [dict(title="N", publication_year=2019, external_id="e5"), dict(title="N", publication_year=2019), dict(authors=["z"], external_id="e5"),
         dict(title="N", publication_year=2019), dict(title="N", publication_year=2019, authors=["Z"])],
        [dict(source="crossref", doi="10.1/o", title="from crossref", metadata={"a": "1", "b": "2"}), dict(doi="10.1/o", abstract="x", metadata={"b": "3"}),
         dict(source="other", doi="10.1/o", url="https://o.org/")],
        [dict(doi="10.1/p", metadata={"merged_sources": '["old"]'}), dict(doi="10.1/p")],
        [dict(doi="10.1/q"), dict(doi="10.1/q", metadata={"merged_sources": '["openalex","old"]'}), dict(doi="10.1/q", source="x")],
    ]
    works = [work(seq, **given) for seq, given in enumerate(g for case in cases for g in case)]
    want = fold(works)
    assert run(rows, works) == want
    assert len(want) == 1 + 1 + 1 + 1 + 2 + 2 + 2 + 2 + 2 + 1 + 2 + 1 + 1 + 1


def test_other_preference(rows):
    works = [work(0, doi="10.1/a", title="first"), work(1, "crossref", doi="10.1/a", title="preferred")]
    got = run(rows, works, ("crossref", "openalex"))
    assert got == fold(works, ("crossref", "openalex")) and got[0]["title"] == "preferred"
    assert got[0]["metadata"] == {"merged_sources": '["openalex","crossref"]'}


@pytest.mark.parametrize("seed, groups, pool", [(1, 150, 3), (2, 2, 60)])
def test_random_works_give_the_walk(rows, seed, groups, pool):
    rng = random.Random(seed)
    works = []
    for seq in range(500):
        group = rng.randrange(groups)
        key = lambda tag: f"{group}-{tag}{rng.randrange(pool)}"  # noqa: B023, E731
        maybe = lambda share, value: value if rng.random() < share else None
        works.append(
            work(
                seq, rng.choice(["openalex", "crossref", "x", "y"]), title=maybe(0.6, key("T")), authors=[key("A")] if rng.random() < 0.5 else [],
                publication_year=maybe(0.7, 2000 + rng.randrange(2)), doi=maybe(0.4, "10.1000/" + key("d")), abstract=maybe(0.5, key("ab")),
                url=maybe(0.4, "https://h.org/" + key("u") + rng.choice(["", "/"])), external_id=maybe(0.4, key("e")),
                metadata={rng.choice("abc"): str(seq)} if rng.random() < 0.7 else {},
            )
        )
    assert run(rows, works) == fold(works)


def test_one_key_shared_by_most_works(rows):
    """A hot key: hundreds of works with one hash and DOIs of their own become one record."""
    works = [work(i, title="Introduction", publication_year=2020, doi=f"10.1000/{i}") for i in range(400)]
    works += [work(400 + i, doi=f"10.1000/{i % 50}") for i in range(200)]
    got = run(rows, works)
    assert got == fold(works) and len(got) == 50


def plain_components(works):
    """Leaders by repeated passes over shared keys."""
    from fold_model import _keys as keys_of

    leader = {w["seq"]: w["seq"] for w in works}
    while True:
        lowest = {}
        for w in works:
            for key in keys_of(w):
                lowest[key] = min(lowest.get(key, leader[w["seq"]]), leader[w["seq"]])
        new = {w["seq"]: min([leader[w["seq"]], *(lowest[k] for k in keys_of(w))]) for w in works}
        if new == leader:
            return leader
        leader = new


def test_components_differ_where_the_walk_stops(rows):
    """A bridge joins two records, and a key that a record does not show links works all the same."""
    bridge = [dict(doi="10.1/k"), dict(external_id="e2"), dict(doi="10.1/k", external_id="e2")]
    masked = [dict(doi="10.1/l1", external_id="e3"), dict(doi="10.1/l2", external_id="e3"), dict(doi="10.1/l2")]
    alone = [dict(title="T"), dict(title="T"), dict()]
    works = [work(seq, **given) for seq, given in enumerate([*bridge, *masked, *alone])]
    table = rows(SCHEMA, *[tuple(w[n] for n in NAMES) for w in works])
    merged = dedup.deduplicate(table, strategy="components").orderBy("ord").collect()
    assert [(r.seq, r.doi, r.external_id) for r in merged] == [
        (0, "10.1/k", "e2"), (3, "10.1/l1", "e3"), (6, None, None), (7, None, None), (8, None, None)
    ]
    assert len(run(rows, works)) == 7
    assert dedup.deduplicate(rows(SCHEMA), strategy="components").count() == 0


@pytest.mark.parametrize("seed, keys", [(1, 90), (2, 30)])
def test_random_components(rows, seed, keys):
    rng = random.Random(seed)
    works = [work(i, doi=f"10.1/{rng.randrange(3 * keys)}" if rng.random() < 0.6 else None, external_id=f"e{rng.randrange(3 * keys)}" if rng.random() < 0.6 else None) for i in range(200)]
    table = rows(SCHEMA, *[tuple(w[n] for n in NAMES) for w in works])
    merged = dedup.deduplicate(table, strategy="components").collect()
    leaders = plain_components(works)
    assert sorted(r.seq for r in merged) == sorted(set(leaders.values()))


def test_long_chains_take_few_rounds(spark, monkeypatch):
    from pyspark.sql import functions as F

    from evidence_lake.operators import components

    written = []
    plain = components.write_out
    monkeypatch.setattr(components, "write_out", lambda df, label: (written.append(label), plain(df, label))[1])
    line = spark.range(0, 5000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    mixed = line.select((F.col("a") * 7919 % 5001).alias("a"), (F.col("b") * 7919 % 5001).alias("b"))
    for edges in (line, mixed, line.select(F.lit(0).cast("long").alias("a"), "b")):
        written.clear()
        found = components.connected(edges).agg(F.count("*"), F.max("root")).first()
        assert tuple(found) == (5001, 0) and len(written) < 60
    assert components.connected(line.where("a < 0")).count() == 0


def test_no_works_and_unknown_strategy(rows):
    assert run(rows, []) == []
    with pytest.raises(ValueError):
        dedup.deduplicate(rows(SCHEMA), strategy="fuzzy")


def test_contested_works_are_found_by_hashes(spark):
    schema = "ord bigint, doi string, ext string, urlk string, title string, year int, author string"
    own = spark.createDataFrame(
        [(0, "d", None, None, None, None, None), (1, None, "d", None, None, None, None), (2, "d", None, "u", None, None, None),
         (3, None, None, "u", "t", None, None), (4, None, None, None, "t", 2000, "a"), (5, None, None, None, "s", None, None)], schema,
    )
    found = dedup._contested(own)
    assert sorted(r.ord for r in found.collect()) == [0, 2, 3, 4]  # equal values of different fields are no shared key
    assert "xxhash64" in found._jdf.queryExecution().optimizedPlan().toString()
