import random
import uuid

import pytest
from pyspark.sql import functions as F

from evidence_lake.functions import ids, maps
from evidence_lake.functions import text as T


def each(rows, function, values, kind="string"):
    df = rows(f"n int, x {kind}", *enumerate(values))
    return [r.y for r in df.select("n", function(F.col("x")).alias("y")).orderBy("n").collect()]


@pytest.mark.parametrize(
    "function, cases",
    [
        (T.normalize_text, {"  Deep Learning  ": "Deep Learning", "   ": None, "": None, None: None, " a\xa0": "a"}),
        (T.normalize_year, {"2023": 2023, "1000": 1000, "2100": 2100, "-100": None, "2101": None, "not a year": None, "--5": None, None: None}),
        (
            T.normalize_doi,
            {
                "https://doi.org/10.1000/xyz123": "10.1000/xyz123", "HTTP://DOI.ORG/10.1000/Xyz": "10.1000/Xyz",
                "doi:10.1000/x": "10.1000/x", " 10.1000/x ": "10.1000/x", "not-a-doi": None, "10.abc/xyz": None,
                "https://dx.doi.org/10.1000/x": None, "10.1000/a b": None, "doi: 10.1000/x": None, None: None,
            },
        ),
        (
            T.normalize_url,
            {
                "http://example.org/a": "http://example.org/a", "https://example.org": "https://example.org",
                " https://e.org/p ": "https://e.org/p", "HTTPS://E.org": "HTTPS://E.org", "http://a b/x": "http://a b/x",
                "not a url": None, "ftp://example.org/x": None, "": None, "http:///x": None, "http://[abc/x": None, None: None,
            },
        ),
        (
            T.url_key,
            {
                "http://Example.org/A/": "example.org/a", "https://example.org/A?q=1#f": "example.org/a",
                "https://www.example.org///": "www.example.org", "https://e.org/a;b/c;d?x": "e.org/a;b/c", "nothing": None, None: None,
            },
        ),
        (T.collapse_whitespace, {" a\t\n b c ": "a b c"}),
        (T.json_string, {'a"b\n': '"a\\"b\\n"', None: None}),
    ],
)
def test_scalar_functions(rows, function, cases):
    assert each(rows, function, list(cases)) == list(cases.values())


def test_authors(rows):
    got = each(rows, T.normalize_authors, [[" Ana Silva ", "", "   ", None, "Bruno"], None, []], "array<string>")
    assert got == [["Ana Silva", "Bruno"], [], []]


def test_words_keep_repeats_and_letters_of_all_scripts(rows):
    assert each(rows, T.words, ["Ação x_1, X_1! 数据", ""]) == [["ação", "x_1", "x_1", "数据"], []]


def test_content_hash_needs_title_and_year(rows):
    df = rows("t string, a string, y int", (" A  b", "Ana ", 2000), ("a B", "ana", 2000), ("a b", None, 2000), (None, "x", 2000), ("a b", "x", None))
    got = [r.h for r in df.select(T.content_hash(F.col("t"), F.col("a"), F.col("y")).alias("h")).collect()]
    assert got[0] == got[1] != got[2] and got[2] and got[3:] == [None, None]


def test_quoting_is_python_repr(rows):
    texts = ["plain", "a'b", 'a"b', "a'b\"c", "x\ny\t\\z\r", "é\xa0b​q\x01", "\U0001f600 \U000e0001", "\xad z"]
    assert each(rows, T.quoted, texts) == [repr(t) for t in texts]


def test_two_decimals_round_the_binary_value(rows):
    rng = random.Random(5)
    numbers = [rng.random() for _ in range(500)] + [k / 1000 for k in range(1001)] + [-0.145, -0.5, 1.0]
    assert each(rows, T.two_decimals, numbers, "double") == [f"{x:.2f}" for x in numbers]


def test_ids_are_version_5_uuids(rows):
    space = uuid.UUID("6f2f6e0a-9d3f-4b8a-9c0a-9a2e5b7d5a1e")
    assert each(rows, ids.uuid5, ["a", "é"]) == [str(uuid.uuid5(space, t)) for t in ("a", "é")]
    df = rows("d string, i int, t string", ("doc", 3, "text"), (None, 0, "x"))
    got = [r[0] for r in df.select(ids.chunk_id(F.col("d"), F.col("i"), F.col("t"))).collect()]
    assert got == [str(uuid.uuid5(space, "doc:3:text")), str(uuid.uuid5(space, "None:0:x"))]


def test_map_merge_prefers_the_first(rows):
    df = rows("a map<string,string>, b map<string,string>", ({"x": "1"}, {"x": "2", "y": "3"}))
    assert df.select(maps.merge_maps(F.col("a"), F.col("b")).alias("m")).first().m == {"x": "1", "y": "3"}
