import random

import pytest
from pyspark.sql import functions as F

from evidence_lake.operators import chunking, structure
from evidence_lake.operators.embedding import EmbeddingError, EmbeddingProvider, embed_chunks, embed_column
from evidence_lake.sources import files

LINES = "document_id string, page_number int, line_no int, text string, font_size double"
ELEMENTS = "document_id string, page_number int, position int, type string, text string"


def elements_of(rows, *lines):
    found = structure.detect_elements(rows(LINES, *lines)).orderBy("document_id", "position")
    return [(r.page_number, r.position, r.type, r.level, r.text) for r in found.collect()]


def test_fragments_share_a_line_within_the_tolerance_of_its_first(rows):
    fragments = rows(
        "document_id string, page_number int, seq int, text string, y double, size double",
        ("d", 1, 0, "Hello ", 100.0, 10.0), ("d", 1, 1, "big", 99.4, 14.0), ("d", 1, 2, " drift", 98.9, 10.0), ("d", 1, 3, "   ", 50.0, 99.0),
        ("d", 1, 4, "next", 98.0, None), ("d", 2, 5, " page two ", None, 9.0),
    )
    got = structure.assemble_lines(fragments).orderBy("page_number", "line_no").collect()
    assert [(r.page_number, r.line_no, r.text, r.font_size) for r in got] == [
        (1, 0, "Hello big", 14.0), (1, 1, "driftnext", 10.0), (2, 0, "page two", 9.0),
    ]


def test_headings_paragraphs_and_tables(rows):
    body = [("d", 1, 10 + i, f"body {i}", 12.0) for i in range(5)]
    lines = [("d", 1, 0, "Title", 24.0), ("d", 1, 1, "intro", 12.0), ("d", 1, 2, "Part", 18.0), ("d", 1, 3, "a   b   c", 12.0),
             ("d", 1, 4, "1   2   3", 12.0), ("d", 1, 5, "two   cells", 12.0), ("d", 1, 6, "x" * 121, 30.0), ("d", 2, 0, "alone", 0.0)]
    assert elements_of(rows, *lines, *body) == [
        (1, 0, "heading", 2, "Title"), (1, 1, "paragraph", None, "intro"), (1, 2, "heading", 3, "Part"),
        (1, 3, "table", None, "a   b   c\n1   2   3"),
        (1, 4, "paragraph", None, "two   cells " + "x" * 121 + " " + " ".join(f"body {i}" for i in range(5))),
        (2, 5, "paragraph", None, "alone"),
    ]


def test_html_blocks(rows):
    html = "<h1>A&amp;b</h1><p class='x'>one <b>two</b></p><p> </p><table><tr><td>1</td></tr></table>"
    got = structure.html_elements(rows("page_id int, html string", (7, html))).orderBy("position").collect()
    assert [(r.position, r.type, r.level, r.text) for r in got] == [
        (0, "heading", 1, "A&b"), (1, "paragraph", None, "one two"), (2, "table", None, "1"),
    ]


@pytest.mark.parametrize("size", [50, 200, 5000])
def test_chunks_against_the_rule(rows, size):
    rng = random.Random(size)
    data, want = [], {}
    for d in range(12):
        page, heading, elements = 1, None, []
        for position in range(rng.randrange(1, 40)):
            page += rng.random() < 0.1
            kind = "heading" if rng.random() < 0.15 else rng.choice(["paragraph", "table"])
            elements.append((page, kind, rng.choice(["", "  "]) if rng.random() < 0.1 else f" {'w' * rng.randrange(1, 90)}é "))
            data.append((f"d{d}", page, position, kind, elements[-1][2]))
        chunks, texts, section, heading, last = [], [], None, None, None
        for page_, kind, text in elements:
            text = text.strip()
            if not text:
                continue
            if texts and (kind == "heading" or len("\n\n".join(texts)) + 2 + len(text) > size):
                chunks.append(("\n\n".join(texts), last, section))
                texts = []
            heading = text if kind == "heading" else heading
            section = section if texts else heading
            texts.append(text)
            last = page_
        if texts:
            chunks.append(("\n\n".join(texts), last, section))
        want[f"d{d}"] = chunks
    got = {}
    for r in chunking.chunk(rows(ELEMENTS, *data), size).orderBy("document_id", "index").collect():
        assert r["index"] == len(got.setdefault(r.document_id, [])) and r.char_count == len(r.text)
        got[r.document_id].append((r.text, r.page_number, r.section))
    assert got == {d: c for d, c in want.items() if c}


def test_chunking_repeats_and_row_wise_form_agrees(rows):
    texts = rows("doc_id int, text string", (1, "a" * 700 + "\n\n" + "b" * 400 + "\n c \n" + "d" * 1200), (2, "\n \n"), (3, "x"))
    plain = chunking.chunk_texts(texts)
    lines = structure.text_lines(texts)
    elements = lines.select("document_id", "page_number", F.col("line_no").alias("position"), F.lit("paragraph").alias("type"), "text")
    key = lambda df: sorted(map(tuple, df.select("chunk_id", "document_id", "text", "index").collect()))
    assert key(plain) == key(chunking.chunk(elements)) == key(chunking.chunk_texts(texts))
    assert [r.char_count for r in plain.filter("document_id = '1'").orderBy("index").collect()] == [700, 403, 1200]
    totals = chunking.chunk_totals(texts.select(F.col("doc_id").cast("string").alias("document_id")), plain)
    assert {r.document_id: r.total_chunks for r in totals.collect()} == {"1": 3, "2": 0, "3": 1}


def test_other_strategies_plug_in(rows):
    def one_per_element(elements, _):
        return elements.select("document_id", F.col("position").alias("index"), "text", "page_number", F.lit(None).cast("string").alias("section"))

    got = chunking.chunk(rows(ELEMENTS, ("d", 1, 0, "paragraph", "a"), ("d", 1, 1, "paragraph", "b")), strategy=one_per_element)
    assert sorted(r.text for r in got.collect()) == ["a", "b"]


def test_long_texts_take_time_in_proportion(spark):
    """25,000 and 50,000 chunks of one text: twice the text, not four times the time."""
    import time

    from pyspark.sql import functions as F

    took = {}
    for n in (1000, 25_000, 50_000):
        lines = F.repeat(F.lit("word " * 99 + "word\n"), 2 * n)  # of 499 characters: one more than half a chunk
        document = spark.range(1).select(F.lit(1).alias("doc_id"), lines.alias("text"))
        begun = time.time()
        found = chunking.chunk_texts(document, chunk_size=700).agg(F.count("*"), F.max("index"), F.sum("char_count")).first()
        took[n] = time.time() - begun
        assert tuple(found) == (2 * n, 2 * n - 1, 2 * n * 499)
    assert took[50_000] < 3 * took[25_000] + 2


class Lengths(EmbeddingProvider):
    model, dimension = "lengths", 2

    def embed_batch(self, texts):
        if "poison" in texts:
            raise EmbeddingError("refused")
        if "short" in texts:
            return [[0.0, 0.0]]
        return [[float(len(t))] * 2 for t in texts]


def test_every_chunk_gets_one_result(rows):
    texts = ["a", "bb", "poison", "c", "short", "d", "eee"]
    data = [(f"{d}-{i}", d, i, t) for d in ("x", "y", None) for i, t in enumerate(texts)]
    chunks = rows("chunk_id string, document_id string, index int, text string", *data).repartition(5)
    got = {r.chunk_id: r for r in embed_chunks(chunks, Lengths(), batch_size=2).collect()}
    assert len(got) == len(data)
    # one group in order of documents, NULL first: calls of two, across documents
    order = [f"{d}-{i}" for d in (None, "x", "y") for i in range(7)]
    for k in range(0, len(order), 2):
        call = [got[c] for c in order[k : k + 2]]
        said = [texts[int(c[-1])] for c in order[k : k + 2]]
        if "poison" in said:
            assert all(not r.success and r.error == "refused" and r.embedded_at is None for r in call)
        elif "short" in said:
            assert {r.error for r in call} == {"Provider returned 1 vectors for 2 chunks"} and not any(r.embedding for r in call)
        else:
            assert [r.embedding for r in call] == [[float(len(t))] * 2 for t in said]
            assert all((r.model, r.dimension, r.success, r.error) == ("lengths", 2, True, None) and r.embedded_at for r in call)


def test_calls_are_full(rows, tmp_path):
    log = str(tmp_path / "calls")

    class Counting(EmbeddingProvider):
        model, dimension = "counting", 1

        def embed_batch(self, texts):
            with open(log, "a") as out:
                out.write(f"{len(texts)}\n")
            return [[1.0] for _ in texts]

    data = [(f"{d}-{i}", f"d{d}", i, "t") for d in range(200) for i in range(3)]
    chunks = rows("chunk_id string, document_id string, index int, text string", *data)
    assert embed_chunks(chunks, Counting()).filter("success").count() == 600
    with open(log) as lines:
        calls = [int(x) for x in lines]
    assert calls == [100] * 6


def test_batches_do_not_depend_on_partitions(rows):
    class Neighbours(EmbeddingProvider):
        model, dimension = "neighbours", 1

        def embed_batch(self, texts):
            return [[float(sum(int(t) for t in texts))] for _ in texts]

    data = [(f"c{k}", f"d{k % 7}" if k % 5 else None, k // 7, str(k)) for k in range(90)]
    chunks = rows("chunk_id string, document_id string, index int, text string", *data)
    found = []
    for parts, calls in ((1, 1), (13, 50)):
        got = embed_chunks(chunks.repartition(parts), Neighbours(), batch_size=7, calls_per_task=calls).collect()
        found.append(sorted((r.chunk_id, r.embedding[0]) for r in got))
    order = sorted(data, key=lambda r: (r[1] is not None, r[1] or "", r[2], r[0], r[3]))
    want = {}
    for k in range(0, 90, 7):
        want |= {r[0]: float(sum(int(x[3]) for x in order[k : k + 7])) for r in order[k : k + 7]}
    assert found[0] == found[1] == sorted(want.items())
    assert embed_chunks(chunks.limit(0), Neighbours()).count() == 0


def test_query_embedding(rows):
    got = embed_column(rows("query_id int, question string", (1, "abc")), "question", lambda texts: [[len(t)] for t in texts])
    assert got.first().embedding == [3.0]
    many = rows("n int, question string", *[(k, "x" * k) for k in range(25)]).coalesce(1)
    sized = embed_column(many, "question", lambda texts: [[float(len(texts))] for _ in texts], batch_size=10)
    assert sorted(r.embedding[0] for r in sized.collect()) == [5.0] * 5 + [10.0] * 20


def test_fetch_and_store_checks(rows, spark, tmp_path):
    log = rows(
        "n int, status int, type string, announced string, size bigint",
        (0, 200, " Application/PDF; q=1", None, 10), (1, 404, "application/pdf", None, 0), (2, 200, None, None, 0), (3, 200, "image/png", None, 0),
        (4, 200, "text/html", "11", 5), (5, 200, "text/html", "x", 11), (6, 200, "text/html", "10", 10),
    )
    problem = files.fetch_problem(F.col("status"), F.col("type"), F.col("announced"), F.col("size"), max_bytes=10)
    assert [r.p for r in log.select("n", problem.alias("p")).orderBy("n").collect()] == [
        None, "http_404", "content_type_missing", "content_type_refused", "announced_too_large", "too_large", None,
    ]
    stored = files.manifest(rows("n int, content binary, content_type string", (0, b"12345", "APPLICATION/pdf "), (1, b"123456", "application/pdf"), (2, b"1", "text/html"), (3, b"1", None)), max_bytes=5)
    a, b, c, d = stored.orderBy("n").collect()
    assert a.problem is None and a.sha256 == "5994471abb01112afcc18159f6cc74b4f511b99806da59b3caf5a9c173cacfc5"
    assert (b.problem, c.problem, d.problem, b.sha256) == ("too_large", "invalid_type", "invalid_type", None)
    same = stored.filter("n = 0").select(files.hash_matches(F.col("content"), F.lit(a.sha256)).alias("y"), files.hash_matches(F.col("content"), F.lit("no")).alias("n")).first()
    assert same.y and not same.n
    (tmp_path / "f.bin").write_bytes(b"123")
    (tmp_path / "g.bin").write_bytes(b"1234")
    assert sorted((r.size, r.problem, r.content is None) for r in files.read_files(spark, str(tmp_path), max_bytes=3).collect()) == [(3, None, False), (4, "too_large", True)]


def test_html_keeps_all_shown_text(rows):
    from evidence_lake.operators.structure import html_elements

    html = (
        "<html><head><title>no</title><style>p{}</style></head>loose <b>te</b>xt<H1 class='a'>Big</H1><p>one<p>two</p><div>plain</div>"
        "<p>a &amp; b &amp;lt; &#233;&#x1F600;&#xD800; &unknown; 1 < 2</p><!-- <p>hidden</p> --><script>'</p>'</script>"
        "<ul><li>item<li>other</ul><table><tr><td><p>x</p></td><td>y</td></tr></TABLE>tail<br>end<pre>code</pre><p"
    )
    got = html_elements(rows("page_id int, html string", (1, html), (2, None), (3, ""))).orderBy("position").collect()
    assert [(r.type, r.level, r.text) for r in got] == [
        ("paragraph", None, "loose text"), ("heading", 1, "Big"), ("paragraph", None, "one"), ("paragraph", None, "two"),
        ("paragraph", None, "plain"), ("paragraph", None, "a & b &lt; é😀&#xD800; &unknown; 1 < 2"), ("paragraph", None, "item"),
        ("paragraph", None, "other"), ("table", None, "x y"), ("paragraph", None, "tail end"), ("paragraph", None, "code"),
    ]
    assert [r.position for r in got] == list(range(len(got)))


def test_one_fold_per_plan(spark, rows):
    from evidence_lake.operators import chunking

    plan = chunking.chunk_texts(rows("doc_id int, text string", (1, "a\nb")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("aggregate(") == 2  # lists of starts, and in it the starts of a list


def test_totals_from_lengths(rows):
    from evidence_lake.operators import chunking

    documents = rows("doc_id int, text string", (1, "a\n\nb" * 900), (2, ""), (3, None), (4, " x "))
    of_chunks = chunking.chunk_totals(documents.selectExpr("string(doc_id) AS document_id"), chunking.chunk_texts(documents))
    assert sorted(of_chunks.collect()) == sorted(chunking.text_chunk_totals(documents).collect())


def test_tasks_of_calls_stay_few(rows, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from evidence_lake.operators import embedding

    assert embedding._tasks(680_000, 16, 12) == 1024 and embedding._tasks(680_000, 16, 4096) == 4096
    assert [embedding._tasks(calls, 16, 4) for calls in (0, 1, 3, 40, 160)] == [1, 1, 3, 4, 10]
    dealt, plain = [], DataFrame.repartitionByRange
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda self, *by: (dealt.append(by), plain(self, *by))[1])
    chunks = rows("chunk_id string, document_id string, index int, text string", ("a", "d", 0, "y"), ("a", "d", 0, "x"), ("a", "c", 1, "z"))
    placed = embedding.numbered(chunks, ["document_id", "index", "chunk_id"], "ordered", ties=("text",))
    assert [r.text for r in placed.orderBy("place").collect()] == ["z", "x", "y"]
    assert dealt == [("document_id", "index", "chunk_id")]  # long texts are not among the sampled keys
