"""Cuts by the skip list against a plain list of units, and exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence_lake.llm import fill_in_middle
from evidence_lake.llm.fill_in_middle import SkipList

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def skip_list(text):
    return SkipList(np.frombuffer(text.encode(), np.uint8))


def plain(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    assert "".join(units) == text
    digest = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, len(units))))
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def results(df):
    names = ("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output")
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    out = fill_in_middle.fill_in_middle(df)
    return out.select(*names, restored.alias("restored")).collect(), out


def test_every_rank_of_small_texts():
    rng = random.Random(3)
    for size in (0, 1, 2, 15, 16, 17, 200, 3000):
        text = "".join(rng.choice(["a", "bc", "Z", " ", "\n", "é", "漢", "𝄞", "1", "<"]) for _ in range(size))
        units, found = UNITS.findall(text), skip_list(text)
        assert (found.n, found.n_points) == (len(units), len(text))
        at = 0
        for rank in range(len(units) + 1):
            assert found.code_points_before(rank) == at
            at += len(units[rank]) if rank < len(units) else 0


def test_long_texts_over_several_blocks():
    rng = random.Random(4)
    text = "x" * 1_500_000 + "".join(rng.choice(["word ", "é", "漢 ", "ab"]) for _ in range(800_000)) + "y" * 2_000_000
    units, found = UNITS.findall(text), skip_list(text)
    assert found.n == len(units) and len(found.lanes) > 3
    ends = np.cumsum([0, *map(len, units)])
    for rank in [0, 1, 2, found.n - 1, found.n, *rng.sample(range(found.n), 300)]:
        assert found.code_points_before(rank) == ends[rank]


def test_documents(documents):
    rows, df = documents(300, seed=9)
    got, out = results(df)
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text)
        assert r.restored == (r.text or "")


@pytest.mark.parametrize("text", ["<P>", "a<S>b", "x <M", "<", "a<", "<S", "P><S<", "<p>", "a<P<S<M", "\x00a\x00"])
def test_marks_and_parts_of_marks(documents, text):
    _, df = documents(rows=[(i, text) for i in range(60)])
    got, _ = results(df)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, text)
        assert r.restored == text


def test_odd_rows_and_names(spark, documents):
    odd = [(None, None), (None, "a b c"), (5, ""), (5, "x y z"), (7, "same text"), (7, "same text")]
    _, df = documents(rows=odd)
    got, _ = results(df)
    want = sorted([(i, t, *plain(i, t)) for i, t in odd], key=str)
    assert sorted([tuple(r)[:-1] for r in got], key=str) == want
    assert fill_in_middle.fill_in_middle(df.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, "a b", "n", "f", "r", "c", 0)], "doc_id long, text string, N string, Form string, row string, cuts string, h1 int")
    out = fill_in_middle.fill_in_middle(clash)
    assert out.columns == ["doc_id", "text", "row", "cuts", "h1", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert out.first()[:5] == (1, "a b", "r", "c", 0)
