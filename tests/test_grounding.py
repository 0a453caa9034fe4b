"""Passages looked up in a corpus against comparison with every chunk."""

import random

import pytest
from pyspark.sql import functions as F

from evidence_lake.operators import evidence, grounding


def corpus(rng, n):
    words = ["the", "of", "and", "a", *(f"w{k}" for k in range(60)), "Straße", "naïve", "x_1", "42", "漢字"]
    weights = [20, 15, 10, 10, *([1] * (len(words) - 4))]
    return [" ".join(rng.choices(words, weights, k=rng.randrange(0, 60))) for _ in range(n)]


def rows_of(rng):
    chunks = corpus(rng, 60)
    passages = corpus(rng, 25)
    for text in rng.sample([c for c in chunks if len(c) > 30], 25):  # cut anywhere, with other white space
        start = rng.randrange(len(text) - 20)
        passages.append(text[start : start + rng.randrange(1, 60)].replace(" ", rng.choice([" ", "  ", "\n"])))
    for text in rng.sample(chunks, 20):  # with some words of their own
        words = text.split()
        passages.append(" ".join(w if rng.random() < 0.7 else f"own{rng.randrange(9)}" for w in words))
    passages += ["", " ", None, "e", "he", "!", "...", "w1 w", "the the the of own1", chunks[0], chunks[0]]
    chunks += ["", "  ", None, "...", chunks[1], chunks[1], "the", "𝄞 the end", "a\tb"]
    passages += ["𝄞 t", "a b"]
    return list(enumerate(passages)), list(enumerate(chunks))


@pytest.mark.parametrize("seed, block", [(1, grounding.BLOCK), (2, 3)])
def test_same_as_every_pair(spark, seed, block):
    passages, chunks = rows_of(random.Random(seed))
    said = spark.createDataFrame(passages, "passage_id int, text string").repartition(3)
    sources = spark.createDataFrame(chunks, "chunk_id int, text string").repartition(3)
    got = [tuple(r) for r in grounding.ground_everywhere(said, sources, block).collect()]
    every = said.crossJoin(sources.select("chunk_id", F.col("text").alias("source")))
    want = every.where(evidence.is_grounded(F.col("text"), F.col("source"))).select("passage_id", "chunk_id")
    want = [tuple(r) for r in want.collect()]
    assert sorted(got) == sorted(want) and len(want) > 150


def test_no_rows(spark):
    said = spark.createDataFrame([(1, "a b c")], "passage_id int, text string")
    chunks = spark.createDataFrame([(1, "a b c")], "chunk_id int, text string")
    assert [tuple(r) for r in grounding.ground_everywhere(said, chunks).collect()] == [(1, 1)]
    assert grounding.ground_everywhere(said.limit(0), chunks).count() == 0
    assert grounding.ground_everywhere(said, chunks.limit(0)).count() == 0


def test_no_pair_of_everything(spark):
    """Passages meet chunks by their rare words only: no cross join in the plan, and few pairs compared."""
    chunks = [(k, " ".join(f"c{k}x{j}" for j in range(30)) + " the of and") for k in range(300)]
    passages = [(k, text.replace(f"c{k}x3 ", "")) for k, text in chunks[::10]]
    said = spark.createDataFrame(passages, "passage_id int, text string")
    sources = spark.createDataFrame(chunks, "chunk_id int, text string")
    found = grounding.ground_everywhere(said, sources)
    assert sorted(tuple(r) for r in found.collect()) == [(k, k) for k, _ in passages]
    words = spark.createDataFrame([(str(k), t.split()) for k, t in chunks], "chunk string, words array<string>")
    asked = spark.createDataFrame([(str(k), t.split()) for k, t in passages], "passage string, words array<string>")
    assert grounding._by_words(asked, words, 1000).count() == len(passages)


def test_postings_and_pairs_hold_numbers(spark, monkeypatch):
    met, plain = [], grounding._looked_up
    monkeypatch.setattr(grounding, "_looked_up", lambda wanted, postings, *rest: (met.append((wanted.dtypes, postings.dtypes)), plain(wanted, postings, *rest))[1])
    said = spark.createDataFrame([(1, "a b c d e f"), (2, "x")], "passage_id int, text string")
    chunks = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y")], "chunk_id int, text string")
    assert sorted(tuple(r) for r in grounding.ground_everywhere(said, chunks).collect()) == [(1, 1), (1, 2), (2, 3)]
    assert len(met) == 2 and all(dict(w)["passage"] == dict(p)["chunk"] == "bigint" for w, p in met)


@pytest.mark.parametrize("most", [0, grounding.PASSAGE_BYTES])
def test_words_are_looked_up_by_hash(spark, monkeypatch, most):
    monkeypatch.setattr(grounding, "PASSAGE_BYTES", most)
    terms, plain = [], grounding._looked_up
    monkeypatch.setattr(grounding, "_looked_up", lambda wanted, *rest: (terms.append(dict(wanted.dtypes)["term"]), plain(wanted, *rest))[1])
    common = " ".join(f"c{j}" for j in range(20))
    passages = [(k, f"{common} " + " ".join(f"p{k}x{j}" for j in range(31))) for k in range(20)]  # too few words in common
    passages.append((20, "a b a c c a d e"))  # enough in the first chunk by its repeats only
    chunks = [(k, f"{common} other{k}") for k in range(20)] + [(20, "a c x y z a"), (21, "b d e x y z"), (22, passages[0][1])]
    chunks += [(100 + 31 * k + j, f"p{k}x{j}") for k in range(20) for j in range(31)]
    said = spark.createDataFrame(passages, "passage_id int, text string")
    found = grounding.ground_everywhere(said, spark.createDataFrame(chunks, "chunk_id int, text string"))
    assert sorted(tuple(r) for r in found.collect()) == [(0, 22), (20, 20)]
    assert terms[0] == "bigint"
