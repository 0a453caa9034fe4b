import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def made_documents(n, seed):
    """Small texts with copies, shared passages, repeated lines and odd white space."""
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "and", "é", "naïve", "x1", "b-c", "ÄÖ", "word", "long" * 5, "42", "it's", "漢字"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    line_block = "\n".join(" ".join(rng.choice(vocabulary) for _ in range(4)) for _ in range(4))
    texts = [None, "", " ", "one", "\n\n\n\n", "a " * 60, "  two  spaces \t tab\x0b", line_block, "x" * 5000]
    while len(texts) < n:
        kind = rng.random()
        words = [rng.choice(vocabulary) + str(rng.randrange(50)) for _ in range(rng.randrange(1, 80))]
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "  "]) for w in words)
        if kind < 0.2:
            text = rng.choice([t for t in texts if t is not None])
        elif kind < 0.4:
            text = text + passage + " " + text[:20]
        elif kind < 0.5:
            text = text + "\n" + line_block + "\n" + line_block
        texts.append(text)
    ids = list(range(3, 3 + 7 * n, 7))
    rng.shuffle(ids)
    return list(zip(ids, texts))


@pytest.fixture(scope="session")
def documents(spark):
    """(rows, DataFrame with clashing extra columns) for n documents."""
    names = ("n_words", "n_removed", "key", "id", "score", "range", "token", "block", "print", "size")
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)

    def make(n=120, seed=1, rows=None):
        rows = made_documents(n, seed) if rows is None else rows
        return rows, spark.createDataFrame([(i, t, *["other"] * len(names)) for i, t in rows], schema).repartition(3)

    return make
