"""Codes against a comparison with every entry, in plain Python numbers."""

import math
import random

import numpy as np
import pytest

from evidence_lake.llm import code_compression
from evidence_lake.llm.code_compression import Slices, compress_vectors, digest

SCHEMA = "vec_id long, embedding array<double>, label int, Code string, row int, error string, id string"


def plain(rows, parts, entries, rounds, scale=256):
    """rows (vec_id, vector, label) -> [(vec_id, code, error, label)], codebooks"""
    kept = [(i, [math.floor(scale * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, k: v[k * width : (k + 1) * width]
    books = [[cut(v, k) for _, v, _ in kept[:entries]] for k in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        new = [list(b) for b in books]
        for k in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, k), books[k])[1], []).append(cut(v, k))
            for n, group in groups.items():
                new[k][n] = [sum(c) // len(group) for c in zip(*group)]
        books = new
    found = []
    for i, v, g in kept:
        best = [near(cut(v, k), books[k]) for k in range(parts)]
        found.append((i, "".join(f"{n:02x}" for _, n in best), sum(d for d, _ in best), g))
    return found, books


def made(n, dim, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.choice([0.0, 0.25, -0.5, rng.uniform(-2, 2), rng.gauss(0, 0.1)]) for _ in range(dim)]
        if rows and rng.random() < 0.2:
            v = rng.choice(rows)[1]
        rows.append((rng.choice([None, 3 * i, 3 * i - 1, 9]) if i % 11 == 0 else 3 * i, v, rng.choice([None, 1, 2, 2, 2])))
    bad = [None, [None] * dim, [math.nan] + [0.0] * (dim - 1), [math.inf] * dim, [-math.inf] * dim]
    return rows + [(-1 - k, v, 1) for k, v in enumerate(bad)]


@pytest.mark.parametrize("n, dim, parts, entries, rounds", [(150, 8, 4, 16, 2), (90, 6, 2, 64, 1), (20, 4, 4, 64, 2), (70, 3, 1, 5, 3), (5, 16, 16, 64, 0)])
def test_codes(spark, n, dim, parts, entries, rounds):
    rows = made(n, dim, seed=n)
    df = spark.createDataFrame([(*r, "c", 5, "e", "i") for r in rows], SCHEMA).repartition(5)
    out, books = compress_vectors(df, parts, entries, rounds)
    assert out.columns == ["vec_id", "embedding", "label", "row", "id", "code", "error", "label_error"]
    want, want_books = plain(rows, parts, entries, rounds)
    assert books.tolist() == want_books
    got = out.collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert r.label_error == sum(e for _, _, e, g in want if g == r.label) and (r.row, r.id) == (5, "i")


def test_boxes_hold_the_nearest_entry():
    rng = np.random.default_rng(1)
    for spread, far in ((3, 3), (50, 50), (50, 100_000), (1 << 20, 4)):
        for size in (1, 2, 63, 64):
            entries = rng.integers(-spread, spread + 1, (size, 4))
            entries[size // 2] = entries[0]
            rows = rng.integers(-far, far + 1, (300, 4))
            best, distance = Slices(entries).nearest(rows)
            every = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
            assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    for empty in (make(), make((1, None, 2), (2, [math.nan] * 16, None))):
        out, books = compress_vectors(empty)
        assert out.count() == 0 and out.columns == ["vec_id", "embedding", "label", "code", "error", "label_error"]
        assert books.size == 0 and len(digest(books)) == 64
    same = make(*[(7, [0.5] * 16, None)] * 4)
    out, _ = compress_vectors(same)
    assert [tuple(r)[3:] for r in out.collect()] == [("00" * 16, 0, 0)] * 4
    for wrong in (make((1, [0.0] * 15, 1)), make((1, [0.0] * 16, 1), (2, [0.0] * 32, 1)), make((1, [], 1))):
        with pytest.raises(ValueError):
            compress_vectors(wrong)
    with pytest.raises(Exception, match="lies beyond"):
        compress_vectors(make((1, [1e30] * 16, 1)))
    with pytest.raises(ValueError):
        compress_vectors(same, entries=65)
    assert code_compression.ENTRIES == 64
