"""Graph search against comparison with every vector."""

import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence_lake.llm import graph_search
from evidence_lake.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def plain(rows, asked, k):
    """{query: [(vec_id, score)]} by every pair; rows (vec_id, vector)."""
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in asked:
        own = min((v for i, v in usable if i == q), default=None)
        if own is not None:
            near = [(-float(np.dot(np.float64(v), np.float64(own))), i) for i, v in usable if i != q and len(v) == len(own)]
            out[q] = [(i, -s) for s, i in sorted(near)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    """Share of the wanted scores that are reached, rank by rank, so that ties count as found."""
    hit = sum(abs(s - t) < 1e-9 for q, near in want.items() for (_, s), (_, t) in zip(got.get(q, []), near))
    return hit / sum(map(len, want.values()))


def table(spark, rows):
    data = [(i, v, "x", 1.0, "p") for i, v in rows]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, part string, Score double, hash string").repartition(4)


def made(n, dim, seed, clusters=7):
    """Clustered vectors of unlike lengths, with many copies of one and some of others."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(clusters, dim))
    vectors = middles[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim)) * 0.4
    vectors *= rng.uniform(0.5, 2.0, (n, 1))
    copies = rng.random(n) < 0.3
    vectors[copies] = vectors[0]
    vectors[1:20] = vectors[20:39]
    return [(int(3 * i), v) for i, v in zip(rng.permutation(n), vectors.tolist())]


@pytest.mark.parametrize("n, dim, shard_rows", [(3000, 16, 100_000), (3000, 16, 700), (60, 8, 20)])
def test_nearest(spark, n, dim, shard_rows):
    rows = made(n, dim, seed=n)
    asked = [i for i, _ in rows if i % 15 == 0]
    df = table(spark, rows)
    got = found(graph_search.nearest_vectors(df, df.where(F.col("vec_id").isin(asked)), 20, shard_rows=shard_rows))
    want = plain(rows, asked, 20)
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    assert recall(got, want) > 0.95
    copied = list(Counter(tuple(v) for _, v in rows).most_common(1)[0][0])
    exact = dict(rows)
    for q, near in got.items():  # scores of the original vectors, ties in order, no row twice
        assert [-s for _, s in near] == sorted(-s for _, s in near) and len({i for i, _ in near}) == len(near)
        assert all(abs(s - np.dot(exact[q], exact[i])) < 1e-9 for i, s in near)
        ties = [i for i, _ in near if exact[i] == copied]
        assert ties == sorted(i for i, v in rows if v == copied and i != q)[: len(ties)]


def test_blocks_of_queries_change_nothing(spark):
    df = table(spark, made(800, 8, seed=5))
    index, parts = graph_search.build_index(df, 6, shard_rows=300)
    asked = df.where("vec_id % 2 = 0")
    one = found(graph_search.search_index(index, parts, asked, 5))
    assert one == found(graph_search.search_index(index, parts, asked, 5, query_block=37)) and len(one) > 300


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, [1.0, 0.0]), (2, [0.0, -0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]),
            (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, -0.0]), (9, [2.0, 2.0, 1.0]), (10, []), (11, [3.0, 4.0]), (11, [-3.0, 4.0]), (12, [1e-200, 1e-200])]
    df = table(spark, rows)
    got = found(graph_search.nearest_vectors(df, df, 3))
    want = plain(rows, [i for i, _ in rows if i is not None], 3)
    assert got == {q: near for q, near in want.items() if near}  # 9 is alone with its length
    assert graph_search.nearest_vectors(df.limit(0), df, 3).count() == 0
    assert graph_search.nearest_vectors(df, df.limit(0), 3).count() == 0
    assert graph_search.nearest_vectors(df, df.limit(0), 3).columns == ["query_id", "rank", "vec_id", "score"]
    only_bad = df.where("vec_id = 3")
    assert graph_search.nearest_vectors(only_bad, df, 3).count() == 0
    with pytest.raises(ValueError):
        graph_search.nearest_vectors(df, df, 200)


def test_few_edges_reach_every_node():
    rows = np.random.default_rng(2).normal(size=(2000, 12))
    graph = graph_search.Graph(rows, degree=16).build(32)
    assert (graph.edges[np.arange(2000)] != np.arange(2000)[:, None]).all()  # none to itself
    reached, border = {int(graph.starts[0])}, [int(graph.starts[0])]
    while border:
        border = {int(e) for v in border for e in graph.edges[v] if e < graph.n} - reached
        reached |= border
    assert len(reached) > 1980


def test_a_crowd_of_near_copies_is_reached(spark):
    """A third of all vectors next to one, far from the others."""
    rng = np.random.default_rng(12)
    spread = rng.normal(size=(2400, 32))
    crowd = 3 * np.eye(32)[0] + rng.normal(size=(1200, 32)) * 0.02
    vectors = np.concatenate([spread, crowd])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(int(i), v) for i, v in zip(rng.permutation(3600), vectors.tolist())]
    df = table(spark, rows)
    asked = [i for i, _ in rows if i % 20 == 0]
    got = found(graph_search.nearest_vectors(df, df.where("vec_id % 20 = 0"), 20))
    want = plain(rows, asked, 20)
    crowded = {i for i, v in rows if v[0] > 0.99}
    for some in (crowded, {i for i, _ in rows} - crowded):
        near = {q: {i for i, _ in want[q]} for q in asked if q in some}
        assert sum(len({i for i, _ in got[q]} & found_) for q, found_ in near.items()) > 0.93 * 20 * len(near) > 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not supplied")
def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    got = found(QUERIES["op13_nearest_neighbours"](spark, FOLDER))
    asked = [i for i, _ in rows if i % 20 == 0]
    want = plain(rows, asked, 20)
    assert got.keys() == want.keys() and all(len(near) == 20 for near in got.values())
    assert recall(got, want) > 0.98
