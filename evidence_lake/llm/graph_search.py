"""Nearest vectors by inner product, searched in robust-pruned directed graphs, one for each shard.

Vectors are dealt to shards by a hash; equal vectors are one node, which keeps the smallest of their ids (no
more of them can be asked for).  Within a shard nodes are inserted in a random order, in growing batches: a greedy
beam search from the node nearest to the middle proposes neighbours for each, and pruning keeps a proposal only if no
neighbour that is kept already is ``ALPHA`` times nearer to it than the node itself, so edges point into different
directions.  Edges are also entered backwards, and a node with too many of them is pruned again.  Inner products
become distances by one more coordinate that gives all vectors the same length.

A query is searched in every shard by a beam, and what all beams hold is compared by exact inner products in double
precision.  The graphs are a table (one row per node), so a lost executor costs the tasks it ran.  A task holds one
shard, and reads queries in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_lake.llm import vectors
from evidence_lake.llm.arrow import bounded_batches
from evidence_lake.session import write_out

#: Neighbours of a node, nodes that a beam holds while graphs are built and searched, nodes that it expands at once.
DEGREE, BUILD_BEAM, BEAM, EXPANDED = 32, 64, 128, 8
ALPHA = 1.2
#: Nodes that searches may start from, the one next to the middle and others drawn, and how many of them each does:
#: the nearest, so that groups far from the rest are reached.
STARTS, ENTRIES = 512, 4
#: Nodes of a shard, about, and components of all of them.
SHARD_ROWS, SHARD_NUMBERS = 16_384, 1 << 23
#: Queries that one task searches in its shard; more are dealt to several tasks.
QUERY_BLOCK = 1 << 16
_BATCH = 512
_FLOATS = 1 << 22  # that a step of pruning holds


class Graph:
    """Nodes 0 .. n-1 with vectors (rows of equal length) and edges (n x degree, n standing for none)."""

    def __init__(self, rows: np.ndarray, edges: np.ndarray | None = None, degree: int = DEGREE):
        self.n = len(rows)
        unit = rows / np.abs(rows).max()
        norms = np.sqrt(np.einsum("ij,ij->i", unit, unit))
        unit /= norms.max()
        missing = np.sqrt(np.maximum(0.0, 1.0 - (norms / norms.max()) ** 2))
        self.points = np.column_stack([unit, missing]).astype(np.float32)
        self.squares = np.einsum("ij,ij->i", self.points, self.points)
        self.edges = np.full((self.n, degree), self.n, dtype=np.int32) if edges is None else edges
        self.inserted: np.ndarray | None = None  # while it is built: the nodes that are in it
        middle = self.points.mean(axis=0, dtype=np.float64).astype(np.float32)
        nearest = int(np.argmin(self.squares - 2 * self.points @ middle))
        others = np.random.default_rng(0).permutation(self.n)[: STARTS - 1]
        self.starts = np.concatenate([[nearest], others[others != nearest]])

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Nodes (queries x beam, nearest first, n standing for none), and for each step the nodes it expanded with
        their distances.  Queries are points with the added coordinate."""
        n, count = self.n, len(queries)
        ids = np.full((count, beam), n, dtype=np.int32)
        distance = np.full((count, beam), np.inf, dtype=np.float32)
        done = np.ones((count, beam), dtype=bool)
        lengths = np.einsum("ij,ij->i", queries, queries)
        first = self.starts if self.inserted is None else self.starts[self.inserted[self.starts]]
        far = self.squares[first] + lengths[:, None] - 2 * queries @ self.points[first].T
        every = np.arange(count)[:, None]
        near = np.argsort(far, axis=1, kind="stable")[:, : min(ENTRIES, beam)]
        ids[:, : near.shape[1]], distance[:, : near.shape[1]], done[:, : near.shape[1]] = first[near], far[every, near], False
        seen = np.zeros((count, n + 1), dtype=bool)
        seen[:, n] = True
        seen[every, first[near]] = True
        steps = []
        while not done.all():
            place = np.argsort(done, axis=1, kind="stable")[:, :EXPANDED]  # the nearest that are left
            old = np.take_along_axis(done, place, axis=1)
            nodes = np.where(old, n, np.take_along_axis(ids, place, axis=1))
            steps.append((nodes, np.where(old, np.inf, np.take_along_axis(distance, place, axis=1))))
            np.put_along_axis(done, place, True, axis=1)
            row, which = np.nonzero(nodes < n)
            near = self.edges[nodes[row, which]]
            row, near = np.repeat(row, near.shape[1]), near.ravel()
            new = ~seen[row, near]
            code = np.sort(row[new] * n + near[new])
            row, near = np.divmod(code[np.diff(code, prepend=-1) > 0], n)
            seen[row, near] = True
            found = np.einsum("ij,ij->i", self.points[near], queries[row])
            found = self.squares[near] + lengths[row] - 2 * found
            # as many columns as the query with the most new nodes has
            counts = np.bincount(row, minlength=count)
            width = int(counts.max(initial=0))
            if not width:
                continue
            column = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            more_ids = np.full((count, width), n, dtype=np.int32)
            more = np.full((count, width), np.inf, dtype=np.float32)
            more_ids[row, column], more[row, column] = near, found
            distance = np.concatenate([distance, more], axis=1)
            order = np.argsort(distance, axis=1, kind="stable")[:, :beam]
            ids = np.concatenate([ids, more_ids], axis=1)[every, order]
            done = np.concatenate([done, more_ids == n], axis=1)[every, order]
            distance = distance[every, order]
        return ids, steps

    def prune(self, proposals: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Of each row of distinct proposals (n standing for none) with their distances the edges to keep."""
        order = np.argsort(distance, axis=1, kind="stable")
        proposals, distance = np.take_along_axis(proposals, order, axis=1), np.take_along_axis(distance, order, axis=1)
        out = np.full((len(proposals), self.edges.shape[1]), self.n, dtype=np.int32)
        some = max(1, _FLOATS // (proposals.shape[1] * (proposals.shape[1] + self.points.shape[1])))
        for at in range(0, len(proposals), some):
            ids, own = proposals[at : at + some], distance[at : at + some]
            real = np.minimum(ids, self.n - 1)
            points = self.points[real]
            between = self.squares[real][:, :, None] + self.squares[real][:, None, :] - 2 * points @ points.transpose(0, 2, 1)
            open_ = ids < self.n
            rows = np.arange(len(ids))
            for k in range(out.shape[1]):
                left = open_.any(axis=1)
                if not left.any():
                    break
                first = np.argmax(open_, axis=1)
                out[at : at + some][left, k] = ids[left, first[left]]
                open_ &= ALPHA * ALPHA * between[rows, first] > own
                open_[rows, first] = False
        return out

    def insert(self, nodes: np.ndarray, beam: int) -> None:
        """Edges of new nodes, from searches in the graph so far, and the same edges backwards."""
        _, steps = self.search(self.points[nodes], beam)
        proposals = np.concatenate([s[0] for s in steps], axis=1)
        distance = np.concatenate([s[1] for s in steps], axis=1)
        itself = proposals == nodes[:, None]
        proposals, distance = np.where(itself, self.n, proposals), np.where(itself, np.inf, distance)
        self.edges[nodes] = self.prune(proposals, distance)
        row, column = np.nonzero(self.edges[nodes] < self.n)
        ends, starts = self.edges[nodes][row, column], nodes[row]
        known = (self.edges[ends] == starts[:, None]).any(axis=1)
        order = np.argsort(ends[~known], kind="stable")
        ends, starts = ends[~known][order], starts[~known][order]
        at, first, counts = np.unique(ends, return_index=True, return_counts=True)
        have = (self.edges[at] < self.n).sum(axis=1)
        degree = self.edges.shape[1]
        place = np.arange(len(ends)) - np.repeat(first, counts)
        fits = np.repeat(have + counts <= degree, counts)
        self.edges[ends[fits], (np.repeat(have, counts) + place)[fits]] = starts[fits]
        full = np.flatnonzero(have + counts > degree)
        full = full[np.argsort(counts[full], kind="stable")]  # rows of like sizes together
        while len(full):
            width = int(counts[full[0]]) * 2
            now = full[counts[full] <= width]
            full = full[len(now) :]
            new = np.full((len(now), width), self.n, dtype=np.int32)
            rows = np.repeat(np.arange(len(now)), counts[now])
            column = np.arange(len(rows)) - np.repeat(np.cumsum(counts[now]) - counts[now], counts[now])
            new[rows, column] = starts[np.repeat(first[now], counts[now]) + column]
            proposals = np.concatenate([self.edges[at[now]], new], axis=1)
            real = np.minimum(proposals, self.n - 1)
            dots = np.einsum("ijk,ik->ij", self.points[real], self.points[at[now]])
            distance = self.squares[real] + self.squares[at[now]][:, None] - 2 * dots
            self.edges[at[now]] = self.prune(proposals, np.where(proposals < self.n, distance, np.inf))

    def build(self, beam: int, seed: int = 0) -> Graph:
        order = np.random.default_rng(seed).permutation(self.n)
        order = np.concatenate([self.starts[:1], order[order != self.starts[0]]])
        self.inserted = np.zeros(self.n, dtype=bool)
        self.inserted[order[0]] = True
        at, size = 1, 1
        while at < self.n:
            self.insert(order[at : at + size], beam)
            self.inserted[order[at : at + size]] = True
            at, size = at + size, min(2 * size, _BATCH)
        self.inserted = None
        return self


def _read(batches: list[pa.RecordBatch], name: str) -> pa.Array:
    return pa.concat_arrays([b.column(name) for b in batches])


_NODE = "part long, vector array<double>, ids array<long>, edges array<int>"


def _build(degree: int, beam: int):
    """mapInArrow over (part, vector, ids), one part to a partition -> the same with edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        # an order that does not depend on how rows arrived
        first = table.column("ids").flatten().to_numpy()[table.column("ids").offsets.to_numpy()[:-1] - table.column("ids").offsets[0].as_py()]
        table = table.take(pa.array(np.argsort(first, kind="stable")))
        graph = Graph(vectors.matrix(table.column("vector")), degree=degree).build(beam)
        for at in range(0, graph.n, _BATCH):
            part = table.slice(at, _BATCH)
            columns = [part.column(n) for n in ("part", "vector", "ids")]
            yield pa.RecordBatch.from_arrays([*columns, vectors.lists(graph.edges[at : at + _BATCH])], names=["part", "vector", "ids", "edges"])

    return run


def _nearest(k: int, beam: int):
    """mapInArrow over nodes (kind 0), then queries (kind 1) of one shard -> the k nearest of each query."""

    def answers(graph: Graph, rows: np.ndarray, ends: np.ndarray, ids: np.ndarray, own: np.ndarray, queries: np.ndarray):
        unit = queries / np.abs(queries).max(axis=1, keepdims=True)
        unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
        points = np.column_stack([unit, np.zeros(len(queries))]).astype(np.float32)
        found, _ = graph.search(points, beam)
        query, column = np.nonzero(found < graph.n)
        node = found[query, column]
        score = np.einsum("ij,ij->i", rows[node], queries[query])
        counts = ends[node + 1] - ends[node]
        spread = np.repeat(np.arange(len(node)), counts)
        vec = ids[np.repeat(ends[node], counts) + np.arange(len(spread)) - np.repeat(np.cumsum(counts) - counts, counts)]
        query, score = query[spread], score[spread]
        other = vec != own[query]
        query, score, vec = query[other], score[other], vec[other]
        order = np.lexsort((vec, -score, query))
        query, score, vec = query[order], score[order], vec[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < k
        return own[query[kept]], vec[kept], score[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        graph = None
        for batch in batches:
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            nodes = int(np.searchsorted(kind, 1))
            if nodes:
                held.append(batch.slice(0, nodes))
            if nodes == batch.num_rows or not held:
                continue
            if graph is None:
                rows = vectors.matrix(_read(held, "vector"))
                edges = vectors.matrix(_read(held, "edges"))
                lists = _read(held, "ids")
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                ids = lists.flatten().to_numpy()
                graph = Graph(rows, edges)
            for at in range(nodes, batch.num_rows, _BATCH):
                part = batch.slice(at, _BATCH)
                own = part.column("query_id").to_numpy(zero_copy_only=False)
                columns = answers(graph, rows, ends, ids, own, vectors.matrix(part.column("vector")))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["query_id", "vec_id", "score"])

    return run


def _vectors(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector, size) of the rows that take part, with 0.0 for -0.0."""
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    there = F.col("vec_id").isNotNull() & vectors.usable(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    whole = F.transform("vector", lambda x: x + F.lit(0.0))
    return rows.where(there).select("vec_id", whole.alias("vector"), F.size("vector").alias("size"))


def _parts(sizes: dict[int, int], shard_rows: int) -> dict[int, tuple[int, int]]:
    """For each length of vectors its first shard and the number of its shards."""
    out, at = {}, 0
    for size, n in sorted(sizes.items()):
        shards = -(-n // max(1, min(shard_rows, SHARD_NUMBERS // size)))
        out[size], at = (at, shards), at + shards
    return out


def _by_size(parts: dict[int, tuple[int, int]], k: int) -> Column:
    value = F.create_map(*[F.lit(x) for size, p in parts.items() for x in (size, p[k])])
    return F.try_element_at(value, F.col("size")).cast("long")


def build_index(
    table: DataFrame, keep: int, degree: int = DEGREE, beam: int = BUILD_BEAM, shard_rows: int = SHARD_ROWS,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """The graphs of all usable rows as a table (part, vector, ids, edges), and the shards of each length of vectors.

    A node is a distinct vector with the ``keep`` smallest ids that have it.
    """
    bounded_batches(table.sparkSession)
    rows = _vectors(table, vec_id, vector)
    parts = _parts({r["size"]: r["n"] for r in rows.groupBy("size").agg(F.count("*").alias("n")).collect()}, shard_rows)
    if not parts:
        return rows.sparkSession.createDataFrame([], _NODE), parts
    shards = sum(n for _, n in parts.values())
    place = Window.partitionBy("hash", "vector").orderBy("vec_id")
    hashed = rows.withColumn("hash", F.xxhash64("vector")).withColumn("rank", F.dense_rank().over(place))
    ids = F.array_sort(F.collect_set("vec_id")).alias("ids")
    nodes = hashed.where(F.col("rank") <= keep).groupBy("hash", "vector", "size").agg(ids)
    part = (_by_size(parts, 0) + F.pmod("hash", _by_size(parts, 1))).alias("part")
    dealt = nodes.select(part, "vector", "ids").repartitionById(shards, F.col("part").cast("int"))
    return write_out(dealt.mapInArrow(_build(degree, beam), _NODE), "vector-graphs"), parts


def search_index(
    index: DataFrame, parts: dict[int, tuple[int, int]], queries: DataFrame, k: int, beam: int = BEAM,
    query_block: int = QUERY_BLOCK, vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest of each query that the graphs find, other ids than its own."""
    spark = queries.sparkSession
    bounded_batches(spark)
    schema = "query_id long, vec_id long, score double"
    # an id that several rows have is one query
    asked = _vectors(queries, vec_id, vector).groupBy("vec_id").agg(F.min(F.struct("vector", "size")).alias("one")).select("vec_id", "one.*")
    found = spark.createDataFrame([], schema)
    if parts:
        shards = sum(n for _, n in parts.values())
        blocks = max(1, -(-asked.count() // query_block))
        first, count = _by_size(parts, 0), _by_size(parts, 1)
        block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) * shards
        everywhere = asked.where(first.isNotNull()).withColumn("part", F.explode(F.sequence(first, first + count - 1)))
        asking = everywhere.select((F.col("part") + block).alias("part"), F.lit(1).alias("kind"), F.col("vec_id").alias("query_id"), "vector")
        every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
        copies = index.withColumn("block", every_block) if blocks > 1 else index.withColumn("block", F.lit(0))
        nodes = copies.select((F.col("part") + F.col("block") * shards).alias("part"), F.lit(0).alias("kind"), "vector", "ids", "edges")
        # nodes in the order of their numbers, which edges name
        dealt = (
            nodes.unionByName(asking, allowMissingColumns=True)
            .repartitionById(shards * blocks, F.col("part").cast("int"))
            .sortWithinPartitions("kind", F.get("ids", F.lit(0)), "query_id")
        )
        found = dealt.drop("part").mapInArrow(_nearest(k, beam), schema)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest_vectors(
    table: DataFrame, queries: DataFrame, k: int = 20, degree: int = DEGREE, beam: int = BEAM, build_beam: int = BUILD_BEAM,
    shard_rows: int = SHARD_ROWS, vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the k rows of ``table`` of largest inner product.

    Approximate: the rows are those that the beams find, best first, ties to the smaller vec_id; scores are exact in
    double precision.  A larger ``beam`` finds more.

    Rows without vec_id, and vectors that are NULL, zero, or hold NULL or non-finite components take no part.
    Vectors meet only those of their own length.  Rows with a query's own vec_id are not its neighbours.  Repeated rows
    count once; of rows of ``queries`` with one vec_id the smallest vector is asked, while rows of ``table``
    with one vec_id and different vectors are all candidates.  Other columns are left out.  No rows: no rows.
    """
    if not 1 <= k <= beam:
        raise ValueError("k must lie between 1 and beam")
    index, parts = build_index(table, k + 1, degree, build_beam, shard_rows, vec_id, vector)
    return search_index(index, parts, queries, k, beam, vec_id=vec_id, vector=vector)
