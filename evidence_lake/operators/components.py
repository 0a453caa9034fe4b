"""Connected components of a graph given as edges, on whole tables.

Every node points at its smallest neighbour, if that is smaller than itself, and pointers are followed to their ends
by doubling.  Edges between nodes with different ends are the next round's, between these ends.  In each round at
least half of the nodes that still have edges become part of another, so rounds follow the logarithm of the number of
nodes, whatever the shape.  Only map-side aggregates and joins with one row per node: a node with many edges is
never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_lake.session import discard, write_out


def _ends(pointers: DataFrame) -> DataFrame:
    """(node, end) of pointers (node, end) that lead to smaller nodes or stay, followed to the last; written out."""
    while True:
        ahead = pointers.select(F.col("node").alias("end"), F.col("end").alias("next"))
        moved = write_out(pointers.join(ahead, "end").select("node", F.col("next").alias("end"), F.col("end").alias("was")), "ends")
        done = moved.where("was <> end").isEmpty()
        discard(pointers)
        pointers = moved.drop("was")
        pointers._written_to = moved._written_to
        if done:
            return pointers


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (a, b), which may repeat."""
    edges = write_out(edges.where("a <> b").distinct(), "edges")
    roots: DataFrame | None = None
    while not edges.isEmpty():
        back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        lowest = edges.unionByName(back).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        ends = _ends(write_out(lowest.select("node", F.least("node", "near").alias("end")), "pointers"))
        if roots is None:
            roots = ends.withColumnRenamed("end", "root")
        else:
            further = ends.select(F.col("node").alias("root"), F.col("end").alias("further"))
            followed = roots.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
            roots = write_out(followed, "roots")
        a = ends.select(F.col("node").alias("a"), F.col("end").alias("low"))
        b = ends.select(F.col("node").alias("b"), F.col("end").alias("high"))
        between = edges.join(a, "a").join(b, "b").where("low <> high").select(F.col("low").alias("a"), F.col("high").alias("b"))
        following = write_out(between.distinct(), "edges")
        discard(edges)
        edges = following
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots
