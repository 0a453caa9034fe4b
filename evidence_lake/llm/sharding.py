"""Range partitioning by sampled splitters, and shards of equal size.

A size-weighted sample of the keys gives quantile boundaries; records go to the range their key lies in;
ranges that turn out overfull get boundaries of their own from a sample within them, until none is.
Ranges are then small enough to be ordered by one task each, and their totals place each record in the
whole order, so shards are cut to the byte and not only as well as the sample was.

Keys are (key, tie): ``tie`` is a hash that orders rows with equal keys, so a key that a third of all
rows have is split like any other.  Rows equal in key, tie, size and checksum are counted before
anything is moved and told apart again at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_lake.session import write_out

#: Records that one range holds at most (while its keys differ), and what the sample costs the driver.
RANGE_ROWS, SAMPLE_PER_RANGE, MAX_SAMPLE = 100_000, 32, 262_144
ROUNDS = 8
COPIES_PER_STEP = 10_000
_LOWEST = -(2**63)


def order_key(key: Column) -> Column:
    """A long that sorts NULL first."""
    return F.coalesce(key.cast("long"), F.lit(_LOWEST))


@dataclass(frozen=True)
class Splitters:
    """Sorted boundaries; range r holds the keys from boundary r-1 on and below boundary r."""

    keys: np.ndarray
    ties: np.ndarray

    @staticmethod
    def of(pairs) -> Splitters:
        rows = np.array(sorted(set(pairs)), dtype=np.int64).reshape(-1, 2)
        return Splitters(rows[:, 0], rows[:, 1])

    def pairs(self) -> list[tuple[int, int]]:
        return list(zip(self.keys.tolist(), self.ties.tolist()))

    def find(self, keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
        low = np.searchsorted(self.keys, keys, side="left")
        at = np.searchsorted(self.keys, keys, side="right")
        equal = np.flatnonzero(low < at)  # keys that are boundaries: the tie decides
        for first in np.unique(low[equal]).tolist():
            rows = equal[low[equal] == first]
            end = at[rows[0]]
            at[rows] = first + np.searchsorted(self.ties[first:end], ties[rows], side="right")
        return at

    def column(self, key: Column, tie: Column) -> Column:
        """The number of the range of (key, tie)."""

        def ranges(keys: pa.Array, ties: pa.Array) -> pa.Array:
            found = self.find(keys.to_numpy(zero_copy_only=False), ties.to_numpy(zero_copy_only=False))
            return pa.array(found, pa.int32())

        return F.arrow_udf(ranges, "int")(key, tie)


def _sample(records: DataFrame, n: int, seed: int) -> list:
    """n records (all, if there are fewer), likelier the larger they are.

    Exponential keys: the n smallest of -log(u) / weight, where u is a hash of the record, so that a
    repeated task draws the same.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), "key", "tie"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    draw = -F.log(u) / (F.col("size") * F.col("copies"))
    return records.select("key", "tie", draw.alias("draw")).orderBy("draw").limit(n).collect()


def _quantiles(drawn: list, parts: int) -> list[tuple[int, int]]:
    pairs = sorted((r["key"], r["tie"]) for r in drawn)
    return [pairs[len(pairs) * k // parts] for k in range(1, parts)] if pairs else []


def sampled_splitters(records: DataFrame, range_rows: int = RANGE_ROWS, least: int = 1) -> Splitters:
    """Boundaries for records (key, tie, size, copies), each (key, tie) once; ``least`` ranges at least."""
    total = records.count()
    parts = max(least, -(-2 * total // range_rows))
    draws = lambda ranges: int(min(MAX_SAMPLE, SAMPLE_PER_RANGE * ranges))
    splitters = Splitters.of(_quantiles(_sample(records, draws(parts), 0), parts))
    for step in range(1, ROUNDS):
        placed = records.withColumn("range", splitters.column(F.col("key"), F.col("tie")))
        over = {r["range"]: r["n"] for r in placed.groupBy("range").agg(F.count("*").alias("n")).where(F.col("n") > range_rows).collect()}
        if not over:
            break
        more = sum(-(-2 * n // range_rows) for n in over.values())
        drawn = _sample(placed.where(F.col("range").isin(list(over))), draws(more), step)
        by_range: dict[int, list] = {}
        for row, at in zip(drawn, splitters.find(*(np.array([r[c] for r in drawn], dtype=np.int64) for c in ("key", "tie")))):
            by_range.setdefault(int(at), []).append(row)
        new = [p for at, rows in by_range.items() for p in _quantiles(rows, -(-2 * over[at] // range_rows))]
        splitters = Splitters.of(splitters.pairs() + new)
    return splitters


def assign_shards(
    docs: DataFrame,
    shards: int = 8,
    range_rows: int = RANGE_ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard).

    A row's size is the UTF-8 bytes of its text (NULL: none) plus 1.  Shards are ranges of the order by
    doc_id (NULL first; rows with one doc_id by a hash of their texts) whose sizes differ by little more
    than one row's size: a row belongs to the shard that its middle byte falls into.  Equal rows get slots
    of their own.  Other columns are left out.  No rows: no rows.
    """
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 1
    records = write_out(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            order_key(F.col(doc_id)).alias("key"),
            F.xxhash64(F.col(text), F.col(doc_id).isNull()).alias("tie"),
            size.alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
        )
        .groupBy("doc_id", "key", "tie", "size", "text_crc32")
        .agg(F.count("*").alias("copies")),
        "shard-records",
    )
    splitters = sampled_splitters(records, range_rows, least=4 * shards)
    order = Window.partitionBy("range").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda value: F.coalesce(F.sum(value).over(order), F.lit(0))
    ordered = write_out(
        records.withColumn("range", splitters.column(F.col("key"), F.col("tie"))).withColumns(
            {"bytes_before": before(F.col("size") * F.col("copies")), "rows_before": before(F.col("copies"))}
        ),
        "shard-order",
    )
    totals = ordered.groupBy("range").agg(
        F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows")
    ).orderBy("range").collect()  # one row per range
    all_bytes = sum(r["bytes"] for r in totals)
    bases, at, row = {}, 0, 0
    for r in totals:
        bases[r["range"]] = (at, row)
        at, row = at + r["bytes"], row + r["rows"]
    numbers = np.zeros((len(splitters.keys) + 1, 2), dtype=np.int64)
    for k, v in bases.items():
        numbers[k] = v

    def base_of(which: int):
        def base(ranges: pa.Array) -> pa.Array:
            return pa.array(numbers[ranges.to_numpy(zero_copy_only=False), which], pa.int64())

        return F.arrow_udf(base, "long")(F.col("range"))

    placed = ordered.withColumns({"first_byte": base_of(0) + F.col("bytes_before"), "first_row": base_of(1) + F.col("rows_before")})
    # equal rows are told apart in steps, dealt out anew, so that no task has to bring forth all of them
    last = F.floor((F.col("copies") - 1) / COPIES_PER_STEP)
    steps = placed.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition("key", "tie", "step")
    low = F.col("step") * COPIES_PER_STEP
    rows = steps.withColumn("copy", F.explode(F.sequence(low, F.least(F.col("copies"), low + COPIES_PER_STEP) - 1)))
    middle = F.col("first_byte") + F.col("copy") * F.col("size") + F.col("size") / 2
    rows = rows.withColumns(
        {
            "shard": F.least(F.lit(shards - 1), F.floor(middle * shards / max(all_bytes, 1))).cast("int"),
            "row": F.col("first_row") + F.col("copy"),
        }
    )
    firsts = rows.groupBy("shard").agg(F.min("row").alias("first"))  # ``shards`` rows
    return rows.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot")
    )
