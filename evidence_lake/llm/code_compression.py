"""Vectors as short codes: for each part of a vector the number of the nearest entry of a codebook.

Nearest entries are found by slicing and intersecting.  For each coordinate of a part the entries' values are
sorted, and prefix masks say which entries (bits of a uint64) come before each place of that order.  A radius
around a vector's coordinate is a range of places, and the difference of the masks at its ends the entries
inside; these masks, ANDed over the coordinates, are the entries of a box around the part.  The first radius is
the codebook's own spacing; empty boxes are widened, and where the nearest entry of a box lies beyond the radius
the box of its distance decides.  So every entry that may be nearest is compared, and few others are.

Everything is in integers, so results do not depend on how rows are dealt to tasks.  Codebooks are averaged from
sums and counts that each task makes of its rows; only these and the first entries come to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_lake.llm import vectors
from evidence_lake.llm.arrow import bounded_batches
from evidence_lake.llm.columns import others
from evidence_lake.session import discard, write_out

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components beyond this, scaled, are refused: their distances may not fit a long.
LARGEST = 1 << 24
_ROWS = 4096


class Slices:
    """Nearest entries of one part's codebook (entries x coordinates), 64 at most."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        bits = np.uint64(1) << np.arange(len(entries), dtype=np.uint64)
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.entries, order, axis=0).T.copy()
        self.before = [np.concatenate([[np.uint64(0)], np.bitwise_or.accumulate(bits[o])]) for o in order.T]
        apart = np.abs(self.entries[:, None, :] - self.entries[None, :, :]).max(axis=2)
        near = np.where(apart > 0, apart, np.iinfo(np.int64).max).min(axis=1)
        near = near[near < np.iinfo(np.int64).max]  # equal entries have no spacing
        self.radius = max(int(np.median(near)), 1) if len(near) else 1

    def inside(self, rows: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For each row the mask of entries none of whose coordinates is further away than its radius."""
        mask = np.full(len(rows), ~np.uint64(0))
        for own, before, x in zip(self.sorted, self.before, rows.T):
            low, high = np.searchsorted(own, x - radius, "left"), np.searchsorted(own, x + radius, "right")
            mask &= before[high] ^ before[low]
        return mask

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, of equally near ones the first, and its squared distance."""
        best = np.zeros(len(rows), dtype=np.int64)
        distance = np.zeros(len(rows), dtype=np.int64)
        left = np.arange(len(rows))
        radius = np.full(len(rows), self.radius, dtype=np.int64)
        while len(left):
            mask = self.inside(rows[left], radius[left])
            empty = mask == 0
            radius[left[empty]] *= 2
            some = left[~empty]
            if not len(some):
                continue
            held = np.unpackbits(mask[~empty].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, entry = np.nonzero(held)
            apart = self.entries[entry] - rows[some[row]]
            squares = np.einsum("ij,ij->i", apart, apart)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            low = np.minimum.reduceat(squares, first)
            number = np.minimum.reduceat(np.where(squares == low[row], entry, len(self.entries)), first)
            best[some], distance[some] = number, low
            beyond = low > radius[some] ** 2
            radius[some[beyond]] = [math.isqrt(d - 1) + 1 for d in low[beyond].tolist()]
            left = np.concatenate([left[empty], some[beyond]])
        return best, distance


def _assign(codebooks: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and squared distances (rows x parts); codebooks are parts x entries x width."""
    parts, _, width = codebooks.shape
    found = [Slices(book).nearest(rows[:, k * width : (k + 1) * width]) for k, book in enumerate(codebooks)]
    return np.column_stack([f[0] for f in found]), np.column_stack([f[1] for f in found])


def _sums(codebooks: np.ndarray):
    """mapInArrow: vectors -> (slot, total) of a task: for each part and entry its count and the sums of its rows."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((parts * entries, width + 1), dtype=np.int64)
        blocks = (batch.column(0).slice(at, _ROWS) for batch in batches for at in range(0, batch.num_rows, _ROWS))
        for block in blocks:
            rows = vectors.matrix(block).astype(np.int64)
            codes, _ = _assign(codebooks, rows)
            for k in range(parts):
                own = np.column_stack([np.ones(len(rows), np.int64), rows[:, k * width : (k + 1) * width]])
                np.add.at(totals, k * entries + codes[:, k], own)
        slot = np.flatnonzero(totals.ravel())
        columns = [pa.array(slot), pa.array(totals.ravel()[slot])]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "total"])

    return run


def _codes(codebooks: np.ndarray):
    """Arrow UDF: vectors -> (code, error)."""

    def run(scaled: pa.Array) -> pa.Array:
        written, errors = [], [np.zeros(0, np.int64)]
        for at in range(0, len(scaled), _ROWS):
            codes, squares = _assign(codebooks, vectors.matrix(scaled.slice(at, _ROWS)).astype(np.int64))
            written += [x.tobytes().hex() for x in codes.astype(np.uint8)]
            errors.append(squares.sum(axis=1))
        return pa.StructArray.from_arrays([pa.array(written, pa.string()), pa.array(np.concatenate(errors))], names=["code", "error"])

    return F.arrow_udf(run, "code string, error long")


def learn(scaled: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x width) of a table of integer vectors ``scaled`` with their ids ``id``.

    They start as the parts of the ``entries`` smallest ids (of repeated ids the smaller vectors first, NULL ids
    last; fewer vectors make fewer entries).  Each round assigns all vectors and replaces each entry by the
    floored mean of its parts; unused entries stay.
    """
    first = scaled.orderBy(F.col("id").asc_nulls_last(), "scaled").limit(entries).select("scaled").collect()
    start = np.array([r["scaled"] for r in first], dtype=np.int64)
    books = start.reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    _, size, width = books.shape
    for _ in range(rounds):
        sums = scaled.select("scaled").mapInArrow(_sums(books), "slot long, total long")
        totals = np.zeros(parts * size * (width + 1), dtype=np.int64)
        for slot, total in sums.groupBy("slot").agg(F.sum("total")).collect():  # at most one row for each number of the codebooks
            totals[slot] = total
        totals = totals.reshape(parts, size, width + 1)
        count = totals[..., :1]
        books = np.where(count > 0, totals[..., 1:] // np.maximum(count, 1), books)
    return books


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all numbers of the codebooks, by part, entry and place, written with commas between."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def scaled_vectors(table: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(row, id, scaled): usable rows with all their columns and their vectors as floored integers."""
    whole = F.col(vector).cast("array<double>")
    rows = table.select(F.struct(*others(table, ())).alias("row"), F.col(vec_id).alias("id"), whole.alias("vector"))
    floored = F.transform("vector", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    too_large = F.exists("vector", lambda x: F.abs(x) * F.lit(float(scale)) > LARGEST)
    checked = F.when(too_large, F.raise_error(F.lit(f"a component times {scale} lies beyond {LARGEST}"))).otherwise(floored)
    return rows.where(vectors.usable(F.col("vector"))).select("row", "id", checked.cast("array<int>").alias("scaled"))


def compress_vectors(
    table: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """Rows of ``table`` with code, error and label_error, and the codebooks (parts x entries x width) they refer to.

    A code has two hex digits for each part; error is the squared distance between the scaled, floored vector and
    the entries of its code, label_error the sum of errors over rows with the same label, NULL being one.

    Rows whose vector is NULL or holds NULL or non-finite components are left out.  The others must be of one
    length, a positive multiple of ``parts`` (else ValueError), and no component times ``scale`` may lie beyond 2**24
    (else the query fails), so that distances fit a long.  Repeated rows and ids each get a row; rows that are equal
    count as often as they occur.  No rows: no rows, and codebooks without entries.  Columns of ``table`` with the
    new names (in any letter case) are replaced.
    """
    if not 1 <= entries <= 64:
        raise ValueError("entries must lie between 1 and 64, the bits of a mask")
    spark = table.sparkSession
    bounded_batches(spark)
    new = ("code", "error", "label_error")
    slim = table.select(*others(table, new))
    scaled = write_out(scaled_vectors(slim, vec_id, vector, scale), "scaled-vectors")
    shortest, longest = scaled.agg(F.min(F.size("scaled")), F.max(F.size("scaled"))).first()
    if shortest is None:
        nothing = [F.lit(None).cast(k).alias(n) for n, k in (("code", "string"), ("error", "long"), ("label_error", "long"))]
        return scaled.select("row.*", *nothing), np.zeros((parts, 0, 0), dtype=np.int64)
    if shortest != longest or shortest % parts or not shortest:
        raise ValueError(f"vectors of {shortest} to {longest} components cannot all be cut into {parts} equal parts")
    books = learn(scaled.select("id", "scaled"), parts, entries, rounds)
    coded = write_out(scaled.select("row", _codes(books)("scaled").alias("found")).select("row", "found.*"), "vector-codes")
    discard(scaled)
    own = F.col(f"row.`{label}`")
    sums = coded.groupBy(own.alias("key")).agg(F.sum("error").alias("label_error"))
    summed = coded.join(sums, own.eqNullSafe(F.col("key")))
    return summed.select("row.*", "code", "error", "label_error"), books
