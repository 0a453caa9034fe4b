"""Packing of pieces into as few sequences of bounded length as possible, by bin completion.

What a sequence can hold depends on lengths only, and there are at most ``limit`` of them.  So the plan
is made on the histogram of lengths: around the largest remaining length, fillings of the rest of a
sequence are enumerated depth first, largest lengths first; a filling that leaves as much room as an
earlier one but with more, smaller pieces is dominated and not tried; branches whose waste cannot beat
the best filling so far are cut; the first filling found, the best fit, is the first incumbent.  The
filling is applied as often as the histogram allows.  The driver sees one number per length.

The incumbent of the whole plan is the better of that and best-fit decreasing.  While it is above the lower
bound, other fillings that cannot be added to are tried, sequence by sequence and depth first; a plan is
given up where even a full use of the room left needs as many sequences as the incumbent.  After
``PLAN_BRANCHES`` branches the incumbent is taken.

Pieces get their place by their rank among the pieces of the same length, which comes from counts per
block of rows; a length that a third of all pieces have is spread over all blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidence_lake.llm.token_ids import token_pieces
from evidence_lake.session import write_out

LIMIT = 2048
#: Branches tried per sequence before the best filling so far is taken.
BRANCHES = 400
#: Branches tried for the whole plan before the best one so far is taken.
PLAN_BRANCHES = 100_000
#: For so many full sequences, or fewer, a branch takes a filling once; before, as often as it is there.
SINGLY = 64
#: Rows of a block are ranked together.
BLOCK_BITS = 17


@dataclass(frozen=True)
class Filling:
    """``copies`` sequences that each hold ``lengths`` (longest first)."""

    lengths: tuple[int, ...]
    copies: int


def _largest_fitting(counts: np.ndarray, room: int) -> int:
    """The largest length up to ``room`` that is left; 0 if none."""
    if room <= 0:
        return 0
    left = np.flatnonzero(counts[: room + 1])
    return int(left[-1]) if len(left) else 0


def completion(counts: np.ndarray, room: int, branches: int = BRANCHES) -> tuple[int, ...]:
    """Lengths that fill ``room`` best out of ``counts`` (index: length), by branch and bound."""
    best: tuple[int, ...] = ()
    best_waste, budget = room + 1, branches
    volume = np.cumsum(np.arange(len(counts)) * counts)
    smallest = int(np.flatnonzero(counts)[0]) if counts.any() else room + 1

    def search(room: int, below: int, chosen: tuple[int, ...]) -> None:
        nonlocal best, best_waste, budget
        if room < best_waste:
            best, best_waste = chosen, room
        top = min(room, below)
        if top < smallest or room - int(volume[top]) >= best_waste:  # even all that is left wastes as much
            return
        size = _largest_fitting(counts, top)
        while size:
            for times in range(min(int(counts[size]), room // size), 0, -1):
                budget -= 1
                search(room - size * times, size - 1, (*chosen, *[size] * times))
                if not best_waste or budget <= 0:
                    return
            # a smaller length here is dominated unless another piece fits beside it
            size = _largest_fitting(counts, min(size - 1, room - smallest))

    search(room, room, ())
    return best


def _apply(counts: np.ndarray, lengths: tuple[int, ...], once: bool = False) -> int:
    """Take ``lengths`` out of ``counts``, as often as they are there or once."""
    used, times = np.unique(lengths, return_counts=True)
    copies = 1 if once else int((counts[used] // times).min())
    counts[used] -= copies * times
    return copies


def least_waste(counts: np.ndarray, limit: int, branches: int = BRANCHES) -> list[Filling]:
    """Fill the sequence of the largest length that is left best, never going back."""
    counts, fillings = counts.copy(), []
    while size := _largest_fitting(counts, limit):
        counts[size] -= 1
        lengths = (size, *completion(counts, limit - size, branches))
        counts[size] += 1
        fillings.append(Filling(lengths, _apply(counts, lengths)))
    return fillings


def best_fit_decreasing(counts: np.ndarray, limit: int) -> list[Filling]:
    """Largest lengths first, each into the fullest sequence that has room; equal sequences go as one."""
    opened: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # room -> (lengths, copies)
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        for room in sorted(r for r in opened if r >= size):
            times, groups = room // size, opened[room]
            while groups and left:
                lengths, copies = groups.pop()
                full = min(copies, left // times)
                left -= full * times
                if full:
                    opened.setdefault(room - size * times, []).append((lengths + (size,) * times, full))
                if full < copies:
                    some, rest = left, copies - full - (left > 0)
                    left = 0
                    if some:
                        opened.setdefault(room - size * some, []).append((lengths + (size,) * some, 1))
                    if rest:
                        groups.append((lengths, rest))
            if not groups:
                del opened[room]
            if not left:
                break
        for times, copies in ((limit // size, left // (limit // size)), (left % (limit // size), 1)):
            if times and copies:
                opened.setdefault(limit - size * times, []).append(((size,) * times, copies))
    return [Filling(lengths, copies) for groups in opened.values() for lengths, copies in groups]


def _completions(counts: np.ndarray, room: int, branches: int) -> tuple[list[tuple[int, ...]], int]:
    """Fillings of ``room`` that cannot be added to, least waste first, and the branches that took."""
    found: dict[tuple[int, ...], int] = {}
    smallest, spent = int(np.flatnonzero(counts)[0]) if counts.any() else room + 1, 0
    stack: list[tuple[int, int, tuple[int, ...]]] = [(room, room, ())]
    while stack and spent < branches:
        room, below, chosen = stack.pop()
        spent += 1
        if room < smallest or not (fits := _largest_fitting(counts, room)):
            found[chosen] = room
            continue
        size, following = _largest_fitting(counts, min(room, below)), []
        if not size:  # what fits has been left out before, unless all of it is used
            if int(counts[fits]) <= chosen.count(fits):
                left = counts[: room + 1].copy()
                for n in chosen:
                    if n <= room:
                        left[n] -= 1
                if not left.any():
                    found[chosen] = room
            continue
        while size:
            for times in range(min(int(counts[size]), room // size), 0, -1):
                following.append((room - size * times, size - 1, (*chosen, *[size] * times)))
            size = _largest_fitting(counts, size - 1)
        stack.extend(reversed(following))
    return sorted(found, key=lambda f: (found[f], [-n for n in f])), spent


def _searched(counts: np.ndarray, limit: int, best: list[Filling], bound: int, budget: int) -> list[Filling]:
    """A plan of fewer sequences than ``best``, if one is found within ``budget`` branches; else ``best``."""
    counts, least = counts.copy(), sum(f.copies for f in best)
    volume, used = int((np.arange(len(counts)) * counts).sum()), 0
    chosen: list[Filling] = []
    ahead: list[list[tuple[int, ...]]] = []  # for each sequence the fillings not yet tried, best last

    def undo() -> None:
        nonlocal volume, used
        last = chosen.pop()
        for n in last.lengths:
            counts[n] += last.copies
        volume += last.copies * sum(last.lengths)
        used -= last.copies

    while least > bound and budget > 0:
        budget -= 1
        if used + -(-volume // limit) < least and volume:
            size = _largest_fitting(counts, limit)
            counts[size] -= 1
            fillings, spent = _completions(counts, limit - size, min(BRANCHES, budget))
            counts[size] += 1
            budget -= spent
            ahead.append([(size, *f) for f in reversed(fillings)])
        else:
            if not volume and used < least:
                best, least = list(chosen), used
            if not chosen:
                break
            undo()
        while ahead and not ahead[-1]:
            ahead.pop()
            if chosen:
                undo()
        if not ahead:
            break
        lengths = ahead[-1].pop()
        filling = Filling(lengths, _apply(counts, lengths, once=volume <= SINGLY * limit))
        chosen.append(filling)
        volume -= filling.copies * sum(lengths)
        used += filling.copies
    return best


def plan(
    histogram: dict[int, int], limit: int = LIMIT, branches: int = BRANCHES, plan_branches: int = PLAN_BRANCHES
) -> list[Filling]:
    """Fillings that use up ``histogram`` (length -> count), lengths from 1 to ``limit``."""
    counts = np.zeros(limit + 1, dtype=np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= limit:
            raise ValueError(f"length {length} is not between 1 and {limit}")
        counts[length] += n
    bound = lower_bound(histogram, limit) if histogram else 0
    best = least_waste(counts, limit, branches)
    if sum(f.copies for f in best) > bound:
        best = min(best, best_fit_decreasing(counts, limit), key=lambda p: sum(f.copies for f in p))
    return _searched(counts, limit, best, bound, plan_branches)


def lower_bound(histogram: dict[int, int], limit: int = LIMIT) -> int:
    """No packing needs fewer sequences: volume, with large pieces that cannot meet counted apart."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    n = np.array([histogram[s] for s in sizes.tolist()], dtype=np.int64)
    best = -(-int((sizes * n).sum()) // limit)
    for small in sizes[sizes <= limit // 2].tolist():
        big = sizes > limit - small
        middle = (sizes > limit // 2) & ~big
        low = (sizes >= small) & (sizes <= limit // 2)
        room = int((n[middle] * (limit - sizes[middle])).sum())
        over = int((sizes[low] * n[low]).sum()) - room
        best = max(best, int(n[big].sum() + n[middle].sum()) + max(0, -(-over // limit)))
    return max(best, int(n[2 * sizes > limit].sum()))


class Places:
    """Sequence and offset for a piece's length and its rank among pieces of that length."""

    def __init__(self, fillings: list[Filling], limit: int):
        rows, used, base = [], np.zeros(limit + 1, dtype=np.int64), 0
        for filling in fillings:
            at, lengths = 0, filling.lengths
            while lengths:
                size = lengths[0]
                times = lengths.count(size)
                rows.append((size, int(used[size]), times, base, at))
                used[size] += times * filling.copies
                at += size * times
                lengths = lengths[times:]
            base += filling.copies
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        self.first, self.times, self.base, self.offset = table[:, 1], table[:, 2], table[:, 3], table[:, 4]
        self.start = np.searchsorted(table[:, 0], np.arange(limit + 2))

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.empty(len(lengths), dtype=np.int64)
        for size in np.unique(lengths).tolist():
            mine, low, high = lengths == size, self.start[size], self.start[size + 1]
            at[mine] = low + np.searchsorted(self.first[low:high], ranks[mine], side="right") - 1
        copy, turn = np.divmod(ranks - self.first[at], self.times[at])
        return self.base[at] + copy, self.offset[at] + turn * lengths


def pack(pieces: DataFrame, length: str = "length", limit: int = LIMIT, branches: int = BRANCHES) -> DataFrame:
    """``pieces`` with sequence_id and offset, gapless within each sequence.

    ``pieces`` must be a table that reads the same each time (``write_out``) with a column ``row_no`` from
    ``monotonically_increasing_id`` at the time of writing; it is dropped.  Equal rows get places of their
    own.  No pieces: no rows.  Lengths must lie between 1 and ``limit``.
    """
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy(length).count().collect()}  # at most ``limit`` rows
    places = Places(plan(histogram, limit, branches), limit)

    blocks = pieces.drop("sequence_id", "offset").withColumn("_block", F.shiftright("row_no", BLOCK_BITS))
    before = Window.partitionBy(length).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        blocks.groupBy(length, "_block")
        .count()
        .select(F.col(length).alias("_length"), F.col("_block").alias("_b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    )
    ranked = blocks.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_block", length).orderBy("row_no")) - 1
    ).join(bases, (F.col(length) == F.col("_length")) & (F.col("_block") == F.col("_b")))
    kind = pa.struct([("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        found = places.of(lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], fields=list(kind))

    spot = F.arrow_udf(place, "sequence_id bigint, offset bigint")
    return (
        ranked.withColumn("_spot", spot(F.col(length).cast("long"), (F.col("_base") + F.col("_rank")).cast("long")))
        .withColumns({"sequence_id": F.col("_spot.sequence_id"), "offset": F.col("_spot.offset")})
        .drop("_spot", "_block", "_b", "_length", "_base", "_rank", "row_no")
    )


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = LIMIT,
    end_id: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; only documents longer than ``limit`` are cut.  NULL and empty
    texts are the ``end_id`` alone.  NULL and repeated doc_ids are kept as they are: each row is packed.
    Other columns are left out.  No documents: no rows.
    """
    spark: SparkSession = docs.sparkSession
    made = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.explode_outer(token_pieces(spark, tokenizer_path, F.col(text), limit, end_id)).alias("p"),
    )
    table = write_out(
        made.select("doc_id", "p.*").withColumn("row_no", F.monotonically_increasing_id()), "token-pieces"
    )
    return pack(table, "length", limit).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
