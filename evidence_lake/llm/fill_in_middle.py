"""Fill-in-the-middle rearrangement of texts, cut at ranks that an indexable skip list finds.

A text is a list of units: runs of A-Z and a-z, and every other character by itself.  The two cuts are
ranks in that list.  Its skip list has lanes one above the other: a unit stands in lane k if k coins of its
rank came down heads (one in ``FAN`` does, the same ranks in every text), the first unit stands in all.
Every link of a lane carries its width in units, in code points and in bytes.  A search starts in the top
lane, follows links as long as their units fit into what is left of the rank, and goes down a lane; widths
added up on the way are the place.  Below the lowest lane lies the text itself, of which only the stretch of
one link is read, so a text needs memory for its links, one for about ``FAN`` units.

The rearranged text is put together, and taken apart again, by DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_lake.llm import wordwise
from evidence_lake.llm.arrow import bounded_batches
from evidence_lake.llm.columns import others

#: One unit in so many stands in the next lane.
FAN = 16
_LANES = 7
#: Bytes of a long text that are looked at in one go.
_BLOCK = 1 << 20

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


def _lanes_of(ranks: np.ndarray) -> np.ndarray:
    """In how many lanes the unit of each rank stands (0: in none)."""
    coins = wordwise.mix(ranks.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    coins |= np.uint64(1) << np.uint64(_LANES * (FAN.bit_length() - 1))
    zeros = np.bitwise_count((coins & (~coins + np.uint64(1))) - np.uint64(1))
    heights = zeros // (FAN.bit_length() - 1)
    return np.where(ranks == 0, _LANES, heights)


def _unit_starts(data: np.ndarray, letter_before: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Which bytes start a code point, which start a unit, and whether the last byte is a letter."""
    points = (data & 0xC0) != 0x80
    letters = ((data | 0x20) - 97).astype(np.uint8) < 26
    goes_on = np.empty(len(data), dtype=bool)
    goes_on[:1], goes_on[1:] = letter_before, letters[:-1]
    goes_on &= letters
    return points, points & ~goes_on, bool(letters[-1]) if len(data) else letter_before


class SkipList:
    """The units of one text (UTF-8 bytes)."""

    def __init__(self, data: np.ndarray):
        self.data = data
        ranks, points, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        n = n_points = 0
        letter = False
        for at in range(0, len(data), _BLOCK):
            is_point, is_unit, letter = _unit_starts(data[at : at + _BLOCK], letter)
            unit = np.flatnonzero(is_unit)
            rank = np.arange(n, n + len(unit))
            stands = _lanes_of(rank) > 0
            ranks.append(rank[stands])
            places.append(unit[stands] + at)
            before = np.cumsum(is_point)
            points.append(before[unit[stands]] - 1 + n_points)
            n, n_points = n + len(unit), n_points + int(before[-1])
        self.n, self.n_points = n, n_points
        self._link(*map(np.concatenate, (ranks, points, places)))

    def _link(self, ranks: np.ndarray, points: np.ndarray, places: np.ndarray) -> None:
        """lanes: from the lowest, lists of units, code points and bytes that links span, and where they start below."""
        self.lanes = []
        height, stands, below = _lanes_of(ranks), np.arange(len(ranks)), None
        for lane in range(1, _LANES + 1):
            if lane > 1:
                below, stands = stands, stands[height[stands] >= lane]
                if len(stands) == len(below):
                    break
            spans = [np.diff(x[stands], append=end) for x, end in ((ranks, self.n), (points, self.n_points), (places, len(self.data)))]
            down = np.searchsorted(below, stands) if below is not None else np.zeros(len(stands), np.int64)
            self.lanes.append([x.tolist() for x in (*spans, down)])

    def code_points_before(self, rank: int) -> int:
        """Code points before the unit of this rank, which is at most the number of units."""
        left, points, place, at = rank, 0, 0, 0
        for lane, (units, wide, long, down) in enumerate(reversed(self.lanes), start=1):
            while at < len(units) and units[at] <= left:
                left, points, place, at = left - units[at], points + wide[at], place + long[at], at + 1
            if not left:
                return points
            if lane < len(self.lanes):
                at = down[at]
        if not left:
            return points
        size = 4 * FAN
        while True:  # along the text; it ends within the link at which the lowest lane stopped
            part = self.data[place : place + size]
            is_point, is_unit, _ = _unit_starts(part, False)
            starts = np.flatnonzero(is_unit)
            if len(starts) > left:
                return points + int(np.count_nonzero(is_point[: starts[left]]))
            if place + size >= len(self.data):
                return points + int(np.count_nonzero(is_point))
            size *= 4


_CUTS = "n long, prefix_chars long, middle_chars long"
_NAMES = ["n", "prefix_chars", "middle_chars"]


def _cut(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """Units of each text and code points of its prefix and middle, if its numbers are not NULL."""
    numbers = zip(first.to_pylist(), second.to_pylist())
    rows = []

    def lists() -> Iterator[SkipList]:
        for _, _, data, offsets in wordwise.slices(texts):
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                yield SkipList(data[a:b])

    for units, (x, y) in zip(lists(), numbers):
        if x is None or y is None:
            rows.append((units.n, None, None))
        else:
            low, high = sorted((x % (units.n + 1), y % (units.n + 1)))
            low, high = units.code_points_before(low), units.code_points_before(high)
            rows.append((units.n, low, high - low))
    columns = list(zip(*rows)) or [[]] * 3
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)


def draws(doc_id: Column) -> list[Column]:
    """Four numbers below 2**32 that a document's id decides."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The text that was rearranged; exact, since rearranged texts contain none of the three marks."""

    def between(start: str, end: str) -> Column:
        rest = F.substring(output, F.instr(output, start) + len(start), F.length(output))
        return F.substring_index(rest, end, 1) if end else rest

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, ""), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, ""), between(SUFFIX, PREFIX))
    return F.when(form == PLAIN, output).when(form == PSM, psm).otherwise(spm)


def fill_in_middle(
    docs: DataFrame, plain_from: int = 90, spm_below: int = 20, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars (code points) and output, the rearranged text.

    Four numbers from the digest of the doc_id decide a document's cuts (ranks in its units) and form: of 100
    documents those from number ``plain_from`` on stay plain, and of the others those below ``spm_below`` are
    spm, suffix first, the rest psm.  Empty texts and texts that contain a mark are plain; so their output is
    the text, and prefix_chars and middle_chars are NULL.  NULL counts as an empty text and a NULL doc_id as an
    empty one.  Repeated rows each get the same result, and no rows give none.  Columns of ``docs`` with the
    new names (in any letter case) are replaced.
    """
    bounded_batches(docs.sparkSession)
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*others(docs, new)).alias("row"), whole.alias("text"), *[
        h.alias(f"h{k}") for k, h in enumerate(draws(F.col(doc_id)), start=1)
    ])
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= plain_from)
    form = F.when(plain, PLAIN).when(F.col("h4") % 100 < spm_below, SPM).otherwise(PSM)
    formed = rows.withColumn("form", form)
    moved = F.col("form") != PLAIN
    cuts = F.arrow_udf(_cut, _CUTS)("text", F.when(moved, F.col("h1")), F.when(moved, F.col("h2")))
    cut = formed.withColumn("cuts", cuts).select("row", "text", "form", "cuts.*")
    low, size = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle = F.substring("text", F.lit(1), low), F.substring("text", low + 1, size)
    suffix = F.substring("text", low + size + 1, F.length("text"))
    p, s, m = (F.lit(x) for x in (PREFIX, SUFFIX, MIDDLE))
    output = (
        F.when(~moved, F.col("text"))
        .when(F.col("form") == PSM, F.concat(p, prefix, s, suffix, m, middle))
        .otherwise(F.concat(s, suffix, p, prefix, m, middle))
    )
    return cut.select("row.*", "n", "form", "prefix_chars", "middle_chars", output.alias("output"))
