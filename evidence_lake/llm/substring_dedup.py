"""Removal of passages that occur earlier, found by windows of words.

A window is ``size`` consecutive words of one document.  Windows that repeat share their anchors: of the
``anchor``-word runs in a window the one with the smallest hash.  A first pass counts anchors in count-min
sketches, one for each part of the input, which are merged part by part of the sketch.  Counts are
overestimates, so a window that repeats always has an anchor that is estimated repeated.  A second pass
deals out only the windows of such anchors and groups them exactly, by a 128-bit digest (XXH3) of their very words;
nothing is lost, whatever the sketch says, and anchors with equal hashes bring no unlike windows together.

The sketch keeps one bit for each counter, "more than once".  Its size follows the number of words up to
``MAX_COUNTERS``; where more anchors than that crowd it, more windows are grouped, with the same result.
Windows of one anchor occurrence travel as one row; rows of an anchor are read in order of their place,
so that the first occurrence is known without keeping the others.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake.llm import wordwise
from evidence_lake.llm.arrow import bounded_batches
from evidence_lake.llm.columns import others
from evidence_lake.session import write_out

WINDOW, ANCHOR = 20, 8
#: Windows that one row carries at most (the bits of ``gone``).
PER_ROW = 31
#: Counters in each of the sketch's two rows: at least four per expected anchor, within these bounds.
MIN_COUNTERS, MAX_COUNTERS = 1 << 16, 1 << 28
_SLICES = 64
_ROWS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _spread(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Counter numbers in one row of the sketch."""
    return (wordwise.mix(values ^ _ROWS[row]) >> np.uint64(64 - bits)).astype(np.int64)


class Windows:
    """Windows and anchors of the texts of one slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int, anchor: int):
        starts, ends, first = wordwise.word_spans(data, offsets)
        words = wordwise.word_hashes(data, starts, ends)
        counts = np.diff(first)
        self.text = np.repeat(np.arange(len(counts)), counts)
        self.position = np.arange(len(words)) - first[self.text]
        n = max(len(words) - size + 1, 0)
        self.valid = self.position[:n] + size <= counts[self.text[:n]]
        self.starts, self.ends, self.data = starts, ends, data
        self.runs = wordwise.run_hashes(words, anchor)
        self.smallest = wordwise.sliding(self.runs, size - anchor + 1, np.minimum)
        self.size, self.anchor = size, anchor

    def digests(self, at: np.ndarray) -> np.ndarray:
        """128-bit digests (two numbers each) of the words, joined by a space, of the windows at these words."""
        import xxhash

        data = self.data.tobytes()
        joined = b" ".join([data[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())])
        ends = np.cumsum(self.ends - self.starts + 1) - 1
        first = ends[at] - (self.ends[at] - self.starts[at])
        last = ends[at + self.size - 1]
        digest = xxhash.xxh3_128_digest
        packed = b"".join([digest(joined[a:b]) for a, b in zip(first.tolist(), last.tolist())])
        return np.frombuffer(packed, dtype=np.uint64).reshape(-1, 2)

    def anchors(self) -> np.ndarray:
        """The hash at each place that is the anchor of some window."""
        reach = self.size - self.anchor + 1
        if not self.valid.any():
            return self.runs[:0]
        # the largest of the minima of the windows that contain a run, 0 standing for "none"
        minima = np.where(self.valid, self.smallest, np.uint64(0))
        padded = np.concatenate([np.zeros(reach - 1, np.uint64), minima, np.zeros(reach - 1, np.uint64)])
        return self.runs[(wordwise.sliding(padded, reach, np.maximum) == self.runs) & (self.runs > 0)]


def _sketch(size: int, anchor: int, bits: int):
    """mapInArrow: texts -> (part, counters): for each part of the sketch the counters that were hit."""
    schema = pa.schema([("part", pa.int32()), ("counters", pa.binary())])
    low = bits - _SLICES.bit_length() + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Windows(d, o, size, anchor).anchors() for _, _, d, o in wordwise.slices(batch.column(0))]
            values = np.concatenate(found) if found else np.zeros(0, np.uint64)
            parts, packed = [], []
            for row in range(len(_ROWS)):
                counters = np.sort(_spread(values, row, bits))
                cuts = np.searchsorted(counters, np.arange(_SLICES + 1) << low)
                for k in range(_SLICES):
                    if cuts[k] < cuts[k + 1]:
                        parts.append(row * _SLICES + k)
                        inside = counters[cuts[k] : cuts[k + 1]] & ((1 << low) - 1)
                        packed.append(inside.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(packed, pa.binary())], schema=schema)

    return run


def _merge(bits: int):
    """mapInArrow over rows sorted by part -> (part, bits of the counters hit more than once)."""
    schema = pa.schema([("part", pa.int32()), ("many", pa.binary())])
    width = 1 << (bits - _SLICES.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = seen = many = None

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None:
                packed = np.packbits(many, bitorder="little").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([packed], pa.binary())], schema=schema)

        for batch in batches:
            for part, counters in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != now:
                    yield from done()
                    now, seen, many = part, np.zeros(width, bool), np.zeros(width, bool)
                hit = np.frombuffer(counters.as_buffer(), dtype=np.uint32)  # sorted
                many[hit[1:][hit[1:] == hit[:-1]]] = True
                many[hit[seen[hit]]] = True
                seen[hit] = True
        yield from done()

    return run


def repeated_anchors(texts: DataFrame, size: int, anchor: int, bits: int) -> bytes:
    """The merged sketch: for each row of counters one bit per counter, set where it was hit more than once."""
    sketches = texts.mapInArrow(_sketch(size, anchor, bits), "part int, counters binary")
    merged = (
        sketches.repartition("part").sortWithinPartitions("part").mapInArrow(_merge(bits), "part int, many binary").collect()
    )
    width = (1 << (bits - _SLICES.bit_length() + 1)) // 8
    out = bytearray(width * _SLICES * len(_ROWS))
    for row in merged:  # 2 * MAX_COUNTERS bits at most
        out[row["part"] * width : (row["part"] + 1) * width] = row["many"]
    return bytes(out)


def _firsts(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each digest the first row that has it, and these rows."""
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    in_order = digests[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (in_order[1:] != in_order[:-1]).any(axis=1)
    first = np.empty(len(order), dtype=np.int64)
    first[order] = order[new][np.cumsum(new) - 1]
    return first, order[new]


def _occurred(digests: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """For each digest whether it occurred before in the array at another place."""
    origin, _ = _firsts(digests)
    other = np.zeros(len(digests), dtype=bool)
    for place in places:
        other |= place[origin] != place
    return other


_ROW = "anchor long, id long, key long, pos long, n int, gone int, hashes binary"
_ROW_SCHEMA = pa.schema(
    [
        ("anchor", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("pos", pa.int64()),
        ("n", pa.int32()), ("gone", pa.int32()), ("hashes", pa.binary()),
    ]
)


def _starts(change: np.ndarray, most: int) -> np.ndarray:
    """First elements of runs, which end where ``change`` is set and after ``most`` elements."""
    first = np.flatnonzero(change)
    since = np.arange(len(change)) - np.repeat(first, np.diff(np.append(first, len(change))))
    return np.flatnonzero(since % most == 0)


def _candidates(size: int, anchor: int, bits: int, sketch):
    """mapInArrow: (id, key, text) -> a row for each run of windows with one anchor that may repeat."""

    def may_repeat(values: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), dtype=bool)
        for row in range(len(_ROWS)):
            at = _spread(values, row, bits) + (row << bits)
            out &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sketch.value, dtype=np.uint8)
        for batch in batches:
            order = pc.sort_indices(batch, sort_keys=[("id", "ascending"), ("key", "ascending")])
            batch = batch.take(order)
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for low, high, data, offsets in wordwise.slices(batch.column(2)):
                w = Windows(data, offsets, size, anchor)
                at = np.flatnonzero(w.valid)
                if not len(at):
                    continue
                values = w.smallest[at]
                change = np.ones(len(at), dtype=bool)
                change[1:] = (values[1:] != values[:-1]) | (at[1:] != at[:-1] + 1) | (w.text[at[1:]] != w.text[at[:-1]])
                firsts = np.flatnonzero(change)
                wanted = np.repeat(may_repeat(values[firsts], bitmap), np.diff(np.append(firsts, len(at))))
                at, values, change = at[wanted], values[wanted], change[wanted]
                if not len(at):
                    continue
                text, hashes = w.text[at], w.digests(at)
                id_, key, pos = ids[low:high][text], keys[low:high][text], w.position[at]
                # repeats within the slice, whose texts are in order, are settled here
                known = _occurred(hashes, [id_, key, pos])
                rows = _starts(change, PER_ROW)
                n = np.diff(np.append(rows, len(at)))
                bit = np.arange(len(at)) - np.repeat(rows, n)
                gone = np.add.reduceat(np.where(known, 1 << bit, 0), rows)
                kept = np.add.reduceat((~known).astype(np.int64), rows)
                ends = np.concatenate([[0], np.cumsum(kept)]) * 16
                packed = pa.BinaryArray.from_buffers(
                    pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(hashes[~known].tobytes())]
                )
                # rows without windows to compare need no company: anything spreads them
                target = np.where(kept > 0, values[rows].astype(np.int64), wordwise.mix((key[rows] + pos[rows]).astype(np.uint64)).astype(np.int64))
                columns = [target, id_[rows], key[rows], pos[rows], n.astype(np.int32), gone.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), packed], schema=_ROW_SCHEMA)

    return run


_GONE = "id long, key long, pos long, gone int"
_GONE_SCHEMA = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("pos", pa.int64()), ("gone", pa.int32())])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and place -> which windows occurred at an earlier place.

    Of an anchor that goes on in the next batch only the distinct windows and their first places are kept.
    """
    carried = None  # (anchor, hashes, id, key, pos)
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, id_, key, pos, n, gone = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
        offsets = np.frombuffer(batch.column(6).buffers()[1], dtype=np.int32)[
            batch.column(6).offset : batch.column(6).offset + len(batch) + 1
        ]
        data = batch.column(6).buffers()[2]
        data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        own = np.frombuffer(data.tobytes(), dtype=np.uint64).reshape(-1, 2)
        per_row = np.diff(offsets) // 16
        row = np.repeat(np.arange(len(anchor)), per_row)
        # an absolute place per window: bits that are not settled yet, in order
        free = (gone[:, None] >> np.arange(PER_ROW)) & 1 == 0
        free &= np.arange(PER_ROW) < n[:, None]
        bit = np.nonzero(free)[1] if len(own) else np.zeros(0, np.int64)
        if len(bit) != len(own):  # rows whose windows are all settled carry none
            bit = np.nonzero(free & (per_row > 0)[:, None])[1]
        w_anchor, w_id, w_key, w_pos = anchor[row], id_[row], key[row], pos[row] + bit
        hashes, before = own, 0
        if carried is not None and carried[0] == anchor[0]:
            _, c_hashes, c_id, c_key, c_pos = carried
            before = len(c_hashes)
            hashes = np.concatenate([c_hashes, own])
            w_id, w_key, w_pos = np.concatenate([c_id, w_id]), np.concatenate([c_key, w_key]), np.concatenate([c_pos, w_pos])
            w_anchor = np.concatenate([np.full(before, carried[0]), w_anchor])
        repeats = _occurred(hashes, [w_id, w_key, w_pos])
        new = gone.astype(np.int64)
        np.bitwise_or.at(new, row, np.where(repeats[before:], 1 << bit, 0))
        last = w_anchor == anchor[-1]
        if last.any():
            _, first = _firsts(hashes[last])
            first = np.sort(first)
            carried = (anchor[-1], hashes[last][first], w_id[last][first], w_key[last][first], w_pos[last][first])
        elif carried is not None and carried[0] != anchor[-1]:
            carried = None
        some = new > 0
        columns = [id_[some], key[some], pos[some], new[some].astype(np.int32)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], schema=_GONE_SCHEMA)


def later_windows(docs: DataFrame, size: int, anchor: int) -> DataFrame:
    """(id, key, runs): for each document with later occurrences its runs (pos, gone): bit b of ``gone`` is
    set if the window that starts at word pos + b occurs earlier."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select("text").where(F.col("text").isNotNull())
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = volume / 6 * 2 / (size - anchor + 2)  # anchors, if a word and its separator take six bytes
    # a part of the sketch is a whole number of bytes
    bits = max(min(max(int(4 * expected), MIN_COUNTERS), MAX_COUNTERS - 1).bit_length(), _SLICES.bit_length() + 2)
    sketch = spark.sparkContext.broadcast(repeated_anchors(texts, size, anchor, bits))
    rows = docs.select("id", "key", "text").mapInArrow(_candidates(size, anchor, bits, sketch), _ROW)
    ordered = rows.repartition("anchor").sortWithinPartitions("anchor", "id", "key", "pos")
    return (
        ordered.mapInArrow(_later, _GONE)
        .groupBy("id", "key")
        .agg(F.collect_list(F.struct("pos", "gone")).alias("runs"))
    )


def removed_words(n: int, runs: list[dict], size: int) -> np.ndarray:
    """For each of n words whether a window that occurs earlier covers it."""
    depth = np.zeros(n + 1, dtype=np.int64)
    pos = np.array([r["pos"] for r in runs], dtype=np.int64)
    gone = np.array([r["gone"] for r in runs], dtype=np.int64)
    row, bit = np.nonzero((gone[:, None] >> np.arange(PER_ROW)) & 1)
    starts = np.unique(pos[row] + bit)
    depth[starts] += 1
    depth[starts + size] -= 1
    return np.cumsum(depth[:n]) > 0


def _reduce(size: int):
    def run(texts: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for text, of in zip(texts, runs):
            words = (text.as_py() or "").encode().split()
            found, total = of.as_py(), len(words)
            if found:
                words = list(itertools.compress(words, (~removed_words(total, found, size)).tolist()))
            kept = b" ".join(words)
            out.append((total, total - len(words), kept.decode(), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.StructArray.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], names=["n_words", "n_removed", "kept_text", "kept_sha256"]
        )

    return run


def dedup_passages(
    docs: DataFrame, size: int = WINDOW, anchor: int = ANCHOR, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_text (kept words joined by one space) and kept_sha256.

    Words are what spaces and the control characters from tab to carriage return separate.  A word goes if
    a window that covers it has the words of a window that starts earlier, in an earlier document or
    in the same; windows are those of the input.  NULL and empty texts have no words, and texts of fewer
    than ``size`` words have no windows.  Documents are in order of doc_id, NULL first; rows that repeat a
    doc_id are ordered by a hash of their texts, and rows equal in both count as one document, so that
    each gets the same result.  Columns of ``docs`` with the new names (in any letter case) are replaced.
    """
    if not 1 <= anchor <= size:
        raise ValueError("anchor must lie between 1 and size")
    bounded_batches(docs.sparkSession)
    id_ = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))
    key = F.xxhash64(F.col(text), F.col(doc_id).isNull())
    found = later_windows(docs.select(id_.alias("id"), key.alias("key"), F.col(text).alias("text")), size, anchor)
    out = ("n_words", "n_removed", "kept_text", "kept_sha256")
    names = [n for n in docs.columns if n.lower() not in out]
    rows = docs.select(F.struct(*others(docs, (*out, text))).alias("row"), F.col(text).alias("text"), id_.alias("id"), key.alias("key"))
    found = found.withColumnsRenamed({"id": "found_id", "key": "found_key"})
    joined = rows.join(found, (F.col("id") == F.col("found_id")) & (F.col("key") == F.col("found_key")), "left")
    kind = "n_words bigint, n_removed bigint, kept_text string, kept_sha256 string"
    reduced = joined.select("row", "text", F.arrow_udf(_reduce(size), kind)("text", "runs").alias("reduced"))
    own = [F.col("text" if n.lower() == text.lower() else f"row.`{n}`").alias(n) for n in names]
    return reduced.select(*own, "reduced.*")
