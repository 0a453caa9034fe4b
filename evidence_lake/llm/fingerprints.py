"""Document fingerprints from content-defined chunks.

A gear hash runs over the bytes; a chunk ends where the hash's top bits are zero, and normalised sizes
ask for more zero bits before the usual size and fewer after it.  An edit moves only the boundaries next
to it, so the set of chunk digests, weighted by length, tells how much of one text another contains.

The gear hash of 16-bit numbers reaches 16 bytes back, no further than the smallest chunk, so it is
computed for whole slices at once and never sees another text.

Edited texts need each document's successor.  Documents are sorted in ranges between sampled
boundaries; the first document of a range is also dealt to the range before it, so that every range
is a single pass over its rows, without a neighbour's memory.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_lake.llm import wordwise
from evidence_lake.llm.arrow import bounded_batches
from evidence_lake.llm.sharding import Splitters, order_key, sampled_splitters
from evidence_lake.session import write_out

SMALLEST, USUAL, LARGEST = 16, 48, 192
#: Zero bits asked for before and after the usual size.
STRICT_BITS, LOOSE_BITS = 7, 4

_GEAR = (wordwise.mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)

#: digest -> length
Chunks = dict[int, int]


def _gear(data: np.ndarray) -> np.ndarray:
    """At i the hash of the 16 bytes before byte i."""
    h = np.zeros(len(data) + 1, dtype=np.uint16)
    h[1:] = _GEAR[data]
    for shift in (1, 2, 4, 8):
        h[shift:] = h[shift:] + (h[:-shift] << np.uint16(shift))  # the right side is computed before it is stored
    return h


class Boundaries:
    """Where chunks may end in a byte array, whole characters only."""

    def __init__(self, data: np.ndarray):
        self.data = data
        h = _gear(data)
        whole = np.ones(len(data) + 1, dtype=bool)
        whole[:-1] = (data & 0xC0) != 0x80
        loose = np.flatnonzero((h >> np.uint16(16 - LOOSE_BITS) == 0) & whole)
        strict = loose[h[loose] >> np.uint16(16 - STRICT_BITS) == 0]
        self.loose, self.strict = array("q", loose.tobytes()), array("q", strict.tobytes())

    def ends(self, start: int, end: int) -> list[int]:
        """Ends of the chunks of the text at [start, end)."""
        out, loose, strict, data = [], self.loose, self.strict, self.data
        while end - start > SMALLEST:
            usual = min(start + USUAL, end)
            at = bisect_left(strict, start + SMALLEST)
            cut = strict[at] if at < len(strict) else end
            if cut >= usual:
                last = min(start + LARGEST, end)
                at = bisect_left(loose, usual)
                cut = loose[at] if at < len(loose) else end
                if cut >= last:
                    cut = last
                    while cut < end and data[cut] & 0xC0 == 0x80:
                        cut -= 1
            out.append(cut)
            start = cut
        if start < end:
            out.append(end)
        return out


def _digests(content: bytes, start: int, ends: list[int]) -> list[int]:
    import xxhash

    digest, out = xxhash.xxh64_intdigest, []
    for end in ends:
        out.append(digest(content[start:end]))
        start = end
    return out


def chunk_texts(texts: list[bytes]) -> list[tuple[list[int], list[int]]]:
    """For each text the ends of its chunks and their digests."""
    out, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= wordwise.SLICE):
            size += len(texts[end])
            end += 1
        content = b"".join(texts[at:end])
        found, start = Boundaries(np.frombuffer(content, dtype=np.uint8)), 0
        for text in texts[at:end]:
            ends = found.ends(start, start + len(text))
            digests = _digests(content, start, ends)
            out.append(([e - start for e in ends], digests))
            start += len(text)
        at = end
    return out


def weighted(ends: list[int], digests: list[int]) -> Chunks:
    return {d: b - a for a, b, d in zip([0, *ends], ends, digests)}


def containment(a: Chunks, b: Chunks) -> float:
    """The share of a's distinct chunks, by length, that b has too; 1 if both are empty, 0 if only a is."""
    if not a:
        return 0.0 if b else 1.0
    return sum([n for d, n in a.items() if d in b]) / sum(a.values())


def written(chunks: Chunks) -> str:
    """``digest:length`` of each distinct chunk in hexadecimal, sorted and joined by commas."""
    return ",".join(["%016x:%x" % c for c in sorted(chunks.items())])


def edited_text(text: str, following: str) -> str:
    """The last quarter of the characters replaced by as many (or all) from the start of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def _compare(rows: list[tuple[int | None, str]]) -> list[tuple]:
    """Results for all rows but the last, which is only the successor of the one before."""
    encoded = [t.encode() for _, t in rows]
    chunks = chunk_texts(encoded)
    sets = [weighted(*c) for c in chunks]
    heads, tails, edits = [], [], []
    for (_, text), (_, following), (ends, _) in zip(rows, rows[1:], chunks):
        edited = edited_text(text, following).encode()
        kept = len(text[: len(text) - len(text) // 4].encode())
        same = bisect_left(ends, kept + 1)  # chunks that lie in what is kept; the rest is cut anew
        start = ends[same - 1] if same else 0
        heads.append((same, start))
        tails.append(edited[start:])
        edits.append(edited)
    out = []
    for k, (ends, digests) in enumerate(chunk_texts(tails)):
        same, start = heads[k]
        whole = weighted(chunks[k][0][:same] + [start + e for e in ends], chunks[k][1][:same] + digests)
        out.append(
            (
                rows[k][0],
                len(rows[k][1]),
                hashlib.sha256(edits[k]).hexdigest(),
                written(sets[k]),
                written(whole),
                containment(sets[k], whole),
                containment(sets[k], sets[k + 1]),
            )
        )
    return out


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, extra, doc_id, text) sorted by range, extra and place."""
    waiting: list[tuple[int | None, str]] = []
    now, closed = None, False

    def emit(rows: list[tuple[int | None, str]]) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            found = _compare(rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _SCHEMA.types)], schema=_SCHEMA)

    for batch in batches:
        size = 0
        for at, extra, doc, text in zip(*(batch.column(k) for k in range(4))):
            at, row = at.as_py(), (doc.as_py(), text.as_py() or "")
            if at != now:
                now, waiting, closed, size = at, [], False, 0
            if closed:
                continue
            if extra.as_py():  # the successor of the range's last row
                yield from emit([*waiting, row])
                waiting, closed = [], True
                continue
            waiting.append(row)
            size += len(row[1])
            if size > wordwise.SLICE:
                yield from emit(waiting)
                waiting, size = waiting[-1:], 0
        yield from emit(waiting)
        waiting = waiting[-1:]


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next per row.

    Successors go by doc_id (NULL first; rows with one doc_id by a hash of their texts), and the first row
    follows the last; a single row follows itself.  NULL texts count as empty, and an empty text has the
    empty fingerprint.  Texts of up to ``SMALLEST`` bytes are one chunk.  Equal rows are each other's
    successors.  Other columns are left out.  No rows: no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    key, tie = order_key(F.col(doc_id)), F.xxhash64(F.col(text), F.col(doc_id).isNull())
    size = (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long")
    records = write_out(
        docs.select(key.alias("key"), tie.alias("tie"), size.alias("size"))
        .groupBy("key", "tie")
        .agg(F.max("size").alias("size"), F.count("*").alias("copies")),
        "fingerprint-keys",
    )
    splitters = sampled_splitters(records, least=4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    lowest = records.agg(F.min(F.struct("key", "tie")).alias("first")).first()["first"]
    first = (lowest["key"], lowest["tie"]) if lowest else None
    placed = _dealt(docs.select(key.alias("key"), tie.alias("tie"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), splitters, first)
    ordered = placed.repartition("range").sortWithinPartitions("range", "extra", "key", "tie")
    return ordered.select("range", "extra", "doc_id", "text").mapInArrow(
        _ranges,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def _dealt(rows: DataFrame, splitters: Splitters, first: tuple[int, int] | None) -> DataFrame:
    """``rows`` with range and extra; the first row of a range once more as an extra of the range before,
    and the very first as an extra of the last range."""
    last = len(splitters.keys)
    kind = pa.list_(pa.struct([("range", pa.int32()), ("extra", pa.bool_())]))
    heads = {pair: k for k, pair in enumerate(splitters.pairs())}

    def places(keys: pa.Array, ties: pa.Array) -> pa.Array:
        k, t = keys.to_numpy(zero_copy_only=False), ties.to_numpy(zero_copy_only=False)
        out = []
        for at, pair in zip(splitters.find(k, t).tolist(), zip(k.tolist(), t.tolist())):
            dealt = [{"range": at, "extra": False}]
            if pair in heads:
                dealt.append({"range": heads[pair], "extra": True})
            if pair == first:
                dealt.append({"range": last, "extra": True})
            out.append(dealt)
        return pa.array(out, kind)

    where = F.arrow_udf(places, "array<struct<range:int,extra:boolean>>")(F.col("key"), F.col("tie"))
    return rows.withColumn("_places", where).withColumn("_p", F.explode_outer("_places")).select(
        "key", "tie", "doc_id", "text", F.col("_p.range").alias("range"), F.col("_p.extra").alias("extra")
    )
