"""Near-duplicate documents by SimHash fingerprints and pigeonring filtering.

Fingerprints of at most ``bits`` differing bits are linked.  A fingerprint is cut into ``bits + 1``
segments on a ring.  If all differences add up to at most ``bits``, some segment starts a chain of which
every first part of l segments differs in at most l * bits / (bits + 1) bits: no bit in the first
segment, one at most in the first two, and so on.  Fingerprints meet by the first two segments (with one
bit of the second left open); candidates are dropped as soon as a longer part of the chain exceeds its
budget, and what is left is checked in full.

Equal fingerprints are one from the start.  Of the links within a bucket only enough to connect it are
passed on, so groups of near copies cost links in proportion to their size.  A bucket over ``BUCKET``
fingerprints comes back as rows and is dealt out again as pairs of blocks, each compared in a task of its
own: no bucket has to fit one task, and no comparison is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_lake.llm.arrow import bounded_batches
from evidence_lake.llm.wordwise import slices
from evidence_lake.session import discard, write_out

SEED, SHINGLE, BITS = 42, 4, 4
#: Fingerprints of one bucket that are compared in one go.
BUCKET = 4096
_GATHER = 200_000


def _shingle_digests(words: list[bytes], shingle: int, seed: int) -> bytes:
    """The XXH64 digests (big-endian) of all shingles of words, or of all words if they are fewer."""
    import xxhash

    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[shingle - 1 :] if len(words) >= shingle else [len(joined)]
    first = np.concatenate([[0], ends[: len(last) - 1] + 1]).astype(np.int64)
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], seed) for a, b in zip(first.tolist(), np.asarray(last).tolist())])


def fingerprint_of(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit by bit the majority of the XXH64 hashes of the word shingles of a text; 0 without words."""
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    hashes = _shingle_digests(words, shingle, seed)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8 * 255 * 256):  # bounded memory for long texts
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8, min(8 * 255 * 256, len(hashes) - at), at)).reshape(-1, 64)
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8)
        ones += sums.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes) // 8).tobytes(), "big", signed=True)


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint as a long (its 64 bits); NULL counts as empty."""

    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of((t.as_py() or "").encode(), shingle, seed) for t in texts], pa.int64())

    return F.arrow_udf(of, "long")(text)


class Ring:
    """Segments of 64-bit fingerprints, keys by the first two of a chain, and the budgets of its parts."""

    def __init__(self, bits: int):
        if not 1 <= bits <= 20:
            raise ValueError("bits must lie between 1 and 20")
        self.bits, self.m = bits, bits + 1
        widths = [64 // self.m + (k < 64 % self.m) for k in range(self.m)]
        lows = np.concatenate([[0], np.cumsum(widths)])[:-1].tolist()
        segments = [((1 << w) - 1) << low for w, low in zip(widths, lows)]
        self.parts = [  # parts[l - 1][i]: the first l segments of the chain from segment i
            np.array([sum(segments[(i + k) % self.m] for k in range(n)) for i in range(self.m)], dtype=np.uint64)
            for n in range(1, self.m + 1)
        ]
        self.budgets = [n * bits // self.m for n in range(1, self.m + 1)]
        self.open = [(i, lows[(i + 1) % self.m] + p) for i in range(self.m) for p in range(widths[(i + 1) % self.m])]
        self.second = np.array([segments[(i + 1) % self.m] for i, _ in self.open], dtype=np.uint64)
        self.bit = np.array([1 << p for _, p in self.open], dtype=np.uint64)
        self.lowest = np.array([p == lows[(i + 1) % self.m] for i, p in self.open])

    def keys(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each fingerprint 64 (chain number, bits): the first two segments without one bit of the second."""
        masks = np.array([int(self.parts[1][i]) & ~(1 << p) for i, p in self.open], dtype=np.uint64)
        number = np.tile(np.arange(len(self.open), dtype=np.int32), len(prints))
        return number, (prints[:, None] & masks[None, :]).ravel()

    def linked(self, chain: np.ndarray, differences: np.ndarray) -> np.ndarray:
        """Which differences stay within every budget of their chain, and so within ``bits``.

        Fingerprints with equal second segments meet once for each bit of it; only the first time counts.
        """
        second = differences & self.second[chain]
        left = np.flatnonzero((second == self.bit[chain]) | ((second == 0) & self.lowest[chain]))
        starts = np.array([i for i, _ in self.open])[chain]
        for masks, budget in zip(self.parts[2:], self.budgets[2:]):
            left = left[np.bitwise_count(differences[left] & masks[starts[left]]) <= budget]
        return left


_LINK = "a long, b long, chain int, hot boolean"
_LINK_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("chain", pa.int32()), ("hot", pa.bool_())])


def _stars(pairs: np.ndarray) -> np.ndarray:
    """Links (smallest, other) that connect what the pairs connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for a, b in np.unique(pairs, axis=0).tolist():
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return np.array([(find(x), x) for x in root if find(x) != x], dtype=np.int64).reshape(-1, 2)


def _compare(ring: Ring, bucket: int | None):
    """mapInArrow over rows (chain, part, block, print) sorted by the first three -> links, and the rows of
    buckets over ``bucket``."""

    def links_of(chain: np.ndarray, group: np.ndarray, prints: np.ndarray) -> np.ndarray:
        found, at, apart = [], np.arange(len(prints)), 0
        while len(at):
            apart += 1
            at = at[at + apart < len(prints)]
            at = at[group[at + apart] == group[at]]
            a, b = prints[at], prints[at + apart]
            ok = at[ring.linked(chain[at], a ^ b)]
            if len(ok):
                found.append(np.sort(np.column_stack([prints[ok], prints[ok + apart]]).view(np.int64), axis=1))
                if sum(map(len, found)) > 1_000_000:
                    found = [_stars(np.concatenate(found))]
        return _stars(np.concatenate(found)) if found else np.zeros((0, 2), np.int64)

    def batch_of(a, b, chain, hot: bool) -> pa.RecordBatch:
        columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(chain, pa.int32()), pa.array(np.full(len(a), hot))]
        return pa.RecordBatch.from_arrays(columns, schema=_LINK_SCHEMA)

    def process(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        chain, part, block, prints = rows
        change = np.ones(len(part), dtype=bool)
        change[1:] = (part[1:] != part[:-1]) | (chain[1:] != chain[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(change)
        sizes = np.diff(np.append(first, len(part)))
        group, size = np.repeat(np.arange(len(first)), sizes), np.repeat(sizes, sizes)
        if bucket is not None and (hot := size > bucket).any():
            yield batch_of(part[hot], prints[hot].view(np.int64), chain[hot], True)
            size = np.where(hot, 1, size)
        some = size > 1
        if some.any():
            stars = links_of(chain[some], group[some], prints[some])
            yield batch_of(stars[:, 0], stars[:, 1], np.zeros(len(stars), np.int32), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        overfull = None  # a bucket whose first rows have been sent back already

        def joined() -> list[np.ndarray]:
            return [np.concatenate(c) for c in zip(*kept)]

        for batch in batches:
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            rows[3] = rows[3].view(np.uint64)
            if not len(rows[0]):
                continue
            kept.append(rows)
            if sum(len(r[0]) for r in kept) < _GATHER:
                continue
            rows = joined()
            key = lambda k: (rows[0][k], rows[1][k], rows[2][k])
            if overfull is not None:
                same = (rows[0] == overfull[0]) & (rows[1] == overfull[1]) & (rows[2] == overfull[2])
                if same.any():
                    yield batch_of(rows[1][same], rows[3][same].view(np.int64), rows[0][same], True)
                    rows = [r[~same] for r in rows]
                if not same.all():
                    overfull = None
                if not len(rows[0]):
                    kept = []
                    continue
            last = key(-1)
            open_ = (rows[0] == last[0]) & (rows[1] == last[1]) & (rows[2] == last[2])
            if bucket is not None and open_.sum() > bucket:
                yield batch_of(rows[1][open_], rows[3][open_].view(np.int64), rows[0][open_], True)
                overfull, kept = last, []
            else:
                kept = [[r[open_] for r in rows]]
            yield from process([r[~open_] for r in rows])
        if kept:
            rows = joined()
            if overfull is not None:
                same = (rows[0] == overfull[0]) & (rows[1] == overfull[1]) & (rows[2] == overfull[2])
                yield batch_of(rows[1][same], rows[3][same].view(np.int64), rows[0][same], True)
                rows = [r[~same] for r in rows]
            yield from process(rows)

    return run


def links(prints: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) of distinct fingerprints ``print`` that connect all that differ in at most ``bits`` bits."""
    ring = Ring(bits)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), 4096):
                some = every[at : at + 4096]
                chain, part = ring.keys(some)
                columns = [chain, part.view(np.int64), np.repeat(some, len(ring.open)).view(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["chain", "part", "print"])

    rows = prints.select("print").mapInArrow(keyed, "chain int, part long, print long").withColumn("block", F.lit(0).cast("long"))

    def compared(rows: DataFrame, bucket: int | None) -> DataFrame:
        order = ["chain", "part", "block"]
        dealt = rows.select(*order, "print").repartition(*order).sortWithinPartitions(*order, "print")
        return dealt.mapInArrow(_compare(ring, bucket), _LINK)

    found = write_out(compared(rows, bucket), "fingerprint-links")
    hot = found.where("hot").select("chain", F.col("a").alias("part"), F.col("b").alias("print"))
    if not hot.isEmpty():
        blocks = hot.groupBy("chain", "part").agg(F.ceil(F.count("*") / bucket).alias("blocks"))
        mine = F.pmod(F.xxhash64("print"), F.col("blocks"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        paired = (
            hot.join(blocks, ["chain", "part"])
            .withColumn("mine", mine)
            .withColumn("other", other)
            .withColumn("block", F.shiftleft(F.least("mine", "other"), 31) + F.greatest("mine", "other"))
        )
        found = found.unionByName(write_out(compared(paired, None), "fingerprint-links"))
    return found.where("not hot").select("a", "b").distinct()


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the links that a task reads those that connect as much; bounded by links, not by groups."""
    kept: list[np.ndarray] = []

    def stars() -> Iterator[pa.RecordBatch]:
        if kept:
            links = _stars(np.concatenate(kept))
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    for batch in batches:
        kept.append(np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]))
        if sum(map(len, kept)) > _GATHER:
            yield from stars()
            kept = []
    yield from stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges`` (a, b).

    In each round every node points at its smallest neighbour if that is smaller, pointers are followed
    to their ends by doubling, and edges between different ends are the next round's.  At least half of
    the ends go each time, and the edges of what is connected vanish after their first round.  Rounds are
    written to the shared folder.
    """
    distinct = edges.where("a <> b").mapInArrow(_thinned, "a long, b long").distinct()
    edges, labels = write_out(distinct, "edges"), None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("near"))
        )
        ends = table = write_out(both.groupBy("node").agg(F.least("node", F.min("near")).alias("root")), "pointers")
        while True:
            hop = ends.select(F.col("node").alias("root"), F.col("root").alias("next"))
            moved = write_out(ends.join(hop, "root").select("node", "root", "next"), "pointers")
            discard(table)
            ends, table = moved.select("node", F.col("next").alias("root")), moved
            if moved.where("next <> root").isEmpty():
                break
        if labels is None:
            labels = ends
        else:
            higher = ends.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            joined = labels.join(higher, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
            labels = write_out(joined, "labels")
        low = ends.select(F.col("node").alias("a"), F.col("root").alias("low"))
        high = ends.select(F.col("node").alias("b"), F.col("root").alias("high"))
        between = edges.join(low, "a").join(high, "b").where("low <> high")
        following = write_out(between.select(F.col("low").alias("a"), F.col("high").alias("b")).distinct(), "edges")
        discard(edges)
        edges = following
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels


def grouped(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """``prints`` (doc_id, print) with component_id, the smallest doc_id reachable over links.

    ``prints`` must be a table that reads the same each time.  NULL doc_ids are grouped like others but
    name no component, unless a component has no other.
    """
    distinct = write_out(prints.groupBy("print").agg(F.min("doc_id").alias("low")), "fingerprints")
    roots = components(links(distinct, bits)).withColumnRenamed("node", "print")
    named = distinct.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_print = named.join(lowest, "root").select("print", "component_id")
    return prints.join(by_print, "print")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, print (the fingerprint's 64 bits as a long) and component_id.

    Words are lower-cased (A-Z) and separated by white space; shingles count as often as they occur, and a
    text of fewer words is one shingle.  NULL and empty texts have fingerprint zero and are linked like any
    other.  Repeated rows each get a row.  Other columns are left out.  No rows: no rows.
    """
    bounded_batches(docs.sparkSession)
    prints = write_out(
        docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), shingle).alias("print")), "document-fingerprints"
    )
    return grouped(prints, bits).select("doc_id", "print", "component_id")


#: The pipeline's near-duplicates: shingles of five words, similarity (Jaccard) from 0.8 on.
STAGE_SHINGLE, SIMILARITY = 5, 0.8
#: Shingles that many texts have are learned from one text in ``SAMPLED`` (from all of fewer than ``LEAST_SAMPLE``):
#: how often a common one is found there at least, and how many are told apart.  They set the order of shingles
#: only; every order gives the same result.
SAMPLED, LEAST_SAMPLE, COMMON, MOST_COMMON = 64, 20_000, 3, 1 << 20
#: All pairs within the shingles' groups are listed as soon as they are at most so many for each row that the
#: groups had at first, or a round has not halved them; in a group, by blocks of about so many rows.
PAIRS_PER_ROW, PAIR_BLOCK = 4, 4096
#: For bounds in floating point, so that none is missed.
_SLACK = 1 - 1e-9


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles (its word sequence, if shorter), in order."""
    hashes = _shingle_digests(text.lower().split(), shingle, SEED)
    return np.unique(np.frombuffer(hashes, dtype=">u8").astype(np.uint64).view(np.int64))


def _shingles(shingle: int):
    """mapInArrow: (key, text) -> (key, shingles), a few MB of texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1)):
                data = data.tobytes()
                sets = [shingle_hashes(data[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), _lists(sets)], names=["key", "shingles"])

    return run


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _prefixes(text: Column, shingle: int, similarity: float, common) -> Column:
    """(n, prefix): the number of shingles of a text and its first ones, rare ones first.

    Of n shingles at least n * similarity must be in a similar text, so one of the first
    n - ceil(n * similarity) + 1 is, and the first common one is among the first of both texts.
    """

    def of(x: pa.Array) -> pa.Array:
        known, counts = common.value
        sizes, prefixes = [], []
        for t in x:
            hashes = shingle_hashes((t.as_py() or "").encode(), shingle)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            weight = np.where(known[at] == hashes, counts[at], 0)
            first = len(hashes) - int(np.ceil(len(hashes) * similarity * _SLACK)) + 1
            sizes.append(len(hashes))
            prefixes.append(hashes[np.lexsort((hashes, weight))[:first]])
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), _lists(prefixes)], names=["n", "prefix"])

    return F.arrow_udf(of, "n int, prefix array<long>")(text)


def _common_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that many sampled ``texts`` (key, text) have, and how many of them; never empty."""
    every = max(1, min(SAMPLED, texts.count() // LEAST_SAMPLE))
    found = (
        texts.where(F.pmod("key", F.lit(every)) == 0)
        .mapInArrow(_shingles(shingle), "key long, shingles array<long>")
        .select(F.explode("shingles").alias("shingle"))
        .groupBy("shingle")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= COMMON)
        .orderBy(F.col("n").desc(), "shingle")
        .limit(MOST_COMMON)
        .toArrow()
    )
    shingles, counts = (np.append(found.column(k).to_numpy(), 0) for k in ("shingle", "n"))
    order = np.argsort(shingles, kind="stable")
    return shingles[order], counts[order]


def _may_be_similar(x: str, y: str, similarity: float) -> Column:
    """Whether a shingle at these positions may be the first that two similar texts share.

    Texts of sizes n and m need c * (n + m) common shingles, c being similarity / (1 + similarity), so as many
    must be left from the first common one on, in both.
    """
    sizes = [F.col(f"{t}.n") for t in (x, y)]
    needed = similarity / (1 + similarity) * _SLACK * (sizes[0] + sizes[1])
    left = F.least(*[F.col(f"{t}.n") - F.col(f"{t}.pos") for t in (x, y)])
    return (left >= needed) & (F.least(*sizes) >= similarity * _SLACK * F.greatest(*sizes))


def _groups(buckets: DataFrame) -> DataFrame:
    """(shingle, lowest, rows, short) of groups that can hold a similar pair: the first row, the number of rows,
    and that of rows that may be the smaller text of a pair."""
    sized = buckets.groupBy("shingle").agg(F.min("row").alias("lowest"), F.count("*").alias("rows"), F.count_if("row.short").alias("short"))
    return sized.where("rows > 1 and short > 0")


def _first_of_linked(edges: DataFrame) -> DataFrame:
    """``b`` of all edges (a, b), a before b, whose ``a`` stays; a node stays if none before it that stays is linked."""
    gone = edges.select("b").limit(0)
    while not edges.isEmpty():
        stays = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")), "a", "left_anti")
        out = write_out(edges.join(stays, "a").select("b").distinct(), "similar-texts")
        gone = gone.unionByName(out)
        left = edges.join(out, "b", "left_anti").join(out.withColumnRenamed("b", "a"), "a", "left_anti")
        following = write_out(left.select("a", "b"), "similar-pairs")
        discard(edges)
        edges = following
    return gone


def _all_pairs(buckets: DataFrame, similarity: float) -> DataFrame:
    """(a, b), the earlier text first, of all pairs that may be similar; large groups are dealt out in blocks."""
    sized = buckets.join(_groups(buckets).select("shingle", F.ceil(F.col("short") / PAIR_BLOCK).alias("blocks")), "shingle")
    mine = F.pmod(F.xxhash64("row.key"), F.col("blocks"))
    short = sized.where("row.short").select("shingle", mine.alias("block"), F.col("row").alias("x"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    long = sized.select("shingle", every.alias("block"), F.col("row").alias("y"))
    # the smaller text is x; of equally many shingles the one with the lower key
    before = F.struct("x.n", "x.key") < F.struct("y.n", "y.key")
    pairs = short.join(long, ["shingle", "block"]).where(before & _may_be_similar("x", "y", similarity))
    first = F.col("x.place") < F.col("y.place")
    a, b = F.when(first, F.col("x.key")).otherwise(F.col("y.key")), F.when(first, F.col("y.key")).otherwise(F.col("x.key"))
    return pairs.select(a.alias("a"), b.alias("b")).distinct()


def keep_one_of_each(
    docs: DataFrame,
    shingle: int = STAGE_SHINGLE,
    similarity: float = SIMILARITY,
    doc_id: str = "doc_id",
    text: str = "text",
    bits: int | None = None,
) -> DataFrame:
    """``docs`` without near-duplicates: in order of doc_id, a row stays unless an earlier row that stays is similar.

    Texts are similar if their shingle sets have a Jaccard similarity of at least ``similarity``.  All such
    pairs are found: of similar texts of n and m shingles the first common one (rare ones first) leaves
    similarity / (1 + similarity) * (n + m) of both, itself included, so it is among the first ninth or so of the smaller
    and the first fifth of the larger (at 0.8).  Pairs that meet so, and share enough of these, are compared in full.  Where groups of a
    shingle are large, texts that come first in all of their groups are compared with the others of these before
    pairs are listed, as long as that pays.

    With ``bits``, near-duplicates by fingerprint go before: of the texts whose fingerprints are linked (``BITS`` as in
    :func:`near_duplicates`) only the first stays, and what is said above holds for those that stay.  Shingles
    then find what fingerprints miss, as similar texts may differ in more bits.

    Equal texts always go but for one.  NULL counts as an empty text, and texts without words are equal; NULL
    doc_ids come last.  Of rows equal in doc_id and text one stays.  Columns are those of ``docs``.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must lie above 0 and not above 1")
    spark = docs.sparkSession
    bounded_batches(spark)
    content = F.coalesce(F.col(text), F.lit(""))
    key = F.xxhash64(content)
    place = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), key.alias("key"))
    keyed_texts = docs.select(key.alias("key"), content.alias("text"))
    common = spark.sparkContext.broadcast(_common_shingles(keyed_texts, shingle))
    print_ = F.lit(None).cast("long") if bits is None else fingerprint(content)
    made = docs.select(key.alias("key"), place.alias("place"), print_.alias("print"), _prefixes(content, shingle, similarity, common).alias("made"))
    rows = write_out(made.select("key", "place", "print", "made.*"), "text-prefixes")
    texts = write_out(rows.groupBy("key").agg(F.min("place").alias("place"), F.first("print").alias("print")), "distinct-texts")
    if bits is not None:
        linked = grouped(texts.select(F.col("place").alias("doc_id"), "key", "print"), bits)
        texts = write_out(linked.where(F.col("doc_id") == F.col("component_id")).select("key", F.col("doc_id").alias("place")), "distinct-texts")
    one_row = rows.groupBy("place").count().where("count > 1").isEmpty()

    def one_of_each(frame: DataFrame, *names: str) -> DataFrame:
        return frame if one_row else frame.dropDuplicates(list(names))

    first = write_out(one_of_each(rows.join(texts.select("place"), "place", "left_semi"), "key"), "text-prefixes")
    discard(rows)
    short = F.col("pos") < F.col("n") - F.ceil(2 * similarity / (1 + similarity) * _SLACK * F.col("n")) + 1
    dealt = first.select("key", "place", "n", F.posexplode("prefix").alias("pos", "shingle"))
    dealt = dealt.select("shingle", F.struct("place", "key", "n", "pos", short.alias("short")).alias("row"))
    buckets = write_out(dealt.join(_groups(dealt).select("shingle"), "shingle", "left_semi"), "shared-shingles")
    whole = docs.select(key.alias("key"), place.alias("place"), content.alias("text"))

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar; arrays of b travel with the pair, those of a may meet many."""

        def beside(pairs: DataFrame, values: DataFrame, *names: str) -> DataFrame:
            for k, side in (("b", "right"), ("a", "left")):
                pairs = pairs.join(values.select(F.col("key").alias(k), F.struct(*names).alias(side)), k)
            return pairs

        # what both have among their first shingles, and the rest of one of them, is all that can be common
        met = beside(pairs, first, "n", "prefix")
        needed = similarity / (1 + similarity) * _SLACK * (F.col("left.n") + F.col("right.n"))
        rest = F.greatest(*[F.col(f"{t}.n") - F.size(f"{t}.prefix") for t in ("left", "right")])
        near = met.where(F.size(F.array_intersect("left.prefix", "right.prefix")) + rest >= needed)
        near = write_out(near.select("a", "b"), "near-pairs")
        wanted = near.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(texts, "key").select(F.col("place").alias("__place"))
        chosen = one_of_each(whole.join(wanted, F.col("place") == F.col("__place"), "left_semi"), "key")
        sets = write_out(chosen.select("key", "text").mapInArrow(_shingles(shingle), "key long, shingles array<long>"), "shingle-sets")
        both = beside(near, sets, "shingles")
        shared = F.size(F.array_intersect("left.shingles", "right.shingles"))
        either = F.size("left.shingles") + F.size("right.shingles") - shared
        found = write_out(both.where(shared >= similarity * either).select("a", "b"), "similar-pairs")
        discard(sets, near)
        return found

    gone = texts.select("key").limit(0)
    enough, before = None, None
    while True:
        groups = _groups(buckets)
        sizes = groups.agg(F.sum("rows"), F.sum(F.col("short") * (F.col("rows") - 1))).first()
        if sizes[0] is None:
            break
        enough = PAIRS_PER_ROW * sizes[0] if enough is None else enough
        if sizes[1] <= enough or (before is not None and 2 * sizes[1] > before):
            pairs = write_out(_all_pairs(buckets, similarity), "possible-pairs")
            gone = gone.unionByName(_first_of_linked(similar(pairs)).select(F.col("b").alias("key")))
            discard(pairs)
            break
        before = sizes[1]
        beside = buckets.select("shingle", F.col("row").alias("y")).join(groups.select("shingle", F.col("lowest").alias("x")), "shingle")
        all_first = F.min(F.col("x.key") == F.col("y.key"))
        stay = beside.groupBy(F.col("y.key").alias("key")).agg(all_first.alias("first")).where("first").select("key")
        stay = write_out(stay, "kept-texts")
        led = beside.join(stay, F.col("x.key") == F.col("key"), "left_semi")
        pairs = led.where(F.col("x.key") != F.col("y.key")).where(_may_be_similar("x", "y", similarity))
        pairs = write_out(pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct(), "possible-pairs")
        out = write_out(similar(pairs).select(F.col("b").alias("key")).distinct(), "similar-texts")
        gone = gone.unionByName(out)
        left = buckets.join(stay.unionByName(out), F.col("row.key") == F.col("key"), "left_anti")
        left = left.join(groups.select("shingle"), "shingle", "left_semi")
        following = write_out(left, "shared-shingles")
        discard(buckets, stay, pairs)
        buckets = following
    stay = texts.join(gone, "key", "left_anti").select("place.*")
    stay = stay.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    keyed = docs.withColumns({"__text_key": key, "__place": F.col(doc_id)})
    same = F.col("__place").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key"))
    return one_of_each(keyed.join(stay, same, "left_semi"), "__place", "__text_key").select(docs.columns)
