"""Operators against plain versions, with empty tables, NULLs, ties, repeated rows and clashing columns."""

import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import plain
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from evidence_lake.llm import (
    decontamination,
    fingerprints,
    line_dedup,
    packing,
    quality,
    sharding,
    simhash,
    substring_dedup,
    token_counts,
    token_ids,
    url_filter,
)

ODD = [(None, None), (None, "a b c d e f"), (5, ""), (5, "x y z"), (7, "same text here"), (7, "same text here")]


# shards ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("range_rows", [100_000, 7])
def test_shards(documents, range_rows):
    rows, df = documents(150)
    got = sharding.assign_shards(df, 4, range_rows).collect()
    size = {i: len((t or "").encode()) + 1 for i, t in rows}
    total, at = sum(size.values()), 0
    for i, t in sorted(rows):
        (row,) = [r for r in got if r.doc_id == i]
        assert (row["size"], row.text_crc32) == (size[i], zlib.crc32((t or "").encode()))
        assert row.shard == min(3, int((at + size[i] / 2) * 4 / total))
        at += size[i]
    _gapless(got)


def _gapless(got):
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_rows(documents):
    rows, df = documents(rows=ODD * 30)
    got = sharding.assign_shards(df, 3, 5).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    _gapless(got)
    assert sharding.assign_shards(df.limit(0), 3).count() == 0


def test_more_equal_rows_than_one_step(spark):
    df = spark.range(25_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("t").alias("text"))
    _gapless(sharding.assign_shards(df, 2).collect())


# fingerprints ---------------------------------------------------------------------------------


def test_fingerprints(documents):
    rows, df = documents(80)
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(df).collect()}
    order = sorted(rows)
    alone = lambda t: fingerprints.weighted(*fingerprints.chunk_texts([t.encode()])[0])
    for (i, a), (_, b) in zip(order, order[1:] + order[:1]):
        a, b = a or "", b or ""
        n = len(a) // 4
        edited = a[: len(a) - n] + b[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(a), plain.sha(edited))
        assert r.fingerprint == fingerprints.written(alone(a))
        assert r.edited_fingerprint == fingerprints.written(alone(edited))
        assert r.near_edited == fingerprints.containment(alone(a), alone(edited))
        assert r.near_next == fingerprints.containment(alone(a), alone(b))
        assert r.near_next == 1.0 or a != b


def test_chunks_put_together_are_the_text():
    text = ("漢字 and ä words, " * 300).encode() + b"x" * 1000
    ((ends, digests),) = fingerprints.chunk_texts([text])
    assert ends[-1] == len(text) and len(ends) == len(digests)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert max(sizes) <= fingerprints.LARGEST and min(sizes[:-1]) >= fingerprints.SMALLEST - 3
    "".join(text[a:b].decode() for a, b in zip([0, *ends], ends))  # whole characters
    shifted = fingerprints.weighted(*fingerprints.chunk_texts([b"inserted " + text])[0])
    assert fingerprints.containment(fingerprints.weighted(ends, digests), shifted) > 0.5


def test_fingerprints_of_odd_rows(documents):
    _, df = documents(rows=ODD)
    assert fingerprints.fingerprint_documents(df).count() == len(ODD)
    assert fingerprints.fingerprint_documents(df.limit(0)).count() == 0
    _, single = documents(rows=[(1, "abcdefgh")])
    (row,) = fingerprints.fingerprint_documents(single).collect()
    assert row.edited_sha256 == plain.sha("abcdefab") and row.near_next == 1.0


# passages -------------------------------------------------------------------------------------


@pytest.mark.parametrize("size, anchor", [(20, 8), (5, 2), (3, 3), (4, 1)])
def test_passages(documents, size, anchor):
    rows, df = documents(150, seed=size)
    want = plain.passages(rows, size)
    for r in substring_dedup.dedup_passages(df, size, anchor).collect():
        words, gone = want[r.doc_id]
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        assert (r.n_words, r.n_removed, r.kept_text, r.kept_sha256) == (len(words), len(gone), kept, plain.sha(kept))
    assert any(gone for _, gone in want.values())


def test_a_crowded_sketch_loses_nothing(documents, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MIN_COUNTERS", 1 << 7)
    monkeypatch.setattr(substring_dedup, "MAX_COUNTERS", 1 << 8)
    test_passages(documents, 5, 2)


def _thue_morse(n, a, b):
    return "".join((a, b)[bin(k).count("1") & 1] for k in range(n))


@pytest.mark.parametrize("n", [4, 60, 64, 65, 1024, 4096])
def test_words_that_polynomial_hashes_mix_up(documents, n):
    """Words of these kinds have equal polynomial hashes modulo powers of two, whatever the base."""
    first, second = _thue_morse(n, "a", "b"), _thue_morse(n, "b", "a")
    before = " ".join(f"w{k}" for k in range(19))
    rows = [(1, f"{before} {first}"), (2, f"{before} {second}"), (3, f"{before} {first}")]
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_passages(documents(rows=rows)[1]).collect()}
    assert got == {1: 0, 2: 0, 3: 20}
    windows = [[f"{a}{k % 3}" if bit else f"{b}{k % 3}" for k, bit in enumerate(map("b".__eq__, _thue_morse(64, "a", "b")))] for a, b in ("xy", "yx")]
    rows = [(k, " ".join(w)) for k, w in enumerate(windows)]
    want = plain.passages(rows, 64)
    assert all(r.n_removed == len(want[r.doc_id][1]) for r in substring_dedup.dedup_passages(documents(rows=rows)[1], 64).collect())


def test_equal_anchor_hashes_bring_no_windows_together(documents, monkeypatch):
    """Exact grouping does not lean on the hashes of words and runs: with a few values only, results stay."""
    from evidence_lake.llm import wordwise

    few = wordwise.mix
    monkeypatch.setattr(wordwise, "word_hashes", lambda data, starts, ends: few((ends - starts).astype(np.uint64) % np.uint64(2)))
    rows, _ = documents(60, seed=2)
    texts = [t for _, t in rows]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([0] * len(rows), pa.int64()), pa.array(texts)], names=["id", "key", "text"])

    class Everything:  # a sketch with all bits set
        value = b"\xff" * (2 << 17)

    found = list(substring_dedup._candidates(6, 3, 17, Everything)(iter([batch])))
    import pyarrow.compute as pc

    table = pa.Table.from_batches(found)
    table = table.take(pc.sort_indices(table, [(n, "ascending") for n in ("anchor", "id", "key", "pos")]))
    runs = defaultdict(list)
    for part in substring_dedup._later(iter(table.to_batches(max_chunksize=50))):
        for r in part.to_pylist():
            runs[r["id"]].append(r)
    want = plain.passages(rows, 6)
    for i, (words, gone) in want.items():
        assert set(np.flatnonzero(substring_dedup.removed_words(len(words), runs[i], 6)) if runs[i] else []) == gone


def test_passages_of_odd_rows(documents):
    _, df = documents(rows=ODD)
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.dedup_passages(df, 3, 2).collect())
    # rows equal in id and text are one document, so neither is a copy of the other
    assert got == Counter([(None, 0, 0), (None, 6, 0), (5, 0, 0), (5, 3, 0), (7, 3, 0), (7, 3, 0)])
    assert substring_dedup.dedup_passages(df.limit(0), 3, 2).count() == 0


# packing --------------------------------------------------------------------------------------


def test_pieces_and_sequences(documents):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows, _ = documents(60)
    rows = rows + [(1000, "<|endoftext|> special"), (1001, "many   spaces  \n \n"), (1002, "a\u00a0b \u3000c"), (1003, "x\0y z")]
    _, df = documents(rows=rows)
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    got = packing.pack_documents(df, path, limit=64).collect()
    sequences, covered = defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        covered[r.doc_id].append((r.piece, r.start, r.length))
    for i, pieces in covered.items():
        pieces.sort()
        assert [p[0] for p in pieces] == list(range(len(pieces)))
        assert sum(p[2] for p in pieces) == len(ids[i]) and all(p[2] == 64 for p in pieces[1:])
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= packing.lower_bound(Counter(r.length for r in got), 64) + 1


@pytest.mark.parametrize("seed", range(30))
def test_plans_use_everything_up_and_are_near_the_bound(seed):
    import random

    rng = random.Random(seed)
    limit = rng.choice([10, 64, 2048])
    histogram = Counter(rng.randint(1, limit) for _ in range(rng.choice([1, 5, 50, 2000])))
    fillings = packing.plan(histogram, limit)
    used = Counter()
    for f in fillings:
        assert f.copies > 0 and sum(f.lengths) <= limit
        for n in f.lengths:
            used[n] += f.copies
    assert used == histogram
    bound = packing.lower_bound(histogram, limit)
    assert bound <= sum(f.copies for f in fillings) <= max(bound + 1, 1.02 * bound)


def test_completion_finds_what_best_fit_misses():
    assert sum(f.copies for f in packing.plan({6: 1, 5: 2, 3: 2, 2: 1}, 12)) == 2
    assert sum(f.copies for f in packing.plan({7: 2, 5: 1, 3: 4, 4: 2}, 13)) == 3
    assert [f.lengths for f in packing.plan({1: 3000}, 2048)] == [(1,) * 2048, (1,) * 952]
    assert packing.plan({}, 8) == []


@pytest.mark.parametrize(
    "limit, lengths, fewest",
    [
        (20, [12, 9, 8, 8, 7, 7, 7, 7, 6, 5, 2], 4),
        (100, [66, 64, 64, 63, 46, 43, 24, 23, 21, 19, 18, 14, 7], 5),
        (50, [20, 12, 14, 9, 10, 12, 15, 24, 14, 20, 8, 22, 23, 22, 20, 23, 14, 20, 10, 23], 7),
    ],
)
def test_plans_go_back(limit, lengths, fewest):
    found = packing.plan(Counter(lengths), limit)
    assert sum((Counter({n: k * f.copies for n, k in Counter(f.lengths).items()}) for f in found), Counter()) == Counter(lengths)
    assert sum(f.copies for f in found) == fewest


@pytest.mark.parametrize("seed", range(20))
def test_plans_are_never_worse_than_best_fit_decreasing(seed):
    import random

    rng = random.Random(seed)
    limit = rng.choice([20, 100, 2048])
    lengths = [rng.randint(1, limit * 2 // 3) for _ in range(rng.choice([10, 15, 300]))]
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= n]
        if fitting:
            rooms.remove(min(fitting))
        rooms.append((min(fitting) if fitting else limit) - n)
    counts = np.bincount(lengths, minlength=limit + 1)
    fillings = packing.best_fit_decreasing(counts, limit)
    assert sum(f.copies for f in fillings) == len(rooms)
    assert sorted(limit - sum(f.lengths) for f in fillings for _ in range(f.copies)) == sorted(rooms)
    assert sum(f.copies for f in packing.plan(Counter(lengths), limit)) <= len(rooms)


def test_packing_of_odd_rows(documents):
    _, df = documents(rows=ODD)
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack_documents(df, path).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD)
    assert len({r.sequence_id for r in got}) == 1 and len({r.offset for r in got}) == len(got)
    assert packing.pack_documents(df.limit(0), path).count() == 0


def test_cut():
    assert token_ids.cut(5, 5) == [(0, 5)]
    assert token_ids.cut(10, 5) == [(0, 5), (5, 5)]
    assert token_ids.cut(11, 5) == [(0, 1), (1, 5), (6, 5)]


# decontamination ------------------------------------------------------------------------------


@pytest.mark.parametrize("span, k", [(10, 5), (4, 2), (3, 3), (2, 1)])
def test_contamination(spark, documents, span, k):
    rows, df = documents(120, seed=span)
    items = [(100, None), (101, ""), (102, "the"), (103, rows[20][1]), (104, rows[30][1]), (105, rows[40][1][:60])]
    items += [(106, "THE of AND é naïve"), (103, rows[20][1]), (107, rows[50][1])]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words long")
    want = plain.contaminated(rows, items, span)
    for r in decontamination.find_contamination(df, benchmark, span, k).collect():
        words, hit, ids = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items) == (words, len(hit), len(ids))
        assert sorted(r.hit_words) == sorted(hit) and r.item_ids == sorted(map(str, ids))
    assert any(hit for _, hit, _ in want.values())


def test_contamination_of_odd_rows(spark, documents):
    _, df = documents(rows=ODD)
    items = spark.createDataFrame([(None, "x y z"), (1, "same text here")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_hit, r.n_items) for r in decontamination.find_contamination(df, items).collect())
    assert got == [(0, 0, 0), (0, 0, 0), (5, 0, 0), (5, 3, 0), (7, 3, 1), (7, 3, 1)]
    none = decontamination.find_contamination(df, items.limit(0)).collect()
    assert len(none) == len(ODD) and not any(r.n_hit for r in none)
    assert decontamination.find_contamination(df.limit(0), items).count() == 0


# near-duplicates ------------------------------------------------------------------------------


@pytest.mark.parametrize("shingle, bits", [(4, 4), (2, 8), (5, 1)])
def test_near_duplicates(documents, shingle, bits):
    rows, df = documents(150, seed=shingle)
    rows = sorted(rows)
    prints = [plain.simhash(t, shingle) for _, t in rows]
    roots = plain.linked(prints, bits)
    want = {i: (p, rows[r][0]) for (i, _), p, r in zip(rows, prints, roots)}
    got = {r.doc_id: (r.print % 2**64, r.component_id) for r in simhash.near_duplicates(df, shingle, bits).collect()}
    assert got == want


@pytest.mark.parametrize("bits", [1, 4, 8])
def test_crowded_buckets(spark, bits):
    import random

    rng = random.Random(bits)
    bases = [rng.getrandbits(64) for _ in range(3)]
    prints = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(7))) for b in bases for _ in range(150)]
    prints = sorted({p - 2**64 if p >= 2**63 else p for p in prints})
    roots = plain.linked(prints, bits)
    df = spark.createDataFrame([(p,) for p in prints], "print long")
    found = {r.node: r.root for r in simhash.components(simhash.links(df, bits, bucket=8)).collect()}
    assert [found.get(p, p) for p in prints] == [prints[r] for r in roots]


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_near_duplicates_of_odd_rows(documents):
    _, df = documents(rows=ODD)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.print == 0} == {5}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_one_of_each_group_stays(documents):
    base = " ".join(f"word{k}" for k in range(120))
    near = base.replace("word60 ", "other ")
    rows = [(9, base), (4, near), (6, base), (1, "quite another text"), (2, None), (3, ""), (8, "  "), (None, base), (1, "quite another text")]
    _, df = documents(rows=rows)
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    assert simhash.keep_one_of_each(df.limit(0)).count() == 0


def plain_survivors(rows):
    """doc_ids that stay of rows (doc_id, text) with distinct ids, by comparing each row with all that stay."""
    kept = []
    for i, text in sorted(rows):
        words = plain.WORD.findall(plain.lower(text or ""))
        own = {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))}
        if not any(len(own & other) >= 0.8 * len(own | other) for _, other in kept):
            kept.append((i, own))
    return [i for i, _ in kept]


@pytest.mark.parametrize("per_row", [0, simhash.PAIRS_PER_ROW])
def test_many_clusters_of_one_group(documents, monkeypatch, per_row):
    import random

    # all share a long passage, so that fingerprints are close; the second text of each of nine kinds is a copy
    monkeypatch.setattr(simhash, "PAIRS_PER_ROW", per_row)
    rng = random.Random(5)
    shared = [f"shared{k}" for k in range(250)]
    kinds = [shared + [f"own{c}x{k}" for k in range(45)] for c in range(9)]
    rows = [(c, " ".join(kinds[c])) for c in range(9)]
    rows += [(100 + c, " ".join(kinds[c][:-1] + ["other"])) for c in range(9)]
    rng.shuffle(rows)
    _, df = documents(rows=rows)
    got = sorted(r.doc_id for r in simhash.keep_one_of_each(df).collect())
    assert got == plain_survivors(rows) == list(range(9))


@pytest.mark.parametrize("per_row", [0, simhash.PAIRS_PER_ROW])
def test_every_similar_pair_is_found(documents, monkeypatch, per_row):
    import random

    monkeypatch.setattr(simhash, "PAIRS_PER_ROW", per_row)
    rng, rows = random.Random(11), []
    for c in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 300))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(2):  # at similarities on both sides of 0.8, chains included
            for _ in range(rng.randrange(1, 2 + len(words) // 40)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    _, df = documents(rows=rows)
    got = sorted(r.doc_id for r in simhash.keep_one_of_each(df).collect())
    assert got == plain_survivors(rows) and 60 < len(got) < 150


@pytest.mark.parametrize("per_row", [0, simhash.PAIRS_PER_ROW])
def test_pairs_compared_grow_as_the_texts(spark, monkeypatch, per_row):
    """Texts of two of twelve paragraphs and an ending of their own, none similar, and a copy of every tenth."""
    import random

    rng = random.Random(3)
    parts = [" ".join(f"t{p}x{k}" for k in range(60)) for p in range(12)]
    written, listed = simhash.write_out, []

    def counting(df, label):
        table = written(df, label)
        if label == "possible-pairs":
            listed[-1] += table.count()
        return table

    monkeypatch.setattr(simhash, "write_out", counting)
    monkeypatch.setattr(simhash, "PAIRS_PER_ROW", per_row)
    for n in (500, 1000, 2000):
        rows = [(i, " ".join([*rng.sample(parts, 2), *(f"own{i}x{k}" for k in range(20))])) for i in range(n)]
        rows += [(n + i, text + " more") for i, text in rows[::10]]
        listed.append(0)
        kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        assert kept.agg(F.count("*"), F.max("doc_id")).first() == (n, n - 1)
    assert all(p <= n / 5 for p, n in zip(listed, (500, 1000, 2000)))


def test_blocks_of_large_groups_lose_no_pair(documents, monkeypatch):
    monkeypatch.setattr(simhash, "PAIR_BLOCK", 3)
    monkeypatch.setattr(simhash, "PAIRS_PER_ROW", 10**6)
    base = [f"w{k}" for k in range(100)]
    rows = [(i, " ".join(base + [f"own{i}"] * (i % 4))) for i in range(40)]
    rows += [(100 + i, " ".join(base[: 50 + i])) for i in range(45)]
    _, df = documents(rows=rows)
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(df).collect()) == plain_survivors(rows)


# names ----------------------------------------------------------------------------------------

#: Names that operators give columns of their own on the way, and names of results in another letter case.
CLASHES = {
    "passages": (substring_dedup.dedup_passages, "row id key found_id found_key runs reduced N_Removed N_Words Kept_Text KEPT_SHA256 anchor pos gone"),
    "lines": (line_dedup.dedup_lines, "row id key lines removed found_id found_key text_key w h1 h2 first N_Lines N_Removed line"),
    "one_of_each": (simhash.keep_one_of_each, "row key place n pos shingle made rows lowest short x y __Place1 lefts rights"),
    "contamination": (
        lambda df: decontamination.find_contamination(df, df.select(F.lit("1").alias("item_id"), "text")),
        "key print item_no spans size w N_Hit N_Words Item_Ids found",
    ),
    "urls": (lambda df: url_filter.judge_urls(df, url_filter.DEFAULT_RULES, "text"), "Host PATH Rule Verdict token literals rule_no regex tier n"),
    "quality": (
        lambda df: quality.score_documents(df, df.select("doc_id", F.lit(1).alias("quality"))),
        "Score Held_Out PREDICTED features label x y _idd",
    ),
}


@pytest.mark.parametrize("name", CLASHES)
def test_clashing_names(spark, name):
    operator, names = CLASHES[name]
    extra = names.split()
    text = "one two three\nfour five six\nseven eight nine\nten"
    rows = [(i, text, *["own"] * len(extra)) for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in extra))
    out = operator(df)
    lower = [n.lower() for n in out.columns]
    assert len(set(lower)) == len(lower) and {"doc_id", "text"} <= set(lower)
    plain_names = operator(df.select("doc_id", "text")).columns
    for row in out.collect():
        assert all(row[n] == "own" for n in extra if n.lower() not in map(str.lower, plain_names))
        assert all(n in out.columns for n in plain_names)


# URLs -----------------------------------------------------------------------------------------


def test_urls(spark):
    Rule, site = url_filter.Rule, url_filter.site_rule
    rules = (
        site("allow", "com/"),
        site("block", "example.com/en/"),
        site("block", "a-b.net/x"),
        Rule("regex", r"\d{5}", "block"),  # no literal: every URL runs it
        Rule("host_glob", "*.shop.??", "block"),
        Rule("host_glob", "good.shop.de", "allow", 5),  # an exception
        Rule("path_glob", "/a*/b?c", "block"),
        Rule("query_key", "sid", "block"),
        Rule("punycode", "", "block"),
        Rule("regex", r"/old/archive/", "block", 2),
        *url_filter.DEFAULT_RULES,
    )
    cases = {
        "http://EXAMPLE.com/en/1": ("example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/EN/1": ("www.example.com", "/EN/1", "com/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://example.com": ("example.com", "", None, "allow"),
        "http://a-b.net/xyz?casino": ("a-b.net", "/xyz", "a-b.net/x", "block"),
        "http://c.org/casino-bonus#x": ("c.org", "/casino-bonus", "casino", "block"),
        "http://c.org/casinos": ("c.org", "/casinos", None, "allow"),
        "http://c.org/x?casino=1": ("c.org", "/x", None, "allow"),
        "http://c.org/12345": ("c.org", "/12345", r"\d{5}", "block"),
        "http://my.shop.de/": ("my.shop.de", "/", "*.shop.??", "block"),
        "http://shop.de/": ("shop.de", "/", None, "allow"),
        "http://my.shop.info/": ("my.shop.info", "/", None, "allow"),
        "http://GOOD.shop.de/casino": ("good.shop.de", "/casino", "good.shop.de", "allow"),
        "http://c.org/axx/y/bzc?q": ("c.org", "/axx/y/bzc", "/a*/b?c", "block"),
        "http://c.org/axx/bzzc": ("c.org", "/axx/bzzc", None, "allow"),
        "http://c.org/?a=1&sid=2": ("c.org", "/", "sid", "block"),
        "http://c.org/?sid": ("c.org", "/", "sid", "block"),
        "http://c.org/?a=sid&sids=1#sid=1": ("c.org", "/", None, "allow"),
        "http://c.org?utm_source=x": ("c.org", "", "utm_source", "block"),
        "http://10.0.0.255:8080/x": ("10.0.0.255:8080", "/x", "ip", "block"),
        "http://[::1]/x": ("[::1]", "/x", "ip", "block"),
        "http://1.2.3.4.org/": ("1.2.3.4.org", "/", None, "allow"),
        "http://a.xn--80ak6aa92e.org/": ("a.xn--80ak6aa92e.org", "/", "punycode", "block"),
        "http://a.com/old/archive/x": ("a.com", "/old/archive/x", "/old/archive/", "block"),
        "http://ads.c.org/": ("ads.c.org", "/", "ads.*", "block"),
        "http://c.org/x/login": ("c.org", "/x/login", "*/login", "block"),
        "http://c.org/x/logins": ("c.org", "/x/logins", None, "allow"),
        "http://c.org/l?page=250": ("c.org", "/l", "[?&]page=[0-9]{3,}", "block"),
        "no scheme/com/": ("", "", None, "allow"),
        "no scheme 12345": ("", "", r"\d{5}", "block"),
        "a://b://c.com/x": ("b:", "//c.com/x", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    rows = [(k, url, "x", "y", "z") for k, url in enumerate(cases)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, Rule string, row string, text string")
    for given in (rules, url_filter.rule_table(spark, rules)):
        got = url_filter.judge_urls(pages, given)
        assert got.columns == ["page_id", "url", "row", "text", "host", "path", "rule", "verdict"]
        got = got.collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == cases[r.url], r.url
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, ()).collect()} == {"allow"}
    table = spark.createDataFrame([("word", "a", None, 1), (None, "a", "block", 1), ("word", None, "block", 1), ("word", "org", "block", None)] * 2, url_filter._SCHEMA)
    assert {r.rule for r in url_filter.judge_urls(pages, table).collect()} == {None, "org"}
    with pytest.raises(ValueError):
        url_filter.judge_urls(pages, [Rule("colour", "red", "block")])


def test_literals_are_in_every_url_that_a_rule_matches(spark):
    """URLs made from patterns: judged by the index as by trying every rule."""
    import itertools
    import random

    rng = random.Random(6)
    word = lambda: rng.choice(["a", "ab", "b", "c1", "news", "x"])
    rules = []
    for _ in range(150):
        kind = rng.choice(url_filter.KINDS[:5] + ("regex",))
        parts = [word() + rng.choice(["", "*", "?", "-", "."]) for _ in range(rng.randrange(1, 4))]
        pattern = {
            "site": f"{word()}.{word()}/{rng.choice(['', word(), word() + '/'])}", "host_glob": ".".join(parts), "path_glob": "/" + "/".join(parts),
            "query_key": word() + rng.choice(["", "_" + word()]), "word": word(),
            "regex": rng.choice(["/", r"\.", "", "="]) + word() + rng.choice(["/", "/?", r"\.", "$", "[ab]", "|" + word()]) + word(),
        }[kind]
        rules.append(url_filter.Rule(kind, pattern, rng.choice(["block", "allow"]), rng.randrange(3)))
    urls = []
    for k in range(400):
        host, path = ".".join(word() + word() * rng.randrange(2) for _ in range(3)), "/".join(word() + rng.choice(["", word()]) for _ in range(rng.randrange(4)))
        urls.append((k, f"http://{host}/{path}{rng.choice(['', '?' + word() + '=1', '?x&' + word() + '_' + word()])}"))
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    compiled = url_filter._compiled(url_filter.rule_table(spark, rules))
    host, path, query = url_filter.url_parts(F.col("url"))
    every = pages.withColumn("text", F.concat(host, path, query)).crossJoin(compiled)
    fits = F.when(F.col("whole"), F.rlike("url", F.col("regex"))).otherwise(F.rlike("text", F.col("regex")))
    want = every.where(fits).groupBy("page_id").agg(
        F.max_by(F.struct("rule", "rule_verdict"), F.struct("priority", F.length("rule"), "rule", "rule_verdict")).alias("best")
    )
    want = {r.page_id: tuple(r.best) for r in want.collect()}
    assert got == {k: want.get(k, (None, "allow")) for k, _ in urls} and len(want) > 200


def test_a_hundred_thousand_rules(spark):
    """As a table, in a plan of the usual size."""
    rules = spark.range(100_000).select(
        F.lit("site").alias("kind"), F.concat(F.lit("host"), "id", F.lit(".org/p")).alias("pattern"), F.lit("block").alias("verdict"), F.lit(1).alias("priority")
    )
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.host"), F.col("id") * 50, F.lit(".org/page")).alias("url"))
    judged = url_filter.judge_urls(pages, rules)
    assert len(judged._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    blocked = judged.where("verdict = 'block'")
    assert blocked.count() == 2000 and blocked.where("rule <> concat(substring(host, 5), '/p')").count() == 0


# quality --------------------------------------------------------------------------------------


def _labelled(spark, n=400):
    rows, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        words = [f"w{(k * 7 + j) % 31}" for j in range(20 + k % 30)]
        rows.append((k, " ".join(w.upper() + "!!" if bad else w for w in words)))
        labels.append((k, 0 if bad else 1, 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = _labelled(spark)
    got = quality.score_documents(docs.withColumn("score", F.lit("x")), labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)


def test_held_out_labels_are_not_learned(spark):
    docs, labels = _labelled(spark)
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda l: [r.score for r in quality.score_documents(docs, l).orderBy("doc_id").collect()]
    assert scores(labels) == pytest.approx(scores(turned))


def test_quality_without_labels_and_of_odd_rows(spark, documents):
    docs, labels = _labelled(spark)
    _, odd = documents(rows=ODD)
    some = labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0), (3, 1, 0)], labels.schema))
    model = quality.learn(docs, some)
    got = odd.select(quality.score(model, F.col("text")).alias("s")).collect()
    assert len(got) == len(ODD) and all(0 <= r.s <= 1 for r in got)
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(docs.limit(0), labels).count() == 0


# tokens ---------------------------------------------------------------------------------------


def test_token_counts(spark, documents):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows, _ = documents(80)
    extra = ["▁ inside ▁▁x", " leading", "trailing ", "   ", "a   b    c ", "\n\n  \n", "<s> </s> <unk>", "x\0y", "é漢字" * 400, "the\nof and\tit"]
    rows = rows + [(5000 + k, t) for k, t in enumerate(extra)]
    _, df = documents(rows=rows)
    got = df.select("doc_id", token_counts.token_count(spark, path, F.col("text")).alias("n")).collect()
    want = dict(rows)
    assert [(r.doc_id, r.n) for r in got] == [(r.doc_id, len(model.encode(want[r.doc_id] or ""))) for r in got]


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        counter = token_counts.Counter(token_counts.prove(file.read()))
    for text in ["qwert zuiop asdfg", "qwert hjklö yxcvb zuiop", "bnmqw qwert bnmqw the of"] * 3:
        assert counter.count(text) == len(counter.encoder.encode(text))


# lines ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [3, 2])
def test_lines(documents, size):
    rows, df = documents(150, seed=9)
    want = plain.lines(rows, size)
    got = line_dedup.dedup_lines(df, size)
    assert set(got.columns) == set(df.columns) | {"n_lines"}
    for r in got.collect():
        own, gone = want[r.doc_id]
        assert (r.n_lines, r.n_removed) == (len(own), len(gone))
        assert (r.text or "") == "\n".join(x for k, x in enumerate(own) if k not in gone)
    assert any(gone for _, gone in want.values())


def test_lines_of_odd_rows(documents):
    same = "a\nb\nc"
    _, df = documents(rows=[(None, same), (3, same), (3, "x\n" + same), (8, same), (8, same), (9, None), (9, "")])
    got = Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(df).collect())
    want = [(None, 3, 0, same), (3, 3, 3, ""), (3, 4, 3, "x"), (8, 3, 3, ""), (8, 3, 3, ""), (9, 0, 0, None), (9, 1, 0, "")]
    assert got == Counter(want)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_stage_drops_texts_of_linked_fingerprints(spark):
    """Texts of one phrase over and over, with endings of their own: fingerprints are near, sets of shingles are not."""
    import corpus_pipeline

    phrase = "one two three four five six seven eight nine " * 60
    rows = [(i, phrase + " ".join(f"w{i}x{k}" for k in range(20)), "en") for i in (3, 1, 2)]
    rows += [(7, "quite another text of its own", "en"), (9, "quite another text of its own", "en"), (8, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(df).collect()) == [1, 2, 3, 7, 8]
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7, 8] and kept.columns == df.columns
