"""The named queries of the training-data operators: reference SQL, or checks against plain versions."""

import os
import struct
import zlib

import plain
import public_tokenizers
import pytest
from oracle import compare, connect

import corpus_pipeline
from evidence_lake.llm import packing, quality
from evidence_lake.llm.queries import QUERIES, SQL

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not supplied")


@pytest.mark.parametrize("name", SQL)
def test_query(spark, name):
    problem = compare(spark, connect(FOLDER), FOLDER, QUERIES[name], SQL[name])
    assert problem is None, problem


def test_near_dedup_query(spark):
    rows = sorted(connect(FOLDER).execute("SELECT doc_id, text FROM documents").fetchall())
    prints = [plain.simhash(t, 4) for _, t in rows]
    roots = plain.linked(prints, 4)
    got = sorted(tuple(r) for r in QUERIES["op6_simhash_near_dedup"](spark, FOLDER).collect())
    assert got == [(i, f"{p:016x}", rows[r][0]) for (i, _), p, r in zip(rows, prints, roots)]


def rows_of(table, columns):
    return sorted(connect(FOLDER).execute(f"SELECT {columns} FROM {table}").fetchall())


def test_shards_query(spark):
    rows = rows_of("documents", "doc_id, text")
    got = {r.doc_id: r for r in QUERIES["op1_sampled_splitter_shards"](spark, FOLDER).collect()}
    size = {i: len((t or "").encode()) + 1 for i, t in rows}
    total, at, slots = sum(size.values()), 0, {}
    assert got.keys() == size.keys()
    for i, t in rows:
        r = got[i]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (size[i], zlib.crc32((t or "").encode()), "bytes", None)
        assert r.shard == min(7, int((at + size[i] / 2) * 8 / total))
        slots.setdefault(r.shard, []).append(r.slot)
        at += size[i]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and slots.keys() == set(range(8))


def test_fingerprints_query(spark):
    rows = rows_of("documents", "doc_id, text")
    got = {r.doc_id: r for r in QUERIES["op2_document_fingerprints"](spark, FOLDER).collect()}
    written = lambda f: ",".join(f"{d:016x}:{n:x}" for d, n in sorted(f.items()))
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
        n, r = len(a) // 4, got.pop(i)
        edited = a[: len(a) - n] + b[:n]
        own, other, following = plain.fingerprint(a), plain.fingerprint(edited), plain.fingerprint(b)
        assert (r.n_chars, r.edited_sha256) == (len(a), plain.sha(edited))
        assert (r.fingerprint, r.edited_fingerprint) == (written(own), written(other))
        assert r.near_edited == pytest.approx(plain.share_within(own, other)) and r.near_next == pytest.approx(plain.share_within(own, following))
    assert not got


def test_packing_query(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows_of("documents", "doc_id, text")}
    pieces, sequences = {}, {}
    for r in QUERIES["op4_best_fit_packing"](spark, FOLDER).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for i, own in pieces.items():
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            part = ids[i][at : at + r.length]
            assert (r.piece, r.start, len(part)) == (k, at, r.length)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            assert r.length == 2048 or len(ids[i]) <= 2048 or k == 0
            at += r.length
        assert at == len(ids[i]) and (len(ids[i]) > 2048 or len(own) == 1)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    lengths = sorted((r.length for own in pieces.values() for r in own), reverse=True)
    bins = []
    for n in lengths:  # best-fit decreasing
        fit = min((b for b in range(len(bins)) if bins[b] >= n), key=lambda b: bins[b], default=None)
        if fit is None:
            bins.append(2048 - n)
        else:
            bins[fit] -= n
    assert -(-sum(lengths) // 2048) <= len(sequences) <= len(bins)


def test_quality_query(spark):
    rows, labels = rows_of("documents", "doc_id, text"), dict(rows_of("labels", "doc_id, quality"))
    want = plain.quality_scores(rows, labels)
    got = QUERIES["op8_quality_classifier"](spark, FOLDER).collect()
    assert {r.doc_id for r in got} == want.keys()
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="tables not supplied")
def test_quality_of_held_out_documents(spark):
    labels = dict(connect(LARGER).execute("SELECT doc_id, quality FROM labels").fetchall())
    got = QUERIES["op8_quality_classifier"](spark, LARGER).collect()
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(p == y for p, y in held) >= 0.95 * len(held)


def test_token_counts_query(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in QUERIES["op9_token_counts"](spark, FOLDER).collect()}
    rows = rows_of("documents", "doc_id, text")
    assert got.keys() == {i for i, _ in rows}
    for i, t in rows:
        n = len(model.encode(t or "", num_threads=1))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096)


def test_pipeline(spark):
    """Stage by stage against plain versions of what each decides."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}

    def step(k, frame):
        name, stage = corpus_pipeline.STAGES[k]
        return stage(spark, frame, FOLDER)

    scores = {r.doc_id: r.score for r in quality.score_documents(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()}
    good = step(0, docs)
    kept = {r.doc_id: r.text for r in good.collect()}
    assert good.columns == columns and set(kept) == {i for i in before if scores[i] >= 0.3} and len(kept) < len(before)

    reduced = step(1, good)
    want = plain.lines(list(kept.items()), 3)
    texts = {r.doc_id: (r.text, r.n_chars) for r in reduced.collect()}
    assert reduced.columns == columns
    for i, (own, gone) in want.items():
        text = "\n".join(x for k, x in enumerate(own) if k not in gone)
        assert texts[i] == (text, len(text))

    single = step(2, reduced)
    left = {r.doc_id: r.text for r in single.collect()}
    assert single.columns == columns and set(left) < set(texts)

    def shingles(text):
        words = plain.WORD.findall(plain.lower(text))
        return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))}

    for i in set(texts) - set(left):  # a kept, earlier document is as similar
        a = shingles(texts[i][0])
        assert any(j < i and len(a & b) >= 0.8 * len(a | b) for j, b in ((j, shingles(t)) for j, t in left.items()))
    assert len(set(left.values())) == len(left)

    clean = step(3, single)
    items = connect(FOLDER).execute("SELECT item_id, text FROM benchmark").fetchall()
    hits = plain.contaminated(list(left.items()), items, 10)
    final = {r.doc_id for r in clean.collect()}
    assert clean.columns == columns and final == {i for i in left if not hits[i][1]} and final < set(left)

    packed = step(4, clean).collect()
    assert {r.doc_id for r in packed} == final
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)
    assert len({r.sequence_id for r in whole}) <= packing.lower_bound({n: sum(r.length == n for r in whole) for n in {r.length for r in whole}}) + 1
