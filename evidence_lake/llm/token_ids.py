"""Ids of a byte-level BPE tokenizer file, cut into pieces for sequences of bounded length.

The tokenizer's word pattern starts a new word at every single space between other characters, so the
parts of a text between spaces can be encoded apart; each distinct part is encoded once per worker, as
memory allows.  Texts with runs of spaces or with special strings are encoded whole.
"""

from __future__ import annotations

import json
import zlib

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from evidence_lake.llm.arrow import bounded_batches

REMEMBERED, LONGEST = 300_000, 40
#: The word pattern that a byte-level pre-tokenizer with ``use_regex`` stands for (fixed value).
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes with ids, if the ids rise in the order of the merges; else None."""
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    ids = [vocab["".join(p)] for p in pairs]
    pre = spec.get("pre_tokenizer") or {}
    plain = (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and spec["model"].get("type") == "BPE"
        and not spec["model"].get("ignore_merges")
        and not spec["model"].get("dropout")
        and all(a < b for a, b in zip(ids, ids[1:]))
    )
    if not plain:
        return None
    letters = _byte_of_letter()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(letters[c] for c in token): n for token, n in vocab.items() if token not in special}


class Encoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        self.whole_text = Tokenizer.from_str(spec)
        self.special = [t["content"] for t in parsed.get("added_tokens", [])]
        ranks = _ranks(parsed)
        self.parts = None
        if ranks:
            import tiktoken

            self.parts = tiktoken.Encoding("ranks", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, bytes] = {}

    def _packed(self, ids: list[int]) -> bytes:
        return b"".join([n.to_bytes(4, "little") for n in ids])

    def _part(self, part: str) -> bytes:
        packed = self._packed(self.parts.encode_ordinary(part))
        if len(part) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self._forget()
            self.known[part] = packed
        return packed

    def encode(self, text: str) -> bytes:
        if self.parts is None or "  " in text or any(s in text for s in self.special):
            return self._packed(self.whole_text.encode(text, add_special_tokens=False).ids)
        if not text:
            return b""
        parts = text.replace(" ", "\0 ").split("\0") if "\0" not in text else None
        if parts is None:
            first, *rest = text.split(" ")
            parts = [first, *[" " + x for x in rest]]
        known = self.known
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            return b"".join([known[p] if p in known else self._part(p) for p in parts])


_encoders: dict[int, Encoder] = {}


def cut(size: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``size`` ids; only the first may be shorter than ``limit``."""
    if size <= limit:
        return [(0, size)]
    first = size % limit or limit
    return [(0, first)] + [(at, limit) for at in range(first, size, limit)]


def token_pieces(spark: SparkSession, tokenizer_path: str, text: Column, limit: int, end_id: int) -> Column:
    """Array of (piece, start, length, ids_crc32) over a text's ids and a final ``end_id``; NULL counts as empty.

    The tokenizer file is read on the driver and sent to the workers.
    """
    bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    end = end_id.to_bytes(4, "little")
    kind = pa.list_(
        pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    )

    def pieces(texts: pa.Array) -> pa.Array:
        key = hash(shared.value)
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(shared.value)
        encode = _encoders[key].encode
        out = []
        for x in texts:
            ids = encode(x.as_py() or "") + end
            view = memoryview(ids)
            out.append(
                [
                    {"piece": k, "start": a, "length": n, "ids_crc32": zlib.crc32(view[4 * a : 4 * (a + n)])}
                    for k, (a, n) in enumerate(cut(len(ids) // 4, limit))
                ]
            )
        return pa.array(out, kind)

    return F.arrow_udf(pieces, "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>")(text)
