"""Token counts by a sentencepiece BPE model, mostly without running it.

Which vocabulary strings encode alone as one token is proved once, on the driver, by encoding each of
them.  Texts are split into pre-tokens (a run of spaces and what follows it up to the next space); the
model joins nothing across them, which its vocabulary shows.  Pre-tokens that are whole tokens count
as one, and only the rest is merged by the model, each distinct one once per worker as memory allows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from evidence_lake.llm.arrow import bounded_batches

_SPACE = "▁"
_UNIT = re.compile(r" +[^ ]*")
#: Pre-tokens that a worker remembers at most, and their longest length in characters.
REMEMBERED, LONGEST = 400_000, 40


@dataclass
class Vocabulary:
    """A model and what was proved about it."""

    model: bytes
    separable: bool  # nothing is joined across the start of a run of spaces
    whole: list[str] = field(default_factory=list)  # words that are one token after a space


def prove(model: bytes) -> Vocabulary:
    """Read the vocabulary; keep the strings that the model encodes as exactly one token."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    rules, kind = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    normal = [p.piece for p in proto.pieces if p.type == kind.NORMAL]
    separable = (
        rules.name == "identity"
        and not rules.precompiled_charsmap
        and rules.add_dummy_prefix
        and not rules.remove_extra_whitespaces
        and rules.escape_whitespaces
        and not proto.trainer_spec.treat_whitespace_as_suffix
        and proto.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
        and not any(p.type == kind.USER_DEFINED for p in proto.pieces)
        and not any(_SPACE in p.lstrip(_SPACE) for p in normal)
    )
    if not separable:
        return Vocabulary(model, False)
    words = [p[1:] for p in normal if p.startswith(_SPACE) and len(p) > 1 and p[1] != _SPACE]
    encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
    encoded = encoder.encode(words, num_threads=1)
    return Vocabulary(model, True, [w for w, ids in zip(words, encoded) if len(ids) == 1])


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        import sentencepiece

        self.vocabulary = vocabulary
        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.model)
        self.lone_space = len(self.encoder.encode("a ")) - len(self.encoder.encode("a"))
        self._forget()

    def _forget(self) -> None:
        self.known = dict.fromkeys(self.vocabulary.whole, 1)
        self.known[""] = self.lone_space
        self.room = REMEMBERED

    def _merge(self, words: list[str]) -> dict[str, int]:
        """Counts of words that are not known yet."""
        counts = dict(zip(words, map(len, self.encoder.encode(words, num_threads=1))))
        if len(counts) > self.room:
            self._forget()
        for word, n in counts.items():
            if self.room and len(word) <= LONGEST:
                self.known[word] = n
                self.room -= 1
        return counts

    def _total(self, words: list[str]) -> int:
        try:
            return sum(map(self.known.__getitem__, words))
        except KeyError:
            missing = list({w for w in words if w not in self.known})
        known, counts = self.known, self._merge(missing)
        return sum([counts[w] if w in counts else known[w] for w in words])

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.vocabulary.separable or _SPACE in text:
            return len(self.encoder.encode(text))
        if "  " not in text and text[0] != " ":
            return self._total(text.split(" "))
        units = [u[1:] for u in _UNIT.findall(" " + text)]  # the model itself puts a space in front
        spaced = [u for u in units if u[:1] == " "]
        return self._total([u for u in units if u[:1] != " "]) + sum(map(len, self.encoder.encode(spaced, num_threads=1)))


_counters: dict[int, Counter] = {}


def token_count(spark: SparkSession, model_path: str, text: Column) -> Column:
    """Number of tokens of a text, without begin and end tokens; 0 for NULL and empty texts.

    The model file is read on the driver and sent to the workers.
    """
    bounded_batches(spark)
    with open(model_path, "rb") as file:
        shared = spark.sparkContext.broadcast(prove(file.read()))

    def counts(texts: pa.Array) -> pa.Array:
        key = hash(shared.value.model)
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(shared.value)
        count = _counters[key].count
        return pa.array([count(x.as_py()) for x in texts], pa.int64())

    return F.arrow_udf(counts, "long")(text)
