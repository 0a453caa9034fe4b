"""Passages looked up in every chunk of a corpus, by an inverted index of words.

A passage is grounded in a chunk that contains it verbatim, up to white space, or enough of its words,
repeats included.  A chunk with enough of them has one of the passage's rarest: as many as it may lack,
and one more.  Only these words are looked up; chunks whose share among them, and all of the rest, might do
are compared in full.

A passage that a chunk contains verbatim has all its words there but for the first and the last, which may
be cut; only where that is not enough, in passages of a few words, the characters decide: such a passage is
looked up by the rarest of its runs of three characters.

Postings of a frequent word are dealt out in blocks, and equal texts, of chunks or passages, are compared
once.  Texts go by numbers: postings and pairs, of which there are many, hold no digests.  Words go by hashes until texts
are compared: two words with one hash can only bring more pairs together, and of these only those whose hashes leave it
open are compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_lake import fixed_values as V
from evidence_lake.functions import text as T
from evidence_lake.operators.evidence import is_grounded
from evidence_lake.session import discard, write_out

#: Chunks of one word, or run of characters, that one task looks up.
BLOCK = 100_000
#: Passages up to this size are sent to all tasks.
PASSAGE_BYTES = 16 * 1024 * 1024
#: A verbatim passage of fewer words may have too small a share of its words in a chunk.
FEW_WORDS = int(2 / (1 - V.MIN_TOKEN_OVERLAP)) + 1
_GRAM = 3
_SLACK = 1 - 1e-9


def _looked_up(wanted: DataFrame, postings: DataFrame, counts: DataFrame, block: int) -> DataFrame:
    """``wanted`` (term, ...) with the ``chunk`` of each posting (term, chunk); ``counts`` has n per term."""
    sized = counts.join(wanted.select("term").distinct(), "term", "left_semi").select("term", F.ceil(F.col("n") / block).alias("blocks"))
    asked = wanted.join(sized, "term").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = postings.join(sized, "term").withColumn("block", F.pmod(F.xxhash64("chunk"), F.col("blocks")))
    return asked.drop("blocks").join(dealt.drop("blocks"), ["term", "block"]).drop("block")


def _by_words(said: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """(passage, chunk) of which the rarest words of the passage allow that enough are in the chunk."""
    words = said.select("passage", F.size("words").alias("size"), F.explode("words").alias("term"))
    times = words.groupBy("passage", "size", "term").agg(F.count("*").alias("times"))
    postings = sources.select("chunk", F.explode("words").alias("term"))
    counts = write_out(postings.groupBy("term").agg(F.count("*").alias("n")).join(times, "term", "left_semi"), "word-counts")
    rare_first = Window.partitionBy("passage").orderBy(F.coalesce("n", F.lit(0)), "term")
    before = F.sum("times").over(rare_first.rowsBetween(Window.unboundedPreceding, -1))
    needed = F.ceil(F.col("size") * V.MIN_TOKEN_OVERLAP * _SLACK)
    first = (
        times.join(counts, "term", "left")
        .withColumns({"before": F.coalesce(before, F.lit(0)), "needed": needed})
        .where(F.col("before") <= F.col("size") - F.col("needed"))
    )
    # of the words looked up so many must be there, if all others are
    least = F.col("needed") - (F.col("size") - F.sum("times").over(Window.partitionBy("passage")))
    met = _looked_up(first.select("passage", "term", "times", least.alias("least")), postings, counts, block)
    totals = met.groupBy("passage", "chunk").agg(F.sum("times").alias("found"), F.first("least").alias("least"))
    return totals.where("found >= least").select("passage", "chunk")


def _grams(text: Column, size: int) -> Column:
    def of(characters: Column) -> Column:
        last = F.size(characters) - size
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.concat(*[F.get(characters, i + k) for k in range(size)])))

    return F.get(F.transform(F.array(F.split(text, "")), of), F.lit(0))


def _by_characters(said: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """(passage, chunk) for passages of few words and chunks with the passage's rarest run of characters."""
    few = said.where(F.size("words") < FEW_WORDS).withColumn("size", F.least(F.length("quoted"), F.lit(_GRAM)))
    types = dict(said.dtypes)["passage"], dict(sources.dtypes)["chunk"]
    pairs = said.sparkSession.createDataFrame([], "passage {}, chunk {}".format(*types))
    for size in sorted(r["size"] for r in few.select("size").distinct().collect()):  # 1 to _GRAM
        grams = few.where(F.col("size") == size).select("passage", F.explode(_grams(F.col("quoted"), size)).alias("term"))
        grams = write_out(grams, "passage-characters")
        postings = sources.select("chunk", F.explode(_grams(F.col("source"), size)).alias("term"))
        counts = postings.groupBy("term").agg(F.count("*").alias("n")).join(grams, "term", "left_semi")
        counts = write_out(counts, "character-counts")
        known = grams.join(counts, "term", "left").select("passage", "term", F.coalesce("n", F.lit(0)).alias("n"))
        rarest = known.groupBy("passage").agg(F.min_by("term", F.struct("n", "term")).alias("term"))
        pairs = pairs.unionByName(_looked_up(rarest, postings, counts, block).select("passage", "chunk"))
    return pairs


def ground_everywhere(passages: DataFrame, chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(passage_id, chunk_id) of all chunks in which each passage is grounded, as ``is_grounded`` has it.

    ``passages`` has passage_id and text, ``chunks`` chunk_id and text.  Blank and NULL texts ground nothing and
    are grounded nowhere; repeated rows each count.
    """
    key = lambda column: F.sha2(column, 256)
    hashed = lambda column: F.transform(T.words(column), lambda w: F.xxhash64(w))
    named = passages.select("passage_id", T.collapse_whitespace(F.col("text")).alias("quoted")).where("quoted <> ''")
    placed = chunks.select("chunk_id", T.collapse_whitespace(F.col("text")).alias("source")).where("source <> ''")
    placed = write_out(placed.withColumn("source_key", key("source")), "placed-chunks")
    number = F.monotonically_increasing_id()
    said = named.select(key("quoted").alias("said_key"), "quoted").dropDuplicates(["said_key"])
    said = write_out(said.withColumns({"words": hashed(F.col("quoted")), "passage": number}), "passage-words")
    sources = placed.select("source_key", "source").dropDuplicates(["source_key"])
    sources = write_out(sources.withColumns({"words": F.array_distinct(hashed(F.col("source"))), "chunk": number}), "chunk-words")
    possible = _by_words(said, sources, block).unionByName(_by_characters(said, sources, block)).distinct()
    distinct = said.select("passage", "said_key", "quoted", F.array_distinct("words").alias("hashes"), F.size("words").alias("size"))
    # few passages go to all tasks, so that pairs are sent as two numbers; many would be more than the texts of chunks
    if (said.agg(F.sum(F.length("quoted") + 16 * F.size("words"))).first()[0] or 0) <= PASSAGE_BYTES:
        compared = possible.join(sources, "chunk").join(F.broadcast(distinct), "passage")
    else:
        compared = possible.join(distinct, "passage").join(sources, "chunk")
    # repeated words count as known here
    most = F.size(F.array_intersect("hashes", "words")) + F.col("size") - F.size("hashes")
    likely = (most >= F.col("size") * V.MIN_TOKEN_OVERLAP * _SLACK) | F.contains("source", "quoted")
    compared = compared.where(likely).select("said_key", "source_key", "quoted", "source")
    grounded = is_grounded(F.col("quoted"), F.col("source"), collapsed=True)
    found = write_out(compared.where(grounded).select("said_key", "source_key"), "grounded-pairs")
    discard(said, sources)
    ids = named.select("passage_id", key("quoted").alias("said_key"))
    at = placed.select("chunk_id", "source_key")
    return found.join(ids, "said_key").join(at, "source_key").select("passage_id", "chunk_id")
