"""Passages of benchmark items in documents, found by winnowing.

Both sides hash every k-gram of words and keep the smallest hash of each sliding window of
``span - k + 1`` k-grams.  Two texts that share ``span`` consecutive words share such a window of
k-grams, hence its smallest hash, so joining the kept hashes finds every pair of document and item
with a shared span.  The pairs' hits are then extended to full spans: a document word is hit if it
lies in a span of the document that is equal to a span of the item.

All DataFrame functions.  Documents meet items by text, so copies are matched once; kept hashes are
joined, never documents with all items; whether the item side is broadcast is left to its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_lake.llm.columns import ascii_lower, let, text_key, upto
from evidence_lake.session import write_out

SPAN = 10
KGRAM = 5
#: Everything ASCII that is neither digit nor lower-case letter separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text; NULL has none."""
    words = F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")
    return F.coalesce(words, F.array().cast("array<string>"))


def _grams(words: Column, k: int) -> Column:
    """A hash for each run of k words, which must be a lambda variable or a column."""
    return F.transform(upto(F.size(words) - (k - 1)), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))


def _winnowed(words: Column, span: int, k: int) -> Column:
    """The distinct smallest hashes of the sliding windows of a word array."""
    width = span - k + 1

    def smallest(h: Column) -> Column:
        if width == 1:
            return h
        window = lambda i: F.least(*[F.get(h, i + j) for j in range(width)])
        return F.transform(upto(F.size(h) - (width - 1)), window)

    return F.array_distinct(let(_grams(words, k), smallest))


def _fingerprints(words: Column, span: int, k: int, short: list[int]) -> Column:
    """Winnowed hashes for full spans, and all hashes of the lengths that short items have."""
    return F.concat(_winnowed(words, span, k), *[F.array_distinct(_grams(words, n)) for n in short])


def prepared_items(benchmark: DataFrame, span: int, k: int, item_id: str, text: str) -> DataFrame:
    """(item_no, item_id, size, spans, prints): each distinct item's hashed spans and kept hashes."""
    words = benchmark.select(F.col(item_id).cast("string").alias("item_id"), words_of(F.col(text)).alias("w"))
    words = words.where(F.size("w") > 0).distinct()
    whole = F.col("size") < span
    lengths = {n: F.array_distinct(_grams(F.col("w"), n)) for n in range(1, span + 1)}
    by_length = F.coalesce(*[F.when(F.col("size") == n, of) for n, of in lengths.items()])
    return words.withColumn("size", F.least(F.size("w"), F.lit(span))).select(
        F.xxhash64("item_id", "w").alias("item_no"),
        "item_id",
        "size",
        by_length.alias("spans"),
        F.when(whole, by_length).otherwise(_winnowed(F.col("w"), span, k)).alias("prints"),
    )


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    span: int = SPAN,
    k: int = KGRAM,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, item_ids (sorted as strings) and hit_words (their numbers, from 0).

    Items of fewer than ``span`` words, but not none, are one span.  NULL and empty texts and items have
    no words.  Repeated rows each get the result of their text; repeated items count once, and an item
    whose id is NULL hits words but is not counted or listed.  Columns of ``docs`` with the new names are
    replaced.  No items: nothing is hit.
    """
    if not 1 <= k <= span:
        raise ValueError("k must lie between 1 and span")
    items = write_out(prepared_items(benchmark, span, k, item_id, item_text), "benchmark-items")
    short = sorted(r["size"] for r in items.where(F.col("size") < span).select("size").distinct().collect())

    prints = let(words_of(F.col(text)), lambda w: _fingerprints(w, span, k, short))
    kept = docs.select(text_key(F.col(text)).alias("key"), F.explode_outer(prints).alias("print"))
    item_prints = items.select("item_no", F.explode("prints").alias("print"))
    pairs = kept.where("print is not null").join(item_prints, "print").select("key", "item_no").distinct()
    candidates = (
        pairs.join(items.select("item_no", "item_id", "size", "spans"), "item_no")
        .groupBy("key")
        .agg(F.collect_list(F.struct("item_id", "size", "spans")).alias("__items"))
    )

    def extended(w: Column, items_of: Column) -> Column:
        def hits(grams: Column) -> Column:
            def starts(item: Column) -> Column:
                full = F.filter(upto(F.size(grams)), lambda p: F.array_contains(item["spans"], F.get(grams, p)))
                part = lambda n: F.filter(
                    upto(F.size(w) - (n - 1)),
                    lambda p: F.array_contains(item["spans"], F.xxhash64(*[F.get(w, p + j) for j in range(n)])),
                )
                of = F.when(item["size"] == span, full)
                for n in short:
                    of = of.when(item["size"] == n, part(n))
                return F.struct(item["item_id"].alias("item_id"), item["size"].alias("size"), of.alias("starts"))

            return F.filter(F.transform(items_of, starts), lambda x: F.size(x["starts"]) > 0)

        return let(_grams(w, span), hits)

    def result(w: Column) -> Column:
        none = F.array().cast(f"array<struct<item_id:string,size:int,starts:array<int>>>")
        hits = F.when(F.col("__items").isNull(), none).otherwise(extended(w, F.col("__items")))
        return F.struct(F.size(w).cast("long").alias("n_words"), hits.alias("hits"))

    out = ("n_words", "n_hit", "n_items", "item_ids", "hit_words")
    docs = docs.drop(*out).withColumn("__key", text_key(F.col(text)))
    names = [n for n in docs.columns if n != "__key"]
    found = candidates.withColumnRenamed("key", "__found")
    judged = docs.join(found, F.col("__key") == F.col("__found"), "left").select(
        *names, let(words_of(F.col(text)), result).alias("__r")
    )
    covered = F.flatten(
        F.transform(
            F.col("__r.hits"),
            lambda x: F.flatten(F.transform(x["starts"], lambda p: F.sequence(p, p + x["size"] - 1))),
        )
    )
    ids = F.array_sort(F.array_distinct(F.array_compact(F.transform(F.col("__r.hits"), lambda x: x["item_id"]))))
    full = judged.select(
        *names, F.col("__r.n_words").alias("n_words"), ids.alias("item_ids"), F.array_distinct(covered).alias("hit_words")
    )
    return full.select(
        *names,
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        "item_ids",
        "hit_words",
    )
