"""Merging works that describe the same publication, exactly as a one-by-one pass would.

The rule is sequential: walk the works by (provider rank, list position); a work joins
the *first* record so far that shares its DOI, external id, URL key or content hash,
else it starts a record.  A record's own keys grow while works join it (the first
non-empty value of each field stays), so the outcome is not the connected components
of the key graph.

The walk is replaced by a fixed-point iteration over whole tables.  Given any guess of
"which record does each work join", the time at which every record acquired every key
is one aggregation, and the record each work then finds first is one join on keys.  A
work's answer depends on earlier works only, so each round settles at least the next
work of every group of related works, and a round that changes nothing has reached the
one and only answer.  In practice a handful of rounds does; the number follows the
length of chains of changed decisions, not the number of rows.

Nothing is ever gathered per group: per key or per record there are only aggregates
that combine map-side, so a key shared by a third of all rows costs one partial
aggregate per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_lake import fixed_values as V
from evidence_lake.functions import text as T
from evidence_lake.operators.components import connected
from evidence_lake.session import discard, write_out

_FOREVER = (1 << 63) - 1
_FIELDS = ("doi", "ext", "urlk", "title", "year", "author")


def provider_rank(source: Column, preference: Sequence[str] = V.PROVIDER_PREFERENCE) -> Column:
    """Place in the preference list; unknown providers share the place behind it."""
    rank = F.lit(len(preference))
    for place, name in reversed(list(enumerate(preference))):
        rank = F.when(source == name, F.lit(place)).otherwise(rank)
    return rank


def in_merge_order(works: DataFrame, preference: Sequence[str] = V.PROVIDER_PREFERENCE) -> DataFrame:
    """Works with ``ord``: 0, 1, 2, ... by provider rank, then list position ``seq``.

    ``seq`` may be of any type that can be sorted, also a struct of list, file and offset.  The places are
    sorted over all tasks and numbered by one offset per task.  Two works at one place fail the query, as
    the outcome would depend on chance.
    """
    ranked = works.withColumn("_rank", provider_rank(F.col("source"), preference))
    places = ranked.groupBy("_rank", "seq").agg(F.count("*").alias("_n"))
    ordered = places.repartitionByRange("_rank", "seq").sortWithinPartitions("_rank", "seq")
    placed = write_out(ordered.withColumn("_at", F.monotonically_increasing_id()), "places")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row for each task that sorted
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    single = F.when(F.col("_n") == 1, F.col("_before") + row).otherwise(
        F.raise_error(F.concat(F.lit("several works at the place "), F.to_json(F.struct("seq"))))
    )
    return ranked.join(numbered.select("_rank", "seq", single.alias("ord")), ["_rank", "seq"]).select(
        *works.columns, "ord"
    )


def _hash_key(title: Column, author: Column, year: Column) -> Column:
    return F.concat(F.lit("hash:"), T.content_hash(title, author, year))


def _identity(works: DataFrame) -> DataFrame:
    """The slim columns that decide who merges with whom."""
    title = T.collapse_whitespace(F.lower(F.col("title")))
    return works.select(
        "ord",
        F.col("doi").alias("doi"),
        F.col("external_id").alias("ext"),
        T.url_key(F.col("url")).alias("urlk"),
        T.blank_to_null(title).alias("title"),
        F.col("publication_year").alias("year"),
        F.lower(F.get(F.col("authors"), F.lit(0))).alias("author"),
    )


def _tagged(**columns: Column) -> Column:
    pairs = [F.concat(F.lit(f"{tag}:"), c) for tag, c in columns.items()]
    return F.array_compact(F.array(*pairs))


def _plain_keys() -> Column:
    return _tagged(doi=F.col("doi"), ext=F.col("ext"), url=F.col("urlk"))


def identity_keys(works: DataFrame) -> DataFrame:
    """(seq, key): two works match when they have a key in common."""
    own = _identity(works.withColumn("ord", F.col("seq")))
    keys = F.array_append(_plain_keys(), _hash_key(F.col("title"), F.col("author"), F.col("year")))
    return own.select(F.col("ord").alias("seq"), F.explode(F.array_compact(keys)).alias("key"))


def _contested(own: DataFrame) -> DataFrame:
    """Works sharing a DOI, external id, URL key or title with another work.

    All others stay alone: a record's title is the title of one of its works, so even a
    content hash put together from several works needs a shared title.
    """
    keys = own.select("ord", F.explode(F.array_append(_plain_keys(), F.concat(F.lit("title:"), F.col("title")))).alias("key"))
    # hashes for keys, which are sent twice: two that clash only make a work contested that need not be
    keys = keys.filter(F.col("key").isNotNull()).select("ord", F.xxhash64("key").alias("key"))
    shared = keys.groupBy("key").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    shared = shared.filter(F.col("lo") != F.col("hi")).select("key")
    contested = keys.join(shared, "key", "left_semi").select("ord").distinct()
    return own.join(contested, "ord", "left_semi")


def _record_entries(members: DataFrame) -> DataFrame:
    """(key, leader, since, until): work t sees the key on the record if since < t <= until."""
    since = {f: F.min(F.when(F.col(f).isNotNull(), F.col("ord"))) for f in _FIELDS}
    value = {f: F.min_by(f, F.when(F.col(f).isNotNull(), F.col("ord"))) for f in _FIELDS}
    records = members.groupBy("leader").agg(
        *[since[f].alias(f"{f}_at") for f in _FIELDS], *[value[f].alias(f) for f in _FIELDS]
    )
    forever = F.lit(_FOREVER)
    titled = F.when(
        F.col("title").isNotNull() & F.col("year").isNotNull(), F.greatest("title_at", "year_at")
    )
    authored = F.greatest(titled, F.coalesce("author_at", titled))
    bare_until = F.coalesce("author_at", forever)

    def entry(key: Column, at: Column, until: Column) -> Column:
        kept = F.when(key.isNotNull() & (at < until), key)
        return F.struct(kept.alias("key"), at.alias("since"), until.alias("until"))

    entries = F.array(
        entry(F.concat(F.lit("doi:"), F.col("doi")), F.col("doi_at"), forever),
        entry(F.concat(F.lit("ext:"), F.col("ext")), F.col("ext_at"), forever),
        entry(F.concat(F.lit("url:"), F.col("urlk")), F.col("urlk_at"), forever),
        # the hash changes when a record without authors gets its first ones
        entry(_hash_key(F.col("title"), F.lit(None).cast("string"), F.col("year")), titled, bare_until),
        entry(
            F.when(F.col("author").isNotNull(), _hash_key(F.col("title"), F.col("author"), F.col("year"))),
            authored, forever,
        ),
    )
    return (
        records.select("leader", F.explode(entries).alias("e"))
        .select("leader", "e.key", "e.since", "e.until")
        .filter(F.col("key").isNotNull())
    )


def _cover(low: Column, high: Column, levels: int) -> Column:
    """The O(log n) aligned power-of-two blocks that make up [low, high), high up to 2^levels."""

    def at_level(level: Column) -> Column:
        # ceil(low / 2^level) without overflow at the top of the range
        left = F.when(low == 0, F.lit(0).cast("bigint")).otherwise(
            F.call_function("shiftright", low - 1, level) + 1
        )
        right = F.call_function("shiftright", high, level)
        block = lambda n: F.struct(level.alias("level"), n.alias("block"))
        open_ = left < right
        return F.array_compact(
            F.array(
                F.when(open_ & (left.bitwiseAND(F.lit(1)) == 1), block(left)),
                F.when(open_ & (right.bitwiseAND(F.lit(1)) == 1), block(right - 1)),
            )
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at_level))


def _blocks_of(point: Column, levels: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(levels)),
        lambda level: F.struct(level.alias("level"), F.call_function("shiftright", point, level).alias("block")),
    )


def _settle(keys: DataFrame, entries: DataFrame, levels: int) -> DataFrame:
    """(ord, leader): the first record each work sees, given the records' keys over time; ``ord`` is
    below 2^levels."""
    own = (F.col("since") == F.col("leader")) & (F.col("until") == F.lit(_FOREVER))
    # keys a record had from its first work on: the earliest record is in sight iff it is earlier
    from_start = entries.filter(own).groupBy("key").agg(F.min("leader").alias("leader"))
    early = keys.join(from_start, "key").filter(F.col("leader") < F.col("ord")).select("ord", "leader")
    # keys that came later or went away: look the moment up in a hierarchy of time blocks,
    # so that a key with many works and many records never pairs them all
    end = F.when(F.col("until") == _FOREVER, F.lit(1 << levels)).otherwise(F.col("until") + 1)
    timed = (
        entries.filter(~own)
        .select("key", "leader", F.explode(_cover(F.col("since") + 1, end, levels)).alias("t"))
        .groupBy("key", "t")
        .agg(F.min("leader").alias("leader"))
    )
    moments = keys.join(timed.select("key").distinct(), "key", "left_semi").select(
        "key", "ord", F.explode(_blocks_of(F.col("ord"), levels)).alias("t")
    )
    late = moments.join(timed, ["key", "t"]).select("ord", "leader")
    return early.unionByName(late).groupBy("ord").agg(F.min("leader").alias("leader"))


def _follow(guess: DataFrame, steps: int = 2) -> DataFrame:
    """Sends works that point at a work which is itself part of a record on to that record.

    Settled works point at true first works and stay as they are, so this cannot undo
    progress; it only shortens the way.
    """
    for _ in range(steps):
        ahead = guess.filter(F.col("ord") != F.col("leader")).select(
            F.col("ord").alias("leader"), F.col("leader").alias("ahead")
        )
        guess = guess.join(ahead, "leader", "left").select("ord", F.coalesce("ahead", "leader").alias("leader"))
    return guess


def assign_records(works: DataFrame) -> DataFrame:
    """(ord, leader) for every work of ``in_merge_order``: the first work of its record."""
    own = write_out(_contested(_identity(works)), "contested")
    # positions are dense, so the hierarchy of time blocks is as high as the number of works has bits
    levels = max(1, int(own.agg(F.max("ord")).first()[0] or 0).bit_length())
    keys = own.select(
        "ord",
        F.explode(F.array_append(_plain_keys(), _hash_key(F.col("title"), F.col("author"), F.col("year")))).alias("key"),
    ).filter(F.col("key").isNotNull())
    keys = write_out(keys, "keys")

    # first guess: the earliest work sharing any key
    holders = keys.groupBy("key").agg(F.min("ord").alias("leader"))
    guess = keys.join(holders, "key").groupBy("ord").agg(F.min("leader").alias("leader"))
    guess = own.select("ord").join(guess, "ord", "left")
    guess = before = write_out(guess.select("ord", F.coalesce("leader", "ord").alias("leader")), "guess")
    while True:
        guess = _follow(guess)
        found = _settle(keys, _record_entries(own.join(guess, "ord")), levels)
        updated = (
            guess.withColumnRenamed("leader", "was")
            .join(found, "ord", "left")
            .select("ord", F.coalesce("leader", "ord").alias("leader"), "was")
        )
        updated = write_out(updated, "guess")
        discard(before)
        settled = updated.filter(F.col("leader") != F.col("was")).isEmpty()
        guess, before = updated.select("ord", "leader"), updated
        if settled:
            discard(own, keys)
            return guess


def assign_components(works: DataFrame) -> DataFrame:
    """(ord, leader) for every work that shares a key with another: the first work of its connected component.

    Works are linked by the keys they came with.  That differs from the one-by-one pass in two ways: a work with keys of
    two records joins them into one here (there it joins the first, and they stay apart), and works meet by keys that
    records do not show in the pass, as only the first value of each field becomes a record's key.
    """
    own = _identity(works)
    hashed = _hash_key(F.col("title"), F.col("author"), F.col("year"))
    keys = own.select("ord", F.explode(F.array_compact(F.array_append(_plain_keys(), hashed))).alias("key"))
    keys = write_out(keys, "keys")
    # each work is linked with the first one of each of its keys
    first = keys.groupBy("key").agg(F.min("ord").alias("first"))
    found = connected(keys.join(first, "key").select(F.col("first").alias("a"), F.col("ord").alias("b")))
    return found.select(F.col("node").alias("ord"), F.col("root").alias("leader"))


#: How works are assigned to records: the one-by-one pass, or connected components of shared keys.
STRATEGIES = {"hierarchical": assign_records, "components": assign_components}


def merge_records(members: DataFrame) -> DataFrame:
    """One work per ``leader``: first non-empty value of each field in ``ord`` order.

    Metadata is the union of all, the earlier work winning a key, plus
    ``merged_sources``: the source of the ``second`` work, of the first, then the
    others' in order of appearance.
    """
    rank, no_strings = F.col("ord"), F.array().cast("array<string>")

    def first_of(name: str, usable: Column) -> Column:
        return F.min_by(name, F.when(usable, rank)).alias(name)

    listed = F.col("metadata")["merged_sources"]
    fields = members.groupBy("leader").agg(
        F.min_by("seq", rank).alias("seq"),
        F.min_by("source", rank).alias("source"),
        *[
            first_of(name, T.blank_to_null(F.col(name)).isNotNull())
            for name in ("title", "abstract", "doi", "url", "external_id")
        ],
        first_of("authors", F.size("authors") > 0),
        first_of("publication_year", F.col("publication_year").isNotNull()),
        # a list the first or second work may bring along from an earlier merge
        F.min_by(listed, F.when(listed.isNotNull() & (rank <= F.col("second")), rank)).alias("listed"),
    )
    names = (
        members.groupBy("leader", "second", "source")
        .agg(F.min("ord").alias("at"))
        .withColumn(
            "place",
            F.when(F.col("at") == F.col("second"), 0).when(F.col("at") == F.col("leader"), 1).otherwise(2),
        )
        # distinct sources of one record: no more than there are providers
        .groupBy("leader")
        .agg(F.sort_array(F.collect_list(F.struct("place", "at", "source"))).alias("names"))
    )
    entries = (
        members.select("leader", "ord", F.explode("metadata").alias("k", "v"))
        .filter(F.col("k") != "merged_sources")
        .groupBy("leader", "k")
        .agg(F.min_by("v", "ord").alias("v"))
        .groupBy("leader")
        .agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("metadata"))
    )
    base = F.coalesce(F.from_json("listed", "array<string>"), no_strings)
    added = F.transform("names", lambda n: n["source"])
    merged_sources = F.to_json(F.concat(base, F.array_except(added, base)))
    empty = F.create_map().cast("map<string,string>")
    return (
        fields.join(names, "leader")
        .join(entries, "leader", "left")
        .withColumn("authors", F.coalesce("authors", no_strings))
        .withColumn(
            "metadata",
            F.map_concat(
                F.coalesce("metadata", empty), F.create_map(F.lit("merged_sources"), merged_sources)
            ),
        )
    )


def deduplicate(
    works: DataFrame,
    preference: Sequence[str] = V.PROVIDER_PREFERENCE,
    strategy: str = "hierarchical",
) -> DataFrame:
    """Normalized works with duplicates merged; order by ``ord`` to list first occurrences first.

    ``strategy`` is ``hierarchical``, the one-by-one pass, or ``components``, see :func:`assign_components`.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown deduplication strategy: {strategy!r}")
    columns = works.columns
    placed = write_out(in_merge_order(works, preference), "works")
    records = STRATEGIES[strategy](placed)
    seconds = records.groupBy("leader").agg(
        F.min(F.when(F.col("ord") != F.col("leader"), F.col("ord"))).alias("second")
    )
    grouped = write_out(records.join(seconds.filter("second is not null"), "leader"), "grouped")
    merged = merge_records(placed.join(grouped, "ord")).withColumnRenamed("leader", "ord")
    alone = placed.join(grouped.select("ord"), "ord", "left_anti")
    return alone.select("ord", *columns).unionByName(merged.select("ord", *columns))
