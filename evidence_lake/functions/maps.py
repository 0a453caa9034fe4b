"""Map helpers that never trip over duplicate keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_maps(primary: Column, secondary: Column) -> Column:
    """Union of both maps; ``primary`` wins where keys collide."""
    extra = F.map_filter(secondary, lambda k, _: ~F.map_contains_key(primary, k))
    return F.map_concat(primary, extra)


def map_of_present(**entries: Column) -> Column:
    """A map holding only the entries whose value is not NULL."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in entries.items()])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def printable_map(c: Column) -> Column:
    """Entries sorted by key as ``k=v`` joined by ``;`` (maps cannot be compared)."""
    entries = F.sort_array(F.map_entries(c))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
