"""Field rules, referential checks and what to do with rows that break them.

A rule set maps a name to an expression that is true where the rule is broken.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_lake import fixed_values as V
from evidence_lake.functions import text as T

Rules = Mapping[str, Column]


def strip_strings(rows: DataFrame) -> DataFrame:
    """All strings stripped, also those in arrays, as document and research payloads are on entry."""
    plain = {n: T.strip(F.col(n)) for n, t in rows.dtypes if t == "string"}
    listed = {n: F.transform(n, T.strip) for n, t in rows.dtypes if t == "array<string>"}
    return rows.withColumns(plain | listed) if plain or listed else rows


def _lengths(limits: Mapping[str, int], required: tuple[str, ...], columns: list[str]) -> dict[str, Column]:
    rules: dict[str, Column] = {}
    for name, most in limits.items():
        if name not in columns:
            continue
        if name in required:
            rules[f"{name}_missing"] = F.col(name).isNull()
            rules[f"{name}_too_short"] = F.length(name) < 1
        rules[f"{name}_too_long"] = F.length(name) > most
    return rules


def document_rules(columns: list[str]) -> dict[str, Column]:
    """Rules for stored documents."""
    rules = _lengths(V.DOCUMENT_MAX_CHARS, ("source", "title"), columns)
    if "status" in columns:
        rules["status_unknown"] = ~F.col("status").isin(*V.DOCUMENT_STATUSES)
    return rules


def research_rules(columns: list[str]) -> dict[str, Column]:
    """Rules for stored research questions."""
    rules = _lengths(V.RESEARCH_MAX_CHARS, tuple(V.RESEARCH_MAX_CHARS), columns)
    if "status" in columns:
        rules["status_unknown"] = ~F.col("status").isin(*V.RESEARCH_STATUSES)
    return rules


def change_rules(rules: Rules, present: str = "present") -> dict[str, Column]:
    """The rules as far as they concern fields that a change names in ``present``.

    A rule is about the field its name begins with.
    """
    return {name: F.array_contains(present, name.rsplit("_", 2 if "_too_" in name else 1)[0]) & broken for name, broken in rules.items()}


def violations(rules: Rules) -> Column:
    """Names of the broken rules, in rule order."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def check(rows: DataFrame, rules: Rules) -> DataFrame:
    """Rows with ``violations``."""
    return rows.withColumn("violations", violations(rules))


def quarantine(rows: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``violations``)."""
    checked = check(rows, rules)
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def enforce(rows: DataFrame, rules: Rules) -> DataFrame:
    """Rows as they are; one broken rule anywhere fails the whole query."""
    broken = violations(rules)
    message = F.concat(F.lit("invalid row: "), F.array_join(broken, ", "))
    failed = F.when(F.size(broken) > 0, F.raise_error(message).cast("boolean"))
    return rows.filter(F.coalesce(failed, F.lit(True)))


def research_form_errors() -> Column:
    """field -> message for the first thing wrong with each form field; values come trimmed.

    Lengths count UTF-16 units, as the form does.
    """
    entries = []
    for name, (missing, too_long) in V.RESEARCH_FORM_MESSAGES.items():
        units = F.octet_length(F.encode(F.col(name), "UTF-16BE")) / 2
        message = F.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit(missing)).when(
            units > V.RESEARCH_MAX_CHARS[name], F.lit(too_long)
        )
        entries.append(F.struct(F.lit(name).alias("key"), message.alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def first_errors(detail: Column) -> Column:
    """array<struct<loc array<string>, msg string>> -> field -> first message.

    The field is the last part of ``loc``, or ``_``; items without a message do not count.
    """
    field = lambda d: F.coalesce(F.try_element_at(d["loc"], F.lit(-1)), F.lit("_"))
    named = F.transform(
        F.filter(F.coalesce(detail, F.array().cast("array<struct<loc:array<string>,msg:string>>")), lambda d: d["msg"] != ""),
        lambda d, i: F.struct(field(d).alias("field"), i.alias("at"), d["msg"].alias("msg")),
    )
    ordered = F.sort_array(named)
    before = F.concat(F.array(F.lit(None).cast("struct<field:string,at:int,msg:string>")), ordered)
    firsts = F.zip_with(
        ordered, before,
        lambda d, prev: F.when(
            d.isNotNull() & (prev.isNull() | (prev["field"] != d["field"])), F.struct(d["field"].alias("key"), d["msg"].alias("value"))
        ),
    )
    return F.map_from_entries(F.array_compact(firsts))


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent does not exist."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def is_known_source(source: Column) -> Column:
    """Is this a search provider the system knows?"""
    return source.isin(*V.PROVIDER_PREFERENCE)


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) for key values that occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
