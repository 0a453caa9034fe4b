"""Column helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it.

    Lambdas of array functions re-evaluate what they refer to for each element, unless
    it is a variable of an enclosing lambda; this makes it one.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def upto(n: Column) -> Column:
    """0 .. n-1; empty for n below 1."""
    return F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def text_key(text: Column) -> Column:
    """Tells rows with a repeated id apart by their text; equal for equal texts."""
    return F.xxhash64(text)


def others(docs: DataFrame, names: tuple[str, ...]) -> list[Column]:
    """The columns of ``docs`` but for those of these names, in any letter case."""
    taken = {n.lower() for n in names}
    return [F.col("`" + n.replace("`", "``") + "`") for n in docs.columns if n.lower() not in taken]
