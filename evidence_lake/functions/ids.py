"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidence_lake import fixed_values as V


def uuid5(name: Column, namespace: str = V.CHUNK_NAMESPACE) -> Column:
    """RFC 4122 version-5 UUID of ``name``: repeatable, so task retries cannot change ids."""
    seed = F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8"))
    digest = F.sha1(seed)
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def chunk_id(document_id: Column, index: Column, text: Column) -> Column:
    """Id of a chunk from its document, place and text; a missing document prints as None."""
    owner = F.coalesce(document_id.cast("string"), F.lit("None"))
    return uuid5(F.concat(owner, F.lit(":"), index.cast("string"), F.lit(":"), text))
