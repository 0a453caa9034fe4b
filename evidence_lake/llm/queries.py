"""All named queries of this subpackage."""

from evidence_lake.llm import native_queries, text_queries, vector_queries  # noqa: F401
from evidence_lake.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
