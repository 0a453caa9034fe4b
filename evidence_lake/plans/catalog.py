"""All named queries."""

from evidence_lake.plans import (  # noqa: F401
    document_queries,
    evidence_queries,
    table_queries,
    works_queries,
)
from evidence_lake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
