"""All registered queries of the library but those of the llm subpackage."""

from corpusspark.plans import corpus_queries, ingest_queries, stream_queries, table_queries  # noqa: F401
from corpusspark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
