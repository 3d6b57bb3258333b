"""All queries outside the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import analytics, conversations, documents, indexes, more, relational, rest, retrieval, streams, understanding
from .plans.kit import Query

_MODULES = (relational, retrieval, indexes, conversations, analytics, documents, understanding, streams, more, rest)


def queries() -> dict[str, Query]:
    return {k: v for m in _MODULES for k, v in m.P.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.P.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["hybrid_retrieval"](spark, sf_dir)
