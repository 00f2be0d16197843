"""The registered queries of the market part and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import feature_queries, market_queries, probability_queries, table_queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with window primitives."""
    return feature_queries.primitives(spark, sf_dir)


def queries() -> dict:
    return feature_queries.QUERIES | market_queries.QUERIES | table_queries.QUERIES | probability_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return feature_queries.SQL | market_queries.SQL | table_queries.SQL | probability_queries.SQL
