"""All queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from markloom.operators import incremental_queries
from markloom.plans import queries, sql

QUERIES = incremental_queries.QUERIES | queries.QUERIES
SQL = incremental_queries.SQL | sql.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries.scan_by_keys(spark, sf_dir)
