"""Queries by name, gathered from the modules of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import audit_queries, common, comparison_queries, depth_queries, history_queries, market_queries, pricing_queries, research_queries, sequencing_queries, session_queries, stream_queries, view_queries

MODULES = (market_queries, pricing_queries, history_queries, research_queries, audit_queries, sequencing_queries, comparison_queries, session_queries, stream_queries, view_queries, depth_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of all routes."""
    return common.episode_table(spark, sf_dir)


def queries() -> dict:
    return {name: query for module in MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
