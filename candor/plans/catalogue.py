"""All registered queries of the engine with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from candor.plans import assembly_queries, collect_queries, comparison_queries, extract_queries, match_queries, metric_queries, page_queries, price_queries, review_queries, sink_queries

MODULES = (assembly_queries, price_queries, review_queries, page_queries, metric_queries, match_queries, extract_queries, collect_queries, comparison_queries, sink_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_queries.trust_score_by_source(spark, sf_dir)
