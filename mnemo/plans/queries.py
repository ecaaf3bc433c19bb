"""The library's queries over the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus_queries, draw_queries, experiment_queries, logit_queries, membership, report_queries, selection_queries, series_queries, stream_queries, study_queries, text_queries, variant_queries

_PARTS = (membership, draw_queries, series_queries, logit_queries, text_queries, corpus_queries, study_queries, report_queries, stream_queries, selection_queries, experiment_queries, variant_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership.effect_sizes(spark, sf_dir)
