"""Registered queries of the library's own operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import curate_queries, evaluation_queries, file_queries, overlap_queries, score_queries, source_queries, text_queries

MODULES = [score_queries, text_queries, overlap_queries, evaluation_queries, curate_queries, source_queries, file_queries]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_queries.flagship_escalation(spark, sf_dir)
