"""Collects the registered queries and their SQL from the plan modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import etl_plans, pair_plans, search_plans, text_plans

MODULES = [search_plans, text_plans, pair_plans, etl_plans]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest documents with text for a few query vectors."""
    return search_plans.knn_with_text(spark, sf_dir)


def queries() -> dict:
    return {name: run for module in MODULES for name, (run, _) in module.PLANS.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, (_, sql) in module.PLANS.items() if sql}
