"""Queries of the library and their SQL oracles, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quorate.plans import attempt_queries, batch_queries, text_queries  # noqa: F401  they register themselves
from quorate.plans.bindings import ORACLE, QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early stop, answer choice, lookup of the expected answers, accuracy."""
    return attempt_queries.accuracy_summary(spark, sf_dir)
