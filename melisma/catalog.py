"""All queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from melisma.plans import text_queries, time_queries  # noqa: F401  they register their queries
from melisma.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["verse_segments"](spark, sf_dir)
