"""Landed web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def page_source(spark: SparkSession, path: str) -> DataFrame:
    """``page_id``, ``url`` and ``html`` of pages that a crawler has stored."""
    return spark.read.parquet(path).select("page_id", "url", "html")
