"""Scans of the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; column pruning and pushed filters reach the Parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
