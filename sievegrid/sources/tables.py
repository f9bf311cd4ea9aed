"""Readers of the Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the folder; any path that Spark can open will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
