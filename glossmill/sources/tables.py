"""Parquet tables of a data folder, read with only the columns a plan asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table `name` of a data folder; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
