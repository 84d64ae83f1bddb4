"""Reading of the project's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a data folder; a table may be a file or a folder of files."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
