"""Access to a directory holding one Parquet table per name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``; column pruning and filters reach its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
