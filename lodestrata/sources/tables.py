"""Readers for the tables of a data directory: one Parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def live(df: DataFrame) -> DataFrame:
    """Rows that were not soft-deleted."""
    return df.filter(F.col("deleted_at").isNull())
