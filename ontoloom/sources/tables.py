"""Table access: one parquet path per table under a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, key: str) -> DataFrame:
    """Rows repeated with the same key count once (null keys are dropped)."""
    return df.where(df[key].isNotNull()).dropDuplicates([key])
