"""The given tables in the shapes the operators take, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tandem.session import apply_settings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_settings(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core for per-row work on an input that arrives in fewer partitions (these
    files hold one row group each, so the other partitions of a scan are empty)."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, key)
