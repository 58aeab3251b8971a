"""Versioned manifests: small tables that name what a larger one consists of.

A version is one file in a folder of its own, so it is there or not; readers take the newest or
keep the one they opened. Writers of one manifest come one after another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F


class Manifest:
    """Rows of ``schema`` per version under ``path``; few enough for the driver by design."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def rows(self, version: int | None = None) -> list[Row]:
        """The rows, with ``version``, of the newest or the given version; none before the first."""
        try:
            stored = self.spark.read.schema(f"{self.schema}, version long").parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        if version is None:
            version = stored.agg(F.max("version")).head()[0]
        return stored.where(F.col("version") == version).collect()

    def commit(self, rows: Sequence[tuple], version: int) -> None:
        table = self.spark.createDataFrame(list(rows), self.schema).coalesce(1)
        table.write.mode("overwrite").parquet(f"{self.path}/version={version}")
