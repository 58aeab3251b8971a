"""Merging two ranked lists per query and ranking what follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.scores import rerank_strength

# Fixed value: the constant of reciprocal rank fusion.
RRF_K = 60


def _both(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    v = vector.select("query_id", "id", F.col("rank").alias("vec_rank"))
    w = keyword.select("query_id", "id", F.col("rank").alias("kw_rank"))
    return v.join(w, ["query_id", "id"], "full")


def rrf_merge(vector: DataFrame, keyword: DataFrame, k: int = RRF_K) -> DataFrame:
    """``query_id, id, vec_rank, kw_rank, rrf, rank``. Ties keep first appearance: the
    vector list in its order, then ids only the keyword list has."""
    gain = F.coalesce(1 / (k + F.col("vec_rank")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("kw_rank")), F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(
        F.desc("rrf"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("kw_rank")
    )
    return _both(vector, keyword).withColumn("rrf", gain).withColumn("rank", F.row_number().over(order))


def vector_primary_merge(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """``query_id, id, vec_rank, kw_rank, rank``: the vector list, then keyword-only ids."""
    order = Window.partitionBy("query_id").orderBy(
        F.asc_nulls_last("vec_rank"), F.asc_nulls_last("kw_rank")
    )
    return _both(vector, keyword).withColumn("rank", F.row_number().over(order))


def cut(merged: DataFrame, pool: int) -> DataFrame:
    return merged.where(F.col("rank") <= pool)


def label_rerank_strength(results: DataFrame) -> DataFrame:
    """Adds ``strength`` from the place of each rerank score within its query."""
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    place = F.when(F.col("rerank_score").isNotNull(), F.row_number().over(order))
    return results.withColumn("strength", rerank_strength(place))
