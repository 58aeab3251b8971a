"""K-means, planar projection and cluster summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.patterns import MAX_CLUSTER_FILTERS, MAX_CLUSTER_VALUES, cluster_filter, cluster_filters
from tandem.functions.vectors import unit

# Bounds on k, the seed, and when a result counts as too dense.
MAX_K = 50
SEED = 42
DENSE_CLUSTERS = 50


def select_records(
    records: DataFrame,
    filters: Sequence[tuple[str, Sequence[str]]],
    max_columns: int = MAX_CLUSTER_FILTERS,
    max_values: int = MAX_CLUSTER_VALUES,
) -> DataFrame:
    """Records to cluster: any value within a column, all columns."""
    return records.where(cluster_filter(cluster_filters(filters, records.columns, max_columns, max_values)))


def check_k(k: int | None, n: int, max_k: int = MAX_K) -> int:
    if k is None:
        raise ValueError("k is required for k-means")
    upper = min(max_k, n - 1) if n > 1 else 1
    if not 2 <= k <= upper:
        raise ValueError(f"k must be between 2 and {upper} for {n} records")
    return k


def kmeans(
    records: DataFrame, k: int, id_col: str = "id", vec: str = "embedding", seed: int = SEED, max_k: int = MAX_K
) -> DataFrame:
    """``id, cluster_id`` from k-means on unit vectors."""
    check_k(k, records.count(), max_k)
    points = records.select(F.col(id_col).alias("id"), array_to_vector(unit(vec)).alias("features"))
    model = KMeans(k=k, seed=seed, initMode="k-means||", initSteps=5, featuresCol="features", predictionCol="cluster_id").fit(points)
    return model.transform(points).select("id", "cluster_id")


def project_to_plane(records: DataFrame, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """``id, x, y``: unit vectors on their two main axes, each pointing towards its largest
    loading. A missing second axis is 0."""
    points = records.select(F.col(id_col).alias("id"), array_to_vector(unit(vec)).alias("features"))
    width = records.select(F.size(vec)).head()
    if width is None:
        return points.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    axes = min(2, width[0])
    model = PCA(k=axes, inputCol="features", outputCol="coords").fit(points)
    loadings = model.pc.toArray()
    signs = [float(np.sign(loadings[np.abs(loadings[:, i]).argmax(), i]) or 1.0) for i in range(axes)]
    coords = vector_to_array("coords")
    columns = [(coords[i] * signs[i]).alias(name) for i, name in zip(range(axes), "xy")]
    if axes < 2:
        columns.append(F.lit(0.0).alias("y"))
    return model.transform(points).select("id", *columns)


def scale_axes(coords: DataFrame, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """Each axis linearly onto [-1, 1]; an axis without spread becomes 0."""
    bounds = coords.agg(
        *[f(a).alias(f"__{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))]
    )

    def scaled(a: str) -> Column:
        lo, hi = F.col(f"__lo_{a}"), F.col(f"__hi_{a}")
        return F.when(hi > lo, 2 * (F.col(a) - lo) / (hi - lo) - 1).otherwise(F.lit(0.0))

    joined = coords.join(F.broadcast(bounds))
    return joined.withColumns({a: scaled(a) for a in axes}).select(*coords.columns)


def cluster_label(cluster_id: Column | str) -> Column:
    c = F.col(cluster_id) if isinstance(cluster_id, str) else cluster_id
    return F.when(c == -1, "Unassigned").otherwise(F.concat(F.lit("Cluster "), (c + 1).cast("string")))


def group_summary(labels: DataFrame) -> DataFrame:
    """``cluster_id, label, count``, clusters in order, unassigned records last."""
    return (
        labels.groupBy("cluster_id")
        .agg(F.count(F.lit(1)).alias("count"))
        .select("cluster_id", cluster_label("cluster_id").alias("label"), "count")
        .orderBy(F.col("cluster_id") == -1, "cluster_id")
    )


def cluster_statistics(labels: DataFrame, algorithm: str) -> DataFrame:
    """One row: records, clusters without noise, and whether a density clustering looks
    too sparse (none) or too dense (over fifty)."""
    groups = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    by_density = F.lit(algorithm == "dbscan")
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count_if(F.col("cluster_id") != -1).alias("n_clusters")
    ).withColumns(
        {
            "too_sparse": by_density & (F.col("n_clusters") == 0),
            "too_dense": by_density & (F.col("n_clusters") > DENSE_CLUSTERS),
        }
    )


def cluster_export(labels: DataFrame, records: DataFrame, display: Sequence[str]) -> DataFrame:
    """Cluster label and display columns, clusters in order, unassigned records last."""
    return (
        labels.join(records.select("id", *display), "id")
        .orderBy(F.col("cluster_id") == -1, "cluster_id", "id")
        .select(cluster_label("cluster_id").alias("cluster"), *display)
    )
