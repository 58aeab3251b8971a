"""Clustering of selected records: labels, group names and a planar layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tandem.operators import clustering
from tandem.operators.dbscan import EPS, MIN_SAMPLES, dbscan


def cluster_records(
    records: DataFrame,
    algorithm: str,
    k: int | None = None,
    filters: Sequence[tuple[str, Sequence[str]]] = (),
    *,
    eps: float = EPS,
    min_samples: int = MIN_SAMPLES,
) -> DataFrame:
    """``id, cluster_id, label, pca_x, pca_y``."""
    if algorithm not in ("kmeans", "dbscan"):
        raise ValueError("algorithm must be 'kmeans' or 'dbscan'")
    chosen = clustering.select_records(records, filters)
    if algorithm == "kmeans":
        labels = clustering.kmeans(chosen, k)
    else:
        labels = dbscan(chosen, eps=eps, min_samples=min_samples)
    layout = clustering.scale_axes(clustering.project_to_plane(chosen))
    return labels.join(layout, "id").select(
        "id",
        "cluster_id",
        clustering.cluster_label("cluster_id").alias("label"),
        layout["x"].alias("pca_x"),
        layout["y"].alias("pca_y"),
    )
