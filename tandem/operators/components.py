"""Connected components of a large graph by alternating star contractions.

Kiveris, Lattanzi, Mirrokni, Rastogi, Vassilvitskii: Connected Components in MapReduce and
Beyond (SoCC 2014). Each round points every node at the smallest node it knows; the number
of edges never grows. A round's result is written to the shared folder, so plans stay short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.session import materialise

MAX_ROUNDS = 100


def _with_minimum(edges: DataFrame) -> DataFrame:
    """Adds ``m``, the smallest of a node ``u`` and its neighbours, to each edge. The minimum
    is reduced before the shuffle and joined back, so no node's edges meet in one task
    (a hub's side of the join is split at run time)."""
    least = edges.groupBy("u").agg(F.min("v").alias("__least"))
    joined = edges.join(least, "u")
    return joined.withColumn("m", F.least("__least", "u")).drop("__least")


def _edge(u: str, v: str):
    return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect each larger neighbour of a node to the smallest node around it."""
    both = edges.select(F.inline(F.array(_edge("u", "v"), _edge("v", "u"))))
    linked = _with_minimum(both)
    return linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them; ``u > v`` holds."""
    linked = _with_minimum(edges)
    moved = linked.select(F.inline(F.array(_edge("v", "m"), _edge("u", "m"))))
    return moved.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``node, root`` for every node with an edge; the root is the smallest node of its
    component. ``edges`` are ``u, v`` in any direction; loops are ignored."""
    current = materialise(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        # One row: how many nodes still keep the edges from being stars, with two edges up or
        # with edges both up and down.
        roles = current.select(
            F.inline(F.array(
                F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")),
            ))
        )
        per_node = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        state = per_node.agg(
            F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).alias("unsettled"),
        ).head()
        if state["unsettled"] == 0:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        current = materialise(_small_star(_large_star(current)), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
