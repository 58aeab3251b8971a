"""Metric cells: spreading vectors over Voronoi cells and scoring cell blocks in NumPy tasks.

Shared by the exact top-k join, the approximate one and DBSCAN. Vectors are unit length, so
the angle between two vectors is a metric and a cell with pivot ``p`` and angular radius
``r`` can hold nothing closer to a query ``q`` than ``angle(q, p) - r``.

A cell is cut into sub-blocks of at most about ``block_rows`` rows by a hash of the row id,
so a cell that holds a large share of all rows becomes many tasks instead of one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PIVOTS = 4096


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.vstack(vectors.to_numpy()).astype(np.float64, copy=False)


def angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def spread_pivots(candidates: np.ndarray, count: int, min_angle: float = 1e-6) -> np.ndarray:
    """Up to ``count`` sampled vectors, none within ``min_angle`` of another chosen one."""
    chosen = np.empty((min(count, len(candidates)), candidates.shape[1]))
    n, limit = 0, np.cos(min_angle)
    for vector in candidates:
        if n == len(chosen):
            break
        if n == 0 or (chosen[:n] @ vector).max() < limit:
            chosen[n] = vector
            n += 1
    return chosen[:n]


def sample_pivots(vectors: DataFrame, id_col: str, vec: str, count: int, min_angle: float = 1e-6) -> np.ndarray:
    """Pivots from the rows with the smallest id hashes: a uniform, repeatable sample whose
    size depends on ``count`` alone, never on the data."""
    wanted = min(count, MAX_PIVOTS) * 2
    rows = vectors.select(F.xxhash64(id_col).alias("h"), vec).orderBy("h", id_col).limit(wanted).collect()
    if not rows:
        return np.zeros((0, 1))
    return spread_pivots(np.array([r[1] for r in rows], dtype=np.float64), min(count, MAX_PIVOTS), min_angle)


def to_nearest_pivot(vectors: DataFrame, vec: str, pivots: np.ndarray) -> DataFrame:
    """Adds ``cell`` (nearest pivot) and ``angle`` (to it); no shuffle."""
    schema = vectors.withColumns({"cell": F.lit(0), "angle": F.lit(0.0)}).schema

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a = angles(matrix(batch[vec]), pivots)
                cell = a.argmin(axis=1)
                yield batch.assign(cell=cell.astype(np.int32), angle=a[np.arange(len(a)), cell])

    return vectors.mapInPandas(assign, schema)


def to_cells(
    vectors: DataFrame, vec: str, pick: Callable[[pd.DataFrame, np.ndarray], Iterator[np.ndarray]], pivots: np.ndarray
) -> DataFrame:
    """Adds the array column ``cells``: for each row the cells ``pick`` selects from its
    angles to all pivots; no shuffle."""
    schema = vectors.withColumn("cells", F.array().cast("array<int>")).schema

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                chosen = pick(batch, angles(matrix(batch[vec]), pivots))
                yield batch.assign(cells=[c.astype(np.int32) for c in chosen])

    return vectors.mapInPandas(assign, schema)


def _lookup(values: Sequence[int]) -> Column:
    return F.lit(np.array(values, dtype=np.int32))


def sub_block(id_col: str, cell: Column, parts: Sequence[int]) -> Column:
    """Sub-block of a row within its cell, by id hash."""
    return F.pmod(F.xxhash64(id_col), F.element_at(_lookup(parts), cell + 1)).cast("int")


def every_sub_block(cell: Column, parts: Sequence[int]) -> Column:
    """All sub-blocks of a cell, to copy a row to each."""
    return F.explode(F.sequence(F.lit(0), F.element_at(_lookup(parts), cell + 1) - 1))


def parts_for(counts: dict[int, int], n_cells: int, block_rows: int) -> list[int]:
    return [max(1, -(-counts.get(c, 0) // block_rows)) for c in range(n_cells)]


# Blocks a side of a grid of blocks, and the most numbers of a block (128 MB as doubles).
GRID = 8
GRID_NUMBERS = 1 << 24


def grid_counts(n_left: int, n_right: int, block_rows: int, slots: int, width: int = 0) -> tuple[int, int]:
    """Blocks per side of a grid in which every left block meets every right block.

    Work for every core when the input is small (but no block under 256 rows), then blocks of
    ``block_rows`` rows, until the grid has two tasks a core and at least ``GRID`` times ``GRID``.
    From there on blocks grow and a row is copied no more often, until a block has ``GRID_NUMBERS``
    numbers at ``width``; only beyond that are there more blocks.
    """
    lb, rb = max(1, -(-n_left // block_rows)), max(1, -(-n_right // block_rows))
    while lb * rb < slots and n_left // lb > 512:
        lb *= 2
    while lb * rb < slots and n_right // rb > 512:
        rb *= 2
    side = max(GRID, math.isqrt(2 * slots - 1) + 1)
    most = side * side
    wanted, lb = lb, min(lb, side)
    rb = min(rb, most // lb)
    lb = max(lb, min(wanted, most // rb))
    return max(lb, -(-n_left * width // GRID_NUMBERS)), max(rb, -(-n_right * width // GRID_NUMBERS))


def grid_sides(left: DataFrame, left_id: str, lb: int, right: DataFrame, right_id: str, rb: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the blocks ``lb`` and ``rb``: a row has its own by id hash, and is copied to
    every block of the other side."""

    def cut(df: DataFrame, id_col: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(id_col), F.lit(n_own)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    return cut(left, left_id, "lb", lb, "rb", rb), cut(right, right_id, "rb", rb, "lb", lb)


def width_of(vectors: DataFrame, vec: str) -> int:
    """Numbers of the first vector, 0 without one."""
    row = vectors.select(F.size(vec).alias("d")).head()
    return row["d"] if row else 0


# Vector comparisons that make a task worth starting.
TASK_COMPARISONS = 1 << 22


def block_tasks(side: DataFrame, keys: Sequence[str], comparisons: int | None) -> DataFrame:
    """Shuffle one side of a block join into a set number of tasks, by the work to do.

    Block scoring is heavy for its bytes, so the run-time merging of small shuffle
    partitions, which looks at bytes, would leave most cores idle.
    """
    if comparisons is None:
        return side
    slots = side.sparkSession.sparkContext.defaultParallelism
    return side.repartition(max(slots, min(comparisons // TASK_COMPARISONS, 64 * slots)), *keys)
