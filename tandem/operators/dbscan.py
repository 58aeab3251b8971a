"""DBSCAN on unit vectors without listing neighbour pairs.

* Equal vectors are one weighted point, so copies cost nothing however many there are.
* Points meet in a grid of id blocks, at most ``GRID`` a side while a block fits a task, so a
  point travels a bounded number of times. Inside a task it is compared only with points of the
  metric cells within its nearest-pivot distance plus twice eps (and within the cell radius
  plus eps), which by the triangle inequality hold every neighbour. Das Sarma, He, Chaudhuri:
  ClusterJoin (VLDB 2014).
* A task reads its vectors where Arrow has put them, without a copy of a block, and compares tiles
  with matrix products of single precision; pairs within the rounding error of eps are computed
  again in double precision. It emits one number per point
  (neighbour weight), then one edge per core point (to the smallest core point of its local
  group). The edges grow with the points, not with the pairs.
* A row that has reached ``min_samples`` is not counted further, and rows and columns that are in
  one group already are not compared again: where clusters are wide, both passes end early. Points
  without a neighbour do not travel in the second pass.
* A cell whose radius is at most eps / 2 and whose weight reaches ``min_samples`` is dense:
  all its points are core and connected, so they are never compared with each other.

Clusters are numbered by their smallest core id; a border point joins the lowest numbered
cluster among its core neighbours; the rest is noise (-1).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions.vectors import unit
from tandem.operators.cells import (
    angles,
    block_tasks,
    grid_counts,
    grid_sides,
    matrix,
    sample_pivots,
    to_nearest_pivot,
)
from tandem.operators.components import connected_components
from tandem.operators.ordering import row_ordinal
from tandem.session import materialise

# The defaults of the clustering screen.
EPS = 0.3
MIN_SAMPLES = 5
BLOCK_ROWS = 2048
SLICE_ROWS, TILE_ROWS = 512, 4096
NOISE = -1
_SLACK = 1e-9


def _angle_of(distance: float) -> float:
    """Angle between unit vectors at a Euclidean distance."""
    return float(2 * np.arcsin(min(1.0, distance / 2)))


def _hits(lefts: np.ndarray, rights: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the pairs within ``eps``."""
    dots = lefts.astype(np.float32) @ rights.astype(np.float32).T
    # Twice what single precision can be off by for unit vectors.
    bound, off = 1 - eps * eps / 2, (lefts.shape[1] + 16) * 2.0**-23
    row, col = np.nonzero(dots >= np.float32(bound - off))
    near = dots[row, col] > bound + off
    open_ = np.flatnonzero(~near)
    for at in range(0, len(open_), TILE_ROWS):
        some = open_[at : at + TILE_ROWS]
        exact = np.einsum("ij,ij->i", lefts[row[some]], rights[col[some]])
        near[some] = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * exact)) <= eps
    return row[near], col[near]


class _Rows:
    """The vectors of a block, left in the Arrow buffers they came in; only rows asked for are copied."""

    def __init__(self, column: pa.ChunkedArray):
        self.parts = []
        for chunk in column.chunks:
            lengths = np.unique(chunk.value_lengths().to_numpy(zero_copy_only=False))
            if len(lengths) > 1:
                raise ValueError("vectors differ in width")
            if len(lengths):
                self.parts.append(chunk.flatten().to_numpy(zero_copy_only=False).reshape(len(chunk), lengths[0]))
        self.starts = np.cumsum([0, *map(len, self.parts)])

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        home = np.searchsorted(self.starts, index, "right") - 1
        found = np.empty((len(index), self.parts[0].shape[1]))
        for part in np.unique(home):
            here = home == part
            found[here] = self.parts[part][index[here] - self.starts[part]]
        return found


class _Block:
    """One side of a task: its columns by name, its vectors apart."""

    def __init__(self, rows: pa.Table):
        self.vectors = _Rows(rows["vec"])
        self.columns = rows.drop_columns(["vec"]).to_pandas()

    def __len__(self) -> int:
        return len(self.columns)

    def __getitem__(self, name: str) -> pd.Series:
        return self.columns[name]


def _vectors(side):
    return side.vectors if isinstance(side, _Block) else matrix(side["vec"])


def _merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (the smallest member of each group) after the groups of ``u`` and ``v`` become one."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not (label == (further := label[label])).all():
            label = further


def _slices(lefts: pd.DataFrame, rights: pd.DataFrame, pivots: np.ndarray, reach: float, dense: np.ndarray):
    """``rows, columns`` to compare: left rows of alike cells with a tile of the right rows that the
    triangle inequality leaves them; a pair in the same dense cell need not be compared."""
    home, own = lefts["cell"].to_numpy(), lefts["angle"].to_numpy()
    order = np.lexsort((own, home))
    vectors, cells = _vectors(lefts), rights["cell"].to_numpy()
    radius = np.full(len(pivots), -np.inf)
    np.maximum.at(radius, cells, rights["angle"].to_numpy())
    for start in range(0, len(order), SLICE_ROWS):
        rows = order[start : start + SLICE_ROWS]
        a = angles(vectors[rows], pivots)
        visit = (a <= own[rows, None] + 2 * reach) & (a <= radius + reach)
        inside = np.flatnonzero(dense[home[rows]])
        visit[inside, home[rows][inside]] = False
        columns = np.flatnonzero(visit.any(axis=0)[cells])
        for at in range(0, len(columns), TILE_ROWS):
            yield rows, columns[at : at + TILE_ROWS]


_POINT = ["id", "vec", "weight", "core", "cell", "angle"]


class _Meeting:
    """Pairs of blocks. A task gets both as tables of Arrow."""

    def __init__(self, left: DataFrame, right: DataFrame, lb: int, rb: int, comparisons: int):
        sides = grid_sides(left.select(*_POINT), "id", lb, right.select(*_POINT), "id", rb)
        left, right = (block_tasks(side, ["lb", "rb"], comparisons).groupBy("lb", "rb") for side in sides)
        self.pairs = left.cogroup(right)

    def applyInPandas(self, task: Callable, schema: str) -> DataFrame:  # noqa: N802
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            found = task(_Block(left), _Block(right))
            return pa.table({c: pa.array(found[c], pa.bool_() if c == "border" else pa.int64()) for c in found})

        return self.pairs.applyInArrow(run, schema)


def _degrees(meeting, eps: float, slices: Callable, enough: float = np.inf) -> DataFrame:
    """Neighbour weight of each point, exact below ``enough``: a row that a task has found so much
    for is core, whatever else it meets, and is not compared further there."""

    def count(lefts: pd.DataFrame, rights: pd.DataFrame) -> pd.DataFrame:
        if not len(lefts) or not len(rights):
            return pd.DataFrame(columns=["id", "n"])
        l_vecs, r_vecs = _vectors(lefts), _vectors(rights)
        n, weight = np.zeros(len(lefts)), rights["weight"].to_numpy(np.float64)
        for rows, columns in slices(lefts, rights):
            rows = rows[n[rows] < enough]
            if len(rows):
                row, col = _hits(l_vecs[rows], r_vecs[columns], eps)
                n[rows] += np.bincount(row, weight[columns[col]], len(rows))
        return pd.DataFrame({"id": lefts["id"], "n": n.astype(np.int64)})

    return meeting.applyInPandas(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("degree"))


def _unsettled(label: np.ndarray, core: np.ndarray, rows: np.ndarray, columns: np.ndarray, n_left: int):
    """``rows, columns`` that can still teach something: core rows and columns of the largest group
    among the rows are connected already, so only pairs with one outside it are compared. A row
    that is not core needs every column."""
    groups, size = np.unique(label[rows[core[rows]]], return_counts=True)
    if not len(groups):
        yield rows, columns
        return
    largest = groups[size.argmax()]
    inside = core[rows] & (label[rows] == largest)
    others = columns[label[n_left + columns] != largest]
    if not inside.all():
        yield rows[~inside], columns
    if len(others):
        yield rows[inside], others


def _links(meeting, eps: float, slices: Callable) -> DataFrame:
    """``u, v, border``: core points linked to one core point of their local group, and
    border points (fewer neighbours than ``min_samples`` by definition) to their cores."""

    def link(lefts: pd.DataFrame, rights: pd.DataFrame) -> pd.DataFrame:
        if not len(lefts) or not len(rights):
            return pd.DataFrame(columns=["u", "v", "border"])
        l_vecs, r_vecs = _vectors(lefts), _vectors(rights)
        core, core_right, n_left = lefts["core"].to_numpy(), rights["core"].to_numpy(), len(lefts)
        ids = np.r_[lefts["id"].to_numpy(), rights["id"].to_numpy()]
        label, out = np.arange(len(ids)), []
        for every_row, every_column in slices(lefts, rights):
            every_column = every_column[core_right[every_column]]
            for rows, columns in _unsettled(label, core, every_row, every_column, n_left):
                row, col = _hits(l_vecs[rows], r_vecs[columns], eps)
                row, col = rows[row], n_left + columns[col]
                joins = core[row]
                label = _merge(label, row[joins], col[joins])
                out.append(pd.DataFrame({"u": ids[row[~joins]], "v": ids[col[~joins]], "border": True}))
        edges = pd.DataFrame({"u": ids, "v": ids[label], "border": False})
        return pd.concat([edges[edges["u"] != edges["v"]], *out])

    return meeting.applyInPandas(link, "u bigint, v bigint, border boolean")


def vectors_weight(points: DataFrame) -> int:
    return points.agg(F.sum("weight")).head()[0]


def dbscan(
    records: DataFrame,
    id_col: str = "id",
    vec: str = "embedding",
    eps: float = EPS,
    min_samples: int = MIN_SAMPLES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``id, cluster_id`` for every record that has a vector."""
    if eps <= 0 or min_samples < 1:
        raise ValueError("eps must be positive and min_samples at least 1")
    spark = records.sparkSession
    slots = spark.sparkContext.defaultParallelism
    given = records.where(F.size(vec) > 0).select(F.col(id_col).cast("bigint").alias("id"), unit(vec).alias("vec"))
    is_zero = ~F.exists("vec", lambda x: x != 0)
    vectors = materialise(given.where(~is_zero), "dbscan-vectors")
    # Zero vectors are one point too: 0 from each other and 1 from every unit vector.
    zeros = materialise(given.where(is_zero).select("id"), "dbscan-zeros")
    zero_id, zero_weight = zeros.agg(F.min("id"), F.count(F.lit(1))).head()
    reached_weight = zero_weight if eps >= 1 else 0
    points = materialise(
        vectors.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")), "dbscan-points"
    )
    n_points = points.count()
    pivots = sample_pivots(points, "id", "vec", max(1, -(-n_points // block_rows)), _angle_of(eps / 2))
    if not len(pivots):
        alone = 0 if zero_weight >= min_samples else NOISE
        return zeros.select("id", F.lit(alone).alias("cluster_id"))
    n_cells = len(pivots)
    homes = materialise(to_nearest_pivot(points, "vec", pivots), "dbscan-homes")
    stats = (
        homes.groupBy("cell")
        .agg(F.sum("weight").alias("w"), F.max("angle").alias("r"))
        .collect()
    )
    # Two points of a cell are at most two radii (as angles) apart.
    dense = {s["cell"] for s in stats if 2 * s["r"] <= _angle_of(eps) - _SLACK and s["w"] >= min_samples}
    reach = _angle_of(eps) + _SLACK
    is_dense = np.isin(np.arange(n_cells), list(dense))

    in_dense = F.col("cell").isin([int(c) for c in dense]) if dense else F.lit(False)
    flagged = homes.withColumn("core", in_dense)
    shared = spark.sparkContext.broadcast(pivots)

    def slices(lefts: pd.DataFrame, rights: pd.DataFrame):
        return _slices(lefts, rights, shared.value, reach, is_dense)

    lb, rb = grid_counts(n_points, n_points, block_rows, slots, pivots.shape[1])
    comparisons = n_points * n_points
    degrees = _degrees(
        _Meeting(flagged.where(~F.col("core")), flagged, lb, rb, comparisons), eps, slices, max(1, min_samples - reached_weight))
    with_core = materialise(
        flagged.join(degrees, "id", "left").withColumn(
            "core", F.col("core") | (F.coalesce("degree", F.lit(0)) + reached_weight >= min_samples)
        ),
        "dbscan-cores",
    )
    # A point that meets nothing but itself has no link.
    met = with_core.where(F.col("core") | (F.col("degree") > F.col("weight")))
    links = materialise(_links(_Meeting(met, with_core.where("core"), lb, rb, comparisons), eps, slices), "dbscan-links")
    first_of_cell = with_core.where(in_dense).groupBy("cell").agg(F.min("id").alias("v"))
    spokes = with_core.where(in_dense).join(F.broadcast(first_of_cell), "cell").select(F.col("id").alias("u"), "v")
    edges = links.where(~F.col("border")).select("u", "v").unionByName(spokes)
    cores, borders = with_core.where("core").select("id"), links.where("border").select("u", "v")
    if zero_weight:
        # Within reach (eps of 1 or more) the zero point touches all others.
        zero = spark.range(1).select(F.lit(zero_id).cast("bigint").alias("id"))
        touched = vectors_weight(points) if eps >= 1 else 0
        if zero_weight + touched >= min_samples:
            cores = cores.unionByName(zero)
            if eps >= 1:
                hub = F.lit(zero_id).cast("bigint").alias("v")
                edges = edges.unionByName(with_core.where("core").select(F.col("id").alias("u"), hub))
                borders = borders.unionByName(with_core.where(~F.col("core")).select(F.col("id").alias("u"), hub))
        elif eps >= 1:
            borders = borders.unionByName(
                with_core.where("core").select(F.lit(zero_id).cast("bigint").alias("u"), F.col("id").alias("v"))
            )
    components = connected_components(edges)

    roots = cores.join(
        components.withColumnRenamed("node", "id"), "id", "left"
    ).select("id", F.coalesce("root", "id").alias("root"))
    numbers = row_ordinal(roots.select("root").distinct(), "root", "number")
    of_core = materialise(roots.join(numbers, "root").select("id", F.col("number").cast("int").alias("cluster_id")), "dbscan-labels")
    of_border = (
        borders.select(F.col("u").alias("point"), F.col("v").alias("id"))
        .join(of_core, "id")
        .groupBy("point")
        .agg(F.min("cluster_id").alias("cluster_id"))
        .withColumnRenamed("point", "id")
    )
    labelled = of_core.unionByName(of_border)
    of_point = points.join(labelled, "id", "left").select(
        "vec", F.coalesce("cluster_id", F.lit(NOISE)).alias("cluster_id")
    )
    found = vectors.join(of_point, "vec").select("id", "cluster_id")
    if not zero_weight:
        return found
    # One row or none.
    of_zero = labelled.where(F.col("id") == zero_id).agg(F.coalesce(F.min("cluster_id"), F.lit(NOISE)).alias("cluster_id"))
    return found.unionByName(zeros.join(F.broadcast(of_zero)).select("id", "cluster_id"))
