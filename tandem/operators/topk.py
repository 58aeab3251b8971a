"""Top-k cosine join: for every left vector its k most similar right vectors.

The join runs over pairs of row blocks. A task holds one left and one right block, scores
them tile by tile and emits at most k rows per left row. Blocks are made by id hash and form a
grid of at most ``GRID`` blocks a side while a block fits a task, so a row travels a bounded number
of times however many rows there are: the bytes shuffled grow with the rows, never with the pairs.

* ``exact`` on small right sides: every left row meets every right row.
* ``exact`` on larger ones: right rows know their Voronoi cell around sampled pivots. Inside a
  task a left row takes the nearest cells first, then only cells whose angular bound can still
  beat its k-th score. Nothing a cell is skipped for could have entered the result.
* ``exact`` for few left rows: these are taken to the right rows, which stay where they are.
* ``approximate``: cells are hash buckets of random hyperplanes; the own buckets and
  the nearest neighbour buckets are visited.

Scores are ranked after rounding to nine decimals, ties by right id, so the result does not
depend on blocking.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.vectors import unit
from tandem.operators.cells import (
    GRID,
    GRID_NUMBERS,
    angles,
    block_tasks,
    grid_counts,
    grid_sides,
    matrix,
    sample_pivots,
    to_nearest_pivot,
    width_of,
)
from tandem.operators.codedtopk import coded, exact_scores, surviving_pairs
from tandem.session import materialise

BLOCK_ROWS = 4096
SLICE_ROWS = 512
TILE_ROWS = 4096
SCORE_DIGITS = 9
_TOLERANCE = 1e-7


def block_topk(
    lefts: np.ndarray, rights: np.ndarray, ids: np.ndarray, k: int, bound: Callable[[int, int], np.ndarray] | None = None,
    cells: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left row, right id and score of each left row's k best right rows, ties by id.

    Right rows pass in tiles; the k-th score so far tells which scores of a tile can count. Of equal
    right rows only the first k by id are looked at. Where ``cells`` gives the cell of every right
    row and ``bound(start, stop)`` the best score that each of these left rows can reach in each
    cell, tiles are taken cell by cell from the most promising one, and cells that no left row of a
    slice can use are passed over.
    """
    order = np.argsort(ids, kind="stable")
    order = order[_copies_before(rights[order]) < k]
    if cells is not None:
        order = order[np.argsort(cells[order], kind="stable")]
        cells = cells[order]
    rights, ids = rights[order], ids[order]
    out = []
    for start in range(0, len(lefts), SLICE_ROWS):
        part = lefts[start : start + SLICE_ROWS]
        row, right, score = np.empty(0, np.int64), ids[:0], np.empty(0)
        kth = np.full(len(part), -np.inf)
        for columns in _tiles(len(ids), cells, bound and bound(start, start + len(part)), lambda: kth):
            scores = part @ rights[columns].T
            least = kth - _TOLERANCE
            if scores.shape[1] > k:
                fresh = np.isneginf(kth)
                if fresh.any():
                    least[fresh] = np.partition(scores[fresh], -k, axis=1)[:, -k] - _TOLERANCE
            r, c = np.nonzero(scores >= least[:, None])
            if not len(r):
                continue
            row, right = np.r_[row, r], np.r_[right, ids[columns][c]]
            score = np.r_[score, np.round(scores[r, c], SCORE_DIGITS)]
            best = np.lexsort((right, -score, row))
            row, right, score = row[best], right[best], score[best]
            place = _places(row)
            kept = place < k
            row, right, score, place = row[kept], right[kept], score[kept], place[kept]
            last = place == k - 1
            kth[row[last]] = score[last]
        out.append((row + start, right, score))
    return tuple(np.concatenate(x) for x in zip(*out))


def _places(groups: np.ndarray) -> np.ndarray:
    """Position of each entry within its run of equal values."""
    first = np.r_[0, np.flatnonzero(np.diff(groups)) + 1]
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.r_[first, len(groups)]))


def _copies_before(vectors: np.ndarray) -> np.ndarray:
    """How many earlier rows are equal to each row."""
    return pd.DataFrame({"v": [v.tobytes() for v in np.ascontiguousarray(vectors)]}).groupby("v").cumcount().to_numpy()


def _tiles(n: int, cells: np.ndarray | None, bound: np.ndarray | None, kth: Callable[[], np.ndarray]) -> Iterator[slice | np.ndarray]:
    """The columns to score next; ``bound`` holds a row per left row and a column per cell."""
    if bound is None:
        yield from (slice(at, at + TILE_ROWS) for at in range(0, n, TILE_ROWS))
        return
    first, last = (np.searchsorted(cells, np.arange(bound.shape[1]), side) for side in ("left", "right"))
    waiting = [c for c in np.argsort(-bound.max(axis=0), kind="stable") if last[c] > first[c]]
    while waiting:
        usable = (bound[:, waiting] >= (kth() - _TOLERANCE)[:, None]).any(axis=0)
        waiting = [c for c, u in zip(waiting, usable) if u]
        taken, size = [], 0
        while waiting and size < TILE_ROWS:
            c = waiting.pop(0)
            taken.append(np.arange(first[c], last[c]))
            size += len(taken[-1])
        columns = np.concatenate(taken) if taken else np.empty(0, np.int64)
        yield from (columns[at : at + TILE_ROWS] for at in range(0, len(columns), TILE_ROWS))


Kernel = Callable[[pd.DataFrame, pd.DataFrame], "tuple[np.ndarray, np.ndarray, np.ndarray]"]


def _score_blocks(
    left: DataFrame, right: DataFrame, keys: Sequence[str], k: int, by: Sequence[str] = (), comparisons: int | None = None,
    kernel: Kernel | None = None,
) -> DataFrame:
    """Local top-k of every (left block, right block) that share a key; ``comparisons`` is
    about the number of vector pairs that meet, where known."""
    schema = left.select(*by, "left_id", F.lit(0).cast("bigint").alias("right_id"), F.lit(0.0).alias("score")).schema

    def plain(lefts: pd.DataFrame, rights: pd.DataFrame):
        return block_topk(matrix(lefts["left_vec"]), matrix(rights["right_vec"]), rights["right_id"].to_numpy(), k)

    def score(lefts: pd.DataFrame, rights: pd.DataFrame) -> pd.DataFrame:
        if not len(lefts) or not len(rights):
            return pd.DataFrame(columns=schema.names)
        row, right_ids, scores = (kernel or plain)(lefts, rights)
        best = pd.DataFrame({"left_id": lefts["left_id"].to_numpy()[row], "right_id": right_ids, "score": scores})
        return best.assign(**{b: lefts[b].iloc[0] for b in by})[schema.names]

    left, right = (block_tasks(side, keys, comparisons) for side in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, schema)


def _best(scored: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    order = Window.partitionBy(*by, "left_id").orderBy(F.desc("score"), "right_id")
    return (
        scored.withColumn("cand_pos", F.row_number().over(order))
        .where(F.col("cand_pos") <= k)
        .select(*by, "left_id", "right_id", F.col("score").alias("cosine_score"), "cand_pos")
    )


def _hash_blocks(
    left: DataFrame, right: DataFrame, lb: int, rb: int, k: int, comparisons: int, kernel: Kernel | None = None
) -> DataFrame:
    lefts, rights = grid_sides(left, "left_id", lb, right, "right_id", rb)
    return _score_blocks(lefts, rights, ["lb", "rb"], k, comparisons=comparisons, kernel=kernel)


def _hash_blocks_by(left: DataFrame, right: DataFrame, by: Sequence[str], k: int, block_rows: int) -> DataFrame:
    """Hash blocks within each value of ``by``; every value gets blocks for its own size, at most
    ``GRID`` a side while these fit a task, so that rows travel a bounded number of times."""
    rows = GRID_NUMBERS // max(1, width_of(right, "right_vec"))

    def blocks(df: DataFrame, name: str) -> DataFrame:
        n = F.count(F.lit(1))
        return df.groupBy(*by).agg(F.greatest(F.least(F.ceil(n / block_rows), F.lit(GRID)), F.ceil(n / rows)).cast("int").alias(name))

    sizes = blocks(left, "n_lb").join(blocks(right, "n_rb"), list(by))

    def cut(df: DataFrame, id_col: str, own: str, other: str) -> DataFrame:
        sized = df.join(sizes, list(by))
        return sized.withColumn(own, F.pmod(F.xxhash64(id_col), F.col(f"n_{own}")).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1))
        ).drop("n_lb", "n_rb")

    return _score_blocks(
        cut(left, "left_id", "lb", "rb"), cut(right, "right_id", "rb", "lb"), [*by, "lb", "rb"], k, by
    )


def visit(
    left: DataFrame, right: DataFrame, k: int, block_rows: int, width: int, decode: Callable[[pd.DataFrame], np.ndarray] | None = None
) -> DataFrame:
    """Score ``left`` (array column ``cells``) against the right rows of at least the cells it names;
    ``right`` has an array column ``cells`` too. Rows meet in a grid of id blocks; a task scores
    left rows that name alike cells together, against the right rows of any of these. ``decode``
    makes the vectors (of ``width``) of right rows that travel in another form."""

    def kernel(lefts: pd.DataFrame, rights: pd.DataFrame):
        named = np.vstack(lefts["cells"].to_numpy())
        order = np.lexsort((lefts["left_id"].to_numpy(), named[:, 0]))
        l_vecs, r_vecs = matrix(lefts["left_vec"])[order], decode(rights) if decode else matrix(rights["right_vec"])
        of_right, ids = np.vstack(rights["cells"].to_numpy()), rights["right_id"].to_numpy()
        n_cells = max(named.max(), of_right.max()) + 1
        found = []
        for start in range(0, len(order), SLICE_ROWS):
            rows = order[start : start + SLICE_ROWS]
            wanted = np.zeros(n_cells, bool)
            wanted[named[rows]] = True
            met = wanted[of_right].any(axis=1)
            if met.any():
                part = l_vecs[start : start + SLICE_ROWS]
                row, right_ids, scores = block_topk(part, r_vecs if met.all() else r_vecs[met], ids if met.all() else ids[met], k)
                found.append((rows[row], right_ids, scores))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), ids[:0], np.empty(0))

    n_left, n_right = left.count(), right.count()
    lb, rb = grid_counts(n_left, n_right, block_rows, left.sparkSession.sparkContext.defaultParallelism, width)
    return _hash_blocks(left, right, lb, rb, k, n_left * n_right, kernel)


def _pruned_cells(left: DataFrame, right: DataFrame, n_left: int, n_right: int, k: int, block_rows: int) -> DataFrame:
    pivots = sample_pivots(right, "right_id", "right_vec", max(2, -(-n_right // block_rows)))
    spark = left.sparkSession
    lb, rb = grid_counts(n_left, n_right, block_rows, spark.sparkContext.defaultParallelism, pivots.shape[1])
    if not len(pivots):
        return _hash_blocks(left, right, lb, rb, k, 0)
    shared = spark.sparkContext.broadcast(pivots)

    def kernel(lefts: pd.DataFrame, rights: pd.DataFrame):
        cells, centres = rights["cell"].to_numpy(), shared.value
        radius = np.full(len(centres), -np.inf)
        np.maximum.at(radius, cells, rights["angle"].to_numpy())
        vectors = matrix(lefts["left_vec"])
        # Left rows of one cell follow each other, so that a slice has few cells to visit.
        order = np.argsort(_nearest(vectors, centres), kind="stable")
        vectors = vectors[order]

        def bound(start: int, stop: int) -> np.ndarray:
            # Nothing in an empty cell, nothing nearer in another than its radius allows.
            reach = angles(vectors[start:stop], centres) - radius
            return np.where(np.isinf(radius), -np.inf, np.cos(np.clip(reach - _TOLERANCE, 0.0, np.pi)))

        row, right_ids, scores = block_topk(vectors, matrix(rights["right_vec"]), rights["right_id"].to_numpy(), k, bound, cells)
        return order[row], right_ids, scores

    return _hash_blocks(left, to_nearest_pivot(right, "right_vec", pivots), lb, rb, k, n_left * n_right, kernel)


def _against_few(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Local top-k of at most ``SLICE_ROWS`` left rows in every partition of the right side: the few
    left vectors go to where the right rows are, and these do not travel."""
    schema = left.select("left_id", F.lit(0).cast("bigint").alias("right_id"), F.lit(0.0).alias("score")).schema
    few = left.select("left_id", "left_vec").toArrow()
    left_ids = few.column("left_id").to_numpy()
    shared = left.sparkSession.sparkContext.broadcast(np.array(few.column("left_vec").to_pylist(), np.float64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, right, best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("right_vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            found = block_topk(shared.value, vectors, batch.column("right_id").to_numpy(), k)
            row, right, best = (np.r_[x, y] for x, y in zip((row, right, best), found))
            order = np.lexsort((right, -best, row))
            order = order[_places(row[order]) < k]
            row, right, best = row[order], right[order], best[order]
        yield pa.RecordBatch.from_arrays([pa.array(left_ids[row]), pa.array(right), pa.array(best)], names=schema.names)

    return right.select("right_id", "right_vec").mapInArrow(score, schema)


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(vectors[at : at + TILE_ROWS] @ centres.T).argmax(axis=1) for at in range(0, len(vectors), TILE_ROWS)])


def _unit_sides(left, right, left_id, left_vec, right_id, right_vec, by=()):
    keys = [F.col(b).alias(b) for b in by]
    # Filtered before the division: a filter on the result would divide twice.
    lefts, rights = left.where(F.size(left_vec) > 0), right.where(F.size(right_vec) > 0)
    return (
        lefts.select(*keys, F.col(left_id).cast("bigint").alias("left_id"), unit(left_vec).alias("left_vec")),
        rights.select(*keys, F.col(right_id).cast("bigint").alias("right_id"), unit(right_vec).alias("right_vec")),
    )


def topk_cosine(
    left: DataFrame,
    right: DataFrame,
    k: int,
    *,
    left_id: str = "left_id",
    left_vec: str = "left_vec",
    right_id: str = "right_id",
    right_vec: str = "right_vec",
    by: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
    method: str = "auto",
    **approximate,
) -> DataFrame:
    """Top-k: ``left_id, right_id, cosine_score, cand_pos``.

    ``method`` is ``blocks``, ``coded`` (blocks of one-byte codes with error bounds), ``cells`` or
    ``auto`` (once the right side has more than sixteen blocks cells, or for few left rows every right
    row where it is), all exact, or ``approximate``: through an index of cells and codes made
    for this call, tuned to find nearly all (``vectorindex``), or with settings of
    ``approximate_topk`` through hyperplane hashes. Rows without a vector take no part. With ``by`` columns the join
    runs within each of their values, all in one job.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if method == "approximate":
        if by:
            raise ValueError("approximate search does not run within groups")
        if not approximate:
            from tandem.operators.vectorindex import temporary_index

            return temporary_index(right, k, right_id, right_vec).search(left, k, left_id, left_vec, block_rows=block_rows)
        ids = {"left_id": left_id, "left_vec": left_vec, "right_id": right_id, "right_vec": right_vec}
        return approximate_topk(left, right, k, **ids, block_rows=block_rows, **approximate)
    if approximate:
        raise ValueError(f"exact search has no setting {', '.join(approximate)}")
    lefts, rights = _unit_sides(left, right, left_id, left_vec, right_id, right_vec, by)
    if by:
        return _best(_hash_blocks_by(lefts, rights, by, k, block_rows), k, by)
    n_left, n_right = left.count(), right.count()
    if method == "auto" and 0 < n_left <= SLICE_ROWS and n_right > 16 * block_rows:
        return _best(_against_few(lefts, rights, k), k)
    if method == "cells" or (method == "auto" and n_right > 16 * block_rows):
        return _best(_pruned_cells(lefts, rights, n_left, n_right, k, block_rows), k)
    slots = left.sparkSession.sparkContext.defaultParallelism
    lb, rb = grid_counts(n_left, n_right, block_rows, slots, width_of(rights, "right_vec") if n_right > 16 * BLOCK_ROWS else 0)
    if method == "coded":
        codes = coded(lefts, "left_id", "left_vec"), coded(rights, "right_id", "right_vec")
        pairs = surviving_pairs(*codes, lb, rb, k, n_left * n_right)
        return _best(exact_scores(pairs, lefts, rights, SCORE_DIGITS), k)
    return _best(_hash_blocks(lefts, rights, lb, rb, k, n_left * n_right), k)


def approximate_topk(
    left: DataFrame,
    right: DataFrame,
    k: int,
    *,
    left_id: str = "left_id",
    left_vec: str = "left_vec",
    right_id: str = "right_id",
    right_vec: str = "right_vec",
    tables: int = 4,
    bits: int = 8,
    probes: int = 3,
    block_rows: int = BLOCK_ROWS,
    seed: int = 42,
) -> DataFrame:
    """Top-k among rows that share a hyperplane-hash bucket in one of ``tables`` tables.

    Each left row visits its own bucket and the ``probes - 1`` buckets nearest to it per
    table. A table has ``2 ** bits`` buckets at every size of the input. Left rows with alike
    buckets are scored together against the right rows of any of them. Same columns as the
    exact join; scores are exact, some neighbours may be missing.
    """
    lefts, rights = _unit_sides(left, right, left_id, left_vec, right_id, right_vec)
    width_row = rights.select(F.size("right_vec").alias("d")).head()
    if width_row is None:
        return topk_cosine(left, right, k, left_id=left_id, left_vec=left_vec, right_id=right_id, right_vec=right_vec)
    planes = np.random.default_rng(seed).standard_normal((tables, bits, width_row["d"]))
    weights = 1 << np.arange(bits)

    def buckets(vec: str, probes: int):
        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                found = []
                for t in range(tables):
                    side = matrix(batch[vec]) @ planes[t].T
                    own = (side > 0) @ weights
                    found.append(own + (t << bits))
                    # Flip the bits whose hyperplanes are closest.
                    flips = np.argsort(np.abs(side), axis=1)[:, : probes - 1]
                    found += [(own ^ weights[flips[:, j]]) + (t << bits) for j in range(flips.shape[1])]
                yield batch.assign(cells=list(np.stack(found, axis=1).astype(np.int32)))

        return assign

    def with_cells(df: DataFrame, vec: str, probes: int) -> DataFrame:
        schema = df.withColumn("cells", F.array().cast("array<int>")).schema
        return df.mapInPandas(buckets(vec, probes), schema)

    homes = materialise(with_cells(rights, "right_vec", 1), "lsh-right")
    visits = materialise(with_cells(lefts, "left_vec", probes), "lsh-left")
    return _best(visit(visits, homes, k, block_rows, width_row["d"]), k)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact pairs found: ``exact_pairs, found_pairs, recall``."""
    found = approximate.select("left_id", "right_id", F.lit(1).alias("hit"))
    joined = exact.select("left_id", "right_id").join(found, ["left_id", "right_id"], "left")
    return joined.agg(
        F.count(F.lit(1)).alias("exact_pairs"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found_pairs")
    ).withColumn("recall", F.col("found_pairs") / F.col("exact_pairs"))
