"""Exact top-k cosine join over one-byte codes with error bounds.

Vectors travel to the blocks as one byte per dimension, a scale and the length of what the code
leaves out. For two unit vectors the true cosine differs from that of their codes by at most
``e + (1 + e) * f``, so every pair has a lower and an upper bound. A pair whose upper bound is
below the k-th best lower bound of its left row cannot be among the k best; only the others fetch
their full vectors and are scored exactly, which is a few more than k per left row.

Of equal vectors only the first k by id can be in a result, so a large group of copies does not
travel on in full. The result is that of the plain join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.vectors import dot
from tandem.operators.cells import block_tasks, grid_sides

_ROUNDING = 1e-9
SLICE_ROWS = 512


def coded(units: DataFrame, id_col: str, vec: str) -> DataFrame:
    """``id, code, scale, error, digest`` of unit vectors: the code is one signed byte per dimension."""

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = batch.column(vec).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                scale = np.maximum(np.abs(vectors).max(axis=1) / 127, np.finfo(np.float32).tiny).astype(np.float32)
                codes = np.rint(vectors / scale[:, None]).clip(-127, 127).astype(np.int8)
                error = np.linalg.norm(vectors - codes * scale[:, None].astype(np.float64), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale),
                     pa.array(np.nextafter(error.astype(np.float32), np.float32(np.inf))), batch.column("digest")],
                    names=[id_col, "code", "scale", "error", "digest"])

    # 16 bytes tell equal vectors.
    digest = F.substring(F.unhex(F.sha2(F.array_join(F.transform(vec, lambda x: x.cast("string")), ",").cast("binary"), 256)), 1, 16)
    rows = units.select(id_col, vec, digest.alias("digest"))
    return rows.mapInArrow(code, f"{id_col} long, code binary, scale float, error float, digest binary")


def _decoded(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(rows["code"]), np.int8).reshape(len(rows), -1)
    return codes * rows["scale"].to_numpy(np.float64)[:, None], rows["error"].to_numpy(np.float64)


def surviving_pairs(lefts: DataFrame, rights: DataFrame, lb: int, rb: int, k: int, comparisons: int) -> DataFrame:
    """``left_id, right_id`` of pairs that can be among the k best of their left row."""
    names = ["left_id", "right_id", "lower", "upper"]

    def bounds(l_rows: pd.DataFrame, r_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(l_rows) or not len(r_rows):
            return pd.DataFrame(columns=names)
        r_rows = r_rows.sort_values("right_id")
        r_rows = r_rows[r_rows.groupby("digest").cumcount() < k]
        ids, (r_vecs, r_error) = r_rows["right_id"].to_numpy(), _decoded(r_rows)
        found = []
        # So few left rows at a time that their bounds stay at 32 MB.
        step = max(1, min(SLICE_ROWS, (1 << 22) // max(1, len(ids))))
        for start in range(0, len(l_rows), step):
            part = l_rows.iloc[start : start + step]
            l_vecs, l_error = _decoded(part)
            near = l_vecs @ r_vecs.T
            slack = l_error[:, None] + (1 + l_error)[:, None] * r_error[None, :] + _ROUNDING
            lower, upper = near - slack, near + slack
            if len(ids) > k:
                keep = upper >= np.partition(lower, -k, axis=1)[:, [-k]]
            else:
                keep = np.ones(near.shape, bool)
            row, col = np.nonzero(keep)
            found.append(pd.DataFrame({
                "left_id": part["left_id"].to_numpy()[row], "right_id": ids[col], "lower": lower[row, col], "upper": upper[row, col]}))
        return pd.concat(found)

    sides = grid_sides(lefts, "left_id", lb, rights, "right_id", rb)
    left, right = (block_tasks(side, ["lb", "rb"], comparisons) for side in sides)
    local = left.groupBy("lb", "rb").cogroup(right.groupBy("lb", "rb")).applyInPandas(
        bounds, "left_id long, right_id long, lower double, upper double")
    # The k-th best lower bound over all blocks.
    best = Window.partitionBy("left_id").orderBy(F.desc("lower"), "right_id")
    ranked = local.withColumn("place", F.row_number().over(best))
    kth = F.max(F.when(F.col("place") == k, F.col("lower"))).over(Window.partitionBy("left_id"))
    return ranked.withColumn("kth", kth).where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))).select("left_id", "right_id")


def exact_scores(pairs: DataFrame, lefts: DataFrame, rights: DataFrame, digits: int) -> DataFrame:
    """``left_id, right_id, score`` of the pairs from the full vectors."""
    met = pairs.join(rights, "right_id").join(lefts, "left_id")
    return met.select("left_id", "right_id", F.round(dot("left_vec", "right_vec"), digits).alias("score"))
