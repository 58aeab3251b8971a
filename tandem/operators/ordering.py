"""Global row order without a single-task window: ordinals and forward fill.

Both work in blocks of consecutive order values. A block is bounded by ``block_rows``
because the order column is a unique whole number, so no window ever sorts more than one
block, however large or uneven a group is. Only one summary row per block is ordered
globally.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.cells import quoted

BLOCK_ROWS = 1_000_000
_BLOCK = "__block"


def _with_block(df: DataFrame, order: str, block_rows: int) -> DataFrame:
    return df.withColumn(_BLOCK, F.floor(quoted(order) / F.lit(block_rows)))


def _same_keys(summary: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """A summary table and the condition that joins rows to it; a null key is a key."""
    renamed = summary.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    return renamed, reduce(and_, [quoted(k).eqNullSafe(quoted(f"__of_{k}")) for k in keys])


def row_ordinal(
    df: DataFrame,
    order: str,
    name: str = "original_row",
    group: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds the 0-based position of each row within its group, by a unique integer column."""
    keys = [*group, _BLOCK]
    blocked = _with_block(df, order, block_rows)
    before = Window.partitionBy(*group).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocked.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(quoted(order)))
    return (
        blocked.withColumn("__local", local)
        .join(*_same_keys(starts, keys))
        .withColumn(name, F.col("__start") + F.col("__local") - 1)
        .drop(_BLOCK, "__local", "__start", *[f"__of_{k}" for k in keys])
    )


def forward_fill(
    df: DataFrame,
    columns: Sequence[str],
    order: str,
    group: Sequence[str] = ("sheet_name",),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Replaces each null by the last value above it in the same group."""
    keys = [*group, _BLOCK]
    blocked = _with_block(df, order, block_rows)
    last_values = [
        F.max_by(quoted(c), F.when(quoted(c).isNotNull(), quoted(order))).alias(f"__last{i}")
        for i, c in enumerate(columns)
    ]
    above = Window.partitionBy(*group).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocked.groupBy(*keys)
        .agg(*last_values)
        .select(
            *keys,
            *[
                F.last(f"__last{i}", ignorenulls=True).over(above).alias(f"__carry{i}")
                for i in range(len(columns))
            ],
        )
    )
    inside = (
        Window.partitionBy(*keys)
        .orderBy(quoted(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = blocked
    local = {c: F.last(quoted(c), ignorenulls=True).over(inside) for c in columns}
    filled = filled.withColumns(local).join(*_same_keys(carried, keys))
    return filled.withColumns(
        {c: F.coalesce(quoted(c), F.col(f"__carry{i}")) for i, c in enumerate(columns)}
    ).select(*[quoted(c) for c in df.columns])
