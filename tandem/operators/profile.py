"""Browsing and profiling of sheets and records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions.cells import cell_text, contextual_content, quoted, strip, vector_preview
from tandem.functions.patterns import RowFilter, require_valid, row_filter
from tandem.sources.records import SIDES

# Values listed by default.
MAX_VALUES = 100


def page(size: int) -> int:
    """The caller's page size; a page holds at least one row."""
    if size < 1:
        raise ValueError("a page holds at least one row")
    return size


def filtered(rows: DataFrame, filters: Sequence[RowFilter]) -> DataFrame:
    require_valid(filters, rows.columns)
    return rows.where(row_filter(filters, rows.columns))


def browse_records(records: DataFrame, side: str | None = None, limit: int = 25) -> DataFrame:
    """First ``limit`` records by id with a vector preview and the total in ``total``."""
    if side is not None:
        if side not in SIDES:
            raise ValueError("side must be 'left' or 'right'")
        records = records.where(F.col("side") == side)
    total = records.agg(F.count(F.lit(1)).alias("total"))
    first = records.orderBy("id").limit(page(limit))
    if "embedding" in records.columns:
        first = first.withColumn("embedding", vector_preview("embedding"))
    return first.join(F.broadcast(total))


def volume_statistics(records: DataFrame) -> DataFrame:
    """One row: counts and mean text lengths per side, and the estimated token volume."""

    def per_side(side: str):
        mine = F.col("side") == side
        mean = F.coalesce(F.avg(F.when(mine, F.length("contextual_content"))), F.lit(0.0))
        return [F.count_if(mine).alias(f"records_{side}"), mean.alias(f"avg_chars_{side}")]

    volume = F.col("avg_chars_left") * F.col("records_left") + F.col("avg_chars_right") * F.col("records_right")
    return records.agg(*per_side("left"), *per_side("right")).withColumn(
        "est_embed_tokens", F.floor(volume / 4).cast("bigint")
    )


def _first_values(values: DataFrame, order, max_values: int) -> DataFrame:
    """First values in order and whether there were more. One row beyond the limit is
    fetched to know."""
    first = values.orderBy(*order).limit(max_values + 1)
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    entry = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], "value")
    listed = first.agg(F.array_sort(F.collect_list(entry)).alias("all"))
    ordered = F.transform("all", lambda x: x["value"])
    return listed.select(
        F.explode(F.slice(ordered, 1, max_values)).alias("value"), (F.size("all") > max_values).alias("truncated")
    )


def distinct_values(records: DataFrame, column: str, max_values: int = MAX_VALUES) -> DataFrame:
    """``value, truncated``: non-null values of a stored column in order."""
    values = records.select(quoted(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    return _first_values(values, ["value"], max_values)


def distinct_cells(
    rows: DataFrame, column: str, filters: Sequence[RowFilter] = (), max_values: int = MAX_VALUES
) -> DataFrame:
    """``value, truncated``: cell texts by (lower case, text) after the other filters. The
    blank value counts for ``truncated`` but is not listed."""
    if column not in rows.columns:
        raise ValueError(f"unknown column: {column!r}")
    values = filtered(rows, filters).select(cell_text(quoted(column)).alias("value")).distinct()
    return _first_values(values, [F.lower("value"), "value"], max_values).where(F.col("value") != "")


def column_samples(rows: DataFrame, columns: Sequence[str], order: str, n: int = 5) -> DataFrame:
    """``column, position, value``: the first n cells of each column."""
    known = [c for c in columns if c in rows.columns]
    first = rows.orderBy(order).limit(page(n))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), cell_text(quoted(c)).alias("value")) for c in known])
    listed = first.agg(F.array_sort(F.collect_list(F.struct(quoted(order).alias("o"), cells.alias("cells")))).alias("rows"))
    return listed.select(F.posexplode("rows").alias("position", "row")).select(
        "position", F.explode("row.cells").alias("cell")
    ).select("cell.column", "position", "cell.value")


def filter_counts(rows: DataFrame, filters: Sequence[RowFilter]) -> DataFrame:
    """``rows_unfiltered, rows_filtered`` in one pass."""
    require_valid(filters, rows.columns)
    return rows.agg(
        F.count(F.lit(1)).alias("rows_unfiltered"),
        F.count_if(row_filter(filters, rows.columns)).alias("rows_filtered"),
    )


def context_preview(
    rows: DataFrame,
    order: str,
    context_columns: Sequence[str],
    content_column: str | None,
    filters: Sequence[RowFilter] = (),
    n: int = 3,
) -> DataFrame:
    """The first n record texts that the chosen columns would give."""
    if not context_columns and not content_column:
        raise ValueError("choose at least one column")
    text = contextual_content(context_columns, content_column)
    built = filtered(rows, filters).select(quoted(order).alias("row_no"), text.alias("sample"))
    return built.where(strip("sample") != "").orderBy("row_no").limit(page(n))
