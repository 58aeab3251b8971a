"""Workbooks as named sheet tables: scan, select, profile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions.cells import quoted
from tandem.operators.ordering import BLOCK_ROWS, forward_fill

ROW_NO = "row_no"
SHEET = "sheet_name"


def read_sheet_files(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet", **options) -> dict[str, DataFrame]:
    """Sheet name to table. The files must carry a ``row_no`` column with the row order."""
    return {name: spark.read.format(fmt).options(**options).load(path) for name, path in paths.items()}


def select_sheet(sheets: Mapping[str, DataFrame], sheet: str | None, label: str = "workbook") -> dict[str, DataFrame]:
    """One sheet, or the only one; a workbook with several needs a choice."""
    wanted = (sheet or "").strip()
    if not wanted:
        if len(sheets) > 1:
            raise ValueError(f"{label}: choose a sheet (the workbook has several)")
        return dict(sheets)
    if wanted not in sheets:
        raise ValueError(f"{label}: unknown sheet {wanted!r}")
    return {wanted: sheets[wanted]}


def _as_text(df: DataFrame, name: str, order: str) -> DataFrame:
    data = [quoted(c).cast("string").alias(c) for c in df.columns if c != order]
    return df.select(F.lit(name).alias(SHEET), quoted(order).cast("bigint").alias(ROW_NO), *data)


def clean_rows(df: DataFrame, columns: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Forward fill, then drop rows that are still empty.

    In this order only the blank rows above the first value of a sheet disappear; a blank
    row further down becomes a copy of the row above it.
    """
    filled = forward_fill(df, columns, ROW_NO, (SHEET,), block_rows)
    return filled.where(reduce(lambda a, b: a | b, [quoted(c).isNotNull() for c in columns]))


def scan_sheets(
    sheets: Mapping[str, DataFrame], order: str = ROW_NO, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """All sheets as text in one table: columns are united by name, ``sheet_name`` added.

    Each sheet is filled over its own columns only, so a column that a sheet lacks stays
    null there; all sheets are filled in one pass because the fill is per sheet anyway.
    """
    texts = [_as_text(df, name, order) for name, df in sheets.items()]
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), texts)
    columns = [c for c in united.columns if c not in (SHEET, ROW_NO)]
    return clean_rows(united, columns, block_rows)


def sheet_profile(scanned: DataFrame, sheets: Mapping[str, DataFrame], order: str = ROW_NO) -> DataFrame:
    """Cleaned row count and column names per sheet, in one pass over all of them."""
    names = F.create_map(
        *[
            x
            for name, df in sheets.items()
            for x in (F.lit(name), F.array(*[F.lit(c) for c in df.columns if c != order]))
        ]
    )
    return (
        scanned.groupBy(SHEET)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(SHEET, "row_count", F.element_at(names, F.col(SHEET)).alias("columns"))
    )
