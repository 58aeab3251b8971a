"""Record, match and export tables: building them from cleaned sheets and writing them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.cells import (
    as_column,
    contextual_content,
    display_value,
    quoted,
    stored_column_names,
    stored_value,
    strip,
)
from tandem.operators.ordering import BLOCK_ROWS, row_ordinal

SIDES = ("left", "right")
# Fixed value: widest vector the vector index takes.
MAX_VECTOR_WIDTH = 2000


def corpus_records(
    rows: DataFrame,
    order: str,
    stored_columns: Sequence[str],
    context_columns: Sequence[str],
    content_column: str | None,
    sheet: Column | str = "sheet_name",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``id, sheet_name, col_*, contextual_content`` with ids 1.. in source order."""
    missing = sorted({*stored_columns, *context_columns, *([content_column] if content_column else [])} - set(rows.columns))
    if missing:
        raise ValueError(f"unknown columns: {missing}")
    names = stored_column_names(stored_columns)
    built = rows.select(
        quoted(order).alias("__order"),
        as_column(sheet).cast("string").alias("sheet_name"),
        *[stored_value(quoted(c)).alias(n) for c, n in names.items()],
        contextual_content(context_columns, content_column, sheet).alias("contextual_content"),
    ).where(strip("contextual_content") != "")
    numbered = row_ordinal(built, "__order", "id", block_rows=block_rows)
    return numbered.select(
        (F.col("id") + 1).alias("id"), "sheet_name", *names.values(), "contextual_content"
    )


def side_records(
    rows: DataFrame,
    side: str,
    order: str,
    context_columns: Sequence[str],
    content_column: str | None,
    display_column: str | None = None,
    sheet: Column | str = "sheet_name",
    extra: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One side of a compare job: ``side, original_row, sheet_name, contextual_content,
    display_value``; ``original_row`` counts the rows given (after filtering) from 0."""
    if side not in SIDES:
        raise ValueError("side must be 'left' or 'right'")
    numbered = row_ordinal(rows, order, "original_row", block_rows=block_rows)
    shown = display_value(quoted(display_column)) if display_column else F.lit(None).cast("string")
    return numbered.select(
        F.lit(side).alias("side"),
        "original_row",
        as_column(sheet).cast("string").alias("sheet_name"),
        contextual_content(context_columns, content_column, sheet).alias("contextual_content"),
        shown.alias("display_value"),
        *extra,
    ).where(strip("contextual_content") != "")


def two_sided_records(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both sides with one id space: even ids left, odd ids right."""
    both = left.unionByName(right, allowMissingColumns=True)
    return both.select(
        (F.col("original_row") * 2 + F.when(F.col("side") == "left", 0).otherwise(1)).alias("id"), "*"
    )


def width_violations(records: DataFrame, width: int, vec: str = "embedding") -> DataFrame:
    """Rows whose vector is missing or has another width than the corpus."""
    if not 0 < width <= MAX_VECTOR_WIDTH:
        raise ValueError(f"vector width must be between 1 and {MAX_VECTOR_WIDTH}")
    return records.where(F.coalesce(F.size(vec), F.lit(-1)) != width)


def write_records(records: DataFrame, path: str, width: int | None = None, mode: str = "overwrite") -> None:
    """Records as parquet, split by side where they have one; widths are checked on the way."""
    checked = records
    if width is not None:
        fits = F.coalesce(F.size("embedding"), F.lit(-1)) == width
        checked = records.where(F.assert_true(fits, "embedding width differs from the corpus").isNull())
    writer = checked.write.mode(mode)
    if "side" in records.columns:
        writer = writer.partitionBy("side")
    writer.parquet(path)


def write_matches(matches: DataFrame, path: str, run_column: str = "run_id") -> None:
    """Ranked pairs split by run; writing a run again replaces just that run."""
    (
        matches.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(run_column)
        .parquet(path)
    )


def read_question_set(spark, path: str) -> DataFrame:
    """Question set from CSV with a header: ``question, ground_truth``, trimmed, none empty."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"')
    return clean_question_set(raw)


def clean_question_set(raw: DataFrame) -> DataFrame:
    names = {c.strip(): c for c in raw.columns}
    if not {"question", "ground_truth"} <= names.keys():
        raise ValueError("a question set needs the columns 'question' and 'ground_truth'")
    q, g = strip(quoted(names["question"])), strip(quoted(names["ground_truth"]))
    return raw.select(q.alias("question"), g.alias("ground_truth")).where(
        (F.length("question") > 0) & (F.length("ground_truth") > 0)
    )


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Report or export as CSV (with a header), JSON lines or parquet."""
    writer = df.write.mode("overwrite")
    {
        "csv": lambda: writer.option("header", True).option("escape", '"').csv(path),
        "json": lambda: writer.json(path),
        "parquet": lambda: writer.parquet(path),
    }[fmt]()
