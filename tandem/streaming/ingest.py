"""Incremental record ingest: new source rows become records and postings as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tandem.functions.cells import contextual_content, quoted, stored_column_names, stored_value, strip
from tandem.models import Embedder, embed_column
from tandem.operators.keyword import build_postings


def record_stream(
    rows: DataFrame,
    id_column: str,
    stored_columns: Sequence[str],
    context_columns: Sequence[str],
    content_column: str | None,
    embedder: Embedder | None = None,
    event_time: str | None = None,
    replay_window: str = "1 hour",
    sheet: str = "sheet_name",
    as_given: bool = False,
) -> DataFrame:
    """Records from a stream of source rows, row by row. The id comes from the source.

    With an event-time column, rows seen again within the replay window are dropped. ``as_given``
    takes the values of a typed table as they stand: each row is a record, one of unknown text too.
    """
    if event_time:
        rows = rows.withWatermark(event_time, replay_window).dropDuplicatesWithinWatermark([id_column])
    names = stored_column_names(stored_columns)
    records = rows.select(
        quoted(id_column).cast("bigint").alias("id"),
        quoted(sheet).cast("string").alias("sheet_name"),
        *[(quoted(c).cast("string") if as_given else stored_value(quoted(c))).alias(n) for c, n in names.items()],
        contextual_content(context_columns, content_column, quoted(sheet), as_given).alias("contextual_content"),
    )
    if not as_given:
        records = records.where(strip("contextual_content") != "")
    return records if embedder is None else records.withColumn("embedding", embed_column("contextual_content", embedder))


def start_ingest(
    records: DataFrame, path: str, checkpoint: str, analyzer: str = "english", **trigger
) -> StreamingQuery:
    """Write records and their postings under ``path``, one folder per micro-batch.

    A batch that is run again after a failure overwrites its own folder, so the tables hold
    each batch once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = f"batch={batch_id}"
        batch.write.mode("overwrite").parquet(f"{path}/records/{folder}")
        # Read back, so the embedder is not asked twice for the same rows.
        written = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/records/{folder}")
        build_postings(written, analyzer=analyzer).write.mode("overwrite").parquet(f"{path}/postings/{folder}")

    return _start(records, write, checkpoint, trigger)


def _start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_ingested(spark, path: str, table: str) -> DataFrame:
    """``records`` or ``postings`` written so far."""
    return spark.read.parquet(f"{path}/{table}").drop("batch")
