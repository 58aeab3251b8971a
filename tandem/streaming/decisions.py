"""The decision log as a stream: current decisions, last write wins.

Every micro-batch is reduced to its latest row per left id and stored in its own folder;
the current view is the latest row over all folders. A batch costs what it contains, a
batch run again replaces its own folder, and late rows lose by ``decided_at, seq`` just as
in the batch view. ``compact`` folds the folders into one.

``start_decisions_state`` keeps the latest decision of every left id as state instead: a batch
stores only the rows that change the view, and late rows are turned away where they arrive.
What the state holds of a cleared row expires once no row older than it can come any more.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tandem.operators.decisions import current_decisions, latest_per_left

# The folder of compacted rows; micro-batches count from 0.
COMPACTED = -1


def start_decisions(log: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        latest_per_left(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        log.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


class LatestDecision(StatefulProcessor):
    """Per left id: the newest row by ``decided_at, seq``; rows that are not newer yield nothing.

    A cleared left id is remembered until the watermark has passed its clearing: rows that come
    later than that are dropped before they get here."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "decided long, seq long, cleared boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.latest.get() if self.latest.exists() else None
        best, newest = (held[0], held[1]) if held else None, None
        for row in rows:
            order = (row["__decided"], row["seq"])
            if best is None or order > best:
                best, newest = order, row
        if newest is not None:
            cleared = bool(newest["deleted"])
            self.latest.update((*best, cleared))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            if cleared:
                self.handle.registerTimer(best[0] // 1000 + 1)
            yield newest

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.latest.exists() and self.latest.get()[2]:
            self.latest.clear()
        return iter(())


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_decisions_state(log: DataFrame, path: str, checkpoint: str, lateness: str = "30 days", **trigger) -> StreamingQuery:
    """Current decisions as state; the rows that change them are stored like those of
    ``start_decisions``, and ``read_current`` reads them. Rows that come more than ``lateness`` after
    the newest one are dropped. The session is set to keep its state in files."""
    spark = log.sparkSession
    spark.conf.set(STATE_STORE, _ROCKS)
    timed = log.withColumn("__decided", F.unix_micros("decided_at")).withWatermark("decided_at", lateness)
    changes = timed.groupBy("left_id").transformWithState(
        LatestDecision(), outputStructType=timed.schema, outputMode="Update", timeMode="EventTime")
    names = log.columns

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(*names).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        changes.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_current(spark: SparkSession, path: str) -> DataFrame:
    return current_decisions(spark.read.parquet(path).drop("batch"))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the latest rows (deletions included) of all batches to a new log folder."""
    latest_per_left(spark.read.parquet(path).drop("batch")).write.mode("overwrite").parquet(f"{target}/batch={COMPACTED}")
