"""What several training-data operators share: settings, table reads and hot-key joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.session import apply_settings

# Arrow batches end at this many rows or bytes, so that a batch of very long texts stays
# within a Python worker's memory.
BATCH_ROWS = "2048"
BATCH_BYTES = str(8 << 20)

# A key is hot when it holds more than one in this many rows. There are fewer than this many
# such keys whatever the table's size, so a table of hot keys is always small enough to
# broadcast.
HOT_SHARE = 2000


def prepared(spark: SparkSession) -> SparkSession:
    apply_settings(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, taken: list[str]) -> str:
    """The name, with as many underscores before it as it takes to be a new one."""
    names = {t.lower() for t in taken}
    while name.lower() in names:
        name = "_" + name
    return name


def byte_length(text: Column) -> Column:
    """UTF-8 bytes of a text; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def join_hot(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, one row per key, on a key of any skew.

    Hot groups (more than one in HOT_SHARE of the ``n_rows`` rows, told by the column
    ``size`` of groups) are fewer than HOT_SHARE and join as a broadcast; the rows of a hot
    key never move. All others meet in a shuffle, where no key is hot any more.
    """
    hot = groups.where(F.col(size) * HOT_SHARE > F.lit(n_rows))
    cold = groups.where(F.col(size) * HOT_SHARE <= F.lit(n_rows))
    at_hot = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return at_hot.unionByName(rest.join(cold, key))
