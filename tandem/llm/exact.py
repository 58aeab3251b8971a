"""Exact deduplication that no group of copies can overload.

Two texts are equal when their normalised forms are identical, compared as whole strings in
every step; the digest only decides where rows meet.

1. Each task combines its own rows per (digest, salt, content): one row per distinct text
   and task leaves it, however many copies it held.
2. The partial winners meet by digest and a salt of the task they come from, so that the
   copies of one text are merged in several tasks.
3. The salts' winners of a text meet and give the group: its winner and its size.

The rows then look up their group: the few digests that hold a large share of all rows
through a broadcast, the others through a shuffle join on small columns.

The winner is the row with the longest original text in code points, then the smallest id.
Null text counts as empty; ids must be whole numbers, a null id counts as larger than every
other. Rows that repeat an id count each and get
one answer. Extra columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import join_hot
from tandem.session import materialise

SALTS = 8
# White space that does not count (fixed values): space, tab, line feed, vertical tab, form
# feed, carriage return.
IGNORED = " \t\n\x0b\x0c\r"
_LAST_ID = (1 << 63) - 1
_SHIFT = 1 << 64


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), IGNORED, "")


def _number(value: int) -> Column:
    return F.lit(Decimal(value)).cast("decimal(20,0)")


def _priority(length: Column, key: Column) -> Column:
    """Length, then smallest id, as one number, which a hash aggregation keeps in place."""
    id_rank = (_number(_LAST_ID) - F.coalesce(key, F.lit(_LAST_ID))).cast("decimal(20,0)")
    return length.cast("decimal(10,0)") * _number(_SHIFT) + id_rank


def _winner(priority: Column) -> Column:
    return (_number(_LAST_ID) - priority % _number(_SHIFT)).cast("long")


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``df``: ``key, keep_id, group_size, kept, text_sha256``."""
    content = normalised(F.col(text))
    rows = df.select(
        F.col(key).cast("long").alias("key"),
        content.alias("content"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("length"),
    ).withColumn("digest", F.unhex(F.sha2(F.col("content").cast("binary"), 256)))
    partial = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "content")
        .agg(F.max(_priority(F.col("length"), F.col("key"))).alias("best"), F.count(F.lit(1)).alias("n"))
    )
    groups = (
        partial.groupBy("digest", "content")
        .agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))
        .select("digest", _winner(F.col("best")).alias("keep_id"), "group_size")
    )
    groups = materialise(groups, "copies")
    answered = join_hot(rows.select("key", "digest"), groups, "digest", "group_size", df.count())
    return answered.select(
        F.col("key").alias(key),
        F.when(F.col("keep_id") == _LAST_ID, F.lit(None)).otherwise(F.col("keep_id")).alias("keep_id"),
        "group_size",
        F.coalesce(F.col("key"), F.lit(_LAST_ID)).eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
