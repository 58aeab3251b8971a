"""Balanced contiguous shards of atomic groups.

Copies of one text are an atomic group, and groups stand in the order of their smallest id.
The smallest shard capacity for which a greedy walk over the groups needs no more than the
given number of shards is found by binary search; the walk at that capacity gives the cuts.

The walk never needs the groups on the driver. Sizes are summed per range of ids, a bounded
number of ranges, and the search runs over these sums; the ranges that a cut of a better
partition could still fall into are then split, until none is left and the cuts are exact.
Each round is one aggregation over the groups, and its result is a few thousand sums.

Equal texts share a shard; rows within a shard are numbered without a gap. Null and empty texts are one group. Ids must be whole numbers; a null id sorts
first. Rows that repeat an id are numbered one by one. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.common import byte_length, join_hot
from tandem.session import materialise

ROW_OVERHEAD = 8
RANGES = 4096
NUMBERED_TOGETHER = 200_000
_FIRST_ID = -(1 << 63)


@dataclass(frozen=True)
class _Range:
    """Groups whose smallest id, shifted right by ``shift``, is ``index``: their bytes."""

    shift: int
    index: int
    size: int
    groups: int

    @property
    def low(self) -> int:
        return self.index << self.shift


def _walk(sizes: list[int], capacity: int) -> list[int]:
    """Greedy contiguous shards of unsplittable sizes, none above ``capacity``: the position
    each shard but the first starts at."""
    cuts, used = [], 0
    for i, size in enumerate(sizes):
        if used + size > capacity:
            cuts.append(i)
            used = 0
        used += size
    return cuts


def _smallest_capacity(sizes: list[int], shards: int) -> int:
    """Binary search for the smallest capacity at which the walk needs no more shards."""
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if len(_walk(sizes, middle)) < shards:
            high = middle
        else:
            low = middle + 1
    return low


def _even_cuts(sizes: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts at a feasible capacity, each as near to its even share as the capacity allows.

    Walking back from the end gives the earliest place of each cut from which the rest still
    fits; any cut between that place and a full shard after the cut before can be completed."""
    before = [0]
    for size in sizes:
        before.append(before[-1] + size)
    total, n = before[-1], len(sizes)
    earliest, at = [0] * shards, n
    for i in range(shards - 1, 0, -1):
        at = bisect_left(before, before[at] - capacity)
        earliest[i] = at
    cuts, last = [], 0
    for i in range(1, shards):
        latest = bisect_right(before, before[last] + capacity) - 1
        ideal = i * total // shards
        at = bisect_left(before, ideal)
        if at and ideal - before[at - 1] < before[min(at, n)] - ideal:
            at -= 1
        last = min(max(at, earliest[i], last), latest)
        cuts.append(last)
    return [c for c in cuts if 0 < c < n]


def _sums(groups: DataFrame, shift: int, parents: list[_Range] = []) -> list[_Range]:
    """Sums over ``groups (first_id, group_bytes)`` per shifted id, within ``parents`` if
    given; both the parents and the sums are bounded by a few RANGES."""
    if parents:
        spark, step = groups.sparkSession, parents[0].shift
        wanted = spark.createDataFrame([(p.index,) for p in parents], "parent long")
        inside = F.shiftright("first_id", step) == F.col("parent")
        groups = groups.join(F.broadcast(wanted), inside, "left_semi")
    found = (
        groups.groupBy(F.shiftright("first_id", shift).alias("index"))
        .agg(F.sum("group_bytes").alias("size"), F.count(F.lit(1)).alias("groups"))
        .collect()
    )
    return [_Range(shift, r["index"], r["size"], r["groups"]) for r in found]


def minimax_cuts(groups: DataFrame, shards: int, ranges_at_once: int = RANGES) -> list[int]:
    """Smallest ``first_id`` of each shard but the first, for ``groups (first_id,
    group_bytes)`` with distinct ids: contiguous shards whose largest is as small as can be.

    With ranges taken as unsplittable, the search gives an attainable capacity U, so the
    best one is at most U. In any partition at least as good, the first i shards hold no
    more than i U bytes and the others no more than (shards - i) U, which bounds every cut.
    Ranges of several groups within these bounds are split; when none is left, no partition
    beats U, and the cuts are made at U.
    """
    bounds = groups.agg(F.min("first_id").alias("low"), F.max("first_id").alias("high")).head()
    if bounds.low is None:
        return []
    shift = 0
    while (bounds.high >> shift) - (bounds.low >> shift) >= ranges_at_once:
        shift += 1
    ranges = _sums(groups, shift)
    while True:
        ranges.sort(key=lambda r: r.low)
        sizes = [r.size for r in ranges]
        total, capacity = sum(sizes), _smallest_capacity(sizes, shards)
        open_ranges = _within_bounds(ranges, total, capacity, shards)
        if not open_ranges or capacity == -(-total // shards):
            return [ranges[i].low for i in _even_cuts(sizes, capacity, shards)]
        step = max(r.shift for r in open_ranges)
        parents = sorted((r for r in open_ranges if r.shift == step), key=lambda r: -r.size)
        parents = parents[: ranges_at_once // 2]
        finer = min(step, max(1, (ranges_at_once // len(parents)).bit_length() - 1))
        split = set(parents)
        ranges = [r for r in ranges if r not in split] + _sums(groups, step - finer, parents)


def _within_bounds(ranges: list[_Range], total: int, capacity: int, shards: int) -> list[_Range]:
    """Ranges of several groups that may hold a cut of a partition no worse than ``capacity``."""
    if any(r.groups == 1 and r.size == capacity for r in ranges):
        return []  # one group alone needs this capacity
    found, before = [], 0
    for r in ranges:
        after = before + r.size
        if r.groups > 1:
            # Some i with  total - (shards - i) * capacity < after  and  before < i * capacity.
            first = before // capacity + 1
            if first < shards and total - (shards - first) * capacity < after:
                found.append(r)
        before = after
    return found


def shard_documents(
    df: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row: ``key, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``bytes``: shard sizes are as equal as the groups allow, in the minimax sense.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).cast("long").alias("key"),
        (byte_length(F.col(text)) + ROW_OVERHEAD).alias("size"),
        F.crc32(content.cast("binary")).cast("long").alias("text_crc32"),
        F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"),
    )
    rows = materialise(rows, "shard-rows")
    order = F.coalesce(F.col("key"), F.lit(_FIRST_ID))
    groups = materialise(
        rows.groupBy("digest").agg(
            F.min(order).alias("first_id"), F.sum("size").alias("group_bytes"),
            F.count(F.lit(1)).alias("group_rows"),
        ),
        "shard-groups",
    )
    # A table that repeats an id may have several groups that start with it: they stay together.
    starts = groups.groupBy("first_id").agg(F.sum("group_bytes").alias("group_bytes"))
    cuts = minimax_cuts(starts, shards)
    shard = _place(F.col("first_id"), cuts)
    n_rows = rows.count()
    placed = join_hot(rows, groups.select("digest", "group_rows", shard.alias("shard")), "digest", "group_rows", n_rows)
    return (
        _numbered(placed, order, n_rows)
        .select(
            F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            "slot", F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def _place(first_id: Column, cuts: list[int]) -> Column:
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= first_id))


def _numbered(placed: DataFrame, order: Column, n_rows: int) -> DataFrame:
    """Adds ``slot``: rows of a shard are dealt to bins by hash, numbered within their bin,
    and bins follow one another."""
    bins = max(1, n_rows // NUMBERED_TOGETHER)
    binned = placed.withColumn("bin", F.pmod(F.xxhash64("key", "digest"), F.lit(bins)))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        binned.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("shard", "bin").orderBy(order, "digest")
    return (
        binned.withColumn("local", F.row_number().over(within))
        .join(offsets, ["shard", "bin"])
        .withColumn("slot", F.col("offset") + F.col("local") - 1)
    )
