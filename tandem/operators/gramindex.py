"""A stored index of letter sequences for substring search.

For every sequence of one to three letters that a record's texts hold, the index keeps the
records as bitmaps of 2^15 ids, in folders by a hash of the sequence. A search reads the folders
of its patterns' sequences, intersects the bitmaps of the rarest ones and checks the whole
pattern on the records that remain, in the order of ids and no further than its k results need.
Patterns of one or two letters have sequences too; a pattern of wildcards alone reads records
from the smallest id on until it has enough.

Records are stored beside the bitmaps in at most PARTS folders of consecutive ids, and only the
folders of candidates are read. Ids are whole numbers. Letters compare in lower case, as in the
pattern match itself; a null text has no sequences and matches nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.functions.cells import quoted
from tandem.functions.patterns import ilike_contains, wildcard_pattern
from tandem.session import materialise

LONGEST = 3
SPAN_BITS = 15  # a bitmap covers 2^15 ids
PARTS = 1024
FOLDERS = 256
# Letters that make a task of building worth starting, and most such tasks per bitmap's ids.
TASK_LETTERS = 1 << 18
SPAN_TASKS = 4
# Ids that a batch of candidates opens at once.
BATCH_IDS = 1 << 18
# Sequences intersected per pattern; candidates checked at first, per wanted result.
RAREST = 4
AHEAD = 4


def _grams(text: Column, n: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _build_tasks(letters: int, spans: int, slots: int) -> int:
    """Tasks that gather entries, each from ids of its own: by the letters, but so few that a bitmap
    comes from few tasks."""
    return max(1, min(-(-letters // TASK_LETTERS), max(slots, SPAN_TASKS * spans)))


def _folder() -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(FOLDERS)).cast("int")


def _pattern_grams(queries: DataFrame) -> DataFrame:
    """``query_id, query_text, grams, skipped``: what a match has to hold, and how many letters it
    has to have besides."""
    pattern = F.lower(wildcard_pattern(F.col("query_text")))
    runs = F.transform(
        F.regexp_extract_all(pattern, F.lit(r"(?s)((?:[^%_\\]|\\.)+)"), F.lit(1)), lambda r: F.regexp_replace(r, r"(?s)\\(.)", "$1"))
    of_run = F.transform(runs, lambda r: F.when(F.length(r) >= LONGEST, _grams(r, LONGEST)).when(F.length(r) == 2, _grams(r, 2)).otherwise(_grams(r, 1)))
    return queries.select(
        "query_id", "query_text", F.array_distinct(F.flatten(of_run)).alias("grams"), F.regexp_count(pattern, F.lit("_")).alias("skipped"))


@dataclass(frozen=True)
class GramIndex:
    """``bitmaps``: ``gram, span, n, bits`` by ``folder``; ``counts``: ``gram, n`` by ``folder``;
    ``records``: ``id`` and the texts by ``part``, which holds ids of ``width`` spans."""

    bitmaps: DataFrame
    counts: DataFrame
    records: DataFrame
    texts: tuple[str, ...]
    low: int
    width: int

    @classmethod
    def build(cls, records: DataFrame, path: str, texts: Sequence[str], id_col: str = "id") -> GramIndex:
        spark = records.sparkSession
        rows = records.select(F.col(id_col).cast("long").alias("id"), *[quoted(t) for t in texts]).where(F.col("id").isNotNull())
        span = F.shiftright("id", SPAN_BITS)
        letters = reduce(add, [F.coalesce(F.length(quoted(t)), F.lit(0)) for t in texts])
        ends = rows.agg(F.min(span).alias("low"), F.max(span).alias("high"), F.sum(letters).alias("letters")).head()
        low = ends["low"] or 0
        width = ((ends["high"] or 0) - low) // PARTS + 1
        part = F.floor((span - low) / width).cast("int")
        rows.withColumn("part", part).repartitionByRange("part", "id").sortWithinPartitions("part", "id").write.partitionBy("part").mode(
            "overwrite").parquet(f"{path}/records")
        spark.createDataFrame([(low, width, list(texts))], "low long, width long, texts array<string>").write.mode("overwrite").parquet(f"{path}/settings")
        held = [_grams(F.lower(quoted(t)), n) for t in texts for n in range(1, LONGEST + 1)]
        every = F.array_distinct(F.concat(*[F.coalesce(g, F.array().cast("array<string>")) for g in held]))
        # A file of one row group arrives as one task, whose entries would all be sorted there.
        tasks = _build_tasks(ends["letters"] or 0, (ends["high"] or 0) - low + 1, spark.sparkContext.defaultParallelism)
        entries = rows.repartitionByRange(tasks, "id").select("id", F.explode(every).alias("gram"))
        bitmaps = entries.groupBy("gram", span.alias("span")).agg(
            F.bitmap_construct_agg(F.col("id").bitwiseAND((1 << SPAN_BITS) - 1)).alias("bits"))
        bitmaps.withColumns({"n": F.bitmap_count("bits"), "folder": _folder()}).repartitionByRange("folder", "gram", "span").sortWithinPartitions(
            "folder", "gram", "span").write.partitionBy("folder").mode("overwrite").parquet(f"{path}/bitmaps")
        written = spark.read.schema("gram string, n long").parquet(f"{path}/bitmaps")
        counts = written.groupBy("gram").agg(F.sum("n").alias("n")).withColumn("folder", _folder())
        counts.repartitionByRange("folder", "gram").write.partitionBy("folder").mode("overwrite").parquet(f"{path}/counts")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GramIndex:
        settings = spark.read.parquet(f"{path}/settings").head()
        schemas = {
            "bitmaps": "gram string, span long, bits binary, n long, folder int", "counts": "gram string, n long, folder int",
            "records": ", ".join(["id long", *[f"`{t.replace('`', '``')}` string" for t in settings["texts"]], "part int"])}
        tables = (spark.read.schema(schemas[t]).parquet(f"{path}/{t}") for t in ("bitmaps", "counts", "records"))
        return cls(*tables, tuple(settings["texts"]), settings["low"], settings["width"])

    def _matches(self, text: Column) -> Column:
        return reduce(or_, [F.coalesce(ilike_contains(quoted(t), text), F.lit(False)) for t in self.texts])

    def _part(self, span: Column) -> Column:
        return F.floor((span - self.low) / self.width).cast("int")

    def candidates(self, queries: DataFrame) -> DataFrame:
        """``query_id, query_text, span, n, bits``: the records that hold the rarest sequences of
        each pattern. Patterns of wildcards alone are left out."""
        wanted = _pattern_grams(queries).select("query_id", "query_text", F.explode("grams").alias("gram"))
        wanted = materialise(wanted, "pattern-grams")
        # At most FOLDERS numbers.
        folders = [r[0] for r in wanted.select(_folder()).distinct().collect()]
        counted = wanted.join(self.counts.where(F.col("folder").isin(folders)).drop("folder"), "gram", "left")
        # All windows here run over the sequences of one pattern. One that no record holds rules
        # the pattern out.
        rarest = Window.partitionBy("query_id").orderBy("n", "gram")
        chosen = counted.withColumns({
            "missing": F.max(F.col("n").isNull()).over(Window.partitionBy("query_id")), "place": F.row_number().over(rarest)})
        chosen = chosen.where(~F.col("missing") & (F.col("place") <= RAREST))
        needed = chosen.withColumn("needed", F.max("place").over(Window.partitionBy("query_id")))
        found = needed.select("query_id", "query_text", "gram", "needed").join(
            self.bitmaps.where(F.col("folder").isin(folders)).select("gram", "span", "bits"), "gram")
        met = found.groupBy("query_id", "query_text", "span", "needed").agg(F.count(F.lit(1)).alias("held"), F.bitmap_and_agg("bits").alias("bits"))
        return met.where("held = needed").withColumn("n", F.bitmap_count("bits")).where("n > 0").select("query_id", "query_text", "span", "n", "bits")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``query_id, id, rank``: the first k records by id that match ``%query_text%``."""
        queries = queries.select("query_id", "query_text").where(F.col("query_text").isNotNull())
        spans = Window.partitionBy("query_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
        met = materialise(self.candidates(queries).withColumn("before", F.coalesce(F.sum("n").over(spans), F.lit(0))), "candidates")
        found, seen, ahead = [], 0, AHEAD * k
        going = met
        while not going.isEmpty():
            # Spans that begin before the next ``ahead`` candidates of the pattern.
            now = going.where((F.col("before") >= seen) & (F.col("before") < ahead))
            verified = materialise(self._verified(now), "verified")
            found.append(verified)
            every = reduce(DataFrame.unionByName, found)
            enough = every.groupBy("query_id").agg(F.count(F.lit(1)).alias("have")).where(F.col("have") >= k)
            going = met.where(F.col("before") >= ahead).join(enough, "query_id", "left_anti")
            seen, ahead = ahead, 4 * ahead
        found += self._by_scan(_pattern_grams(queries).where(F.size("grams") == 0), k)
        order = Window.partitionBy("query_id").orderBy("id")
        every = reduce(DataFrame.unionByName, found)
        return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def _verified(self, met: DataFrame) -> DataFrame:
        """``query_id, id`` of candidates that match the whole pattern."""
        kind = met.schema["query_id"].dataType.simpleString()

        def opened(batch: pa.RecordBatch, taken: list[np.ndarray], made: list[np.ndarray]) -> pa.RecordBatch:
            rows = pa.array(np.concatenate(taken))
            return pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(rows), batch.column("query_text").take(rows), pa.array(np.concatenate(made))],
                names=["query_id", "query_text", "id"])

        def ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                taken, made, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
                for i, (span, bits) in enumerate(zip(batch.column("span").to_pylist(), batch.column("bits").to_pylist())):
                    held = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
                    made.append(held + (span << SPAN_BITS))
                    taken.append(np.full(len(held), i))
                    n += len(held)
                    if n >= BATCH_IDS:
                        yield opened(batch, taken, made)
                        taken, made, n = taken[:1], made[:1], 0
                yield opened(batch, taken, made)

        # At most PARTS numbers; only these folders of records are read.
        parts = [r[0] for r in met.select(self._part(F.col("span"))).distinct().collect()]
        pairs = met.select("query_id", "query_text", "span", "bits").mapInArrow(ids, f"query_id {kind}, query_text string, id long")
        records = self.records.where(F.col("part").isin(parts)).drop("part")
        return pairs.join(records, "id").where(self._matches(F.col("query_text"))).select("query_id", "id")

    def _by_scan(self, queries: DataFrame, k: int) -> list[DataFrame]:
        """Patterns of wildcards alone ask for a length: one ordered read per length in use."""
        parts = [r["part"] for r in self.records.select("part").distinct().orderBy("part").collect()]
        nothing = F.array().cast("array<bigint>")
        found = [queries.select("query_id", F.explode(nothing).alias("id"))]
        for letters in sorted(r[0] for r in queries.select("skipped").distinct().collect()):
            long = reduce(or_, [F.coalesce(F.length(quoted(t)) >= letters, F.lit(False)) for t in self.texts])
            ids: list[int] = []
            at, take = 0, 1
            while at < len(parts) and len(ids) < k:
                # At most k ids; later folders are read only while these do not give them.
                read = self.records.where(F.col("part").isin(parts[at : at + take])).where(long)
                ids += [r["id"] for r in read.select("id").orderBy("id").limit(k - len(ids)).collect()]
                at, take = at + take, 4 * take
            if ids:
                found.append(queries.where(F.col("skipped") == letters).select("query_id", F.explode(F.lit(ids)).alias("id")))
        return found
