"""Ranked keyword search over blocks of postings with stored score bounds.

The postings of a term are cut into blocks of about BLOCK rows by falling impact (the part of a
BM25 score that depends on term and record alone), and every block carries its largest impact.
A search first scores a few promising records of each query exactly; the k-th best of them is a
threshold that the result cannot fall below. Then

* the terms whose bounds together stay below the threshold are set aside (MaxScore): a record
  that holds only such terms cannot be a result;
* of the other terms only the blocks are read whose bound, with the bounds of all other terms
  of the query, reaches the threshold (block-max pruning);
* records whose known part plus the bounds of the terms set aside reaches the threshold are
  scored exactly from their own terms.

Nothing that is left out could have entered the result, so it equals the unpruned one. A query
that asks for all of its terms reads the list of its rarest term only, pruned in the same way.

Blocks are cut by impact level and, within a level, by a hash of the record, so the list of a
term that a third of all records hold is made by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.session import materialise

# Published BM25 parameters (fixed values) and the digits that scores are ranked by.
K1 = 1.2
B = 0.75
SCORE_DIGITS = 9
# Postings of a block; impact levels of a list; records scored first, per wanted result.
BLOCK = 128
LEVELS = 64
SEEDS = 4
_TOLERANCE = 1e-6
# Folders of a saved index.
FOLDER = "term_folder"
FOLDERS = 256


@dataclass(frozen=True)
class BlockIndex:
    """``terms``: ``*by, term, term_no, df, idf, bound``; ``blocks``: ``term_no, block,
    place, bound, n, entries`` with ``id, impact``; ``records``: ``*by, id, term_nos, impacts``."""

    terms: DataFrame
    blocks: DataFrame
    records: DataFrame
    by: tuple[str, ...] = ()

    @classmethod
    def build(cls, postings: DataFrame, by: Sequence[str] = (), only: DataFrame | None = None) -> BlockIndex:
        """From ``*by, id, term, tf``; every ``by`` value is an index of its own. The tables are
        written to the shared folder. An index for one set of queries holds the terms ``only``
        (``*by, term``) these ask for; lengths and counts are those of all postings."""
        record = [*by, "id"]
        # Windows over the terms of one record.
        of_record = Window.partitionBy(*record)
        sized = postings.withColumns({
            "length": F.sum("tf").over(of_record), "opens": F.row_number().over(of_record.orderBy("term")) == 1, "kept": F.lit(True)})
        if only is not None:
            # One row of each record stays for the counts, whether asked for or not.
            listed = materialise(only.select(*by, "term").distinct(), "asked-words").withColumn("listed", F.lit(True))
            sized = sized.join(listed, [*by, "term"], "left").withColumn("kept", F.col("listed").isNotNull()).drop("listed")
            sized = sized.where("kept or opens")
        sized = materialise(sized, "sized")
        totals = sized.groupBy(*by).agg(F.count_if("opens").alias("n_docs"), F.sum(F.when(F.col("opens"), F.col("length"))).alias("n_tokens"))
        # One row without ``by``: safe to attach to every posting.
        sized = sized.join(totals, list(by)) if by else sized.join(F.broadcast(totals))
        average = F.col("n_tokens") / F.col("n_docs")
        impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / average))
        weighed = sized.where("kept").select(*record, "term", "n_docs", impact.alias("impact"))
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        facts = weighed.groupBy(*by, "term", "n_docs").agg(F.count(F.lit(1)).alias("df"), F.max("impact").alias("bound"))
        # The numbers hold once written.
        terms = materialise(
            facts.select(*by, "term", F.monotonically_increasing_id().alias("term_no"), "df", idf.alias("idf"), "bound"), "terms")
        numbered = materialise(
            weighed.join(terms.select(*by, "term", "term_no", "df"), [*by, "term"])
            .withColumn("level", F.when(F.col("df") <= BLOCK, 0).otherwise(F.floor(F.col("impact") / (K1 + 1) * LEVELS)))
            .select(*record, "term_no", "df", "impact", "level"), "numbered")
        blocks = materialise(_blocks(numbered), "blocks")
        entry = F.struct("term_no", "impact")
        records = (
            numbered.groupBy(*record).agg(F.sort_array(F.collect_list(entry)).alias("e"))
            .select(*record, F.col("e.term_no").alias("term_nos"), F.col("e.impact").alias("impacts"))
        )
        return cls(terms, blocks, materialise(records, "records"), tuple(by))

    def save(self, path: str) -> None:
        """Terms and blocks in folders by a hash of the term, sorted so that a search reads the
        folders and row groups of its terms."""
        for name, table, key in (("terms", self.terms, "term"), ("blocks", self.blocks, "term_no")):
            tagged = table.withColumn(FOLDER, _folder(key))
            order = [key] if name == "terms" else [key, "place"]
            tagged.repartitionByRange(FOLDER, *order).sortWithinPartitions(FOLDER, *order).write.partitionBy(FOLDER).mode(
                "overwrite").parquet(f"{path}/{name}")
        self.records.write.mode("overwrite").parquet(f"{path}/records")

    @classmethod
    def load(cls, spark: SparkSession, path: str, by: Sequence[str] = ()) -> BlockIndex:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("terms", "blocks", "records")), tuple(by))


def _folder(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FOLDERS)).cast("int")


def _blocks(numbered: DataFrame) -> DataFrame:
    """Blocks of all lists. ``place`` is about how many postings of the list stand higher."""
    # At most LEVELS + 1 rows per frequent term.
    levels = numbered.where(F.col("df") > BLOCK).groupBy("term_no", "level").agg(F.count(F.lit(1)).alias("of_level"))
    higher = Window.partitionBy("term_no").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("above", F.coalesce(F.sum("of_level").over(higher), F.lit(0)))
    cut = numbered.join(levels, ["term_no", "level"], "left").withColumns({
        "above": F.coalesce("above", F.lit(0)),
        "part": F.pmod(F.xxhash64("id"), F.ceil(F.coalesce("of_level", "df") / BLOCK)),
    })
    return cut.groupBy("term_no", "level", "part").agg(
        F.max("impact").alias("bound"), F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("id", "impact")).alias("entries"),
        F.first("above").alias("above"),
    ).select(
        "term_no", F.concat_ws(".", "level", "part").alias("block"), (F.col("above") + F.col("part") * BLOCK).alias("place"),
        "bound", "n", "entries")


def _of_folders(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Of a saved table only the folders of the wanted keys (at most FOLDERS numbers)."""
    if FOLDER not in table.columns:
        return table
    folders = [r[0] for r in wanted.select(_folder(key)).distinct().collect()]
    return table.where(F.col(FOLDER).isin(folders)).drop(FOLDER)


@dataclass(frozen=True)
class PrunedTopk:
    """``matches``: the query's key, ``id, score, rank``; ``reads``: the query's key, ``blocks_read``
    (those read for the threshold included) of ``blocks_total``."""

    matches: DataFrame
    reads: DataFrame


def _exact(pairs: DataFrame, vectors: DataFrame, records: DataFrame, query: list[str], record: list[str]) -> DataFrame:
    """``score`` and ``matched`` terms of (query, record) pairs, from the terms of both."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            def lists(name: str) -> tuple[np.ndarray, list[int]]:
                column = batch.column(name)
                return column.flatten().to_numpy(zero_copy_only=False), (np.asarray(column.offsets) - column.offsets[0].as_py()).tolist()

            (asked, q), (weights, _), (held, d), (impacts, _) = map(lists, ("asked", "weights", "term_nos", "impacts"))
            scores, matched = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                terms, own = asked[q[i] : q[i + 1]], held[d[i] : d[i + 1]]
                at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                same = own[at] == terms
                scores[i] = float((weights[q[i] : q[i + 1]][same] * impacts[d[i] : d[i + 1]][at[same]]).sum())
                matched[i] = same.sum()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keys), pa.array(scores), pa.array(matched)], names=[*keys, "score", "matched"])

    keys = [*query, "id"]
    met = pairs.join(vectors, query).join(records, record).select(*keys, "asked", "weights", "term_nos", "impacts")
    schema = ", ".join(f"`{c}` {met.schema[c].dataType.simpleString()}" for c in keys)
    scored = met.mapInArrow(score, f"{schema}, score double, matched long")
    return scored.withColumn("score", F.round("score", SCORE_DIGITS))


def topk_pruned(index: BlockIndex, asked: DataFrame, k: int, every_term: bool, query_id: str = "query_id") -> PrunedTopk:
    """The k best records of each query by BM25, ties by id. ``asked`` holds ``*by, query_id,
    term``, distinct terms; a record has to hold all of them (``every_term``) or any."""
    query, record = [*index.by, query_id], [*index.by, "id"]
    counted = asked.withColumn("n_terms", F.count(F.lit(1)).over(Window.partitionBy(*query)))
    found = counted.join(_of_folders(index.terms, "term", asked), [*index.by, "term"]).withColumn("upper", F.col("idf") * F.col("bound"))
    of_query = Window.partitionBy(*query)
    by_bound = of_query.orderBy(F.desc("upper"), "term_no")
    # All windows here run over the terms of one query.
    known = found.withColumns({
        "total": F.sum("upper").over(of_query),
        "present": F.count(F.lit(1)).over(of_query),
        "rarity": F.row_number().over(of_query.orderBy("df", "term_no")),
        "before": F.coalesce(F.sum(F.least("df", F.lit(SEEDS * k))).over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "up_to": F.sum("upper").over(of_query.orderBy("upper", "term_no").rowsBetween(Window.unboundedPreceding, 0)),
    })
    if every_term:
        known = known.where(F.col("present") == F.col("n_terms"))
    known = materialise(known.drop("term", "n_terms"), "asked-terms")
    blocks = _of_folders(index.blocks, "term_no", known)
    entry = F.struct("term_no", "idf")
    vectors = known.groupBy(*query).agg(F.sort_array(F.collect_list(entry)).alias("e"), F.max("present").alias("present")).select(
        *query, F.col("e.term_no").alias("asked"), F.col("e.idf").alias("weights"), "present")

    def exact(pairs: DataFrame) -> DataFrame:
        scored = _exact(pairs, vectors.drop("present"), index.records, query, record)
        if not every_term:
            return scored.drop("matched")
        complete = scored.join(vectors.select(*query, "present"), query)
        return complete.where(F.col("matched") == F.col("present")).drop("matched", "present")

    def opened(read: DataFrame) -> DataFrame:
        one = read.select(*query, "idf", F.explode("entries").alias("e"))
        return one.groupBy(*query, F.col("e.id").alias("id")).agg(F.sum(F.col("idf") * F.col("e.impact")).alias("part"))

    leading = F.col("rarity") == 1 if every_term else F.col("before") < SEEDS * k
    first = known.where(leading).join(blocks.where(F.col("place") < SEEDS * k), "term_no")
    best_part = Window.partitionBy(*query).orderBy(F.desc("part"), "id")
    seeds = opened(first).withColumn("r", F.row_number().over(best_part)).where(F.col("r") <= SEEDS * k)
    best = Window.partitionBy(*query).orderBy(F.desc("score"), "id")
    ranked = exact(seeds.select(*query, "id")).withColumn("rank", F.row_number().over(best))
    threshold = ranked.where(F.col("rank") == k).select(*query, (F.col("score") - _TOLERANCE).alias("threshold"))

    bounded = known.join(threshold, query, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
    kept = (F.col("rarity") == 1) if every_term else (F.col("up_to") >= F.col("threshold"))
    aside = F.lit(0.0) if every_term else F.coalesce(F.sum(F.when(~kept, F.col("upper"))).over(of_query), F.lit(0.0))
    bounded = materialise(bounded.withColumns({"kept": kept, "aside": aside}), "bounds")
    reach = F.col("idf") * blocks["bound"] + F.col("total") - F.col("upper")
    read = bounded.where("kept").join(blocks, "term_no").where(reach >= F.col("threshold"))
    candidates = opened(read)
    if not every_term:
        limits = bounded.groupBy(*query).agg(F.max("aside").alias("aside"), F.max("threshold").alias("threshold"))
        candidates = candidates.join(limits, query).where(F.col("part") + F.col("aside") >= F.col("threshold"))
    matches = exact(candidates.select(*query, "id")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def counted_blocks(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*query).agg(F.count(F.lit(1)).alias("n"))

    both = counted_blocks(read.select(*query, "term_no", "block").unionByName(first.select(*query, "term_no", "block")).distinct())
    totals = known.join(blocks.select("term_no"), "term_no").groupBy(*query).agg(F.count(F.lit(1)).alias("blocks_total"))
    reads = totals.join(both, query, "left").select(*query, F.coalesce("n", F.lit(0)).alias("blocks_read"), "blocks_total")
    return PrunedTopk(matches.select(*query, "id", "score", "rank"), reads)
