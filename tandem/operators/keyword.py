"""Keyword index and ranked keyword search for many queries at once.

The index is two tables: postings ``(id, term, tf)`` and lengths ``(id, length)``. A record
matches a query when it holds every query term; matches are ranked by Okapi BM25. The
record text goes through the chosen analyzer, an optional id text always through the plain
one, and query text through the chosen one (so an id token matches only where its analysed
query form equals it).

Matching starts from the rarest term of each query: only records in that posting list are
looked up for the other terms, instead of intersecting whole posting lists of common terms.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.functions.cells import as_column
from tandem.functions.text import ANALYZERS, english_stem, is_stop_word, tokens
from tandem.operators.blockmax import K1, SCORE_DIGITS, B, BlockIndex, PrunedTopk, topk_pruned
from tandem.session import materialise

# Candidates per retriever by default (fixed value).
POOL = 50
# Folders of a saved index.
BUCKET = "term_bucket"
BUCKETS = 256


def _stemmed(terms: DataFrame) -> DataFrame:
    """Replace ``term`` by its stem; the stemmer runs once per distinct term."""
    stems = terms.select("term").distinct().withColumn("stem", english_stem("term"))
    return terms.join(stems, "term").withColumn("term", F.col("stem")).drop("stem")


def _words(source: DataFrame, key: str, text: Column, analyzer: str) -> DataFrame:
    """``id, term`` of every word, not stemmed."""
    if analyzer not in ANALYZERS:
        raise ValueError(f"analyzer must be one of {ANALYZERS}")
    exploded = source.select(F.col(key).alias("id"), F.explode(tokens(text)).alias("term"))
    if analyzer != "simple":
        exploded = exploded.where(~is_stop_word("term"))
    return exploded


def _term_counts(source: DataFrame, key: str, text: Column, analyzer: str) -> DataFrame:
    counted = _words(source, key, text, analyzer).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    if analyzer != "english":
        return counted
    return _stemmed(counted).groupBy("id", "term").agg(F.sum("tf").alias("tf"))


def build_postings(
    records: DataFrame,
    id_col: str = "id",
    content: Column | str = "contextual_content",
    id_text: Column | str | None = None,
    analyzer: str = "english",
) -> DataFrame:
    """``id, term, tf`` for the content and, analysed plainly, the id text."""
    postings = _term_counts(records, id_col, as_column(content), analyzer)
    if id_text is None:
        return postings
    extra = _term_counts(records, id_col, as_column(id_text), "simple")
    return postings.unionByName(extra).groupBy("id", "term").agg(F.sum("tf").alias("tf"))


@dataclass(frozen=True)
class KeywordIndex:
    """``asked`` tells that the postings are written and are those of the queries' terms alone."""

    postings: DataFrame
    lengths: DataFrame
    analyzer: str
    asked: bool = False

    @classmethod
    def build(cls, records: DataFrame, id_col: str = "id", content: Column | str = "contextual_content",
              id_text: Column | str | None = None, analyzer: str = "english") -> KeywordIndex:
        postings = build_postings(records, id_col, content, id_text, analyzer)
        return cls(postings, lengths_of(postings), analyzer)

    @classmethod
    def for_queries(cls, records: DataFrame, queries: DataFrame, id_col: str = "id", content: Column | str = "contextual_content",
                    analyzer: str = "english") -> KeywordIndex:
        """A written index for one set of queries: the posting lists of their terms alone, with the
        lengths of all records, so these queries find what they find in the whole index."""
        listed = materialise(query_terms(queries, analyzer).select("term").distinct(), "asked-words").withColumn("listed", F.lit(True))
        if analyzer == "english":
            counted = _term_counts(records, id_col, as_column(content), analyzer).join(listed, "term", "left")
        else:
            counted = _words(records, id_col, as_column(content), analyzer).join(listed, "term", "left").withColumn("tf", F.lit(1))
        # The words nobody asks for are one count per record, which its length needs.
        counted = counted.groupBy("id", F.when(F.col("listed"), F.col("term")).alias("term")).agg(F.sum("tf").alias("tf"))
        counted = materialise(counted, "postings")
        return cls(counted.where(F.col("term").isNotNull()), materialise(lengths_of(counted), "lengths"), analyzer, asked=True)

    def written(self) -> KeywordIndex:
        """The index as tables in the shared folder: built once for all that follows."""
        postings = materialise(self.postings, "postings")
        return KeywordIndex(postings, materialise(lengths_of(postings), "lengths"), self.analyzer)

    def save(self, path: str) -> None:
        """Postings partitioned by a hash of the term and sorted by term, so a search reads the
        folders of its terms and skips row groups without them; lengths beside them."""
        (
            self.postings.withColumn(BUCKET, _bucket("term"))
            .repartitionByRange(BUCKET, "term", "id")
            .sortWithinPartitions(BUCKET, "term", "id")
            .write.partitionBy(BUCKET)
            .mode("overwrite")
            .parquet(f"{path}/postings")
        )
        lengths_of(self.postings.sparkSession.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(
            f"{path}/lengths"
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str, analyzer: str = "english") -> KeywordIndex:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"), analyzer)


def _bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def asked_postings(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """The posting lists of the terms; of a saved index only their folders are read."""
    if BUCKET in postings.columns:
        # At most BUCKETS numbers.
        wanted = [r[0] for r in terms.select(_bucket("term")).distinct().collect()]
        postings = postings.where(F.col(BUCKET).isin(wanted)).drop(BUCKET)
    return postings.join(terms.select("term").distinct(), "term", "left_semi")


def lengths_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("id").agg(F.sum("tf").alias("length"))


def query_terms(queries: DataFrame, analyzer: str) -> DataFrame:
    """``query_id, term, n_terms``: distinct analysed terms of each query."""
    terms = _term_counts(queries, "query_id", F.col("query_text"), analyzer).select(
        F.col("id").alias("query_id"), "term"
    )
    return terms.withColumn("n_terms", F.count(F.lit(1)).over(Window.partitionBy("query_id")))


def _matched_postings(postings: DataFrame, terms: DataFrame, written: bool = False) -> DataFrame:
    """Postings of every (query, record) pair that holds all terms of the query:
    ``query_id, id, term, tf, df``. A query without terms matches nothing."""
    # The posting lists asked for, read from the index once and used three times. Their files are
    # far smaller than their rows, so their size must not decide for a broadcast.
    asked = (postings if written else materialise(asked_postings(postings, terms), "asked")).hint("merge")
    frequency = asked.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = terms.join(frequency, "term")
    rarest_first = Window.partitionBy("query_id").orderBy("df", "term")
    complete = (
        known.withColumn("__place", F.row_number().over(rarest_first))
        .withColumn("__found", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
        .where(F.col("__found") == F.col("n_terms"))
    )
    candidates = complete.where(F.col("__place") == 1).join(asked.select("term", "id"), "term").select("query_id", "id")
    wanted = candidates.hint("merge").join(complete.select("query_id", "term", "n_terms", "df"), "query_id")
    hits = wanted.join(asked, ["id", "term"])
    return (
        hits.withColumn("__hits", F.count(F.lit(1)).over(Window.partitionBy("query_id", "id")))
        .where(F.col("__hits") == F.col("n_terms"))
        .select("query_id", "id", "term", "tf", "df")
    )


def and_match(index: KeywordIndex, queries: DataFrame) -> DataFrame:
    """``query_id, id`` of records that hold every term of the query."""
    return (
        _matched_postings(index.postings, query_terms(queries, index.analyzer), index.asked).select("query_id", "id").distinct()
    )


def bm25_scores(index: KeywordIndex, queries: DataFrame) -> DataFrame:
    """``query_id, id, score`` of all AND matches."""
    hits = _matched_postings(index.postings, query_terms(queries, index.analyzer), index.asked)
    # One row: safe to attach to every hit.
    totals = index.lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturation = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length"))
    return (
        hits.join(index.lengths.hint("merge"), "id")
        .join(F.broadcast(totals))
        .groupBy("query_id", "id")
        .agg(F.round(F.sum(idf * F.col("tf") * (K1 + 1) / saturation), SCORE_DIGITS).alias("score"))
    )


def keyword_topk(index: KeywordIndex, queries: DataFrame, pool: int = POOL) -> DataFrame:
    """``query_id, id, score, rank``: best matches per query, ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return bm25_scores(index, queries).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool)


def keyword_baseline(index: KeywordIndex, queries: DataFrame, k: int) -> DataFrame:
    """Keyword-only search: the best ``k``, score at four decimals."""
    return keyword_topk(index, queries, k).withColumn("score", F.round("score", 4))


def block_index(index: KeywordIndex) -> BlockIndex:
    """The index with its postings cut into blocks with score bounds."""
    return BlockIndex.build(index.postings)


def keyword_topk_pruned(blocks: BlockIndex, queries: DataFrame, analyzer: str, pool: int = POOL) -> PrunedTopk:
    """The result of ``keyword_topk``, from the blocks that can hold it."""
    return topk_pruned(blocks, query_terms(queries, analyzer).drop("n_terms"), pool, every_term=True)


def any_term_topk(lefts: DataFrame, rights: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """``*by, left_id, right_id, score, rank``: the k best right rows of each left row by BM25, of
    all right rows that share at least one term with it, ties by id. ``lefts`` and ``rights`` hold
    ``*by``, their id and ``text``; each ``by`` value is an index of its own.

    The right rows become an index of posting blocks with score bounds, of the terms that occur on
    the left; a left row reads the blocks that can still hold one of its k best. Texts travel once,
    to where their words are counted.
    """
    texts = rights.select(*by, F.col("right_id").alias("id"), "text").repartition(*by, "id")
    words = texts.select(*by, "id", F.explode(tokens("text")).alias("term"))
    postings = words.groupBy(*by, "id", "term").agg(F.count(F.lit(1)).alias("tf"))
    asked = lefts.select(*by, "left_id", F.explode(F.array_distinct(tokens("text"))).alias("term"))
    found = topk_pruned(BlockIndex.build(postings, by, asked), asked, k, every_term=False, query_id="left_id").matches
    return found.withColumnRenamed("id", "right_id")
