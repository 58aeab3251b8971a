"""What models said about a content, kept by the content.

A key is the SHA-256 of everything an answer depends on: the text or prompt and the settings of
the model. Rows that ask for the same content ask once, and content that was answered in an
earlier run, a failed one included, is not asked again. Missing keys are answered in a fixed
number of portions, each written before the next begins, so a run that fails keeps what it has.
Answers that are null (a failed call) are not kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions.cells import as_column
from tandem.models import Embedder, Judge, embed_column
from tandem.operators.judge import call_judge, system_prompt
from tandem.session import materialise

PORTIONS = 8
KEY = "content_key"


def content_key(*parts: Column | str) -> Column:
    """The key of a content; null parts differ from empty ones, and no two lists run together."""
    texts = [as_column(p).cast("string") for p in parts]
    framed = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*framed).cast("binary"), 256)


class ContentStore:
    """Answers at ``path``: ``content_key, answer``."""

    def __init__(self, spark: SparkSession, path: str, answer: str):
        self.spark, self.path, self.schema = spark, path, f"{KEY} string, answer {answer}, portion long"

    def _stored(self) -> DataFrame | None:
        """Everything written so far. The number in the options keeps a plan that holds readings of
        several moments from taking them for one."""
        try:
            last = self.spark.read.schema(self.schema).parquet(self.path).agg(F.max("portion")).head()[0]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return self.spark.read.schema(self.schema).option("written", str(last)).parquet(self.path)

    def read(self) -> DataFrame:
        """``content_key, answer``; a key that two runs answered at the same time counts once."""
        stored = self._stored()
        if stored is None:
            stored = self.spark.createDataFrame([], self.schema)
        return stored.groupBy(KEY).agg(F.min_by("answer", "portion").alias("answer"))

    def _next(self) -> int:
        """A number that no portion has."""
        stored = self._stored()
        return 0 if stored is None else 1 + stored.agg(F.coalesce(F.max("portion"), F.lit(-1))).head()[0]

    def fill(self, requests: DataFrame, answered: Callable[[DataFrame], DataFrame], portions: int = PORTIONS) -> DataFrame:
        """``requests`` with their ``answer`` (null where there is none). ``answered`` adds that
        column to rows of distinct contents."""
        asked = materialise(requests, "requests")
        others = [c for c in asked.columns if c != KEY]
        # Any row of a content can stand for it.
        one = asked.groupBy(KEY).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in others])).alias("r")).select(KEY, "r.*")
        missing = materialise(one.join(self.read().select(KEY), KEY, "left_anti"), "missing")
        number = self._next()
        for portion in range(portions):
            part = missing.where(F.pmod(F.xxhash64(KEY), F.lit(portions)) == portion)
            if not part.isEmpty():
                made = answered(part).select(KEY, "answer").where(F.col("answer").isNotNull())
                made.write.mode("overwrite").parquet(f"{self.path}/portion={number + portion}")
        return asked.join(self.read(), KEY, "left")


def embed_incremental(
    records: DataFrame, embedder: Embedder, store: ContentStore, model: str, text: Column | str = "contextual_content",
    name: str = "embedding",
) -> DataFrame:
    """Records with ``embedding``: every distinct text is embedded once over all runs with the
    store. ``model`` names the model and its settings."""
    value = as_column(text)
    requests = records.withColumns({"__text": value, KEY: content_key(F.lit(model), value)})
    found = store.fill(requests, lambda rows: rows.withColumn("answer", embed_column("__text", embedder)))
    return found.withColumnRenamed("answer", name).drop("__text", KEY)


def call_judge_once(
    prompts: DataFrame, judge: Judge, store: ContentStore, model: str, system: str | None = None, rpm: int = 0, tasks: int | None = None,
) -> DataFrame:
    """``call_judge`` that pays only for prompts the store has no reply to: adds ``reply``. Equal
    prompts are paid for once; a failed call leaves a null and is asked again by the next run."""
    key = content_key(F.lit(model), F.lit(system_prompt(system)), "prompt", "max_tokens")

    def answered(rows: DataFrame) -> DataFrame:
        return call_judge(rows, judge, system, rpm, tasks).withColumnRenamed("reply", "answer")

    return store.fill(prompts.withColumn(KEY, key), answered).withColumnRenamed("answer", "reply").drop(KEY)
