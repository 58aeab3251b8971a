"""Text quality by a sparse ensemble of rules.

Statistics of each whole text are written once. A forest of shallow trees is grown on a
bounded sample of labelled rows; every path from a root to a node is a rule, a conjunction
of bounds on statistics. A lasso-penalised logistic regression over the rules (Friedman and
Popescu, "Predictive learning via rule ensembles", 2008) keeps a few of them with a weight
each. The kept rules are compiled into one column expression that scores all rows.

The labelled sample holds at most ``max_labelled`` rows, those with the smallest hash of their
id; all statistics, rules and scores cover every row and whole texts.

Results: null and empty texts have all statistics zero and are scored like any other. Where
the labels are missing or of one kind, every score is their smoothed mean. Labels that are
null or repeated do not count or count each; a repeated id is scored row by row. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import prepared
from tandem.session import materialise

MAX_LABELLED = 20_000
TREES = 24
DEPTH = 4
LASSO = 0.0005

STATISTICS = (
    "characters", "words", "word_length", "distinct_words", "repeated_neighbours", "distinct_lines",
    "capitals", "digits", "symbols", "exclamations", "bars", "stops", "line_breaks", "beyond_ascii",
    "capital_words", "longest_word",
)
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = b"#$%&*+<=>@\\^_`{}~"


def statistics(text: str) -> list[float]:
    """The statistics of one whole text, in the order of STATISTICS."""
    raw = text.encode()
    n, words, lines = max(1, len(raw)), text.split(), text.split("\n")
    n_words = max(1, len(words))

    def share(letters: bytes) -> float:
        return (len(raw) - len(raw.translate(None, letters))) / n

    shouted = sum(w.isupper() for w in words)
    return [
        float(len(text)),
        float(len(words)),
        sum(map(len, words)) / n_words,
        len(set(words)) / n_words,
        sum(a == b for a, b in zip(words, words[1:])) / n_words,
        len(set(lines)) / len(lines),
        share(_CAPITALS),
        share(b"0123456789"),
        share(_SYMBOLS),
        raw.count(b"!") / n,
        raw.count(b"|") / n,
        (raw.count(b".") + raw.count(b",")) / n_words,
        raw.count(b"\n") / n_words,
        (len(raw) - len(text)) / n,
        shouted / n_words,
        float(max(map(len, words), default=0)),
    ]


@dataclass(frozen=True)
class Rule:
    """Bounds ``low < statistic <= high`` that must all hold."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        def one(name: str, low: float, high: float) -> Column:
            sides = [F.col(name) > low] if low != float("-inf") else []
            sides += [F.col(name) <= high] if high != float("inf") else []
            return reduce(and_, sides)

        return reduce(and_, [one(*b) for b in self.bounds])


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    weights: tuple[tuple[Rule, float], ...] = ()

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def with_statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the statistics of each row."""
    prepared(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch.column("text").to_pylist()]
            columns = list(zip(*rows)) if rows else [[]] * len(STATISTICS)
            arrays = [pa.array(list(c), pa.float64()) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *arrays], names=["key", *STATISTICS])

    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = ", ".join([f"key {kind}", *[f"{name} double" for name in STATISTICS]])
    return rows.mapInArrow(make, schema)


def _paths(node, bounds: dict[str, tuple[float, float]]) -> Iterator[Rule]:
    """A rule for every node below a root of a fitted tree."""
    if bounds:
        yield Rule(tuple((name, *bounds[name]) for name in sorted(bounds)))
    if node.getClass().getSimpleName() != "InternalNode":
        return
    name, threshold = STATISTICS[node.split().featureIndex()], float(node.split().threshold())
    low, high = bounds.get(name, (float("-inf"), float("inf")))
    yield from _paths(node.leftChild(), bounds | {name: (low, min(high, threshold))})
    yield from _paths(node.rightChild(), bounds | {name: (max(low, threshold), high)})


def fit(labelled: DataFrame, label: str = "label", max_labelled: int = MAX_LABELLED, seed: int = 7) -> RuleEnsemble:
    """Fits the ensemble on ``labelled``: statistics and a 0/1 label."""
    sample = materialise(
        labelled.select(F.col(label).cast("double").alias("label"), "key", *STATISTICS)
        .where(F.col("label").isNotNull())
        .orderBy(F.xxhash64("key"), *STATISTICS)
        .limit(max_labelled)
        .withColumn("features", array_to_vector(F.array(*STATISTICS))),
        "labelled",
    )
    n, positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).head()
    if positive == 0 or positive == n:
        mean = (positive + 0.5) / (n + 1.0)
        return RuleEnsemble(_logit(mean))
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=4, subsamplingRate=0.7,
        featureSubsetStrategy="onethird", seed=seed, labelCol="label",
    ).fit(sample)
    rules: dict[Rule, None] = {}
    for tree in forest.trees:
        rules.update(dict.fromkeys(_paths(tree._java_obj.rootNode(), {})))
    # All of them: the lasso selects.
    chosen = list(rules)
    if not chosen:
        return RuleEnsemble(_logit((positive + 0.5) / (n + 1.0)))
    indicators = F.array(*[r.column().cast("double") for r in chosen])
    lasso = LogisticRegression(
        elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=60, featuresCol="rules", labelCol="label"
    ).fit(materialise(sample.select("label", array_to_vector(indicators).alias("rules")), "rules"))
    kept = [(r, float(w)) for r, w in zip(chosen, lasso.coefficients.toArray()) if w]
    return RuleEnsemble(float(lasso.intercept), tuple(kept))


def _logit(p: float) -> float:
    import math

    return math.log(p / (1 - p))


def _learnt(
    docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, held_out: tuple[int, int], max_labelled: int
) -> tuple[DataFrame, Column, RuleEnsemble]:
    rows = materialise(with_statistics(docs, key, text), "statistics")
    divisor, remainder = held_out
    aside = F.coalesce(F.crc32(F.col("key").cast("string").cast("binary")) % divisor == remainder, F.lit(False))
    known = labels.select(F.col(key).alias("key"), F.col(label).alias("label"))
    return rows, aside, fit(rows.where(~aside).join(known, "key"), max_labelled=max_labelled)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    key: str = "doc_id",
    text: str = "text",
    held_out: tuple[int, int] = (4, 2),
    threshold: float = 0.7,
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """``key, held_out, score, predicted`` for each row. Labels are learnt only from rows whose
    crc32 of the id, as text, leaves another remainder than ``held_out`` (divisor, remainder)."""
    rows, aside, ensemble = _learnt(docs, labels, label, key, text, held_out, max_labelled)
    return rows.select(
        F.col("key").alias(key), aside.alias("held_out"), ensemble.score().alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    key: str = "doc_id",
    text: str = "text",
    held_out: tuple[int, int] = (4, 2),
    threshold: float = 0.7,
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold; no row moves to be decided."""
    _, _, ensemble = _learnt(docs, labels, label, key, text, held_out, max_labelled)
    kinds = ", ".join(f"{name} double" for name in STATISTICS)

    @F.pandas_udf(kinds)
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics(t) for t in texts], columns=list(STATISTICS), dtype="float64")

    scored = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        found(F.coalesce(F.col(text), F.lit(""))).alias("found"),
    ).select("row", "found.*")
    kept = scored.where(ensemble.score() >= threshold)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
