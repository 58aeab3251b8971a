"""A training corpus from ``documents`` in five stages, each written before the next reads it.

Every stage works on all rows that the one before kept. Null texts count as empty; a stage
decides by id, so rows that repeat an id stay or go together; columns beyond those of
``documents`` are carried along; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import exact, packing, quality, setsketch, suffixes
from tandem.llm.common import free_name, prepared
from tandem.session import materialise


def _kept(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    chosen = decisions.where("kept").select(F.col("doc_id").alias("__chosen"))
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["__chosen"]), "left_semi")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    labels = prepared(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, labels)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, white space aside."""
    return _kept(docs, exact.exact_groups(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return _kept(docs, setsketch.near_duplicates(docs, k=5, percent=80))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages of 100 bytes or more that start earlier in the corpus, with
    their new length; documents that consist of nothing else go."""
    facts = free_name("cut", docs.columns)
    cut = suffixes.kept_texts(docs, facts=facts)
    removed = F.col(f"{facts}.n_removed")
    cut = cut.where((removed == 0) | (removed < F.col(f"{facts}.n_bytes")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new_length = F.char_length("text").cast(kind)
        cut = cut.withColumn("n_chars", F.when(removed > 0, new_length).otherwise(F.col("n_chars")))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in training sequences."""
    tokens = packing.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack_documents(docs, tokens)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("packing", pack),
]

# No SQL for a learnt classifier and a tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
