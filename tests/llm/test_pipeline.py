import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    """A small corpus with labels: good and shouted texts, copies, near copies, a passage."""
    rng = random.Random(8)
    passage = " ".join("".join(rng.choice("mnopqr") for _ in range(6)) for _ in range(60))
    rows, labels = [], []
    for i in range(120):
        words = ["".join(rng.choice("aeioulnrst") for _ in range(6)) for _ in range(80)]
        bad = i % 4 == 0
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words), "en", "s", 0, "extra"))
        labels.append((i, int(not bad), 0))
    rows += [(200, rows[1][1] + "\n", "en", "s", 0, "e"), (201, rows[2][1] + " end", "en", "s", 0, "e")]
    rows += [(202, rows[3][1][:200] + " " + passage, "en", "s", 0, "e"), (203, rows[5][1][:300] + " seldom uttered " + passage, "en", "s", 0, "e")]
    rows += [(204, None, None, None, None, None), (205, "", "en", "s", 0, "e")]
    rows = [(*r[:4], len(r[1] or ""), r[5]) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [{r.doc_id: r for r in docs.collect()}]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(path := f"{folder}/{i}")
        docs = spark.read.parquet(path)
        seen.append({r.doc_id: r for r in docs.collect()})
    _, good, distinct, apart, cut = seen
    assert {i for i in range(120) if i % 4} <= good.keys() and not {0, 4, 8} & good.keys()
    assert 1 not in distinct and 200 in distinct  # the longer of two equal texts stays
    assert 2 in apart and 201 not in apart
    assert cut[203].text != apart[203].text and len(cut[203].text) == cut[203].n_chars
    assert "seldom uttered" in cut[203].text and len(cut[203].text) < 40
    pieces = corpus_pipeline.pack(spark, docs, folder)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == cut.keys()


def test_stages_carry_columns_of_any_name(spark, folder):
    names = ["n_removed", "n_bytes", "__no_text", "no_text", "cut", "_cut", "kept", "rank", "row", "columns", "__chosen", "score", "a.b", "key"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").drop("key")
    docs = docs.select("*", *[F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in names])
    plain = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "n_chars")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out, expected = stage(spark, docs, folder), stage(spark, plain, folder)
        assert out.columns == docs.columns
        assert sorted(map(tuple, out.select(*plain.columns).collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
        assert out.where(" or ".join(f"`{n}` <> concat('{n} ', doc_id)" for n in names)).count() == 0
        out.write.parquet(path := f"{folder}/clash{i}")
        expected.write.parquet(also := f"{folder}/plain{i}")
        docs, plain = spark.read.parquet(path), spark.read.parquet(also)
    assert corpus_pipeline.pack(spark, docs, folder).count() > 0


def test_stages_take_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_every_query_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_run_on_the_given_tables(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("whole")).where("not whole").count() == 0
