import random
import re

import pytest
from pyspark.sql import functions as F

from tandem.operators import gramindex, substring
from tandem.operators.gramindex import GramIndex
from tandem.session import scratch_path


def like(pattern, text):
    """``%pattern%`` as a regular expression, letters alike in either case."""
    out, at = "", 0
    whole = pattern + "%"
    while at < len(whole):
        c = whole[at]
        if c == "\\" and at + 1 < len(whole):
            at += 1
            out += re.escape(whole[at].lower())
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c.lower()))
        at += 1
    return text is not None and re.search("(?s)" + out + "$" if whole.endswith("\\%") else "(?s)" + out, text.lower()) is not None


def records(seed=1, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = "".join(rng.choice("abcdAB%_\\ é") for _ in range(rng.randrange(0, 12)))
        rows.append((rng.randrange(-200_000, 200_000) * 2 + i % 2, a if i % 17 else None, "common tail" if i % 3 == 0 else f"x{i}"))
    return list({r[0]: r for r in rows}.values())


PATTERNS = ["a", "ab", "abc", "A_b", "%", "", "___", "_" * 11, "mm", "common", "tail", "a%d", "\\%", "\\_", "\\\\", "é", "zz", "x1", "q\\", "\\", "b\\a", "n t_il", "_%_"]


@pytest.mark.parametrize("k", [3, 10_000])
def test_equals_a_match_of_every_record(spark, k):
    rows = records()
    df = spark.createDataFrame(rows, "key long, a string, `b c` string")
    index = GramIndex.build(df, scratch_path(spark, "grams-test"), ["a", "b c"], id_col="key")
    queries = spark.createDataFrame([*enumerate(PATTERNS), (99, None)], "query_id long, query_text string")
    got = {}
    for r in index.search(queries, k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    for q, pattern in enumerate(PATTERNS):
        expected = sorted(i for i, a, b in rows if like(pattern, a) or like(pattern, b))[:k]
        assert sorted(got.get(q, [])) == list(enumerate(expected, 1)), pattern
    assert 99 not in got
    plain = substring.substring_topk(df.withColumnRenamed("key", "id"), queries.where("query_id < 99"), k, ["a", "b c"])
    assert sorted(map(tuple, plain.collect())) == sorted((q, i, r) for q, v in got.items() for r, i in v)


def test_bitmaps_hold_the_records_of_each_sequence(spark):
    rows = [(5, "abc"), (5 + (1 << 15), "xbc"), (-3, "bcbc"), (70_000, None)]
    df = spark.createDataFrame(rows, "id long, a string")
    index = GramIndex.build(df, scratch_path(spark, "grams-test"), ["a"])
    counts = {r.gram: r.n for r in index.counts.collect()}
    assert (counts["bc"], counts["b"], counts["abc"], counts["cbc"]) == (3, 3, 1, 1)
    assert {r.span for r in index.bitmaps.where("gram = 'bc'").collect()} == {0, 1, -1}
    plan = index.bitmaps.where("folder in (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan


def test_early_stop_reads_the_first_folders_only(spark, monkeypatch):
    df = spark.range(4000).select((F.col("id") * 20_000).alias("id"), F.lit("every record alike").alias("a"))
    index = GramIndex.build(df, scratch_path(spark, "grams-test"), ["a"])
    read = []
    verified = GramIndex._verified

    def counting(self, met):
        read.append(met.agg(F.sum("n")).head()[0])
        return verified(self, met)

    monkeypatch.setattr(GramIndex, "_verified", counting)
    queries = spark.createDataFrame([(1, "alike"), (2, "%"), (3, "e")], "query_id long, query_text string")
    found = index.search(queries, 5)
    assert [r.id for r in found.where("query_id = 1").orderBy("rank").collect()] == [0, 20_000, 40_000, 60_000, 80_000]
    assert found.count() == 15 and sum(read) < 200


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id long, a string")
    index = GramIndex.build(df, scratch_path(spark, "grams-test"), ["a"])
    queries = spark.createDataFrame([(1, "x"), (2, "%")], "query_id long, query_text string")
    assert index.search(queries, 3).count() == 0
    full = GramIndex.build(spark.createDataFrame([(1, "x")], df.schema), scratch_path(spark, "grams-test"), ["a"])
    assert full.search(queries.limit(0), 3).count() == 0
    assert gramindex.LONGEST == 3


def test_one_file_is_built_by_many_tasks(spark, monkeypatch):
    dealt = []
    by_range = type(spark.range(1)).repartitionByRange

    def recording(self, *args):
        dealt.extend(a for a in args if isinstance(a, int))
        return by_range(self, *args)

    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", recording)
    monkeypatch.setattr(gramindex, "TASK_LETTERS", 1000, raising=False)
    monkeypatch.setattr(gramindex, "FOLDERS", 4)
    df = spark.range(200).coalesce(1).select("id", F.format_string("Customer#%09d", "id").alias("a"))
    index = GramIndex.build(df, scratch_path(spark, "grams-test"), ["a"])
    assert dealt == [4]  # 3,600 letters
    assert {r.gram: r.n for r in index.counts.where("gram in ('er#', '#00', '199')").collect()} == {"er#": 200, "#00": 200, "199": 1}


def test_tasks_of_a_build_grow_with_letters_and_stay_few_per_bitmap():
    assert [gramindex._build_tasks(*x) for x in ((0, 1, 12), (1 << 20, 1, 12), (1 << 30, 1, 12), (97_200_000, 165, 12))] == [1, 4, 12, 371]
