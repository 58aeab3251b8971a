"""Segments of a streamed index, stored matches, answers by content, jobs as data."""

import random

import pytest
from pyspark.sql import functions as F

from tandem.models import HashedTermEmbedder
from tandem.operators import keyword
from tandem.plans import compare
from tandem.session import scratch_path
from tandem.sources.contentstore import ContentStore, call_judge_once, content_key, embed_incremental
from tandem.sources.matchstore import MatchStore
from tandem.streaming.segments import SegmentStore

RECORDS = "id long, contextual_content string, code string, seq long, deleted boolean"


def store(spark, **options):
    return SegmentStore(spark, scratch_path(spark, "segments-test"), "code string", "simple", id_text="code", order="seq", **options)


def as_batch(spark, live):
    """The batch index of the live records, ``id -> (text, code)``."""
    rows = [(i, t, c) for i, (t, c) in live.items()]
    records = spark.createDataFrame(rows, "id long, contextual_content string, code string")
    return keyword.KeywordIndex.build(records, id_text="code", analyzer="simple")


def terms(index):
    return sorted(tuple(r) for r in index.postings.select("id", "term", "tf").collect())


def test_segments_equal_the_batch_index_after_every_batch(spark):
    rng = random.Random(4)
    made, live = store(spark, fan=3), {}
    for number in range(11):
        batch = {}
        for _ in range(12):
            i = rng.randrange(30)
            batch.setdefault(i, []).append((i, f"red {rng.randrange(4)} ring" if rng.random() < 0.9 else None, f"C-{i}", rng.randrange(100), rng.random() < 0.15))
        if number == 3:
            # Rows of the batch before come again as they were.
            batch = again
        rows = [r for of in batch.values() for r in of]
        made.append(spark.createDataFrame(rows, RECORDS), number)
        again = batch
        for i, of in batch.items():
            _, text, code, _, deleted = max(of, key=lambda r: (r[3], r[1] is not None, r[1] or "", r[2], r[4]))
            live.pop(i, None)
            if not deleted:
                live[i] = (text, code)
        if number in (2, 3, 7, 10):
            assert sorted((r.id, r.contextual_content) for r in made.records().collect()) == sorted((i, t) for i, (t, _) in live.items())
            assert terms(made.index()) == terms(as_batch(spark, live))
            assert made.statistics() == (len(live), sum(n for *_, n in terms(made.index())))
    levels = [s["level"] for s in made.manifest()]
    assert levels == sorted(levels, reverse=True) and all(levels.count(x) < 3 for x in levels) and max(levels) == 2


def test_a_batch_that_runs_again_counts_once_and_readers_keep_their_version(spark):
    made = store(spark)
    rows = [(1, "red", "a", 1, False), (2, "blue", "b", 1, None)]
    made.append(spark.createDataFrame(rows, RECORDS), 0)
    version = made.manifest()[0]["version"]
    made.append(spark.createDataFrame([(9, "never", "z", 1, False)], RECORDS), 0)
    made.append(spark.createDataFrame([(1, "green", "a", 1, False), (2, "x", "b", 1, True)], RECORDS), 1)
    assert [(r.id, r.contextual_content) for r in made.records().collect()] == [(1, "green")]
    assert sorted(r.contextual_content for r in made.records(version).collect()) == ["blue", "red"]
    assert made.statistics() == (1, 2) and made.statistics(version) == (2, 4)
    assert store(spark).records().count() == 0 and store(spark).statistics() == (0, 0)


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "id long, contextual_content string, code string"
    made = SegmentStore(spark, str(tmp_path / "index"), "code string", "simple", id_text="code")
    for part in range(3):
        rows = [(i, f"text {part}", f"code{i}") for i in range(part, part + 3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        made.start(stream, str(tmp_path / "marks")).awaitTermination()
    found = keyword.keyword_topk(made.index(), spark.createDataFrame([(1, "text 2"), (2, "code0")], "query_id long, query_text string"), 9)
    assert sorted((r.query_id, r.id) for r in found.collect()) == [(1, 2), (1, 3), (1, 4), (2, 0)]


def test_replaced_matches_by_version(spark):
    def matches(rows):
        return spark.createDataFrame(rows, "left_id long, right_id long, score double")

    made = MatchStore(spark, scratch_path(spark, "matches-test"), buckets=8)
    with pytest.raises(ValueError):
        made.read()
    old = [(i, j, 0.5) for i in range(40) for j in range(2)]
    made.write(matches(old))
    lefts = spark.createDataFrame([(3,), (5,), (3,)], "left_id long")
    assert made.replace(lefts, matches([(3, 7, 0.9)])) == 1
    new = [r for r in old if r[0] not in (3, 5)] + [(3, 7, 0.9)]
    assert sorted(map(tuple, made.read().collect())) == sorted(new)
    assert sorted(map(tuple, made.read(0).collect())) == sorted(old)
    written = {r["written"] for r in made._versions.rows()}
    assert written == {0, 1} and sum(r["written"] == 1 for r in made._versions.rows()) <= 2
    with pytest.raises(ValueError):
        made.replace(lefts, matches([(4, 1, 0.1)]))
    assert made.versions() == 2 and sorted(map(tuple, made.read().collect())) == sorted(new)
    made.replace(lefts.limit(0), matches([]))
    assert sorted(map(tuple, made.read().collect())) == sorted(new)


def test_replies_are_paid_for_once(spark):
    class Counted:
        def __init__(self, calls, failing=()):
            self.calls, self.failing = calls, failing

        def reply(self, system_prompt, prompt, max_tokens):
            self.calls.add(1)
            if prompt in self.failing:
                raise ConnectionError(prompt)
            return f"{system_prompt[:3]} {prompt} {max_tokens}"

    rows = [(1, "a", 10), (2, "b", 10), (3, "a", 10), (4, "a", 20), (5, "c", 10)]
    prompts = spark.createDataFrame(rows, "left_id long, prompt string, max_tokens int")
    replies, calls = ContentStore(spark, scratch_path(spark, "replies-test"), "string"), spark.sparkContext.accumulator(0)

    def run(failing=(), **options):
        before = calls.value
        got = {r.left_id: r.reply for r in call_judge_once(prompts, Counted(calls, failing), replies, "m", tasks=2, **options).collect()}
        return calls.value - before, got

    asked, got = run(failing=("b",))
    assert asked == 4 and got[1] == got[3] != got[4] and got[2] is None
    assert run()[0] == 1 and run() == (0, {i: f"You {p} {n}" for i, p, n in rows})
    assert run(system="Other")[0] == 4
    keys = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "bc"), ("", "bc")], "x string, y string").select(content_key("x", "y"))
    assert len({r[0] for r in keys.collect()}) == 4


def test_vectors_are_made_once_per_text(spark):
    texts = spark.sparkContext.accumulator(0)

    class Counting(HashedTermEmbedder):
        def embed(self, rows):
            texts.add(len(rows))
            return super().embed(rows)

    vectors = ContentStore(spark, scratch_path(spark, "vectors-test"), "array<double>")
    first = spark.createDataFrame([(1, "red"), (2, "red"), (3, "blue"), (4, None)], "id long, contextual_content string")
    one = embed_incremental(first, Counting(8), vectors, "m")
    more = spark.createDataFrame([(5, "blue"), (6, "green")], first.schema)
    both = one.unionByName(embed_incremental(more, Counting(8), vectors, "m")).collect()
    assert texts.value == 4 and all(len(r.embedding) == 8 for r in both)
    assert {r.id: r.embedding for r in both}[5] == {r.id: r.embedding for r in both}[3]


def job_rows(spark):
    rows = []
    for job, shift in (("a", 0), ("b", 1 << 45), (None, -5)):
        for i in range(8):
            cells = {"name": f"item {i % 4} {job}", "colour": "red" if i % 2 else "nan", "size": str(i)}
            rows.append((job, shift + i, "left" if i < 4 else "right", i % 4, "s", cells, [1.0, float(i % 4), float(i // 6)]))
    schema = "job_id string, id long, side string, original_row long, sheet_name string, cells map<string,string>, embedding array<double>"
    return spark.createDataFrame(rows, schema)


def test_jobs_as_data_equal_single_runs(spark):
    rows = job_rows(spark)

    class Lengths:
        def reply(self, system_prompt, prompt, max_tokens):
            parts = prompt.split("--- Candidate")[1:]
            return "[" + ", ".join(str(len(p) % 50 / 50) for p in parts) + "]"

    jobs = spark.createDataFrame(
        [("a", 2, ["colour"], "name", False), ("b", 3, ["size", "colour"], None, True), (None, 1, None, None, False)],
        "job_id string, top_k int, right_columns array<string>, right_display string, judge_enabled boolean")
    got = compare.run_jobs(rows, jobs, judge=Lengths()).collect()
    for job, k, columns, display, judged in [tuple(r) for r in jobs.collect()]:
        own = rows.where(F.col("job_id").eqNullSafe(F.lit(job)))
        records = compare.job_records(own, compare._job_table(jobs)).withColumn("embedding", F.col("embedding"))
        run = compare.run_compare(records, compare.RunConfig(top_k=k, judge_enabled=judged), judge=Lengths()).matches
        expected = sorted((r.left_id, r.right_id, round(r.final_score, 9), r["rank"]) for r in run.collect())
        mine = [r for r in got if r.job_id == job]
        assert sorted((r.left_id, r.right_id, round(r.final_score, 9), r["rank"]) for r in mine) == expected
        assert all((r.right_display is None) == (display is None) for r in mine)
    texts = {r.contextual_content for r in compare.job_records(rows, compare._job_table(jobs)).where("side = 'right'").collect()}
    assert "[sheet] s | [size] 4" in texts and "[sheet] s | [size] 5 | [colour] red" in texts and "[sheet] s" in texts


def test_job_tables_are_checked(spark):
    rows = job_rows(spark)
    for wrong in ([("a", 0, True)], [("a", 1, True), ("a", 2, True)], [("a", 1, False)]):
        with pytest.raises(ValueError):
            compare.run_jobs(rows, spark.createDataFrame(wrong, "job_id string, top_k int, vector_enabled boolean"))
