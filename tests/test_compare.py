import sys
import json

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tandem.functions import scores
from tandem.models import Throttle
from tandem.operators import judge, matching
from tandem.plans import compare

# The stand-in models below travel to the workers with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.mark.parametrize(
    "reply,n,want",
    [
        ('```json\n[{"score":0.5,"reason":"a"},0.7]\n```', 2, [(0.5, {"reason": "a"}), (0.7, None)]),
        ("[0.1]", 3, [(0.1, None), None, None]),
        ("[0.1,0.2,0.3]", 2, [(0.1, None), (0.2, None)]),
        ('{"scores":[0.2,{"score":2,"reason":"x"}]}', 2, [(0.2, None), (1.0, {"reason": "x"})]),
        ('{"score":0.4}', 1, [(0.4, None)]),
        ('{"score":0.4}', 2, [None, None]),
        ('{"scores":0.4,"score":0.4}', 1, [None]),
        ("true", 1, [None]),
        ('{"score":true}', 1, [None]),
        ('{"score":"0.5"}', 1, [None]),
        ("not json", 2, [None, None]),
        ("", 1, [None]),
        (None, 1, [None]),
        ('[null, true, "0.5", [1], {"reason":"r"}, -3]', 6, [None] * 5 + [(0.0, None)]),
        ('[{"score":1,"n":3,"b":false,"z":null,"o":{"a":1},"l":[1]}]', 1, [(1.0, {"n": "3", "b": "false", "z": None})]),
        (json.dumps([{"score": 1, "reason": "y" * 2500}]), 1, [(1.0, {"reason": "y" * 2000 + "…"})]),
    ],
)
def test_judge_replies(spark, reply, n, want):
    slots = spark.createDataFrame([(reply, n)], "r string, n int").select(judge.parsed_slots("r", "n")).head()[0]
    assert [s and (s.score, s.meta) for s in slots] == want


def test_judge_limits(spark):
    assert judge.effective_rpm(None, 20) == 20
    assert judge.effective_rpm(1000) == 360
    assert judge.effective_rpm(-5) == 0
    assert judge.system_prompt("  own ") == "own"
    assert judge.system_prompt(" ") == judge.DEFAULT_SYSTEM_PROMPT
    df = spark.createDataFrame([(0,), (1,), (14,), (20,), (500,)], "n int")
    assert [r[0] for r in df.select(judge.completion_budget("n")).collect()] == [2048, 2048, 2050, 2818, 8192]


def test_throttle_spaces_calls(monkeypatch):
    slept, now = [], [100.0]
    monkeypatch.setattr("tandem.models.time.monotonic", lambda: now[0])
    monkeypatch.setattr("tandem.models.time.sleep", slept.append)
    throttle = Throttle(30)
    throttle.wait()
    now[0] += 0.5
    throttle.wait()
    assert slept == [1.5]
    Throttle(0).wait()
    assert slept == [1.5]


def test_score_rules(spark):
    df = spark.createDataFrame(
        [(0.1, 0.2, 0.3), (None, 0.2, 0.3), (None, None, 0.3), (None, 1.5, None), (None, -1.0, 0.9)],
        "j double, r double, c double")
    rows = df.select(
        scores.final_score("j", "r", "c").alias("f"), scores.legacy_final_score("r", "c").alias("l"),
        scores.score_band(scores.final_score("j", "r", "c")).alias("b")).collect()
    assert [r.f for r in rows] == [0.1, 0.2, 0.3, 1.5, -1.0]
    assert [r.l for r in rows] == [0.2, 0.2, 0.3, 0.0, 0.9]
    assert [r.b for r in rows] == ["weak", "weak", "weak", "match", "weak"]


def test_run_settings():
    for bad in (
        {"vector_enabled": False}, {"vector_enabled": False, "reranker_enabled": True}, {"top_k": 0},
        {"vector_enabled": False, "judge_enabled": True},
    ):
        with pytest.raises(ValueError):
            compare.RunConfig(**bad)
    compare.RunConfig(vector_enabled=False, judge_enabled=True, max_rights=10)


@pytest.fixture(scope="module")
def records(spark):
    rng = np.random.default_rng(1)
    rows = [(2 * i, "left", i, f"left text {i}", rng.standard_normal(4).tolist()) for i in range(6)]
    rows += [(2 * i + 1, "right", i, f"right text {i} {'x' * i}", rng.standard_normal(4).tolist()) for i in range(9)]
    return spark.createDataFrame(rows, "id long, side string, original_row long, contextual_content string, embedding array<double>")


class Halves:
    """Scores the first candidate 0.5, fails for one left row, answers rubbish for another."""

    def reply(self, system_prompt, prompt, max_tokens):
        if "left text 1" in prompt:
            raise RuntimeError("down")
        if "left text 2" in prompt:
            return "sorry"
        return '[{"score": 0.5, "reason": "first"}]'


def test_judge_failures_fall_back(spark, records):
    run = compare.run_compare(records, compare.RunConfig(top_k=3, judge_enabled=True, judge_rpm=360), judge=Halves())
    rows = run.matches.collect()
    judged = {r.left_id for r in rows if r.judge_score is not None}
    assert judged == {0, 6, 8, 10}
    for r in rows:
        assert r.final_score == (r.judge_score if r.judge_score is not None else r.cosine_score)
    counts = run.metrics().head()
    assert (counts.candidate_pairs, counts.left_rows, counts.judge_requests, counts.judge_unparsed) == (18, 6, 6, 14)
    with pytest.raises(ValueError):
        compare.run_compare(records, compare.RunConfig(judge_enabled=True))


class Broken:
    def score(self, queries, texts):
        raise RuntimeError("down")


def test_scorer_failure_falls_back_to_cosine(spark, records):
    run = compare.run_compare(records, compare.RunConfig(top_k=3, reranker_enabled=True), scorer=Broken())
    rows = run.matches.collect()
    assert len(rows) == 18 and all(r.rerank_score == r.cosine_score for r in rows)
    pairs = spark.createDataFrame([(1, 2, 0.4, 1)], "left_id long, right_id long, cosine_score double, cand_pos int")
    assert matching.rerank_pairs(pairs, None, enabled=False).head().rerank_score == 0.4


def test_ranks_are_dense_and_ties_keep_candidate_order(spark):
    rows = [(1, 10, 0.5, 2), (1, 11, 0.5, 1), (1, 12, 0.9, 3), (2, 10, 0.1, 1)]
    scored = matching.with_scores(
        spark.createDataFrame(rows, "left_id long, right_id long, cosine_score double, cand_pos int"), None)
    ranked = [(r.left_id, r.right_id, r["rank"]) for r in matching.rank_matches(scored, 2).orderBy("left_id", "rank").collect()]
    assert ranked == [(1, 12, 1), (1, 11, 2), (2, 10, 1)]


def test_caps(spark, records):
    left, right = matching.side_of(records, "left"), matching.side_of(records, "right")
    pairs = matching.capped_candidates(left, right, 2).collect()
    assert {(r.left_id, r.right_id, r.cand_pos) for r in pairs} == {(2 * i, 2 * j + 1, j + 1) for i in range(6) for j in range(2)}
    report = matching.capped_rights_report(right, 1).head()
    assert (report.rights_loaded, report.rights_total, report.truncated) == (1, 9, True)
    with pytest.raises(ValueError):
        matching.capped_rights_report(right, 0)
    many = spark.range(60_100)
    assert matching.first_left_rows(many, 60_000).count() == 60_000
    assert matching.capped_rights(many, 1000).select(F.size("ids")).head()[0] == 1000
    report = matching.left_rows_report(left, 2).head()
    assert (report.lefts_used, report.lefts_total, report.limited) == (2, 6, True)
    assert [r.id for r in matching.first_left_rows(left, 2).collect()] == [0, 2]
    assert matching.first_left_rows(left, None).count() == 6


def test_rejudge_touches_only_chosen_rows(spark, records):
    old = compare.run_compare(records, compare.RunConfig(top_k=3)).matches
    chosen = spark.createDataFrame([(0,)], "left_id long")
    new = compare.rejudge(old, chosen, records, compare.RunConfig(top_k=3, judge_enabled=True), Halves())
    before = {(r.left_id, r.right_id): r.final_score for r in old.collect()}
    after = {(r.left_id, r.right_id): r.final_score for r in new.collect()}
    assert before.keys() == after.keys()
    assert {k for k in before if before[k] != after[k]} <= {k for k in before if k[0] == 0}
    with pytest.raises(ValueError):
        compare.rejudge(old, chosen, records, compare.RunConfig(), Halves())


def test_many_jobs_equal_single_runs(spark, records):
    jobs = records.withColumn("job_id", F.lit("a")).unionByName(records.where("id < 9").withColumn("job_id", F.lit("b")))
    config = compare.RunConfig(top_k=2)
    got = {(r.job_id, r.left_id, r.right_id, r["rank"]) for r in compare.run_many(jobs, config).collect()}
    want = set()
    for job, part in (("a", records), ("b", records.where("id < 9"))):
        want |= {(job, r.left_id, r.right_id, r["rank"]) for r in compare.run_compare(part, config).matches.collect()}
    assert got == want


class FailsOnOne:
    """A scorer that breaks on a batch that holds the text ``bad``."""

    def score(self, queries, texts):
        if "bad" in queries:
            raise RuntimeError("no")
        return [0.9 for _ in queries]


def test_a_failing_left_row_falls_back_alone(spark):
    pairs = spark.createDataFrame(
        [(left, right, 0.1, 1) for left in range(5) for right in (10, 11)],
        "left_id long, right_id long, cosine_score double, cand_pos int",
    )
    texts = spark.createDataFrame([(i, "bad" if i == 3 else f"text {i}") for i in [*range(5), 10, 11]], "id long, text string")
    got = matching.rerank_pairs(pairs.coalesce(1), texts, FailsOnOne()).collect()
    assert {(r.left_id, r.rerank_score) for r in got} == {(i, 0.1 if i == 3 else 0.9) for i in range(5)}


class TextLengths:
    """Scores each candidate by how long its text is, which only fits its own job's texts."""

    def reply(self, system_prompt, prompt, max_tokens):
        blocks = prompt.split("--- Candidate ")[1:]
        return str([min(1.0, len(b.split("---\n", 1)[1].strip()) / 100) for b in blocks])


def test_jobs_with_the_same_rows_are_judged_apart(spark):
    rows, source = [], []
    for job in ("a", "b", None):
        for i in range(4):
            side = "left" if i < 2 else "right"
            rows.append((job, i, side, i % 2, "s", f"text {i}", None, [1.0, 0.1 * i]))
            source.append((job, side, i % 2, "s", "x" * (10 + i if job == "a" else 50 + i)))
    records = spark.createDataFrame(
        rows, "job_id string, id long, side string, original_row long, sheet_name string, contextual_content string,"
        " display_value string, embedding array<double>")
    extra = spark.createDataFrame(source, "job_id string, side string, original_row long, sheet_name string, note string")
    config = compare.RunConfig(top_k=2, judge_enabled=True, judge_left_columns=["note"], judge_right_columns=["note"])
    got = compare.run_many(records, config, source_rows=extra, judge=TextLengths()).collect()
    assert len(got) == 12 and {r.job_id for r in got} == {"a", "b", None}
    assert {len({(r.left_id, r.right_id) for r in got if r.job_id == job}) for job in ("a", "b", None)} == {4}
    assert max(r.judge_score for r in got if r.job_id == "a") < min(r.judge_score for r in got if r.job_id == "b")


class Constant:
    def reply(self, system_prompt, prompt, max_tokens):
        return str([0.5] * prompt.count("--- Candidate "))


def test_a_run_without_vectors_finds_right_rows_of_any_id(spark):
    rows = [(0, "left", 0, "a", "blue kettle"), (2, "left", 1, "b", "red lamp"), (4, "left", 2, "a", "nothing alike")]
    rows += [(2 * i + 1, "right", i, "a" if i < 200 else "b", f"plain row {i}") for i in range(300)]
    rows += [(9001, "right", 9000, "a", "a kettle in blue"), (9003, "right", 9001, "b", "the red one"), (9005, "right", 9002, "a", None)]
    records = spark.createDataFrame(rows, "id long, side string, original_row long, job_id string, contextual_content string")
    config = compare.RunConfig(vector_enabled=False, judge_enabled=True, max_rights=2)
    run = compare.run_compare(records, config, judge=Constant())
    assert {(r.left_id, r.right_id, r.cand_pos) for r in run.candidates.collect()} == {(0, 9001, 1), (2, 9003, 1)}
    jobs = compare.run_many(records, config, judge=Constant()).collect()
    assert {(r.job_id, r.left_id, r.right_id) for r in jobs} == {("a", 0, 9001), ("b", 2, 9003)}


def test_the_judge_sees_texts_of_a_typed_table_as_given(spark, tmp_path):
    import queryset

    queryset.load_all()
    docs = [(0, "red ring", "en", "web"), (1, "", "en", "web"), (2, "NaN", "en", "web"), (3, None, "en", "web")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "word"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.id: r.text for r in queryset.QUERIES["judge_text_override"](spark, str(tmp_path)).collect()}
    start = "[sheet] web | [lang] en | [text] "
    assert got == {0: "[sheet] benchmark | [item_id] 0 | [n_chars] 4", 2: None, 1: start + "red ring", 3: start, 5: start + "NaN", 7: None}
