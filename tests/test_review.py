import datetime as dt

import pytest
from pyspark.sql import functions as F

from tandem.functions import scores
from tandem.operators import decisions as dec
from tandem.operators import profile, reports
from tandem.functions.patterns import RowFilter

T = dt.datetime(2024, 1, 1)
LOG = "seq long, left_id long, matched_right_id long, matched_right_ids array<long>, decided_at timestamp, review_comment string, review_outcome string, deleted boolean"


@pytest.fixture(scope="module")
def records(spark):
    rows = [(i, "left", i, f"left {i}", None if i == 2 else f"L{5 - i}") for i in range(6)]
    rows += [(100 + i, "right", i, f"right {i} 50%_x" if i == 3 else f"right {i}", f"R{i}") for i in range(5)]
    return spark.createDataFrame(rows, "id long, side string, original_row long, contextual_content string, display_value string")


@pytest.fixture(scope="module")
def matches(spark):
    rows = [(i, 100 + (i + r) % 5, 0.9 - 0.1 * r - 0.05 * i, None, None, {"reason": "ä"} if r == 0 else None, 0.9 - 0.1 * r - 0.05 * i, r + 1)
            for i in range(6) for r in range(3)]
    return spark.createDataFrame(rows, "left_id long, right_id long, cosine_score double, rerank_score double, judge_score double, judge_meta map<string,string>, final_score double, rank int")


@pytest.fixture(scope="module")
def log(spark):
    def at(n):
        return T + dt.timedelta(minutes=n)

    return spark.createDataFrame([
        (1, 0, None, [100, 101], at(1), "both", None, False),
        (2, 1, 101, [], at(2), None, "partial", False),
        (3, 2, None, [], at(3), "", "no_match", False),
        (4, 3, None, [103], at(4), "", "fail", False),
        (5, 3, None, None, at(5), "", None, True),
        (6, 4, None, [104], at(6), "", "", False),
        (7, 4, None, [100], at(6), "same time, later row", "", False),
        (8, 5, None, None, at(3), "", "fail", False),
        (9, 5, None, [100], at(2), "late arrival", None, False),
    ], LOG)


def test_current_view(log):
    rows = {r.left_id: r for r in dec.current_decisions(log).collect()}
    assert sorted(rows) == [0, 1, 2, 4, 5]
    assert rows[4].seq == 7 and rows[5].seq == 8


def test_ids(spark):
    df = spark.createDataFrame(
        [([3, None, 1, 3], 9, None), ([], 9, "partial"), (None, 9, None), (None, None, None), ([1], 9, "no_match")],
        "ids array<long>, one long, o string")
    rows = df.select(
        scores.deduplicated_ids("ids").alias("d"), scores.effective_ids("ids", "one").alias("e"),
        scores.submitted_ids("o", "ids", "one").alias("s")).collect()
    assert rows[0].d == [3, 1]
    assert [r.e for r in rows[1:]] == [[9], [9], [], [1]]
    assert [r.s for r in rows] == [[3, 1], [], [9], [], []]


def test_submission_checks(spark, log, matches):
    bad = log.limit(1).withColumn("review_outcome", F.lit("maybe"))
    with pytest.raises(Exception, match="unknown review outcome"):
        dec.resolve_submissions(bad).collect()
    wrong = dec.invalid_selections(log.where("seq in (1, 4, 9)"), matches).collect()
    assert {(r.left_id, r.right_id) for r in wrong} == set()
    elsewhere = log.where("seq = 1").withColumn("left_id", F.lit(2))
    assert {(r.left_id, r.right_id) for r in dec.invalid_selections(elsewhere, matches).collect()} == {(2, 100), (2, 101)}


def test_statistics(records, log):
    current = dec.current_decisions(log)
    stats = dec.review_statistics(records.where("side = 'left'"), current).head()
    assert tuple(stats) == (6, 5, 1, 2, 3)
    counts = dec.outcome_counts(current).head().asDict()
    assert counts == {"no_match": 1, "partial": 1, "fail": 1, "system_fail": 0, "matched_none": 2}


def test_queue(records, matches, log):
    left, right, current = records.where("side = 'left'"), records.where("side = 'right'"), dec.current_decisions(log)

    def queue(**kw):
        return [r.left_id for r in dec.review_queue(left, matches, current, right=right, **kw).collect()]

    assert queue() == [3]
    assert queue(include_decided=True) == [0, 1, 2, 3, 4, 5]
    assert queue(include_decided=True, min_score=0.79) == [0, 1, 2]
    assert queue(outcome="pending") == [3]
    assert queue(outcome=" MATCHED_NONE ") == [0, 4]
    assert queue(outcome="fail") == [5]
    assert queue(include_decided=True, sort_by="display") == [2, 5, 4, 3, 1, 0]
    assert queue(include_decided=True, sort_by="display", descending=True) == [0, 1, 3, 4, 5, 2]
    assert queue(include_decided=True, text="50%_X") == [1, 2, 3]
    assert queue(include_decided=True, text="5_") == []
    assert queue(include_decided=True, text="l4") == [1]
    with pytest.raises(ValueError):
        queue(outcome="done")
    with pytest.raises(ValueError):
        queue(text="x" * 501)
    page = dec.page(dec.review_queue(left, matches, current, include_decided=True), 2, 2)
    assert [r.left_id for r in page.collect()] == [2, 3]


def test_items(records, matches, log):
    left, right, current = records.where("side = 'left'"), records.where("side = 'right'"), dec.current_decisions(log)
    items = {r.left_id: r for r in dec.review_items(dec.review_queue(left, matches, current, include_decided=True), right, matches, current).collect()}
    assert [c.right_id for c in items[0].candidates] == [100, 101, 102]
    assert items[0].candidates[0].judge_meta == '{"reason":"ä"}'
    assert items[1].matched_right_ids == [101] and items[3].is_decided is False and items[4].review_outcome is None


def test_badges(spark):
    df = spark.createDataFrame(
        [(False, "fail", 1), (True, None, 0), (True, "no_match", 0), (True, "system_fail", 0), (True, "system_fail", 2), (True, "no_match", 1), (True, "", 1)],
        "d boolean, o string, n int")
    got = [r[0] for r in df.select(scores.review_badge(F.col("d"), "o", F.col("n"))).collect()]
    assert got == ["", "Reviewed", "No match", "System failure", "Matched · system failure", "Matched", "Matched"]


def test_reports_cover_every_row_once(records, matches, log):
    current = dec.current_decisions(log)
    confirmed = reports.confirmed_matches(records, matches, current).collect()
    assert sorted((r.left_row, r.right_row, r.match_index, r.selected_rights_count, r.review_outcome_display) for r in confirmed) == [
        (0, 0, 1, 2, "matched"), (0, 1, 2, 2, "matched"), (1, 1, 1, 1, "partial"), (4, 0, 1, 1, "matched")]
    unmatched = {r.left_row: r.human_review for r in reports.unique_left(records, current).collect()}
    assert unmatched == {2: "no match", 3: "", 5: "fail"}
    assert {r.right_row for r in reports.unique_right(records, current).collect()} == {2, 3, 4}
    raw = reports.raw_pairs(records, matches, current).collect()
    assert len(raw) == 18 and {r.judge_meta for r in raw} == {"", '{"reason":"ä"}'}
    data = {r.left_row: r for r in reports.evaluation_dataset(records, matches, current).collect()}
    assert data[0].reference == "right 0\n\n---\n\nright 1" and data[3].reference == ""
    assert data[0].retrieved_contexts == ["right 0", "right 1", "right 2"]


def test_browse_limits(records, matches):
    rows = profile.browse_records(records, "right", 2).orderBy("id").collect()
    assert [(r.id, r.total) for r in rows] == [(100, 5), (101, 5)]
    with pytest.raises(ValueError):
        profile.browse_records(records, "middle")
    with pytest.raises(ValueError):
        reports.browse_pairs(records, matches, 0)
    pairs = reports.browse_pairs(records, matches, 1, left_row=4).collect()
    assert len(pairs) == 1 and pairs[0].total == 3


def test_truncation_counts_the_blank_value(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["b", "B", "a", "nan", None, "c"])], "row_no long, v string")
    rows = profile.distinct_cells(df, "v", max_values=4).collect()
    assert [(r.value, r.truncated) for r in rows] == [("a", True), ("B", True), ("b", True)]
    assert [r.value for r in profile.distinct_cells(df, "v", [RowFilter("v", "equals", "b")]).collect()] == ["B", "b"]
    assert [(r.value, r.truncated) for r in profile.distinct_values(df, "v", 2).collect()] == [("B", True), ("a", True)]
    with pytest.raises(ValueError):
        profile.distinct_cells(df, "w")
    assert tuple(profile.filter_counts(df, [RowFilter("v", "contains", "b")]).head()) == (6, 2)
    with pytest.raises(ValueError):
        profile.context_preview(df, "row_no", [], None)


def test_volume(records):
    stats = profile.volume_statistics(records).head()
    assert (stats.records_left, stats.records_right) == (6, 5)
    assert stats.est_embed_tokens == int((stats.avg_chars_left * 6 + stats.avg_chars_right * 5) / 4)


def test_volumes_count_empty_and_nan_texts_of_a_typed_table(spark, tmp_path):
    import queryset

    queryset.load_all()
    rows = [(0, "red ring", "en", "web"), (1, "", "en", "web"), (2, "NaN", "en", "web"), (3, None, "en", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "word")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stats = queryset.QUERIES["volume_statistics"](spark, str(tmp_path)).head().asDict()
    frame = len("[sheet] web | [lang] en | [text] ")
    mean = round(frame + 11 / 3, 4)
    assert stats == {"records_left": 1, "records_right": 4, "avg_chars_left": 4.0, "avg_chars_right": mean,
                     "est_embed_tokens": int((4 + 4 * (frame + 11 / 3)) / 4)}
    terms = {(r.id, r.term) for r in queryset.QUERIES["postings"](spark, str(tmp_path)).collect()}
    assert (1, "text") in terms and (2, "nan") in terms and not any(i == 3 for i, _ in terms)
