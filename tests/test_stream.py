import datetime as dt

import pytest
from pyspark.sql import functions as F

from tandem.models import HashedTermEmbedder
from tandem.operators.decisions import current_decisions
from tandem.operators.keyword import build_postings
from tandem.streaming import decisions, ingest

T = dt.datetime(2024, 1, 1)


def test_decisions_in_several_batches_with_late_rows(spark, tmp_path):
    schema = "seq long, left_id long, decided_at timestamp, review_outcome string, deleted boolean"
    rows = [(i, i % 7, T + dt.timedelta(minutes=(i * 37) % 50), None if i % 3 else "fail", i % 5 == 0) for i in range(60)]
    source = str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    decisions.start_decisions(stream, out, marks).awaitTermination()
    want = {(r.left_id, r.seq) for r in current_decisions(spark.createDataFrame(rows, schema)).collect()}
    assert spark.read.parquet(out).select("batch").distinct().count() == 3
    assert {(r.left_id, r.seq) for r in decisions.read_current(spark, out).collect()} == want
    # More rows arrive: only the new batch is processed, then everything is folded into one.
    more = [(100, 1, T + dt.timedelta(days=1), "partial", False)]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(source)
    decisions.start_decisions(stream, out, marks).awaitTermination()
    want = {(r.left_id, r.seq) for r in current_decisions(spark.createDataFrame(rows + more, schema)).collect()}
    decisions.compact(spark, out, str(tmp_path / "compact"))
    for path in (out, str(tmp_path / "compact")):
        assert {(r.left_id, r.seq) for r in decisions.read_current(spark, path).collect()} == want


def test_ingest_equals_batch_and_drops_replays(spark, tmp_path):
    schema = "doc_id long, ts timestamp, sheet_name string, text string"
    rows = [(i, T + dt.timedelta(seconds=i), "s", f"red ring {i % 4}") for i in range(20)]
    source = str(tmp_path / "in")
    for part in (rows[:10], rows[10:], rows[5:15]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    records = ingest.record_stream(stream, "doc_id", [], [], "text", HashedTermEmbedder(8), event_time="ts")
    out = str(tmp_path / "out")
    ingest.start_ingest(records, out, str(tmp_path / "marks"), analyzer="simple").awaitTermination()
    stored = ingest.read_ingested(spark, out, "records")
    assert sorted(r.id for r in stored.collect()) == list(range(20))
    assert {r.contextual_content for r in stored.collect()} == {f"[sheet] s | [text] red ring {i}" for i in range(4)}
    want = build_postings(stored.select("id", "contextual_content"), analyzer="simple")
    got = ingest.read_ingested(spark, out, "postings").select("id", "term", "tf")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("id", "term", "tf").collect()))
    assert stored.where(F.size("embedding") != 8).count() == 0


def test_a_stream_goes_on_in_the_compacted_log(spark, tmp_path):
    schema = "seq long, left_id long, decided_at timestamp, review_outcome string, deleted boolean"

    def batch(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        return spark.readStream.schema(schema).parquet(str(tmp_path / name))

    first = [(i, i, T, "fail", False) for i in range(5)]
    decisions.start_decisions(batch("one", first), str(tmp_path / "log"), str(tmp_path / "a")).awaitTermination()
    decisions.compact(spark, str(tmp_path / "log"), str(tmp_path / "folded"))
    later = [(10, 0, T + dt.timedelta(days=1), "partial", False), (11, 9, T, None, False)]
    decisions.start_decisions(batch("two", later), str(tmp_path / "folded"), str(tmp_path / "b")).awaitTermination()
    want = {(r.left_id, r.seq) for r in current_decisions(spark.createDataFrame(first + later, schema)).collect()}
    assert {(r.left_id, r.seq) for r in decisions.read_current(spark, str(tmp_path / "folded")).collect()} == want


def test_decisions_as_state_turn_late_rows_away_and_forget_cleared_ones(spark, tmp_path):
    schema = "seq long, left_id long, decided_at timestamp, review_outcome string, deleted boolean"

    def batch(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        decisions.start_decisions_state(stream, str(tmp_path / "log"), str(tmp_path / "marks"), lateness="1 hour").awaitTermination()
        return {(r.left_id, r.seq) for r in decisions.read_current(spark, str(tmp_path / "log")).collect()}

    def at(minutes):
        return T + dt.timedelta(minutes=minutes)

    assert batch([(1, 1, at(10), "fail", False), (2, 1, at(20), None, False), (3, 2, at(15), None, True), (4, 3, at(5), None, None)]) == {(1, 2), (3, 4)}
    # A late row of each: older than what is held, so nothing changes and nothing is written.
    assert batch([(5, 1, at(11), "fail", False), (6, 2, at(12), "fail", False)]) == {(1, 2), (3, 4)}
    changes = spark.read.parquet(str(tmp_path / "log")).select("batch", "seq").collect()
    assert {r.seq for r in changes} == {2, 3, 4}
    # Equal times go by seq; a cleared id gets a new decision.
    assert batch([(7, 1, at(20), "partial", False), (8, 2, at(30), "fail", False)]) == {(1, 7), (2, 8), (3, 4)}
    # Clearing again, then time passes: the state of the cleared id expires, later rows count.
    assert batch([(9, 2, at(40), None, True)]) == {(1, 7), (3, 4)}
    assert batch([(10, 5, at(600), None, False)]) == {(1, 7), (3, 4), (5, 10)}
    assert batch([(11, 2, at(590), "fail", False), (12, 3, at(1), "fail", False)]) == {(1, 7), (2, 11), (3, 4), (5, 10)}


@pytest.mark.parametrize("files", [1, 3])
def test_streamed_tables_may_be_folders(spark, tmp_path, files):
    import queryset

    queryset.load_all()
    docs = spark.createDataFrame([(i, f"word{i} word", "en", "web") for i in range(12)], "doc_id long, text string, lang string, source string")
    docs.repartition(files).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.id, r.term, r.tf) for r in queryset.QUERIES["stream_postings"](spark, str(tmp_path)).where("term like 'word%'").collect()}
    assert got == {(i, t, 1) for i in range(12) for t in (f"word{i}", "word")}
    assert queryset.QUERIES["stream_ingest"](spark, str(tmp_path)).count() == 12


def test_an_arrival_of_many_files_is_one_batch(spark, tmp_path, monkeypatch):
    import queryset
    from queryset import stream as queries

    queryset.load_all()
    docs = spark.createDataFrame([(i, f"word{i % 3} word", "en", f"s{i % 2}") for i in range(24)], "doc_id long, text string, lang string, source string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "word1")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "r")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    monkeypatch.setattr(queries, "scratch_path", lambda session, label: f"{tmp_path}/work")
    found = queryset.QUERIES["stream_search"](spark, str(tmp_path))
    assert sorted((r.kind, r.query_id, r.id) for r in found.collect()) == [
        *[("id", 1, i) for i in (1, 3, 7, 9, 11)], *[("keyword", 1, i) for i in (1, 4, 7, 10, 16)]]
    assert len(list((tmp_path / "work/arrived/part=0").glob("*.parquet"))) > 1
    assert len([f for f in (tmp_path / "work/checkpoint/commits").iterdir() if f.name.isdigit()]) == 7


def odd_documents(spark, path):
    rows = [(0, "red ring", "en", "web"), (1, "", "en", "web"), (2, "NaN", "de", "web"), (3, "  ", "nan", "web"), (4, None, "en", "web"), (5, "x", None, "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return [("en", "[sheet] web | [lang] en | [text] red ring"), ("en", "[sheet] web | [lang] en | [text] "),
            ("de", "[sheet] web | [lang] de | [text] NaN"), ("nan", "[sheet] web | [lang] nan | [text]   "), ("en", None), (None, None)]


def test_streamed_documents_keep_empty_and_nan_texts(spark, tmp_path):
    import queryset

    queryset.load_all()
    want = odd_documents(spark, tmp_path)
    got = queryset.QUERIES["stream_ingest"](spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.col_lang, r.contextual_content) for r in got] == want
    assert {(r.sheet_name, r.width) for r in got} == {("web", 64)}


def test_postings_of_streamed_documents_keep_empty_and_nan_texts(spark, tmp_path):
    import queryset

    queryset.load_all()
    odd_documents(spark, tmp_path)
    got = {}
    for r in queryset.QUERIES["stream_postings"](spark, str(tmp_path)).collect():
        got.setdefault(r.id, {})[r.term] = r.tf
    sheet = {"sheet": 1, "web": 1, "lang": 1, "text": 1}
    assert got == {0: sheet | {"en": 1, "red": 1, "ring": 1}, 1: sheet | {"en": 1}, 2: sheet | {"de": 1, "nan": 1}, 3: sheet | {"nan": 1}}
