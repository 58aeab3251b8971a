import pytest
from pyspark.sql import functions as F

from tandem.functions import cells
from tandem.functions.patterns import (
    RowFilter,
    require_valid,
    ilike_contains,
    cluster_filters,
    row_filter,
    text_contains,
)
from tandem.operators.ordering import forward_fill, row_ordinal
from tandem.sources import records, sheets


def test_leading_blank_rows_go_and_inner_ones_repeat_the_row_above(spark):
    one = spark.createDataFrame(
        [(0, None, None), (1, "a", None), (2, None, None), (3, None, "x")], "row_no long, p string, q string"
    )
    other = spark.createDataFrame([(0, "b", "r0"), (1, "c", None)], "row_no long, p string, r string")
    rows = sheets.scan_sheets({"one": one, "other": other}).orderBy("sheet_name", "row_no").collect()
    assert [(r.sheet_name, r.row_no, r.p, r.q, r.r) for r in rows] == [
        ("one", 1, "a", None, None),
        ("one", 2, "a", None, None),
        ("one", 3, "a", "x", None),
        ("other", 0, "b", None, "r0"),
        ("other", 1, "c", None, "r0"),
    ]


def test_sheet_choice(spark):
    df = spark.createDataFrame([(0, "a")], "row_no long, p string")
    with pytest.raises(ValueError, match="choose a sheet"):
        sheets.select_sheet({"a": df, "b": df}, " ")
    with pytest.raises(ValueError, match="unknown sheet"):
        sheets.select_sheet({"a": df, "b": df}, "c")
    assert list(sheets.select_sheet({"a": df, "b": df}, "b")) == ["b"]
    assert list(sheets.select_sheet({"a": df}, None)) == ["a"]


@pytest.mark.parametrize("block_rows", [1, 3, 1000])
def test_fill_and_ordinal_do_not_depend_on_blocks(spark, block_rows):
    rows = [(i * 7, i % 2, None if i % 5 else f"v{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "pos long, grp int, v string").repartition(4)
    filled = {r.pos: r.v for r in forward_fill(df, ["v"], "pos", ["grp"], block_rows).collect()}
    numbers = {r.pos: r.n for r in row_ordinal(df, "pos", "n", ["grp"], block_rows).collect()}
    for grp in (0, 1):
        last = None
        for place, (pos, _, v) in enumerate(r for r in rows if r[1] == grp):
            last = v if v is not None else last
            assert filled[pos] == last
            assert numbers[pos] == place


def test_three_different_null_rules(spark):
    df = spark.createDataFrame([("nan",), ("NaN",), ("\t  x\u001f",), ("",), (None,)], "c string")
    rows = df.select(
        cells.stored_value("c").alias("stored"), cells.display_value("c").alias("shown"), cells.cell_text("c").alias("cell"),
        cells.contextual_content(["c"], None, F.lit("s")).alias("context"),
    ).collect()
    assert [r.stored for r in rows] == [None, "NaN", "\t  x\u001f", "", None]
    assert [r.shown for r in rows] == [None, None, "\t  x\u001f", "", None]
    assert [r.cell for r in rows] == ["", "", "x", "", ""]
    assert [r.context for r in rows] == ["[sheet] s", "[sheet] s", "[sheet] s | [c] \t  x\u001f", "[sheet] s", "[sheet] s"]


def test_content_column_given_twice_appears_twice(spark):
    df = spark.createDataFrame([("v",)], "`a b` string")
    assert df.select(cells.contextual_content(["a b"], "a b", F.lit("s"))).head()[0] == "[sheet] s | [a b] v | [a b] v"


def test_stored_names():
    assert cells.safe_column_name("Price (USD)/a-b") == "price_(usd)_a_b"
    with pytest.raises(ValueError, match="both stored"):
        cells.stored_column_names(["A b", "a-B"])


def test_prefix_rules(spark):
    df = spark.createDataFrame([("left",), ("right",)], "side string")
    text = cells.embedding_text(F.lit("t"), "side", None, "", default_left="q: ", default_right="d: ")
    assert [r[0] for r in df.select(text).collect()] == ["q: t", "t"]


def test_row_filters(spark):
    df = spark.createDataFrame([("Alpha", 1), (" beta ", 2), ("NaN", 3), (None, 4)], "name string, n int")

    def kept(*filters):
        return [r.n for r in df.where(row_filter(filters, df.columns)).orderBy("n").collect()]

    assert kept(RowFilter("name", "empty")) == [3, 4]
    assert kept(RowFilter("name", "not_empty")) == [1, 2]
    assert kept(RowFilter("name", "contains", "ALPH")) == [1]
    assert kept(RowFilter("name", "not_contains", "a")) == [3, 4]
    assert kept(RowFilter("name", "equals", "BETA")) == [2]
    assert kept(RowFilter("name", "not_equals", "beta")) == [1, 3, 4]
    assert kept(RowFilter("name", "regex", "^b")) == [2]
    assert kept(RowFilter("name", "regex", "^B")) == []
    assert kept(RowFilter("other", "empty")) == []
    assert kept(RowFilter("name", "near", "x")) == []
    assert kept(RowFilter("name", "contains", "a"), RowFilter("n", "equals", "2")) == [2]


def test_filter_checks():
    require_valid([RowFilter("a", "empty")], ["a"])
    for bad in (RowFilter("b", "empty"), RowFilter("a", "contains", " "), RowFilter("a", "regex", "(")):
        with pytest.raises(ValueError):
            require_valid([bad], ["a"])


def test_patterns_are_checked_by_the_engine_that_runs_them(spark):
    df = spark.createDataFrame([("a",)], "a string")
    for broken in ("(", "(?P<n>a)"):
        with pytest.raises(ValueError):
            require_valid([RowFilter("a", "regex", broken)], ["a"])
        assert df.where(row_filter([RowFilter("a", "regex", broken)], ["a"])).count() == 0


def test_rows_without_a_group_are_a_group(spark):
    rows = [(0, None, "x"), (1, None, None), (2, "g", None), (3, "g", "y")]
    df = spark.createDataFrame(rows, "n long, g string, v string")
    assert [r.v for r in forward_fill(df, ["v"], "n", ["g"]).orderBy("n").collect()] == ["x", "x", None, "y"]
    assert [r.original_row for r in row_ordinal(df, "n", group=["g"]).orderBy("n").collect()] == [0, 1, 0, 1]


def test_a_backslash_before_a_letter_is_that_letter(spark):
    df = spark.createDataFrame([("c:dir",), ("c:\\dir",), ("50%",)], "t string")
    assert [r.t for r in df.where(ilike_contains("t", "C:\\dir")).collect()] == ["c:dir"]
    assert [r.t for r in df.where(ilike_contains("t", F.lit("C:\\dir"))).collect()] == ["c:dir"]
    assert [r.t for r in df.where(ilike_contains("t", "C:\\\\dir")).collect()] == ["c:\\dir"]
    assert [r.t for r in df.where(ilike_contains("t", "0\\%")).collect()] == ["50%"]


def test_cluster_filter_rules():
    merged = cluster_filters([("a", [" x ", "x", "y"]), ("b", [""]), ("a", ["z"])], ["a", "b"])
    assert [(f.column, f.values) for f in merged] == [("a", ("z",))]
    with pytest.raises(ValueError):
        cluster_filters([("c", ["x"])], ["a"])
    with pytest.raises(ValueError):
        cluster_filters([(str(i), ["x"]) for i in range(11)], map(str, range(11)))
    with pytest.raises(ValueError):
        cluster_filters([("a", map(str, range(101)))], ["a"])


def test_wildcards_count_in_ids_but_not_in_review_text(spark):
    df = spark.createDataFrame([("a_b",), ("axb",), ("50%",), ("5011",), ("c\\d",)], "t string")
    assert [r.t for r in df.where(ilike_contains("t", "A_B")).collect()] == ["a_b", "axb"]
    assert [r.t for r in df.where(text_contains("t", "A_B")).collect()] == ["a_b"]
    assert [r.t for r in df.where(text_contains("t", "50%")).collect()] == ["50%"]
    assert [r.t for r in df.where(text_contains("t", "c\\d")).collect()] == ["c\\d"]


def test_segments_preview_and_parsing(spark):
    df = spark.createDataFrame([("a | | b|c ", "[1.5, -2,3,4]", [0.12345, 1.0])], "t string, v string, e array<double>")
    row = df.select(
        cells.segments("t").alias("s"), cells.parse_vector("v").alias("v"), cells.vector_preview("e").alias("p")
    ).head()
    assert row.s == ["a", "b", "c"]
    assert row.v == [1.5, -2.0, 3.0, 4.0]
    assert row.p == "[0.123, 1.000 … +0 more]"


def test_question_set_reads_doubled_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_text(' question ,ground_truth\n"say ""hi"", now", yes \n,missing\nonly question,\n')
    rows = records.read_question_set(spark, str(tmp_path / "q.csv")).collect()
    assert [tuple(r) for r in rows] == [('say "hi", now', "yes")]
    with pytest.raises(ValueError):
        records.clean_question_set(spark.createDataFrame([("x",)], "question string"))


def test_record_widths(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.1]), (3, None)], "id long, embedding array<double>")
    assert sorted(r.id for r in records.width_violations(df, 2).collect()) == [2, 3]
    with pytest.raises(ValueError):
        records.width_violations(df, 2001)
    with pytest.raises(Exception, match="width differs"):
        records.write_records(df, str(tmp_path / "r"), 2)
    records.write_records(df.where("id = 1"), str(tmp_path / "ok"), 2)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1


def test_sides(spark):
    df = spark.createDataFrame([(5, "x", "NaN"), (3, "y", "d")], "pos long, c string, d string")
    left = records.side_records(df, "left", "pos", ["c"], None, "d", F.lit("s"))
    rows = records.two_sided_records(left, left.withColumn("side", F.lit("right"))).orderBy("id").collect()
    assert [(r.id, r.side, r.original_row, r.display_value) for r in rows] == [
        (0, "left", 0, "d"), (1, "right", 0, "d"), (2, "left", 1, None), (3, "right", 1, None)
    ]
    with pytest.raises(ValueError):
        records.side_records(df, "middle", "pos", ["c"], None)
