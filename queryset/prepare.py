"""Sheets, row preparation and scalar functions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queryset import register
from queryset.inputs import spread, table
from tandem.functions import cells, patterns, vectors
from tandem.models import HashedTermEmbedder, embed_column
from tandem.operators import ordering
from tandem.session import scratch_path
from tandem.sources import records as rec
from tandem.sources import sheets as sh

# --- a workbook of three sheets with blanks to fill ---------------------------------------


def workbook(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """part, supplier and customer as sheets: a group value stands only in the first row of
    its group (merged cells), every fifth row is blank, and so are the first two."""

    def sheet(name: str, key: str, columns: list[str]) -> DataFrame:
        df = table(spark, sf_dir, name)
        blank = (F.col(key) % 5 == 4) | (F.col(key) < 2)
        return df.select(
            F.col(key).alias("row_no"),
            *[F.when(~blank, F.col(c)).alias(c) for c in columns],
            F.when(~blank & (F.col(key) % 3 == 0), F.concat(F.lit("group "), F.col(key))).alias("group name"),
        )

    return {
        "part": sheet("part", "p_partkey", ["p_name", "p_brand", "p_size"]),
        "supplier": sheet("supplier", "s_suppkey", ["s_name", "s_nationkey"]),
        "customer": sheet("customer", "c_custkey", ["c_name", "c_mktsegment"]),
    }


def _sheet_sql(sheet: str, key: str, columns: list[str], every: list[str]) -> str:
    blank = f"({key} % 5 = 4 or {key} < 2)"
    made = ", ".join(f"case when not {blank} then {c}::varchar end as {c}" for c in columns)
    group = f"case when not {blank} and {key} % 3 = 0 then 'group ' || {key} end"
    window = f"over (order by row_no rows unbounded preceding)"
    filled = ", ".join(f"last_value({c} ignore nulls) {window} as {c}" for c in [*columns, "grp"])
    out = ", ".join(c if c in columns else f"null::varchar as {c}" for c in every)
    present = " or ".join(f"{c} is not null" for c in [*columns, "grp"])
    return f"""select '{sheet}' as sheet_name, row_no, {out}, grp as "group name" from (
        select row_no, {filled} from (select {key} as row_no, {made}, {group} as grp from {sheet})) where {present}"""


_ALL = ["p_name", "p_brand", "p_size", "s_name", "s_nationkey", "c_name", "c_mktsegment"]
_PART = _sheet_sql("part", "p_partkey", ["p_name", "p_brand", "p_size"], _ALL)
_SUPPLIER = _sheet_sql("supplier", "s_suppkey", ["s_name", "s_nationkey"], _ALL)
_CUSTOMER = _sheet_sql("customer", "c_custkey", ["c_name", "c_mktsegment"], _ALL)
SHEETS_SQL = f"{_PART} union all {_SUPPLIER} union all {_CUSTOMER}"


@register(SHEETS_SQL)
def sheet_union(spark, sf_dir):
    return sh.scan_sheets(workbook(spark, sf_dir))


@register(f'select sheet_name, row_no, p_name, p_brand, p_size, "group name" from ({_PART})')
def sheet_single(spark, sf_dir):
    chosen = sh.select_sheet(workbook(spark, sf_dir), "part")
    return sh.scan_sheets(chosen)


@register(f"""select sheet_name, count(*) as row_count,
    case sheet_name when 'part' then 'p_name,p_brand,p_size,group name'
        when 'supplier' then 's_name,s_nationkey,group name' else 'c_name,c_mktsegment,group name' end as columns
    from ({SHEETS_SQL}) group by sheet_name""")
def sheet_profile(spark, sf_dir):
    book = workbook(spark, sf_dir)
    profile = sh.sheet_profile(sh.scan_sheets(book), book)
    return profile.withColumn("columns", F.array_join("columns", ","))


# --- documents as one sheet per source -----------------------------------------------------

_GAPPY_SQL = "select doc_id, source, case when doc_id % 3 = 0 then lang end as lang, n_chars from documents"


@register(f"""select doc_id, source, n_chars,
    last_value(lang ignore nulls) over (partition by source order by doc_id rows unbounded preceding) as lang
    from ({_GAPPY_SQL})""")
def forward_fill(spark, sf_dir):
    gappy = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("lang"), "n_chars"
    )
    return ordering.forward_fill(gappy, ["lang"], "doc_id", ["source"], block_rows=128)


@register("""select doc_id, source, n_chars,
    last_value(lang ignore nulls) over (partition by source order by doc_id rows unbounded preceding) as lang
    from (select doc_id, nullif(source, 'src3') as source, case when doc_id % 3 = 0 then lang end as lang, n_chars from documents)""")
def forward_fill_null_group(spark, sf_dir):
    """Rows without a group are filled among themselves."""
    gappy = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("source") != "src3", F.col("source")).alias("source"),
        F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("lang"), "n_chars",
    )
    return ordering.forward_fill(gappy, ["lang"], "doc_id", ["source"], block_rows=128)


@register("select doc_id, source, (row_number() over (partition by source order by doc_id) - 1)::bigint as original_row from documents")
def row_ordinal(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return ordering.row_ordinal(docs, "doc_id", "original_row", ["source"], block_rows=128).select(
        "doc_id", "source", F.col("original_row").cast("bigint").alias("original_row")
    )


def documents_as_rows(spark, sf_dir) -> DataFrame:
    """documents with 'nan', blank and missing cells among the context columns."""
    docs = table(spark, sf_dir, "documents")
    lang = F.when(F.col("doc_id") % 7 == 0, "NaN").when(F.col("doc_id") % 7 == 1, "nan").when(
        F.col("doc_id") % 7 == 2, "").otherwise(F.col("lang"))
    return docs.select("doc_id", F.col("source").alias("sheet_name"), lang.alias("lang"),
                       F.when(F.col("doc_id") % 5 != 0, F.col("n_chars")).alias("n_chars"), "text")


DOC_ROWS_SQL = """(select doc_id, source as sheet_name,
    case doc_id % 7 when 0 then 'NaN' when 1 then 'nan' when 2 then '' else lang end as lang,
    case when doc_id % 5 <> 0 then n_chars end as n_chars, text from documents)"""

_CONTEXT_SQL = """'[sheet] ' || sheet_name
    || case when lang <> '' and lower(lang) <> 'nan' then ' | [lang] ' || lang else '' end
    || case when n_chars is not null then ' | [n_chars] ' || n_chars::varchar else '' end
    || case when text <> '' and lower(text) <> 'nan' then ' | [text] ' || text else '' end"""


@register(f"select doc_id, {_CONTEXT_SQL} as contextual_content from {DOC_ROWS_SQL}")
def contextual_content(spark, sf_dir):
    return documents_as_rows(spark, sf_dir).select(
        "doc_id", cells.contextual_content(["lang", "n_chars"], "text").alias("contextual_content")
    )


@register(f"""select doc_id, nullif(lang, 'nan') as stored, case when lower(lang) <> 'nan' then lang end as shown,
    case when lower(trim(lang)) = 'nan' then '' else trim(lang) end as cell from {DOC_ROWS_SQL}""")
def cell_values(spark, sf_dir):
    return documents_as_rows(spark, sf_dir).select(
        "doc_id",
        cells.stored_value("lang").alias("stored"),
        cells.display_value("lang").alias("shown"),
        cells.cell_text("lang").alias("cell"),
    )


@register("""select doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as cell from
    (select doc_id, chr(9) || ' ' || text || chr(10) || '  ' as text from documents)""")
def cell_strip(spark, sf_dir):
    padded = F.concat(F.lit("\t "), F.col("text"), F.lit("\n  "))
    return table(spark, sf_dir, "documents").select("doc_id", cells.cell_text(padded).alias("cell"))


@register(f"""select row_number() over (order by doc_id) as id, sheet_name, nullif(lang, 'nan') as col_lang,
    n_chars::varchar as col_n_chars, {_CONTEXT_SQL} as contextual_content from {DOC_ROWS_SQL}""")
def corpus_records(spark, sf_dir):
    """Build, write and read back the record table of a corpus."""
    built = rec.corpus_records(
        documents_as_rows(spark, sf_dir), "doc_id", ["lang", "n_chars"], ["lang", "n_chars"], "text", block_rows=128
    )
    path = scratch_path(spark, "corpus-records")
    rec.write_records(built, path)
    return spark.read.parquet(path).withColumn("id", F.col("id").cast("bigint"))


def part_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.lit("part").alias("sheet_name"), "*")


@register("""select 2 * (row_number() over (order by p_partkey) - 1) as id, 'left' as side,
        row_number() over (order by p_partkey) - 1 as original_row, p_name as display_value,
        '[sheet] part | [p_brand] ' || p_brand || ' | [p_name] ' || p_name as contextual_content from part
    union all
    select 2 * (row_number() over (order by s_suppkey) - 1) + 1, 'right', row_number() over (order by s_suppkey) - 1,
        null, '[sheet] supplier | [s_nationkey] ' || s_nationkey || ' | [s_name] ' || s_name from supplier""")
def two_sided_records(spark, sf_dir):
    """Build, write (split by side) and read back both sides of a job."""
    left = rec.side_records(part_rows(spark, sf_dir), "left", "p_partkey", ["p_brand"], "p_name", "p_name", block_rows=128)
    right = rec.side_records(
        table(spark, sf_dir, "supplier").withColumn("sheet_name", F.lit("supplier")),
        "right", "s_suppkey", ["s_nationkey"], "s_name",
    )
    path = scratch_path(spark, "two-sided-records")
    rec.write_records(rec.two_sided_records(left, right), path)
    return spark.read.parquet(path).select(
        F.col("id").cast("bigint").alias("id"), F.col("side").cast("string").alias("side"),
        F.col("original_row").cast("bigint").alias("original_row"), "display_value", "contextual_content",
    )


# --- row filters -----------------------------------------------------------------------------

_FILTERS = {
    "empty": ("lang", "", "cell = ''"),
    "not_empty": ("lang", "", "cell <> ''"),
    "contains": ("lang", "E", "contains(lower(cell), 'e')"),
    "not_contains": ("lang", "e", "not contains(lower(cell), 'e')"),
    "equals": ("lang", "EN", "lower(cell) = 'en'"),
    "not_equals": ("lang", "En", "lower(cell) <> 'en'"),
    "regex": ("lang", "^[ef][nr]$", "regexp_matches(cell, '^[ef][nr]$')"),
}


def _row_filter(op: str, spark, sf_dir):
    column, value, _ = _FILTERS[op]
    rows = documents_as_rows(spark, sf_dir)
    return rows.where(patterns.row_filter([patterns.RowFilter(column, op, value)], rows.columns)).select("doc_id", "lang")


for _op, (_c, _v, _sql) in _FILTERS.items():
    register(
        f"""select doc_id, lang from (select *, case when lower(trim(lang)) = 'nan' then '' else trim(lang) end as cell
        from {DOC_ROWS_SQL}) where {_sql}""",
        name=f"row_filter_{_op}",
    )(partial(_row_filter, _op))


@register(f"select doc_id, lang from {DOC_ROWS_SQL} where false")
def row_filter_regex_broken(spark, sf_dir):
    """A pattern that is none lets no row through."""
    rows = documents_as_rows(spark, sf_dir)
    return rows.where(patterns.row_filter([patterns.RowFilter("lang", "regex", "(e")], rows.columns)).select("doc_id", "lang")


@register(f"""select doc_id, lang from {DOC_ROWS_SQL} where lower(lang) = 'en' and contains(lower(text), 'the')
    and regexp_matches(sheet_name, '1$')""")
def row_filter_combined(spark, sf_dir):
    rows = documents_as_rows(spark, sf_dir)
    filters = [
        patterns.RowFilter("lang", "equals", "en"),
        patterns.RowFilter("text", "contains", "THE"),
        patterns.RowFilter("sheet_name", "regex", "1$"),
    ]
    return rows.where(patterns.row_filter(filters, rows.columns)).select("doc_id", "lang")


# --- text and vectors ------------------------------------------------------------------------


@register("""select item_id, side, case side when 'left' then 'query: ' else 'passage: ' end || text as prefixed
    from benchmark, (values ('left'), ('right')) s(side)""")
def embedding_prefix(spark, sf_dir):
    sides = F.explode(F.array(F.lit("left"), F.lit("right"))).alias("side")
    return table(spark, sf_dir, "benchmark").select("item_id", sides, "text").select(
        "item_id", "side", cells.embedding_text("text", "side", "query: ", None, default_right="passage: ").alias("prefixed")
    )


@register(f"""select doc_id, pos::int as pos, segment from (
    select doc_id, unnest(parts) as segment, unnest(range(len(parts))) as pos from (
        select doc_id, list_filter(list_transform(string_split(c, '|'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
            lambda x: x <> '') as parts from (select doc_id, {_CONTEXT_SQL} as c from {DOC_ROWS_SQL})))""")
def text_segments(spark, sf_dir):
    text = cells.contextual_content(["lang", "n_chars"], "text")
    return documents_as_rows(spark, sf_dir).select(
        "doc_id", F.posexplode(cells.segments(text)).alias("pos", "segment")
    )


@register("""select vec_id, '[' || printf('%.3f', embedding[1]::double) || ', ' || printf('%.3f', embedding[2]::double)
    || ', ' || printf('%.3f', embedding[3]::double) || ' … +' || (len(embedding) - 3) || ' more]' as preview from embeddings""")
def vector_preview(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", cells.vector_preview("embedding").alias("preview"))


@register("select vec_id, len(embedding)::int as width, round(list_sum(embedding::double[]), 5) as total from embeddings")
def vector_parse(spark, sf_dir):
    """Vectors stored as text are read back as numbers."""
    texts = table(spark, sf_dir, "embeddings").select("vec_id", F.to_json(vectors.to_doubles("embedding")).alias("stored"))
    parsed = texts.select("vec_id", cells.parse_vector("stored").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return parsed.select("vec_id", F.size("v").alias("width"), F.round(total, 5).alias("total"))


@register("select vec_id, len(v)::int as width from (select vec_id, case when vec_id % 9 = 0 then embedding[1:60] "
          "when vec_id % 9 <> 1 then embedding end as v from embeddings) where v is null or len(v) <> 64")
def vector_width_violations(spark, sf_dir):
    odd = F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 60)).when(F.col("vec_id") % 9 != 1, F.col("embedding"))
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", odd.alias("embedding"))
    return rec.width_violations(vecs, 64).select("vec_id", F.size("embedding").alias("width"))


@register("""select vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) as squared, round(u[1], 6) as first from (
    select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as u from
        (select vec_id, list_transform(embedding::double[], lambda x: x * (1 + vec_id)) as e from embeddings))""")
def l2_normalise(spark, sf_dir):
    scaled = F.transform(vectors.to_doubles("embedding"), lambda x: x * (1 + F.col("vec_id")))
    u = table(spark, sf_dir, "embeddings").select("vec_id", vectors.unit(scaled).alias("u"))
    return u.select("vec_id", F.round(vectors.dot("u", "u"), 6).alias("squared"), F.round(F.col("u")[0], 6).alias("first"))


@register("""select trim('Is "' || regexp_replace(b.text, '\\s+', ' ', 'g') || '", here, right?') as question,
        trim(regexp_replace(d.text, '\\s+', ' ', 'g')) as ground_truth
    from benchmark b join documents d on b.item_id = d.doc_id % 40 where d.n_chars % 4 <> 0""")
def question_set(spark, sf_dir):
    """Write a question per document, with quotes and commas, as CSV, read them back, drop
    incomplete rows."""
    one_line = F.regexp_replace("text", r"\s+", " ")
    truth = F.when(F.col("n_chars") % 4 != 0, F.concat(F.lit("  "), one_line)).otherwise("   ")
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("item_id"), truth.alias("ground_truth"))
    asked = table(spark, sf_dir, "benchmark").select(
        "item_id",
        F.concat(F.lit(' Is "'), one_line, F.lit('", here, right? ')).alias("question"),
    )
    path = scratch_path(spark, "questions")
    rec.write_table(asked.join(docs, "item_id").select("question", "ground_truth"), path, "csv")
    return rec.read_question_set(spark, path)


@register("""select doc_id, bucket, round(n / sqrt(sum(n * n) over (partition by doc_id)), 6) as value from (
    select doc_id, ('0x' || substr(md5(term), 1, 8))::bigint % 256 as bucket, count(*)::double as n from (
        select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from documents) group by 1, 2)""")
def hashed_embedding(spark, sf_dir):
    """The built-in embedder; non-zero entries only."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    vecs = docs.select("doc_id", embed_column("text", HashedTermEmbedder(256)).alias("v"))
    entries = vecs.select("doc_id", F.posexplode("v").alias("bucket", "value")).where(F.col("value") > 0)
    return entries.select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.round("value", 6).alias("value"))
