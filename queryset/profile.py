"""Browsing and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from queryset import register
from queryset.compare import passage_records
from queryset.inputs import table
from queryset.prepare import DOC_ROWS_SQL, documents_as_rows, part_rows
from tandem.functions.patterns import RowFilter
from tandem.operators import profile


@register("""select vec_id as id, label, '[' || printf('%.3f', embedding[1]::double) || ', ' || printf('%.3f', embedding[2]::double)
    || ', ' || printf('%.3f', embedding[3]::double) || ' … +61 more]' as embedding, (select count(*) from embeddings) as total
    from embeddings order by vec_id limit 25""")
def browse_records(spark, sf_dir):
    return profile.browse_records(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"))


@register("""with sides as (select (select count(*) from benchmark) as records_left, (select avg(length(text)) from benchmark) as l,
    (select count(*) from documents) as records_right,
    (select avg(length('[sheet] ' || source || ' | [lang] ' || lang || ' | [text] ' || text)) from documents) as r)
    select records_left, records_right, round(l, 4) as avg_chars_left, round(r, 4) as avg_chars_right,
    floor((l * records_left + r * records_right) / 4)::bigint as est_embed_tokens from sides""")
def volume_statistics(spark, sf_dir):
    stats = profile.volume_statistics(passage_records(spark, sf_dir, embedded=False))
    return stats.withColumns({c: F.round(c, 4) for c in ("avg_chars_left", "avg_chars_right")})


@register("""select value, n > 100 as truncated from (select distinct p_retailprice::varchar as value from part order by 1 limit 100),
    (select count(distinct p_retailprice) as n from part)""")
def distinct_values(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_retailprice").cast("string").alias("col_price"))
    return profile.distinct_values(parts, "col_price")


@register("select distinct p_brand as value, false as truncated from part")
def distinct_values_few(spark, sf_dir):
    return profile.distinct_values(table(spark, sf_dir, "part"), "p_brand")


@register(f"""with v as (select distinct case when lower(trim(lang)) = 'nan' then '' else trim(lang) end as value from {DOC_ROWS_SQL})
    select value, (select count(*) from v) > 100 as truncated from v where value <> ''""")
def distinct_cells(spark, sf_dir):
    return profile.distinct_cells(documents_as_rows(spark, sf_dir), "lang")


@register("""with v as (select distinct upper(p_name) || ' ' || p_brand as value from part where contains(lower(p_type), 'o')),
    f as (select value from v order by lower(value), value limit 100)
    select value, (select count(*) from v) > 100 as truncated from f""")
def distinct_cells_filtered(spark, sf_dir):
    rows = part_rows(spark, sf_dir).withColumn("item", F.concat_ws(" ", F.upper("p_name"), "p_brand"))
    return profile.distinct_cells(rows, "item", [RowFilter("p_type", "contains", "O")])


@register("""with f as (select *, row_number() over (order by p_partkey) - 1 as position from part order by p_partkey limit 5)
    select 'p_name' as "column", position::int as position, p_name as value from f
    union all select 'p_size', position::int, p_size::varchar from f""")
def column_samples(spark, sf_dir):
    return profile.column_samples(part_rows(spark, sf_dir), ["p_name", "missing", "p_size"], "p_partkey", 5)


@register("select count(*) as rows_unfiltered, count(*) filter (contains(lower(p_name), 'ring') and p_brand <> 'Brand#1') as rows_filtered from part")
def filter_counts(spark, sf_dir):
    filters = [RowFilter("p_name", "contains", "Ring"), RowFilter("p_brand", "not_equals", "brand#1")]
    return profile.filter_counts(part_rows(spark, sf_dir), filters)


@register("""select p_partkey as row_no, '[sheet] part | [p_brand] ' || p_brand || ' | [p_name] ' || p_name as sample
    from part where regexp_matches(p_type, '^S') order by p_partkey limit 3""")
def context_preview(spark, sf_dir):
    return profile.context_preview(
        part_rows(spark, sf_dir), "p_partkey", ["p_brand"], "p_name", [RowFilter("p_type", "regex", "^S")])
