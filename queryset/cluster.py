"""Clustering by embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryset import register
from queryset.inputs import table
from queryset.retrieval import DOCS, TOKENS, WIDTH, embedded_documents
from tandem.functions.vectors import dot, unit
from tandem.operators import clustering
from tandem.operators.dbscan import dbscan
from tandem.plans.cluster import cluster_records

EPS = 1.15


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("label "), "label").alias("label"), "embedding")


def dbscan_sql(near: str, ids: str, min_samples: int = 5) -> str:
    """Labels from a neighbour table ``near(a, b)`` (own pairs included) by reachability."""
    return f"""with recursive {near},
    core as (select a as id from near group by a having count(*) >= {min_samples}),
    link as (select a, b from near where a in (select id from core) and b in (select id from core)),
    reach as (select id, id as root from core union select l.b, r.root from reach r join link l on l.a = r.id),
    comp as (select id, min(root) as root from reach group by id),
    numbered as (select id, dense_rank() over (order by root) - 1 as c from comp),
    border as (select near.a as id, min(c) as c from near join numbered on numbered.id = near.b
        where near.a not in (select id from core) group by near.a),
    labels as (select ids.id, coalesce(n.c, b.c, -1)::int as cluster_id from ({ids}) ids
        left join numbered n on n.id = ids.id left join border b on b.id = ids.id)"""


def _vector_near(eps: float) -> str:
    return f"""near as (select a.vec_id as a, b.vec_id as b from embeddings a, embeddings b
        where sqrt(greatest(0, 2 - 2 * list_cosine_similarity(a.embedding::double[], b.embedding::double[]))) <= {eps})"""


_IDS = "select vec_id as id from embeddings"
_LABELS = dbscan_sql(_vector_near(EPS), _IDS)

_DOC_NEAR = f"""{DOCS}, tf as (select id, ('0x' || substr(md5(term), 1, 8))::bigint % {WIDTH} as bucket, count(*)::double as n from
        (select id, unnest(regexp_extract_all(lower(content), {TOKENS})) as term from docs) group by 1, 2),
    u as (select id, bucket, n / sqrt(sum(n * n) over (partition by id)) as x from tf),
    near as (select p.id as a, q.id as b from u p join u q using (bucket) group by 1, 2
        having sqrt(greatest(0, 2 - 2 * sum(p.x * q.x))) <= 0.3)"""


@register(f"{_LABELS} select id, cluster_id from labels")
def dbscan_labels(spark, sf_dir):
    return dbscan(vectors(spark, sf_dir), eps=EPS)


@register(f"{_LABELS} select id, cluster_id from labels")
def dbscan_labels_cells(spark, sf_dir):
    """The same through many small cells."""
    return dbscan(vectors(spark, sf_dir), eps=EPS, block_rows=64)


@register(f"{dbscan_sql(_DOC_NEAR, 'select id from docs')} select id, cluster_id from labels")
def dbscan_documents(spark, sf_dir):
    """Documents at the default distance: near copies form the clusters."""
    return dbscan(embedded_documents(spark, sf_dir))


_ZERO_NEAR = """v as (select vec_id as id, vec_id % 10 = 3 as zero, embedding::double[] as x from embeddings),
    near as (select a.id as a, b.id as b from v a, v b where case when a.zero and b.zero then 0.0 when a.zero or b.zero then 1.0
        else sqrt(greatest(0, 2 - 2 * list_cosine_similarity(a.x, b.x))) end <= 0.95)"""


@register(f"{dbscan_sql(_ZERO_NEAR, 'select id from v')} select id, cluster_id from labels")
def dbscan_zero_vectors(spark, sf_dir):
    """A tenth of the vectors are zero: one point, at distance 1 from every other."""
    empty = F.transform("embedding", lambda x: x * 0)
    given = vectors(spark, sf_dir).withColumn("embedding", F.when(F.col("id") % 10 == 3, empty).otherwise(F.col("embedding")))
    return dbscan(given, eps=0.95)


@register("select vec_id as id, -1 as cluster_id from embeddings")
def dbscan_all_noise(spark, sf_dir):
    return dbscan(vectors(spark, sf_dir))


@register(f"""{_LABELS} select cluster_id, case when cluster_id = -1 then 'Unassigned' else 'Cluster ' || (cluster_id + 1) end as label,
    count(*) as count from labels group by 1""")
def cluster_groups(spark, sf_dir):
    return clustering.group_summary(dbscan(vectors(spark, sf_dir), eps=EPS))


@register(f"""{_LABELS} select count(*) as records, count(distinct cluster_id) filter (cluster_id <> -1) as n_clusters,
    count(*) filter (cluster_id <> -1) = 0 as too_sparse, count(distinct cluster_id) filter (cluster_id <> -1) > 50 as too_dense from labels""")
def cluster_statistics(spark, sf_dir):
    return clustering.cluster_statistics(dbscan(vectors(spark, sf_dir), eps=EPS), "dbscan")


@register(f"""{_LABELS} select case when cluster_id = -1 then 'Unassigned' else 'Cluster ' || (cluster_id + 1) end as cluster,
    'label ' || e.label as label from labels join embeddings e on e.vec_id = labels.id""")
def cluster_export(spark, sf_dir):
    data = vectors(spark, sf_dir)
    return clustering.cluster_export(dbscan(data, eps=EPS), data, ["label"])


@register("select vec_id as id from embeddings where 'label ' || label ilike '%1%' or 'label ' || label ilike '%L _%7%' or 'label ' || label ilike '%l 3%'")
def cluster_filter(spark, sf_dir):
    """The later filter on a column replaces the earlier one; wildcards stay wildcards."""
    filters = [("label", ["9"]), ("label", [" 1 ", "L _%7", "l 3", "1"]), ("embedding_note", [""])]
    return clustering.select_records(vectors(spark, sf_dir), filters).select("id")


@register("""select vec_id as id, round(case when max(x) over () > min(x) over () then 2 * (x - min(x) over ()) / (max(x) over () - min(x) over ()) - 1 else 0 end, 6) as x,
    0.0::double as y from (select vec_id, embedding[1]::double as x from embeddings)""")
def scale_axes(spark, sf_dir):
    coords = vectors(spark, sf_dir).select("id", F.col("embedding")[0].cast("double").alias("x"), F.lit(0.25).alias("y"))
    return clustering.scale_axes(coords).select("id", F.round("x", 6).alias("x"), "y")


@register("select count(*) as records, 4 as groups, 0 as empty_groups, 0 as misplaced from embeddings")
def kmeans_groups(spark, sf_dir):
    """Four groups, none empty, every record nearest to the centre of its own group."""
    data = vectors(spark, sf_dir).select("id", unit("embedding").alias("v"))
    labelled = data.join(clustering.kmeans(vectors(spark, sf_dir), 4), "id")
    positions = labelled.select("cluster_id", F.posexplode("v").alias("i", "x"))
    means = positions.groupBy("cluster_id", "i").agg(F.avg("x").alias("x"))
    centres = means.groupBy("cluster_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("c")
    ).withColumnRenamed("cluster_id", "other")
    distance = F.round(dot("c", "c") - 2 * dot("v", "c"), 6)
    nearest = labelled.join(F.broadcast(centres)).groupBy("id", "cluster_id").agg(
        F.min(distance).alias("least"), F.min(F.when(F.col("other") == F.col("cluster_id"), distance)).alias("own"))
    sizes = labelled.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") == 0).alias("empty_groups"))
    return nearest.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("own") > F.col("least") + 0.02).alias("misplaced")
    ).join(F.broadcast(sizes)).select("records", "groups", "empty_groups", "misplaced")


@register("""select count(*) as records, true as within_bounds, true as touches_bounds, true as beats_first_axes from embeddings""")
def pca_plane(spark, sf_dir):
    """Projected and scaled coordinates fill [-1, 1], and the plane holds at least the
    variance of the first two raw axes."""
    data = vectors(spark, sf_dir)
    raw = clustering.project_to_plane(data)
    u = unit("embedding")
    first = data.select(u[0].alias("a"), u[1].alias("b")).agg((F.var_samp("a") + F.var_samp("b")).alias("raw"))
    plane = raw.agg((F.var_samp("x") + F.var_samp("y")).alias("plane"))
    scaled = clustering.scale_axes(raw)
    top = F.greatest(F.max(F.abs(F.col("x"))), F.max(F.abs(F.col("y"))))
    reach = F.least(F.max("x"), F.max("y"), -F.min("x"), -F.min("y"))
    return scaled.agg(
        F.count(F.lit(1)).alias("records"), (top <= 1 + 1e-9).alias("within_bounds"), (reach >= 1 - 1e-9).alias("touches_bounds")
    ).join(F.broadcast(plane)).join(F.broadcast(first)).select(
        "records", "within_bounds", "touches_bounds", (F.col("plane") >= F.col("raw")).alias("beats_first_axes"))


@register(f"""{_LABELS} select id, cluster_id, case when cluster_id = -1 then 'Unassigned' else 'Cluster ' || (cluster_id + 1) end as label,
    true as on_plane from labels""")
def cluster_layout(spark, sf_dir):
    found = cluster_records(vectors(spark, sf_dir), "dbscan", eps=EPS)
    on_plane = (F.abs("pca_x") <= 1 + 1e-9) & (F.abs("pca_y") <= 1 + 1e-9)
    return found.select("id", "cluster_id", "label", on_plane.alias("on_plane"))
