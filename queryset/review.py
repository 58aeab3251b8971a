"""Review decisions and run reports."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queryset import register
from queryset.inputs import table
from tandem.functions import scores
from tandem.operators import decisions as dec
from tandem.operators import reports
from tandem.operators.matching import side_of
from tandem.operators.topk import topk_cosine
from tandem.session import materialise

K = 5

# --- a run over the vectors, with document texts, and decisions taken from the events ------


def records(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    side = F.explode(F.array(F.lit("left"), F.lit("right"))).alias("side")
    return docs.select("doc_id", "source", "text", side).select(
        (F.col("doc_id") * 2 + F.when(F.col("side") == "left", 0).otherwise(1)).alias("id"), "side",
        F.col("doc_id").alias("original_row"), F.col("text").alias("contextual_content"),
        F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("display_value"),
    )


_STORED: dict[tuple[str, str], DataFrame] = {}


def matches(spark, sf_dir) -> DataFrame:
    """The stored matches of one run: computed once per session, as a real run would be."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        vecs = table(spark, sf_dir, "embeddings")
        left = vecs.select((F.col("vec_id") * 2).alias("left_id"), F.col("embedding").alias("left_vec"))
        right = vecs.select((F.col("vec_id") * 2 + 1).alias("right_id"), F.col("embedding").alias("right_vec"))
        found = topk_cosine(left, right, K)
        meta = F.when(F.col("right_id") % 3 != 0, F.create_map(F.lit("reason"), F.concat(F.lit("r"), F.col("right_id"))))
        _STORED[key] = materialise(found.select(
            "left_id", "right_id", F.round("cosine_score", 6).alias("cosine_score"),
            F.lit(None).cast("double").alias("rerank_score"), F.lit(None).cast("double").alias("judge_score"),
            meta.alias("judge_meta"), F.round("cosine_score", 6).alias("final_score"), F.col("cand_pos").alias("rank"),
        ), "stored-matches")
    return _STORED[key]


def submissions(spark, sf_dir) -> DataFrame:
    """Events as submitted decisions: the user is the left row, the best few candidates are
    selected (one of them twice), old rows carry a single id only."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), (F.col("user_id") * 2).alias("left_id"), F.col("ts").alias("decided_at"),
        F.col("props").alias("review_comment"), "event_type")
    best = matches(spark, sf_dir).groupBy("left_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "right_id"))), lambda x: x["right_id"]).alias("best"))
    outcome = F.when(F.col("event_type") == "signup", "no_match").when(F.col("event_type") == "click", "partial").when(
        F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "system_fail")
    picked = F.slice("best", F.lit(1), (F.col("seq") % 4).cast("int"))
    old = F.col("seq") % 7 == 0
    return events.join(best, "left_id").select(
        "seq", "left_id", F.when(old & (F.col("seq") % 4 > 0), F.col("best")[0]).alias("matched_right_id"),
        F.when(~old, F.concat(picked, F.slice(picked, 1, 1))).alias("matched_right_ids"),
        "decided_at", "review_comment", outcome.alias("review_outcome"), (F.col("seq") % 11 == 0).alias("deleted"))


def decision_log(spark, sf_dir) -> DataFrame:
    return dec.resolve_submissions(submissions(spark, sf_dir))


def decisions(spark, sf_dir) -> DataFrame:
    return dec.current_decisions(decision_log(spark, sf_dir))


_COS = "round(list_cosine_similarity(l.embedding::double[], r.embedding::double[]), 9)"
RUN = f"""matches as (select 2 * l.vec_id as left_id, 2 * r.vec_id + 1 as right_id, round({_COS}, 6) as score,
        row_number() over (partition by l.vec_id order by {_COS} desc, r.vec_id) as rank,
        case when (2 * r.vec_id + 1) % 3 <> 0 then '{{"reason":"r' || (2 * r.vec_id + 1) || '"}}' else '' end as meta
        from embeddings l, embeddings r qualify rank <= {K}),
    recs as (select doc_id, 2 * doc_id as lid, 2 * doc_id + 1 as rid, text, case when doc_id % 4 <> 0 then source end as display
        from documents),
    log as (select event_id as seq, 2 * user_id as left_id, ts as decided_at, props as comment,
        case event_type when 'signup' then 'no_match' when 'click' then 'partial' when 'error' then 'fail'
            when 'purchase' then 'system_fail' end as outcome,
        event_id % 11 = 0 as deleted, case when event_type = 'signup' then []::bigint[] when event_id % 7 = 0
            then case when event_id % 4 > 0 then best[1:1] else []::bigint[] end else best[1:event_id % 4] end as ids
        from events join (select left_id, list(right_id order by rank) as best from matches group by 1) b on b.left_id = 2 * user_id),
    decs as (select * from log qualify row_number() over (partition by left_id order by decided_at desc, seq desc) = 1),
    cur as (select * from decs where not deleted)"""


@register(f"with {RUN} select seq, array_to_string(ids, ',') as ids, ids[1] as single, outcome from log")
def resolve_submissions(spark, sf_dir):
    return decision_log(spark, sf_dir).select(
        "seq", F.array_join("matched_right_ids", ",").alias("ids"), F.col("matched_right_id").alias("single"),
        F.col("review_outcome").alias("outcome"))


@register("""select event_id, array_to_string(case event_id % 4 when 0 then
    case when user_id = event_id then [user_id] else [user_id, event_id] end when 1 then [user_id] when 2 then [user_id]
    else []::bigint[] end, ',') as effective from events""")
def effective_ids(spark, sf_dir):
    """Lists with repeats and nulls, empty lists with a single id, and neither."""
    form, user, event = F.col("event_id") % 4, F.col("user_id"), F.col("event_id")
    none = F.lit(None).cast("bigint")
    ids = F.when(form == 0, F.array(user, none, event, user)).when(form == 1, F.array().cast("array<bigint>"))
    rows = table(spark, sf_dir, "events").select(
        "event_id", ids.alias("ids"), F.when(form.isin(1, 2), user).alias("single"))
    return rows.select("event_id", F.array_join(
        scores.effective_ids(scores.deduplicated_ids("ids"), "single"), ",").alias("effective"))


@register(f"with {RUN} select left_id, seq, array_to_string(ids, ',') as ids, outcome from cur")
def decision_current(spark, sf_dir):
    return decisions(spark, sf_dir).select(
        "left_id", "seq", F.array_join("matched_right_ids", ",").alias("ids"), F.col("review_outcome").alias("outcome"))


@register(f"""with {RUN} select distinct s.left_id, s.right_id from (select 2 * user_id as left_id, 2 * (event_id % 500) + 1 as right_id from events) s
    where not exists (select 1 from matches m where m.left_id = s.left_id and m.right_id = s.right_id)""")
def invalid_selections(spark, sf_dir):
    """Events read as selections of arbitrary right rows: which are not candidates."""
    chosen = table(spark, sf_dir, "events").select(
        (F.col("user_id") * 2).alias("left_id"), F.array(F.col("event_id") % 500 * 2 + 1).alias("matched_right_ids"))
    return dec.invalid_selections(chosen, matches(spark, sf_dir))


@register(f"""with {RUN} select (select count(*) from recs) as total_left, count(*) as reviewed, (select count(*) from recs) - count(*) as pending,
    count(*) filter (len(ids) = 0) as no_match, count(*) filter (len(ids) > 0) as matched from cur""")
def review_statistics(spark, sf_dir):
    return dec.review_statistics(side_of(records(spark, sf_dir), "left"), decisions(spark, sf_dir))


@register(f"""with {RUN} select count(*) filter (outcome = 'no_match') as no_match, count(*) filter (outcome = 'partial') as partial,
    count(*) filter (outcome = 'fail') as fail, count(*) filter (outcome = 'system_fail') as system_fail,
    count(*) filter (outcome is null) as matched_none from cur""")
def outcome_counts(spark, sf_dir):
    return dec.outcome_counts(decisions(spark, sf_dir))


# --- review queue --------------------------------------------------------------------------------

_QUEUE = """select lid as left_id, display as display_value from recs join matches m on m.left_id = lid and m.rank = 1
    left join cur on cur.left_id = lid where m.score >= {min_score} and {test}"""
_QUEUES = {
    "default": ({}, "cur.left_id is null"),
    "all_decided": ({"include_decided": True}, "true"),
    "pending": ({"outcome": "pending"}, "cur.left_id is null"),
    "matched_none": ({"outcome": "matched_none"}, "cur.left_id is not null and outcome is null and len(ids) > 0"),
    "no_match": ({"outcome": "no_match"}, "outcome = 'no_match'"),
    "partial": ({"outcome": "partial"}, "outcome = 'partial'"),
    "fail": ({"outcome": "fail"}, "outcome = 'fail'"),
    "system_fail": ({"outcome": "system_fail"}, "outcome = 'system_fail'"),
    "min_score": ({"include_decided": True, "min_score": 0.9999995}, "true"),
    "text": (
        {"include_decided": True, "text": " the s"},
        """(contains(lower(text), 'the s') or contains(lower(coalesce(display, '')), 'the s') or lid in (select left_id from matches
            join recs x on x.rid = right_id where contains(lower(x.text), 'the s') or contains(lower(coalesce(x.display, '')), 'the s')))""",
    ),
}


def _queue(options: dict, spark, sf_dir):
    recs = records(spark, sf_dir)
    queue = dec.review_queue(
        side_of(recs, "left"), matches(spark, sf_dir), decisions(spark, sf_dir), right=side_of(recs, "right"), **options)
    return queue.select("left_id", "display_value")


for _name, (_options, _test) in _QUEUES.items():
    register(f"with {RUN} " + _QUEUE.format(min_score=_options.get("min_score", 0.0), test=_test), name=f"review_queue_{_name}")(
        partial(_queue, _options))


@register(f"with {RUN} " + _QUEUE.format(min_score=0.0, test="true") + " order by coalesce(display, '') desc, lid limit 20 offset 30")
def review_queue_page(spark, sf_dir):
    """Sorted by display text, descending: twenty rows after the first thirty."""
    recs = records(spark, sf_dir)
    queue = dec.review_queue(
        side_of(recs, "left"), matches(spark, sf_dir), decisions(spark, sf_dir), include_decided=True, sort_by="display", descending=True)
    return dec.page(queue, 30, 20).select("left_id", "display_value")


@register(f"""with {RUN} select lid as left_id, c.candidates, coalesce(array_to_string(ids, ','), '') as matched_right_ids,
    cur.left_id is not null as is_decided, outcome as review_outcome, case when cur.left_id is null then ''
        when len(ids) > 0 then 'Matched' || case outcome when 'partial' then ' · partial' when 'fail' then ' · fail'
            when 'system_fail' then ' · system failure' else '' end
        when outcome = 'partial' then 'Partial' when outcome = 'fail' then 'Fail' when outcome = 'system_fail' then 'System failure'
        when outcome = 'no_match' then 'No match'
        else 'Reviewed' end as badge
    from recs left join cur on cur.left_id = lid join (select left_id, string_agg(right_id || ':' || length(text), ' ' order by rank) as candidates
        from matches join recs on rid = right_id group by 1) c on c.left_id = lid""")
def review_items(spark, sf_dir):
    recs, found, current = records(spark, sf_dir), matches(spark, sf_dir), decisions(spark, sf_dir)
    queue = dec.review_queue(side_of(recs, "left"), found, current, include_decided=True)
    items = dec.review_items(queue, side_of(recs, "right"), found, current)
    listed = F.transform(
        "candidates", lambda c: F.concat_ws(":", c["right_id"].cast("string"), F.length(c["contextual_content"]).cast("string")))
    return items.select(
        "left_id", F.array_join(listed, " ").alias("candidates"), F.array_join("matched_right_ids", ",").alias("matched_right_ids"),
        "is_decided", "review_outcome",
        scores.review_badge(F.col("is_decided"), "review_outcome", F.size("matched_right_ids")).alias("badge"))


# --- reports --------------------------------------------------------------------------------------

_RAW_TEXT = "case outcome when 'no_match' then 'no match' when 'partial' then 'partial' when 'fail' then 'fail' when 'system_fail' then 'system failure' else '' end"


@register(f"""with {RUN} select l.doc_id as left_row, l.display as left_display, l.text as left_contextual, rank::int as rank,
    r.doc_id as right_row, r.display as right_display, r.text as right_contextual, score as cosine_score, null::double as rerank_score,
    null::double as judge_score, meta as judge_meta, score as final_score, {_RAW_TEXT} as review_outcome_display,
    coalesce(comment, '') as review_comment from matches m join recs l on l.lid = m.left_id join recs r on r.rid = m.right_id
    left join cur on cur.left_id = m.left_id""")
def raw_pairs(spark, sf_dir):
    return reports.raw_pairs(records(spark, sf_dir), matches(spark, sf_dir), decisions(spark, sf_dir))


@register(f"""with {RUN} select l.doc_id as left_row, rank::int as rank, r.doc_id as right_row, score as final_score,
    (select count(*) from matches) as total from matches m join recs l on l.lid = m.left_id join recs r on r.rid = m.right_id
    order by left_row, rank limit 50""")
def browse_pairs(spark, sf_dir):
    return reports.browse_pairs(records(spark, sf_dir), matches(spark, sf_dir)).select("left_row", "rank", "right_row", "final_score", "total")


@register(f"""with {RUN}, picked as (select *, unnest(ids) as right_id, unnest(range(1, len(ids) + 1)) as match_index from cur)
    select l.doc_id as left_row, l.display as left_display, l.text as left_contextual, r.doc_id as right_row, r.display as right_display,
    r.text as right_contextual, score as cosine_score, null::double as rerank_score, null::double as judge_score, meta as judge_meta,
    score as final_score, len(ids)::int as selected_rights_count, match_index::int as match_index,
    case outcome when 'no_match' then 'no match' when 'partial' then 'partial' when 'fail' then 'fail'
        when 'system_fail' then 'system failure' else 'matched' end as review_outcome_display,
    coalesce(comment, '') as review_comment, decided_at from picked join matches m using (left_id, right_id)
    join recs l on l.lid = left_id join recs r on r.rid = right_id""")
def confirmed_matches(spark, sf_dir):
    return reports.confirmed_matches(records(spark, sf_dir), matches(spark, sf_dir), decisions(spark, sf_dir))


@register(f"""with {RUN} select doc_id as left_row, display as left_display, text as left_contextual, case when cur.left_id is null then ''
    when outcome = 'partial' then 'partial' when outcome = 'fail' then 'fail'
        when outcome = 'system_fail' then 'system failure' else 'no match' end as human_review,
    coalesce(comment, '') as review_comment from recs left join cur on cur.left_id = lid where cur.left_id is null or len(ids) = 0""")
def unique_left(spark, sf_dir):
    return reports.unique_left(records(spark, sf_dir), decisions(spark, sf_dir))


@register(f"""with {RUN} select doc_id as right_row, display as right_display, text as right_contextual from recs
    where rid not in (select unnest(ids) from cur)""")
def unique_right(spark, sf_dir):
    return reports.unique_right(records(spark, sf_dir), decisions(spark, sf_dir))


@register(f"""with {RUN}, ctx as (select left_id, string_agg(text, '##' order by rank) as contexts from matches join recs on rid = right_id group by 1),
    ref as (select left_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by i) as reference from
        (select left_id, unnest(ids) as right_id, unnest(range(len(ids))) as i from cur) join recs on rid = right_id group by 1)
    select doc_id as left_row, text as user_input, coalesce(contexts, '') as retrieved_contexts, coalesce(reference, '') as reference, '' as response
    from recs left join ctx on ctx.left_id = lid left join ref on ref.left_id = lid""")
def evaluation_dataset(spark, sf_dir):
    found = reports.evaluation_dataset(records(spark, sf_dir), matches(spark, sf_dir), decisions(spark, sf_dir))
    return found.withColumn("retrieved_contexts", F.array_join("retrieved_contexts", "##"))
