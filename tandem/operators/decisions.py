"""Review decisions: an append-only log, its current view, statistics and the review queue.

Log rows: ``seq, left_id, matched_right_id, matched_right_ids, decided_at, review_comment,
review_outcome, deleted``. The view keeps the latest row per left id; a deletion makes the
left row pending again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.patterns import MAX_REVIEW_TEXT, text_contains
from tandem.functions.scores import OUTCOMES, effective_ids, has_selection, submitted_ids

OUTCOME_FILTERS = ("all", "pending", "matched_none", *OUTCOMES)


def resolve_submissions(submissions: DataFrame) -> DataFrame:
    """Submitted rows as log rows: ids de-duplicated, cleared by 'no_match', first id kept
    as the single id. An unknown outcome is an error."""
    known = F.col("review_outcome").isNull() | F.col("review_outcome").isin(*OUTCOMES)
    ids = submitted_ids("review_outcome", "matched_right_ids", "matched_right_id")
    return (
        submissions.where(F.assert_true(known, "unknown review outcome").isNull())
        .withColumn("matched_right_ids", ids)
        .withColumns(
            {
                "matched_right_id": F.try_element_at("matched_right_ids", F.lit(1)),
                "review_comment": F.coalesce("review_comment", F.lit("")),
            }
        )
    )


def invalid_selections(decisions: DataFrame, matches: DataFrame) -> DataFrame:
    """``left_id, right_id`` of selected ids that are not candidates of their left row."""
    selected = decisions.select("left_id", F.explode("matched_right_ids").alias("right_id")).distinct()
    return selected.join(matches.select("left_id", "right_id"), ["left_id", "right_id"], "left_anti")


def latest_per_left(log: DataFrame) -> DataFrame:
    """The latest log row per left id, deletions included. A running maximum, so a left id
    with very many log rows is reduced where the rows are."""
    rest = [c for c in log.columns if c != "left_id"]
    latest = F.max_by(F.struct(*rest), F.struct("decided_at", "seq")).alias("row")
    return log.groupBy("left_id").agg(latest).select("left_id", "row.*").select(*log.columns)


def current_decisions(log: DataFrame) -> DataFrame:
    latest = latest_per_left(log)
    return latest.where(~F.coalesce("deleted", F.lit(False))).drop("deleted")


def review_statistics(left: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: ``total_left, reviewed, pending, no_match, matched``. ``no_match`` counts
    decisions without a selected id, whatever their outcome."""
    total = left.agg(F.count(F.lit(1)).alias("total_left"))
    counts = decisions.agg(
        F.count(F.lit(1)).alias("reviewed"),
        F.count_if(~has_selection("matched_right_ids", "matched_right_id")).alias("no_match"),
    )
    zero = F.lit(0).cast("bigint")
    return total.join(F.broadcast(counts)).select(
        "total_left",
        "reviewed",
        F.greatest(zero, F.col("total_left") - F.col("reviewed")).alias("pending"),
        "no_match",
        F.greatest(zero, F.col("reviewed") - F.col("no_match")).alias("matched"),
    )


def outcome_counts(decisions: DataFrame) -> DataFrame:
    """One row with a count per outcome; ``matched_none`` counts decisions without one."""
    outcome = F.coalesce("review_outcome", F.lit(""))
    return decisions.agg(
        *[F.count_if(outcome == o).alias(o) for o in OUTCOMES], F.count_if(outcome == "").alias("matched_none")
    )


def lefts_with_text(left: DataFrame, right: DataFrame, matches: DataFrame, text: str) -> DataFrame:
    """Left ids where the row itself or any of its candidates contains the text."""
    wanted = text.strip()
    if len(wanted) > MAX_REVIEW_TEXT:
        raise ValueError("the search text is too long")

    def hit() -> Column:
        return text_contains("contextual_content", wanted) | text_contains("display_value", wanted)

    own = left.where(hit()).select(F.col("id").alias("left_id"))
    right_hits = right.where(hit()).select(F.col("id").alias("right_id"))
    through = matches.select("left_id", "right_id").join(right_hits, "right_id", "left_semi").select("left_id")
    return own.union(through).distinct()


def _outcome_predicate(key: str) -> Column:
    decided = F.col("decided")
    if key == "pending":
        return ~decided
    if key == "matched_none":
        blank = F.trim(F.coalesce("review_outcome", F.lit(""))) == ""
        return decided & blank & has_selection("matched_right_ids", "matched_right_id")
    return F.coalesce(F.col("review_outcome") == key, F.lit(False))


def review_queue(
    left: DataFrame,
    matches: DataFrame,
    decisions: DataFrame,
    *,
    min_score: float = 0.0,
    outcome: str | None = None,
    include_decided: bool = False,
    text: str | None = None,
    right: DataFrame | None = None,
    sort_by: str = "id",
    descending: bool = False,
) -> DataFrame:
    """Left rows to review, in order: ``left_id, contextual_content, display_value``.

    An outcome filter decides by itself which rows qualify; without one decided rows are
    left out unless asked for. Take a page with ``offset`` and ``limit``.
    """
    key = (outcome or "").strip().lower() or "all"
    if key not in OUTCOME_FILTERS:
        raise ValueError(f"outcome filter must be one of {OUTCOME_FILTERS}")
    best = matches.where((F.col("rank") == 1) & (F.col("final_score") >= min_score)).select("left_id")
    rows = left.select(F.col("id").alias("left_id"), "contextual_content", "display_value").join(best, "left_id")
    if key != "all":
        state = decisions.select(
            "left_id", "review_outcome", "matched_right_ids", "matched_right_id", F.lit(True).alias("__d")
        )
        rows = (
            rows.join(state, "left_id", "left")
            .withColumn("decided", F.coalesce("__d", F.lit(False)))
            .where(_outcome_predicate(key))
        )
    elif not include_decided:
        rows = rows.join(decisions.select("left_id"), "left_id", "left_anti")
    if text and text.strip():
        if right is None:
            raise ValueError("a text filter needs the right rows")
        rows = rows.join(lefts_with_text(left, right, matches, text), "left_id", "left_semi")
    rows = rows.select("left_id", "contextual_content", "display_value")
    if sort_by == "display":
        shown = F.coalesce("display_value", F.lit(""))
        return rows.orderBy(shown.desc() if descending else shown.asc(), "left_id")
    return rows.orderBy("left_id")


def page(queue: DataFrame, offset: int, limit: int = 1) -> DataFrame:
    return queue.offset(offset).limit(limit)


def review_items(lefts: DataFrame, right: DataFrame, matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Queue rows with their candidates in rank order (an array as long as the run's k) and
    their decision."""
    own = matches.join(lefts.select("left_id"), "left_id", "left_semi")
    texts = right.select(
        F.col("id").alias("right_id"),
        F.coalesce("contextual_content", F.lit("")).alias("contextual_content"),
        "display_value",
    )
    item = F.struct(
        "rank",
        "right_id",
        "contextual_content",
        "display_value",
        F.coalesce("cosine_score", F.lit(0.0)).alias("cosine_score"),
        "rerank_score",
        "judge_score",
        F.to_json("judge_meta").alias("judge_meta"),
        "final_score",
    )
    candidates = own.join(texts, "right_id").groupBy("left_id").agg(F.array_sort(F.collect_list(item)).alias("candidates"))
    outcome = F.when(F.col("review_outcome").isin(*OUTCOMES), F.col("review_outcome"))
    state = decisions.select(
        "left_id",
        effective_ids("matched_right_ids", "matched_right_id").alias("__ids"),
        F.coalesce("review_comment", F.lit("")).alias("__comment"),
        outcome.alias("review_outcome"),
        F.lit(True).alias("__d"),
    )
    return (
        lefts.join(candidates, "left_id", "left")
        .join(state, "left_id", "left")
        .select(
            "left_id",
            F.coalesce("contextual_content", F.lit("")).alias("contextual_content"),
            "display_value",
            "candidates",
            F.coalesce("__ids", F.array().cast("array<bigint>")).alias("matched_right_ids"),
            F.coalesce("__d", F.lit(False)).alias("is_decided"),
            F.coalesce("__comment", F.lit("")).alias("review_comment"),
            "review_outcome",
        )
    )
