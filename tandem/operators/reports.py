"""Run reports: raw pairs, confirmed matches, unmatched rows, evaluation data.

Records, matches and decisions are joined on ids that are unique on one side, and the
grouping in the evaluation report is per left row, bounded by the run's k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.operators.profile import page
from tandem.functions.scores import (
    confirmed_outcome_text,
    effective_ids,
    has_selection,
    human_review_text,
    raw_outcome_text,
)

REFERENCE_SEPARATOR = "\n\n---\n\n"


def _side(records: DataFrame, side: str, prefix: str) -> DataFrame:
    return records.where(F.col("side") == side).select(
        F.col("id").alias(f"{prefix}_id"),
        F.col("original_row").alias(f"{prefix}_row"),
        F.col("display_value").alias(f"{prefix}_display"),
        F.col("contextual_content").alias(f"{prefix}_contextual"),
    )


_SCORES = ("cosine_score", "rerank_score", "judge_score")


def _meta_text():
    return F.coalesce(F.to_json("judge_meta"), F.lit("")).alias("judge_meta")


def _pairs(matches: DataFrame, records: DataFrame) -> DataFrame:
    return matches.join(_side(records, "left", "left"), "left_id").join(_side(records, "right", "right"), "right_id")


_PAIR_COLUMNS = (
    "left_row", "left_display", "left_contextual", "rank", "right_row", "right_display", "right_contextual", *_SCORES,
)


def raw_pairs(records: DataFrame, matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every match with both rows and the decision on its left row. Sort by ``left_row,
    rank`` when writing."""
    state = decisions.select("left_id", "review_outcome", "review_comment")
    return _pairs(matches, records).join(state, "left_id", "left").select(
        *_PAIR_COLUMNS,
        _meta_text(),
        "final_score",
        raw_outcome_text("review_outcome").alias("review_outcome_display"),
        F.coalesce("review_comment", F.lit("")).alias("review_comment"),
    )


def browse_pairs(records: DataFrame, matches: DataFrame, limit: int = 50, left_row: int | None = None) -> DataFrame:
    """First ``limit`` pairs by left row and rank, with the total in ``total``."""
    n = page(limit)
    rows = _pairs(matches, records)
    if left_row is not None:
        rows = rows.where(F.col("left_row") == left_row)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    first = rows.orderBy("left_row", "rank").limit(n).select(*_PAIR_COLUMNS, _meta_text(), "final_score")
    return first.join(F.broadcast(total))


def confirmed_matches(records: DataFrame, matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row per selected right row, numbered in selection order."""
    ids = effective_ids("matched_right_ids", "matched_right_id")
    selected = decisions.select(
        "left_id",
        F.size(ids).alias("selected_rights_count"),
        F.posexplode(ids).alias("pos", "right_id"),
        "review_outcome",
        "review_comment",
        "decided_at",
    )
    return (
        selected.join(matches.select("left_id", "right_id", *_SCORES, "judge_meta", "final_score"), ["left_id", "right_id"])
        .join(_side(records, "left", "left"), "left_id")
        .join(_side(records, "right", "right"), "right_id")
        .select(
            "left_row", "left_display", "left_contextual",
            "right_row", "right_display", "right_contextual",
            *_SCORES,
            _meta_text(),
            "final_score",
            "selected_rights_count",
            (F.col("pos") + 1).alias("match_index"),
            confirmed_outcome_text("review_outcome").alias("review_outcome_display"),
            F.coalesce("review_comment", F.lit("")).alias("review_comment"),
            "decided_at",
        )
    )


def unique_left(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Left rows without a selected right row, reviewed or not."""
    selecting = has_selection("matched_right_ids", "matched_right_id")
    state = decisions.where(~selecting).select(
        "left_id", "review_outcome", "matched_right_ids", "matched_right_id", "review_comment", F.lit(True).alias("__d")
    )
    decided = F.coalesce("__d", F.lit(False))
    return (
        _side(records, "left", "left")
        .join(decisions.where(selecting).select("left_id"), "left_id", "left_anti")
        .join(state, "left_id", "left")
        .select(
            "left_row", "left_display", "left_contextual",
            human_review_text(decided, "review_outcome", "matched_right_ids", "matched_right_id").alias("human_review"),
            F.coalesce("review_comment", F.lit("")).alias("review_comment"),
        )
    )


def unique_right(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Right rows no decision selects, neither in its list nor as its single id."""
    listed = decisions.select(F.explode("matched_right_ids").alias("right_id"))
    single = decisions.select(F.col("matched_right_id").alias("right_id"))
    selected = listed.union(single).where(F.col("right_id").isNotNull()).distinct()
    return _side(records, "right", "right").join(selected, "right_id", "left_anti").select(
        "right_row", "right_display", "right_contextual"
    )


def evaluation_dataset(records: DataFrame, matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per left row: its text, its candidates' texts in rank order, and the selected texts
    joined in selection order."""
    texts = records.where(F.col("side") == "right").select(
        F.col("id").alias("right_id"), F.coalesce("contextual_content", F.lit("")).alias("text")
    )

    def in_order(pairs: DataFrame, order: str, name: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct(order, "text")))
        return pairs.join(texts, "right_id").groupBy("left_id").agg(F.transform(listed, lambda x: x["text"]).alias(name))

    contexts = in_order(matches.select("left_id", "right_id", "rank"), "rank", "contexts")
    ids = effective_ids("matched_right_ids", "matched_right_id")
    chosen = in_order(decisions.select("left_id", F.posexplode(ids).alias("pos", "right_id")), "pos", "chosen")
    empty = F.array().cast("array<string>")
    return (
        _side(records, "left", "left")
        .join(contexts, "left_id", "left")
        .join(chosen, "left_id", "left")
        .select(
            "left_row",
            F.coalesce("left_contextual", F.lit("")).alias("user_input"),
            F.coalesce("contexts", empty).alias("retrieved_contexts"),
            F.array_join(F.coalesce("chosen", empty), REFERENCE_SEPARATOR).alias("reference"),
            F.lit("").alias("response"),
        )
    )
