"""Scores, score bands, review outcomes and selected ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.functions.cells import as_column

# Score bands of the review screen and the stored review outcomes.
MATCH_THRESHOLD = 0.85
REVIEW_THRESHOLD = 0.60
OUTCOMES = ("no_match", "partial", "fail", "system_fail")


def final_score(judge: Column | str, rerank: Column | str, cosine: Column | str) -> Column:
    """Ranking score of a pair: the judge's, else the reranker's, else cosine, else 0."""
    return F.coalesce(as_column(judge), as_column(rerank), as_column(cosine), F.lit(0.0))


def legacy_final_score(rerank: Column | str, cosine: Column | str) -> Column:
    """Score of pairs stored before final scores existed: rerank counts only inside [0, 1]."""
    r = as_column(rerank)
    return F.coalesce(F.when(r.between(0.0, 1.0), r), as_column(cosine), F.lit(0.0))


def score_band(score: Column | str) -> Column:
    s = as_column(score)
    return (
        F.when(s >= MATCH_THRESHOLD, "match").when(s >= REVIEW_THRESHOLD, "review").otherwise("weak")
    )


def rerank_strength(rank: Column | str) -> Column:
    r = as_column(rank)
    return (
        F.when(r == 1, "strong").when(r <= 3, "good").when(r <= 10, "ok").when(r.isNotNull(), "weak")
    )


def deduplicated_ids(ids: Column | str) -> Column:
    """Selected ids in order, without nulls and repeats."""
    return F.array_distinct(F.array_compact(as_column(ids)))


def effective_ids(ids: Column | str, single: Column | str) -> Column:
    """Selected right ids: a non-empty list, else the single id of old rows, else none."""
    many, one = as_column(ids), as_column(single)
    return (
        F.when(F.coalesce(F.size(many), F.lit(0)) > 0, many)
        .when(one.isNotNull(), F.array(one))
        .otherwise(F.array().cast("array<bigint>"))
    )


def has_selection(ids: Column | str, single: Column | str) -> Column:
    return (F.coalesce(F.size(as_column(ids)), F.lit(0)) > 0) | as_column(single).isNotNull()


def submitted_ids(outcome: Column | str, ids: Column | str, single: Column | str) -> Column:
    """Ids stored for a submitted decision: 'no_match' clears them."""
    many, one = as_column(ids), as_column(single)
    none = F.array().cast("array<bigint>")
    return (
        F.when(F.coalesce(as_column(outcome), F.lit("")) == "no_match", none)
        .when(many.isNotNull(), deduplicated_ids(many))
        .when(one.isNotNull(), F.array(one))
        .otherwise(none)
    )


def _outcome_text(outcome: Column | str, other: str) -> Column:
    o = as_column(outcome)
    return (
        F.when(o == "no_match", "no match")
        .when(o.isin("partial", "fail"), o)
        .when(o == "system_fail", "system failure")
        .otherwise(other)
    )


def raw_outcome_text(outcome: Column | str) -> Column:
    return _outcome_text(outcome, "")


def confirmed_outcome_text(outcome: Column | str) -> Column:
    return _outcome_text(outcome, "matched")


def human_review_text(decided: Column, outcome: Column | str, ids: Column | str, single: Column | str) -> Column:
    """Review column of the unmatched-left report."""
    known = as_column(outcome).isin(*OUTCOMES)
    return (
        F.when(~decided, "")
        .when(known, raw_outcome_text(outcome))
        .when(~has_selection(ids, single), "no match")
        .otherwise("")
    )


def review_badge(decided: Column, outcome: Column | str, n_selected: Column) -> Column:
    """Short label of a reviewed row."""
    o, text = as_column(outcome), raw_outcome_text(outcome)
    picked = F.when(
        o.isin("partial", "fail", "system_fail"), F.concat(F.lit("Matched · "), text)
    ).otherwise("Matched")
    unpicked = F.when(
        o.isin(*OUTCOMES), F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 100))
    ).otherwise("Reviewed")
    return F.when(~decided, "").when(n_selected > 0, picked).otherwise(unpicked)
