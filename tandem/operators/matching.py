"""Candidate pairs, rerank scores and ranked matches between left and right records.

Records: ``id, side, original_row, sheet_name, contextual_content, display_value,
embedding``. Candidates: ``left_id, right_id, cosine_score, cand_pos``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.scores import final_score
from tandem.models import PairScorer, model_tasks, overlap_score, score_column
from tandem.operators.judge import completion_budget
from tandem.operators.keyword import any_term_topk
from tandem.operators.topk import topk_cosine
from tandem.operators.vectorindex import VectorIndex


def side_of(records: DataFrame, side: str) -> DataFrame:
    return records.where(F.col("side") == side)


def first_left_rows(left: DataFrame, limit: int | None, by: Sequence[str] = ()) -> DataFrame:
    """A trial run's first ``limit`` rows by id; without a limit all."""
    if limit is None or limit < 1:
        return left
    n = limit
    if by:
        place = F.row_number().over(Window.partitionBy(*by).orderBy("id"))
        return left.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")
    return left.orderBy("id").limit(n)


def vector_candidates(
    left: DataFrame, right: DataFrame, k: int, by: Sequence[str] = (), index: VectorIndex | None = None, **options
) -> DataFrame:
    """The k most similar right rows of every left row (within each ``by`` value), from a stored
    index of the right rows where one is given."""
    if index is not None and by:
        raise ValueError("a stored index holds the right rows of one run")
    lefts = left.select(*by, F.col("id").alias("left_id"), F.col("embedding").alias("left_vec"))
    if index is not None:
        return index.search(lefts, k, **options)
    rights = right.select(*by, F.col("id").alias("right_id"), F.col("embedding").alias("right_vec"))
    return topk_cosine(lefts, rights, k, by=by, **options)


def keyword_candidates(left: DataFrame, right: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k best right rows of every left row by shared words (BM25 over all right rows), cosine
    0: the run without vectors. Rows that share no word are no candidates."""

    def texts(rows: DataFrame, key: str) -> DataFrame:
        return rows.select(*by, F.col("id").alias(key), F.coalesce("contextual_content", F.lit("")).alias("text"))

    found = any_term_topk(texts(left, "left_id"), texts(right, "right_id"), _at_least_one(k), by)
    return found.select(*by, "left_id", "right_id", F.lit(0.0).alias("cosine_score"), F.col("rank").alias("cand_pos"))


def left_rows_report(left: DataFrame, limit: int | None) -> DataFrame:
    """``lefts_used, lefts_total, limited``."""
    total = F.count(F.lit(1))
    used = total if limit is None or limit < 1 else F.least(total, F.lit(limit))
    return left.agg(used.cast("bigint").alias("lefts_used"), total.alias("lefts_total"), (used < total).alias("limited"))


def capped_rights(right: DataFrame, limit: int, by: Sequence[str] = ()) -> DataFrame:
    """The first ``limit`` right ids as one array per ``by`` value."""
    n = _at_least_one(limit)
    if by:
        place = F.row_number().over(Window.partitionBy(*by).orderBy("id"))
        first = right.select(*by, "id", place.alias("__place")).where(F.col("__place") <= n)
    else:
        first = right.select("id").orderBy("id").limit(n)
    return first.groupBy(*by).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _at_least_one(limit: int | None) -> int:
    if limit is None or limit < 1:
        raise ValueError("a run without vectors needs the number of right rows to pair with each left row")
    return limit


def capped_candidates(left: DataFrame, right: DataFrame, limit: int, by: Sequence[str] = ()) -> DataFrame:
    """Every left row with the first ``limit`` right rows by id, cosine 0. No run chooses this form.

    The right ids travel as arrays of that many ids (one row unless ``by`` is given), so the
    left side is not shuffled for them.
    """
    ids = capped_rights(right, limit, by)
    lefts = left.select(*by, F.col("id").alias("left_id"))
    joined = lefts.join(ids, list(by)) if by else lefts.join(F.broadcast(ids))
    return joined.select(*by, "left_id", F.posexplode("ids").alias("pos", "right_id")).select(
        *by, "left_id", "right_id", F.lit(0.0).alias("cosine_score"), (F.col("pos") + 1).alias("cand_pos")
    )


def capped_rights_report(right: DataFrame, limit: int) -> DataFrame:
    """``rights_loaded, rights_total, truncated``."""
    n = _at_least_one(limit)
    total = F.count(F.lit(1))
    return right.agg(
        F.least(total, F.lit(n)).cast("bigint").alias("rights_loaded"),
        total.alias("rights_total"),
        (total > n).alias("truncated"),
    )


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds ``left_text`` and ``right_text`` from ``id, text``."""
    left = texts.select(F.col("id").alias("left_id"), F.col("text").alias("left_text"))
    right = texts.select(F.col("id").alias("right_id"), F.col("text").alias("right_text"))
    return pairs.join(left, "left_id", "left").join(right, "right_id", "left")


def rerank_pairs(
    candidates: DataFrame, texts: DataFrame, scorer: PairScorer | None = None, enabled: bool = True
) -> DataFrame:
    """Adds ``rerank_score``. Switched off it repeats cosine; where the scorer fails the
    whole left row falls back to cosine. Without a scorer: built-in token overlap."""
    if not enabled:
        return candidates.withColumn("rerank_score", F.col("cosine_score"))
    if scorer is None:
        left, right = (texts.select(F.col("id").alias(key), "text") for key in ("left_id", "right_id"))
        return overlap_score(candidates, left, right, "left_id", "right_id", "rerank_score")
    text = model_tasks(with_texts(candidates, texts).fillna("", ["left_text", "right_text"]), "left_id")
    scored = text.withColumn("__score", score_column("left_text", "right_text", scorer))
    failed = F.max(F.col("__score").isNull()).over(Window.partitionBy("left_id"))
    return scored.withColumn("rerank_score", F.when(failed, F.col("cosine_score")).otherwise(F.col("__score"))).drop(
        "left_text", "right_text", "__score"
    )


def with_scores(candidates: DataFrame, judged: DataFrame | None) -> DataFrame:
    """Candidates with all score columns and ``final_score``."""
    pairs = candidates
    if "rerank_score" not in pairs.columns:
        pairs = pairs.withColumn("rerank_score", F.lit(None).cast("double"))
    if judged is None:
        pairs = pairs.withColumns(
            {
                "judge_score": F.lit(None).cast("double"),
                "judge_meta": F.lit(None).cast("map<string,string>"),
            }
        )
    else:
        pairs = pairs.join(judged, ["left_id", "right_id"], "left")
    return pairs.withColumn("final_score", final_score("judge_score", "rerank_score", "cosine_score"))


def rank_matches(scored: DataFrame, k: int, keys: Sequence[str] = ("left_id",)) -> DataFrame:
    """The best k pairs per left row, ranked; equal scores keep candidate order."""
    order = Window.partitionBy(*keys).orderBy(F.desc("final_score"), "cand_pos")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(
            *[c for c in keys if c != "left_id"],
            "left_id",
            "right_id",
            "cosine_score",
            "rerank_score",
            "judge_score",
            "judge_meta",
            "final_score",
            "rank",
        )
    )


def stored_candidates(matches: DataFrame, left_ids: DataFrame) -> DataFrame:
    """Matches of the chosen left rows as candidates again, in rank order."""
    return matches.join(left_ids.select("left_id").distinct(), "left_id", "left_semi").select(
        "left_id", "right_id", "cosine_score", "rerank_score", F.col("rank").alias("cand_pos")
    )


def replace_lefts(matches: DataFrame, left_ids: DataFrame, fresh: DataFrame) -> DataFrame:
    """Old matches of all other left rows plus the new ones."""
    kept = matches.join(left_ids.select("left_id").distinct(), "left_id", "left_anti")
    return kept.unionByName(fresh)


def run_metrics(candidates: DataFrame, scored: DataFrame, matches: DataFrame, judged: bool) -> DataFrame:
    """One row of counts for a run."""
    per_left = candidates.groupBy("left_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = per_left.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("candidate_pairs"),
        F.count(F.lit(1)).alias("left_rows"),
        completion_budget(F.coalesce(F.max("n"), F.lit(1))).alias("judge_max_tokens"),
    )
    unparsed = scored.agg(
        F.count(F.lit(1)).alias("judge_pairs"), F.count_if(F.col("judge_score").isNull()).alias("judge_unparsed")
    )
    written = matches.agg(F.count(F.lit(1)).alias("matches_written"))
    all_counts = pairs.join(F.broadcast(unparsed)).join(F.broadcast(written))
    on = F.lit(judged)
    return all_counts.select(
        "candidate_pairs",
        "left_rows",
        F.when(on, F.col("judge_pairs")).alias("judge_pairs"),
        F.when(on, F.col("left_rows")).alias("judge_requests"),
        F.when(on, F.col("judge_unparsed")).alias("judge_unparsed"),
        F.when(on, F.col("judge_max_tokens")).alias("judge_max_tokens"),
        "matches_written",
    )
