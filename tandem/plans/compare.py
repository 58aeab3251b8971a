"""Whole compare runs: candidates, optional rerank, optional judge, ranked matches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.cells import embedding_text, quoted
from tandem.models import Embedder, Judge, PairScorer, embed_column
from tandem.operators import judge as judging
from tandem.operators import matching
from tandem.session import materialise
from tandem.sources.matchstore import MatchStore


@dataclass(frozen=True)
class RunConfig:
    """Settings of one run; checked on creation."""

    top_k: int = 10
    vector_enabled: bool = True
    reranker_enabled: bool = False
    judge_enabled: bool = False
    judge_prompt: str | None = None
    judge_rpm: int | None = None
    judge_tasks: int | None = None
    judge_left_columns: Sequence[str] = ()
    judge_right_columns: Sequence[str] = ()
    max_rights: int | None = None
    max_left_rows: int | None = None

    def __post_init__(self) -> None:
        if self.top_k < 1:
            raise ValueError("top_k must be at least 1")
        if not (self.vector_enabled or self.reranker_enabled or self.judge_enabled):
            raise ValueError("at least one stage must be enabled")
        if not self.vector_enabled and not self.judge_enabled:
            raise ValueError("without vectors the judge must be enabled to score the pairs")
        if not self.vector_enabled and (self.max_rights or 0) < 1:
            raise ValueError("without vectors max_rights says how many right rows each left row meets")


@dataclass(frozen=True)
class RunResult:
    candidates: DataFrame
    scored: DataFrame
    matches: DataFrame
    judged: bool

    def metrics(self) -> DataFrame:
        return matching.run_metrics(self.candidates, self.scored, self.matches, self.judged)


def embed_records(
    records: DataFrame,
    embedder: Embedder,
    left_prefix: str | None = None,
    right_prefix: str | None = None,
) -> DataFrame:
    """Records with ``embedding``, written once: every run and every stage of it reads the same
    vectors, and no text is embedded twice. The side prefix goes to the embedder only."""
    text = embedding_text("contextual_content", "side", left_prefix, right_prefix)
    return materialise(records.withColumn("embedding", embed_column(text, embedder)), "embedded")


def _judged(
    pairs: DataFrame,
    records: DataFrame,
    config: RunConfig,
    judge: Judge,
    rows: DataFrame | None,
    by: Sequence[str] = (),
) -> DataFrame:
    if (config.judge_left_columns or config.judge_right_columns) and rows is not None:
        texts = judging.judge_texts(records, rows, config.judge_left_columns, config.judge_right_columns, by)
    else:
        texts = judging.judge_texts(records, records)
    prompts = judging.judge_prompts(pairs, texts)
    replies = judging.call_judge(
        prompts, judge, config.judge_prompt, judging.effective_rpm(config.judge_rpm), config.judge_tasks
    )
    # Written once: ranking and metrics must not call the model again.
    return judging.judge_scores(materialise(replies.drop("prompt"), "judge-replies"))


def _record_texts(records: DataFrame) -> DataFrame:
    return records.select("id", F.coalesce("contextual_content", F.lit("")).alias("text"))


def run_compare(
    records: DataFrame,
    config: RunConfig,
    *,
    scorer: PairScorer | None = None,
    judge: Judge | None = None,
    source_rows: DataFrame | None = None,
    by: Sequence[str] = (),
    **topk_options,
) -> RunResult:
    """One run over embedded two-sided records; record ids are unique in the table. Without
    vectors the candidates are the best ``max_rights`` of all right rows by shared words."""
    if config.judge_enabled and judge is None:
        raise ValueError("the judge stage needs a judge")
    left = matching.first_left_rows(matching.side_of(records, "left"), config.max_left_rows, by)
    right = matching.side_of(records, "right")
    if config.vector_enabled:
        candidates = matching.vector_candidates(left, right, config.top_k, by, **topk_options)
    else:
        candidates = matching.keyword_candidates(left, right, config.max_rights, by)
    if config.reranker_enabled or config.judge_enabled:
        # Several later steps read the candidates: searched once.
        candidates = materialise(candidates, "run-candidates")
    return run_candidates(records, candidates, config, scorer=scorer, judge=judge, source_rows=source_rows, by=by)


def run_candidates(
    records: DataFrame,
    candidates: DataFrame,
    config: RunConfig,
    *,
    scorer: PairScorer | None = None,
    judge: Judge | None = None,
    source_rows: DataFrame | None = None,
    by: Sequence[str] = (),
) -> RunResult:
    """The stages of a run after the search, over candidates of the caller's choice."""
    if config.judge_enabled and judge is None:
        raise ValueError("the judge stage needs a judge")
    pairs = candidates
    if config.vector_enabled and config.reranker_enabled:
        pairs = matching.rerank_pairs(candidates, _record_texts(records), scorer)
        if config.judge_enabled:
            # Used by the prompts and by the final ranking: scored once.
            pairs = materialise(pairs, "run-pairs")
    judged = _judged(pairs, records, config, judge, source_rows, by) if config.judge_enabled else None
    scored = matching.with_scores(pairs, judged)
    return RunResult(candidates, scored, matching.rank_matches(scored, config.top_k), config.judge_enabled)


def rejudge(
    matches: DataFrame,
    left_ids: DataFrame,
    records: DataFrame,
    config: RunConfig,
    judge: Judge,
    source_rows: DataFrame | None = None,
) -> DataFrame:
    """Judge the chosen left rows again with their stored candidates; only their matches change."""
    if not config.judge_enabled:
        raise ValueError("the judge stage is not enabled for this run")
    pairs = matching.stored_candidates(matches, left_ids)
    scored = matching.with_scores(pairs, _judged(pairs, records, config, judge, source_rows))
    return matching.replace_lefts(matches, left_ids, matching.rank_matches(scored, config.top_k))


def rejudge_stored(
    store: MatchStore, left_ids: DataFrame, records: DataFrame, config: RunConfig, judge: Judge, source_rows: DataFrame | None = None
) -> int:
    """Judges the chosen left rows again with their stored candidates and replaces their matches in
    the store; returns its new version."""
    if not config.judge_enabled:
        raise ValueError("the judge stage is not enabled for this run")
    stored = store.read()
    pairs = materialise(matching.stored_candidates(stored, left_ids), "stored-candidates")
    scored = matching.with_scores(pairs, _judged(pairs, records, config, judge, source_rows))
    fresh = materialise(matching.rank_matches(scored, config.top_k), "judged-again")
    return store.replace(fresh.select("left_id").distinct(), fresh.select(*stored.columns))


def _job_key(job: str = "job_id") -> Column:
    """Tells jobs apart in joins, records without a job being a job of their own."""
    return F.coalesce(F.concat(F.lit("="), F.col(job).cast("string")), F.lit("-"))


def _numbered(records: DataFrame) -> DataFrame:
    """Records of all jobs with ``job_key`` and an ``id`` that is unique in the table and in the
    order of the job's own ids, kept as ``source_id``. Ids of any size; no row is numbered by
    another's place, so no window spans a job."""
    keyed = records.withColumns({"job_key": _job_key(), "source_id": F.col("id")})
    ordered = keyed.repartitionByRange("job_key", "source_id").sortWithinPartitions("job_key", "source_id")
    return materialise(ordered.withColumn("id", F.monotonically_increasing_id()), "numbered")


def _own_ids(matches: DataFrame, numbered: DataFrame) -> DataFrame:
    """Matches with the job and the ids that the caller gave."""
    for side in ("left", "right"):
        known = numbered.select(
            F.col("id").alias(f"{side}_id"), F.col("source_id").alias("__own"), *["job_id"] * (side == "left"))
        matches = matches.join(known, f"{side}_id").drop(f"{side}_id").withColumnRenamed("__own", f"{side}_id")
    return matches


def run_many(records: DataFrame, config: RunConfig, source_rows: DataFrame | None = None, **models) -> DataFrame:
    """Matches of many independent jobs of one configuration: ``job_id`` and the match columns.

    ``records`` of all jobs stand in one table with ``job_id``, and so do the ``source_rows``
    that the judge's texts are rebuilt from. Every join and window is keyed by job, so all jobs
    run as one Spark job, large and small ones side by side; records without a job are a job of
    their own.
    """
    numbered = _numbered(records)
    if source_rows is not None:
        models["source_rows"] = source_rows.withColumn("job_key", _job_key())
    matches = run_compare(numbered, config, by=["job_key"], **models).matches
    return _own_ids(matches, numbered)


# What a job table holds besides ``job_id``, and what holds where a job leaves it null.
JOB_SETTINGS = (
    "left_columns array<string>, right_columns array<string>, left_content string, right_content string, left_display string, "
    "right_display string, top_k int, vector_enabled boolean, reranker_enabled boolean, judge_enabled boolean, max_rights int"
)


def _job_table(jobs: DataFrame) -> DataFrame:
    none, on, off = F.array().cast("array<string>"), F.lit(True), F.lit(False)
    otherwise = {
        "left_columns": none, "right_columns": none, "top_k": F.lit(RunConfig.top_k), "vector_enabled": on, "reranker_enabled": off,
        "judge_enabled": off, "max_rights": F.lit(100)}
    given = {f.rsplit(" ", 1)[0]: f.rsplit(" ", 1)[1] for f in JOB_SETTINGS.split(", ")}
    columns = {
        name: F.coalesce(F.col(name) if name in jobs.columns else F.lit(None).cast(kind), otherwise.get(name, F.lit(None).cast(kind)))
        for name, kind in given.items()}
    table = materialise(jobs.select(_job_key().alias("job_key"), *[c.alias(n) for n, c in columns.items()]), "job-table")
    facts = table.agg(
        F.count(F.lit(1)) - F.count_distinct("job_key"), F.count_if((F.col("top_k") < 1) | (F.col("max_rights") < 1)),
        F.count_if(~F.col("vector_enabled") & ~F.col("judge_enabled")),
    ).head()
    for wrong, message in zip(facts, ("a job stands in the job table more than once", "top_k and max_rights must be at least 1",
                                      "without vectors the judge must be enabled to score the pairs")):
        if wrong:
            raise ValueError(message)
    return table


def job_records(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Records of all jobs from source rows ``job_id, id, side, original_row, sheet_name`` and
    ``cells`` (a map of the row's columns): every job names its own columns."""
    left = F.col("side") == "left"
    content, display = (F.when(left, F.col(f"left_{n}")).otherwise(F.col(f"right_{n}")) for n in ("content", "display"))
    listed = F.when(left, F.col("left_columns")).otherwise(F.col("right_columns"))
    met = rows.withColumn("job_key", _job_key()).join(table, "job_key")

    def cell(name: Column) -> Column:
        return F.element_at("cells", name)

    named = F.concat(listed, F.when(content.isNotNull(), F.array(content)).otherwise(F.array().cast("array<string>")))
    shown = F.filter(named, lambda c: (cell(c) != "") & (F.lower(cell(c)) != "nan"))
    parts = F.transform(shown, lambda c: F.concat(F.lit("["), c, F.lit("] "), cell(c)))
    sheet = F.concat(F.lit("[sheet] "), F.coalesce("sheet_name", F.lit("")))
    return met.select(
        *[quoted(c) for c in rows.columns if c != "cells"],
        F.concat_ws(" | ", sheet, parts).alias("contextual_content"),
        F.when(F.lower(cell(display)) != "nan", cell(display)).alias("display_value"),
    )


def run_jobs(
    rows: DataFrame,
    jobs: DataFrame,
    *,
    embedder: Embedder | None = None,
    scorer: PairScorer | None = None,
    judge: Judge | None = None,
    judge_rpm: int | None = None,
) -> DataFrame:
    """Matches of many jobs whose settings are rows of ``jobs`` (``job_id`` and JOB_SETTINGS).

    ``rows`` are those of ``job_records``, with ``embedding`` where vectors are at hand. Columns,
    display columns, numbers of candidates and results and the stages differ from job to job; the
    plan depends on which of the (at most eight) combinations of stages occur, not on how many
    jobs there are. Jobs without a row in ``jobs`` are not run. The match columns with ``job_id,
    left_display, right_display``.
    """
    table = _job_table(jobs)
    records = job_records(rows, table)
    if "embedding" not in records.columns and embedder is not None:
        records = embed_records(records, embedder)
    numbered = _numbered(records)
    stages = ["vector_enabled", "reranker_enabled", "judge_enabled"]
    # At most eight rows.
    combinations = table.groupBy(*stages).agg(F.max("top_k").alias("k"), F.max("max_rights").alias("rights")).collect()
    found = []
    for c in combinations:
        own = table.where((F.col(stages[0]) == c[0]) & (F.col(stages[1]) == c[1]) & (F.col(stages[2]) == c[2]))
        config = RunConfig(c["k"], c[0], c[1], c[2], judge_rpm=judge_rpm, max_rights=c["rights"])
        part = numbered.join(own.select("job_key"), "job_key", "left_semi")
        left, right = (matching.side_of(part, s) for s in ("left", "right"))
        if c["vector_enabled"]:
            candidates, most = matching.vector_candidates(left, right, c["k"], ["job_key"]), "top_k"
        else:
            candidates, most = matching.keyword_candidates(left, right, c["rights"], ["job_key"]), "max_rights"
        limits = own.select("job_key", F.col(most).alias("__most"), F.col("top_k").alias("__k"))
        within = candidates.join(limits, "job_key").where(F.col("cand_pos") <= F.col("__most"))
        candidates = materialise(within.drop("__most", "__k"), "job-candidates")
        matches = run_candidates(part, candidates, config, scorer=scorer, judge=judge, by=["job_key"]).matches
        of_left = numbered.select(F.col("id").alias("left_id"), "job_key").join(limits.select("job_key", "__k"), "job_key").drop("job_key")
        found.append(matches.join(of_left, "left_id").where(F.col("rank") <= F.col("__k")).drop("__k"))
    if not found:
        raise ValueError("the job table is empty")
    matches = reduce(DataFrame.unionByName, found)
    for side in ("left", "right"):
        shown = numbered.select(F.col("id").alias(f"{side}_id"), F.col("display_value").alias(f"{side}_display"))
        matches = matches.join(shown, f"{side}_id")
    return _own_ids(matches, numbered)
