"""Judge stage: one prompt per left row, throttled calls, replies parsed on the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.cells import WHITESPACE, as_column, contextual_content, strip
from tandem.models import Judge, Throttle

# Completion budget (floor, ceiling, base, per candidate) and request-rate limit
# of a run. And the length at which texts beside a score are cut, unless the caller says
# otherwise.
TOKENS_MIN, TOKENS_MAX, TOKENS_BASE, TOKENS_PER_CANDIDATE = 2048, 8192, 258, 128
MAX_RUN_RPM = 360
META_TEXT_LIMIT = 2000

DEFAULT_SYSTEM_PROMPT = (
    "You are given one reference text and several numbered candidate texts. For each candidate, in order, "
    "judge how well it matches the reference, from 0 (unrelated) to 1 (same thing). Answer with a JSON array "
    'only, one item per candidate: {"score": number, "reason": "one short sentence"}.'
)


def system_prompt(own: str | None) -> str:
    """A run's own prompt replaces the built-in one entirely."""
    return (own or "").strip() or DEFAULT_SYSTEM_PROMPT


def effective_rpm(run_value: int | None, default: int = 0) -> int:
    """Requests per minute: the run's value within 0..360, else the default; 0 = no limit."""
    return max(0, default) if run_value is None else max(0, min(int(run_value), MAX_RUN_RPM))


def completion_budget(n: Column | str) -> Column:
    estimate = TOKENS_BASE + TOKENS_PER_CANDIDATE * F.greatest(F.lit(1), as_column(n))
    return F.least(F.lit(TOKENS_MAX), F.greatest(F.lit(TOKENS_MIN), estimate)).cast("int")


def judge_texts(
    records: DataFrame,
    rows: DataFrame,
    left_columns: Sequence[str] | None = None,
    right_columns: Sequence[str] | None = None,
    by: Sequence[str] = (),
    as_given: bool = False,
) -> DataFrame:
    """``id, text`` for the judge: rebuilt from other columns of the source rows (joined on
    side and row number, within each ``by`` value) where a side has such columns, else the
    stored text.

    ``rows`` carries ``side, original_row, sheet_name``, the ``by`` columns and the source
    columns. ``as_given`` takes the values of a typed table as they stand and leaves an unknown
    text null; a prompt shows it as empty.
    """
    stored = F.col("contextual_content") if as_given else F.coalesce("contextual_content", F.lit(""))
    base = records.select(*by, "id", "side", "original_row", stored.alias("stored"))
    if not left_columns and not right_columns:
        return base.select("id", F.col("stored").alias("text"))
    rebuilt = F.when(F.col("side") == "left", contextual_content(left_columns, as_given=as_given)) if left_columns else None
    if right_columns:
        test, text = F.col("side") == "right", contextual_content(right_columns, as_given=as_given)
        rebuilt = rebuilt.when(test, text) if rebuilt is not None else F.when(test, text)
    own = rows.select(*by, "side", "original_row", rebuilt.alias("rebuilt"))
    return base.join(own, [*by, "side", "original_row"], "left").select(
        "id", F.coalesce("rebuilt", "stored").alias("text")
    )


def judge_prompts(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """``left_id, n_candidates, right_ids, prompt, max_tokens``, one row per left row.

    A left row has at most the run's candidate limit, so a group is small by construction.
    """
    right = texts.select(F.col("id").alias("right_id"), F.col("text").alias("right_text"))
    left = texts.select(F.col("id").alias("left_id"), F.col("text").alias("left_text"))
    item = F.struct("cand_pos", "right_id", F.coalesce("right_text", F.lit("")).alias("text"))
    grouped = (
        candidates.select("left_id", "right_id", "cand_pos")
        .join(right, "right_id", "left")
        .groupBy("left_id")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
    )
    blocks = F.transform(
        "items",
        lambda x, i: F.concat(F.lit("--- Candidate "), (i + 1).cast("string"), F.lit(" ---\n"), x["text"]),
    )
    prompt = F.concat(
        F.lit("Reference:\n"), F.coalesce("left_text", F.lit("")), F.lit("\n\n"), F.array_join(blocks, "\n\n")
    )
    n = F.size("items")
    return grouped.join(left, "left_id", "left").select(
        "left_id",
        n.alias("n_candidates"),
        F.transform("items", lambda x: x["right_id"]).alias("right_ids"),
        prompt.alias("prompt"),
        completion_budget(n).alias("max_tokens"),
    )


def call_judge(
    prompts: DataFrame, judge: Judge, system: str | None = None, rpm: int = 0, tasks: int | None = None
) -> DataFrame:
    """Adds ``reply`` (null where the call failed), one call per row.

    With a rate limit the rows are spread over a fixed number of tasks and each gets an
    equal share of the limit. Retried tasks repeat their calls, so write the replies before
    using them twice and keep speculation off for this stage.
    """
    message = system_prompt(system)
    tasks = tasks or prompts.sparkSession.sparkContext.defaultParallelism
    share = 0.0
    if rpm > 0:
        tasks = min(tasks, rpm)
        share = rpm / tasks
    spread = prompts.repartition(tasks, "left_id")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        throttle = Throttle(share)
        for batch in batches:
            replies = []
            for prompt, budget in zip(batch["prompt"], batch["max_tokens"]):
                throttle.wait()
                try:
                    replies.append(judge.reply(message, prompt, int(budget)))
                except Exception:  # a failed call leaves its pairs unscored
                    replies.append(None)
            yield batch.assign(reply=pd.Series(replies, index=batch.index, dtype="object"))

    schema = spread.withColumn("reply", F.lit(None).cast("string")).schema
    return spread.mapInPandas(call, schema)


# --- reading replies ---------------------------------------------------------------------

_NUMERIC = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _number(v: Column) -> Column:
    """The value as a number; booleans and text are not numbers."""
    return F.when(_kind(v).isin(*_NUMERIC), F.try_variant_get(v, "$", "double"))


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _meta(v: Column, text_limit: int | None) -> Column:
    """Text, number, boolean and null members other than the score, as text; none = null."""
    members = F.try_variant_get(v, "$", "map<string,variant>")
    kept = F.map_filter(members, lambda k, x: (k != "score") & ~_kind(x).isin("ARRAY", "OBJECT"))

    def text(k: Column, x: Column) -> Column:
        s = F.try_variant_get(x, "$", "string")
        if text_limit is None:
            return s
        cut = F.concat(F.substring(s, 1, text_limit), F.lit("…"))
        return F.when((_kind(x) == "STRING") & (F.length(s) > text_limit), cut).otherwise(s)

    as_text = F.transform_values(kept, text)
    return F.when(F.size(as_text) > 0, as_text)


def _slot(v: Column, text_limit: int | None) -> Column:
    """``score, meta`` of one array element: a number, or an object with a numeric score."""
    inner = _bind(F.try_variant_get(v, "$.score", "variant"), _number)

    def scored(found: Column) -> Column:
        score = F.coalesce(found["plain"], found["inner"])
        meta = F.when(found["inner"].isNotNull(), _meta(v, text_limit))
        return F.when(score.isNotNull(), F.struct(_clamped(score).alias("score"), meta.alias("meta")))

    return _bind(F.struct(_number(v).alias("plain"), inner.alias("inner")), scored)


def without_fence(text: Column | str) -> Column:
    """A reply without surrounding blanks and code fence."""
    raw = strip(F.coalesce(as_column(text), F.lit("")))
    opened = F.regexp_replace(raw, f"(?i)^```(?:json)?{WHITESPACE}*", "")
    closed = F.regexp_replace(opened, f"{WHITESPACE}*```{WHITESPACE}*$", "")
    return strip(F.when(raw.startswith("```"), closed).otherwise(raw))


def parsed_slots(reply: Column | str, n: Column | str, text_limit: int | None = META_TEXT_LIMIT) -> Column:
    """array<struct<score, meta>> with exactly ``n`` entries; texts beside a score are cut at
    ``text_limit`` characters, or not at all.

    Accepted: an array (cut or padded to n), ``{"scores": [...]}``, and for one candidate
    ``{"score": x}``. Anything else leaves every entry null.
    """
    count = as_column(n)

    def read(v: Column) -> Column:
        is_object = _kind(v) == "OBJECT"
        listed = F.when(is_object, F.try_variant_get(v, "$.scores", "array<variant>")).otherwise(
            F.try_variant_get(v, "$", "array<variant>")
        )
        has_scores = F.try_variant_get(v, "$.scores", "variant").isNotNull()
        alone = (count == 1) & is_object & ~has_scores
        entries = F.when(alone, F.array(v)).otherwise(listed)
        return _bind(
            entries,
            lambda e: F.transform(F.sequence(F.lit(1), count), lambda i: _bind(F.try_element_at(e, i), lambda x: _slot(x, text_limit))),
        )

    parsed = F.try_parse_json(without_fence(reply))
    return F.when(count > 0, _bind(parsed, read))


def judge_scores(replies: DataFrame) -> DataFrame:
    """``left_id, right_id, judge_score, judge_meta`` from the answered prompts."""
    slots = replies.select("left_id", "right_ids", parsed_slots("reply", "n_candidates").alias("slots"))
    zipped = slots.select("left_id", F.explode(F.arrays_zip("right_ids", "slots")).alias("z"))
    return zipped.select(
        "left_id",
        F.col("z.right_ids").alias("right_id"),
        F.col("z.slots.score").alias("judge_score"),
        F.col("z.slots.meta").alias("judge_meta"),
    )
