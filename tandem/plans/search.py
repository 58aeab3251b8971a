"""Hybrid search over all queries at once, its stage counts, and retrieval evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.models import Embedder, PairScorer, embed_column, model_tasks, overlap_score, score_column
from tandem.operators import fusion
from tandem.operators.keyword import POOL, KeywordIndex, keyword_baseline, keyword_topk
from tandem.operators.substring import substring_topk
from tandem.operators.topk import topk_cosine
from tandem.operators.vectorindex import VectorIndex
from tandem.session import materialise

# Results returned by default.
K_DEFAULT = 5


@dataclass(frozen=True)
class SearchConfig:
    """``pool`` is the number of candidates each retriever gives and the merge keeps; it is
    never less than ``k``."""

    k: int = K_DEFAULT
    pool: int = POOL
    use_vector: bool = True
    use_keyword: bool = True
    use_rrf: bool = True
    use_rerank: bool = True
    rerank_allowed: bool = True

    def __post_init__(self) -> None:
        if not (self.use_vector or self.use_keyword):
            raise ValueError("at least one of vector and keyword search must be on")
        if self.k < 1 or self.pool < 1:
            raise ValueError("k and pool must be at least 1")

    @property
    def candidates(self) -> int:
        return max(self.k, self.pool)

    @property
    def reranks(self) -> bool:
        return self.use_rerank and self.rerank_allowed


@dataclass(frozen=True)
class SearchStages:
    """Ranked lists after each stage; ``ranked`` holds the pool after the last one."""

    vector: DataFrame | None
    keyword: DataFrame | None
    merged: DataFrame
    ranked: DataFrame
    config: SearchConfig


def vector_list(
    records: DataFrame, queries: DataFrame, pool: int = POOL, index: VectorIndex | None = None, **options
) -> DataFrame:
    """``query_id, id, cosine, rank``: the most similar records of each query vector, from a
    stored index of the records where one is given."""
    asked = queries.select(F.col("query_id").alias("left_id"), F.col("query_vec").alias("left_vec"))
    if index is not None:
        found = index.search(asked, pool, **options)
    else:
        rights = records.select(F.col("id").alias("right_id"), F.col("embedding").alias("right_vec"))
        found = topk_cosine(asked, rights, pool, **options)
    return found.select(
        F.col("left_id").alias("query_id"),
        F.col("right_id").alias("id"),
        F.col("cosine_score").alias("cosine"),
        F.col("cand_pos").alias("rank"),
    )


def _nothing(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", "id", "rank").where(F.lit(False))


def search_stages(
    records: DataFrame,
    queries: DataFrame,
    index: KeywordIndex | None,
    config: SearchConfig,
    *,
    embedder: Embedder | None = None,
    scorer: PairScorer | None = None,
    vector_options: Mapping[str, object] | None = None,
    keyword_list: DataFrame | None = None,
) -> SearchStages:
    """``vector_options`` go to the vector join: ``{"index": ...}`` for a stored index of the
    records, ``{"method": "approximate"}`` for one made on the way. ``keyword_list`` is the result
    of ``keyword_topk`` where it is there already; then no index is needed."""
    if config.use_vector and "query_vec" not in queries.columns:
        if embedder is None:
            raise ValueError("vector search needs query vectors or an embedder")
        queries = queries.withColumn("query_vec", embed_column("query_text", embedder))
    if config.use_keyword and index is None and keyword_list is None:
        raise ValueError("keyword search needs an index")
    # Both lists (at most the candidates per query) feed the merge, the scores and the counts:
    # searched once.
    vector = materialise(vector_list(records, queries, config.candidates, **(vector_options or {})), "vector-list") if config.use_vector else None
    if not config.use_keyword:
        keyword = None
    elif keyword_list is not None:
        keyword = keyword_list.where(F.col("rank") <= config.candidates)
    else:
        keyword = materialise(keyword_topk(index, queries, config.candidates), "keyword-list")
    one = vector if vector is not None else keyword
    merge = fusion.rrf_merge if config.use_rrf else fusion.vector_primary_merge
    merged = merge(vector if vector is not None else _nothing(one), keyword if keyword is not None else _nothing(one))
    pool = fusion.cut(merged, config.candidates).select("query_id", "id", "kw_rank", F.col("rank").alias("merged_rank"))
    if config.use_vector:
        pool = pool.join(vector.select("query_id", "id", "cosine"), ["query_id", "id"], "left")
    else:
        pool = pool.withColumn("cosine", F.lit(None).cast("double"))
    if config.reranks:
        # Texts are attached only to the pool, after the cut.
        texts = records.select("id", F.col("contextual_content").alias("text"))
        asked = queries.select("query_id", F.col("query_text").alias("text"))
        if scorer is None:
            # Used three times, and its size tells that the texts need not travel to it.
            pool = materialise(pool, "pool")
            scored = overlap_score(pool, asked, texts, "query_id", "id", "rerank")
        else:
            pairs = pool.join(texts, "id").join(asked.withColumnRenamed("text", "query_text"), "query_id")
            score = score_column("query_text", "text", scorer)
            scored = model_tasks(pairs, "query_id", "id").withColumn("rerank", score).drop("text", "query_text")
            # A query the model fails on keeps its merged order, and has no rerank scores to show it.
            failed = F.max(F.col("rerank").isNull()).over(Window.partitionBy("query_id"))
            scored = scored.withColumn("__failed", failed).withColumn("rerank", F.when(~F.col("__failed"), F.col("rerank"))).drop("__failed")
        order = Window.partitionBy("query_id").orderBy(F.desc("rerank"), "merged_rank")
        ranked = scored.withColumn("rank", F.row_number().over(order))
    else:
        ranked = pool.withColumns({"rerank": F.lit(None).cast("double"), "rank": F.col("merged_rank")})
    return SearchStages(vector, keyword, merged, ranked, config)


def hybrid_search(
    records: DataFrame,
    queries: DataFrame,
    index: KeywordIndex | None,
    config: SearchConfig = SearchConfig(),
    *,
    display: Sequence[str] = (),
    embedder: Embedder | None = None,
    scorer: PairScorer | None = None,
    vector_options: Mapping[str, object] | None = None,
    keyword_list: DataFrame | None = None,
) -> DataFrame:
    """``query_id, rank, id, score, cosine_score, bm25_rank, rerank_score`` and the display
    columns, which are joined last."""
    stages = search_stages(
        records, queries, index, config, embedder=embedder, scorer=scorer, vector_options=vector_options, keyword_list=keyword_list
    )
    best = stages.ranked.where(F.col("rank") <= config.k).select(
        "query_id",
        "rank",
        "id",
        F.round("rerank", 4).alias("score"),
        F.round("cosine", 4).alias("cosine_score"),
        F.col("kw_rank").alias("bm25_rank"),
        F.round("rerank", 4).alias("rerank_score"),
    )
    return best.join(records.select("id", *display), "id") if display else best


def stage_counts(stages: SearchStages, queries: DataFrame) -> DataFrame:
    """Per query: vector and keyword candidates (null if switched off), merged, returned."""

    def counted(df: DataFrame | None, name: str) -> DataFrame | None:
        return None if df is None else df.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))

    parts = {
        "vector_candidates": counted(stages.vector, "vector_candidates"),
        "keyword_candidates": counted(stages.keyword, "keyword_candidates"),
        "merged": counted(stages.merged, "merged"),
    }
    out = queries.select("query_id")
    for name, part in parts.items():
        if part is None:
            out = out.withColumn(name, F.lit(None).cast("bigint"))
        else:
            out = out.join(part, "query_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("returned", F.least("merged", F.lit(stages.config.k)).cast("bigint"))


def evaluation_contexts(
    records: DataFrame,
    cases: DataFrame,
    index: KeywordIndex | None,
    config: SearchConfig = SearchConfig(),
    *,
    embedder: Embedder | None = None,
    scorer: PairScorer | None = None,
) -> DataFrame:
    """``query_id, question, contexts, ground_truth``: the texts retrieved per question.

    ``cases``: ``query_id, question, ground_truth``. A list holds at most ``k`` texts.
    """
    queries = cases.select("query_id", F.col("question").alias("query_text"))
    best = hybrid_search(
        records, queries, index, config, display=["contextual_content"], embedder=embedder, scorer=scorer
    )
    lists = best.groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "contextual_content"))), lambda x: x["contextual_content"]
        ).alias("contexts")
    )
    empty = F.array().cast("array<string>")
    return cases.join(lists, "query_id", "left").select(
        "query_id", "question", F.coalesce("contexts", empty).alias("contexts"), "ground_truth"
    )


def evaluation_export(
    contexts: DataFrame,
    config: SearchConfig,
    project_name: str,
    embedding_model: str | None,
    embedding_width: int | None,
    embedding_url: str | None = None,
) -> DataFrame:
    """Evaluation rows with the settings that produced them."""
    meta = F.struct(
        F.lit(project_name).alias("project"),
        F.struct(
            F.lit(embedding_url).cast("string").alias("url"),
            F.lit(embedding_model).cast("string").alias("model"),
            F.lit(embedding_width).cast("int").alias("dims"),
        ).alias("embedding"),
        F.struct(
            F.lit(config.use_vector).alias("vector"),
            F.lit(config.use_keyword).alias("keyword"),
            F.lit(config.use_rrf).alias("rrf"),
            F.lit(config.use_rerank).alias("rerank"),
        ).alias("pipeline"),
        F.lit(config.k).alias("k"),
    )
    return contexts.withColumn("meta", meta)


def search(
    mode: str,
    records: DataFrame,
    queries: DataFrame,
    *,
    k: int = K_DEFAULT,
    id_column: str | None = None,
    legacy_method: str = "keyword",
    index: KeywordIndex | None = None,
    config: SearchConfig | None = None,
    display: Sequence[str] = (),
    **models,
) -> DataFrame:
    """One entry for the three search modes: ``id``, ``legacy`` and ``topic``. The display
    columns of the records are joined last."""

    def shown(found: DataFrame) -> DataFrame:
        return found.join(records.select("id", *display), "id").select(*found.columns, *display) if display else found

    if k < 1:
        raise ValueError("k must be at least 1")
    if mode == "id":
        if not id_column:
            raise ValueError("id search needs an id column")
        return shown(substring_topk(records, queries, k, [id_column]))
    if mode == "legacy":
        if legacy_method == "keyword":
            if index is None:
                raise ValueError("keyword search needs an index")
            return shown(keyword_baseline(index, queries, k))
        if legacy_method == "ilike":
            texts = ["contextual_content", *([id_column] if id_column else [])]
            return shown(substring_topk(records, queries, k, texts))
        raise ValueError(f"unknown legacy method: {legacy_method!r}")
    if mode == "topic":
        return hybrid_search(records, queries, index, replace(config or SearchConfig(), k=k), display=display, **models)
    raise ValueError(f"unknown search mode: {mode!r}")


def result_export(results: DataFrame, display: Sequence[str]) -> DataFrame:
    """Display columns only, in result order."""
    return results.orderBy("query_id", "rank").select(*display)
