import sys
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark import cloudpickle
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tandem import models
from tandem.functions.text import english_stem
from tandem.functions.vectors import cosine, unit
from tandem.models import HashedTermEmbedder, embed_column
from tandem.operators import codedtopk, fusion, keyword, substring, topk
from tandem.plans import search

# The stand-in models below travel to the workers with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

# Published sample vocabulary of the stemmer.
STEMS = """caresses caress ponies poni ties tie cats cat gaps gap gas gas this this feed feed agreed agre plastered plaster
bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing
hiss fizzed fizz failing fail filing file happy happi sky sky by by say say relational relat conditional condit rational
ration digitizer digit operator oper feudalism feudal hopefulness hope formaliti formal sensibiliti sensibl triplicate
triplic formative format electrical electr goodness good revival reviv allowance allow inference infer adjustable adjust
irritant irrit replacement replac adoption adopt communism communism effective effect bowdlerize bowdler probate probat rate
rate cease ceas controll control roll roll consistency consist consigned consign knackeries knackeri generously generous
generation generat skies sky dying die proceed proceed herring herring""".split()


def test_stemmer(spark):
    pairs = [p for p in zip(STEMS[::2], STEMS[1::2]) if p[0] != "communism"]
    got = spark.createDataFrame(pairs, "w string, s string").select("w", "s", english_stem("w").alias("got")).collect()
    assert [(r.w, r.got) for r in got] == pairs


def brute_topk(left, right, k):
    l, r = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (left, right))
    scores = np.round(l @ r.T, 9)
    return {(i, int(j), n + 1) for i in range(len(l)) for n, j in enumerate(np.lexsort((np.arange(len(r)), -scores[i]))[:k])}


def as_frame(spark, matrix, prefix):
    rows = [(i, v.tolist()) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{prefix}_id long, {prefix}_vec array<double>")


@pytest.mark.parametrize("method,block_rows", [("blocks", 4096), ("blocks", 16), ("cells", 16), ("cells", 5)])
def test_topk_equals_brute_force_with_a_hot_group_of_copies(spark, method, block_rows):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((4, 8))
    right = np.vstack([centres[rng.integers(0, 4, 60)] + 0.1 * rng.standard_normal((60, 8)), np.tile(centres[0], (40, 1))])
    left = rng.standard_normal((30, 8))
    found = topk.topk_cosine(as_frame(spark, left, "left"), as_frame(spark, right, "right"), 7, method=method, block_rows=block_rows)
    assert {(r.left_id, r.right_id, r.cand_pos) for r in found.collect()} == brute_topk(left, right, 7)


def test_topk_edges(spark):
    rng = np.random.default_rng(4)
    left, right = rng.standard_normal((5, 3)), rng.standard_normal((2, 3))
    for method in ("blocks", "cells"):
        found = topk.topk_cosine(as_frame(spark, left, "left"), as_frame(spark, right, "right"), 4, method=method)
        assert {(r.left_id, r.right_id, r.cand_pos) for r in found.collect()} == brute_topk(left, right, 4)
    nothing = as_frame(spark, right, "right").limit(0)
    assert topk.topk_cosine(as_frame(spark, left, "left"), nothing, 4).count() == 0
    with pytest.raises(ValueError):
        topk.topk_cosine(as_frame(spark, left, "left"), nothing, 0)


def test_topk_within_groups(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((40, 4))
    group = np.array([0] * 30 + [1] * 10)
    frame = as_frame(spark, vectors, "left").withColumn("g", F.when(F.col("left_id") < 30, 0).otherwise(1))
    right = frame.toDF("right_id", "right_vec", "g")
    got = {(r.left_id, r.right_id, r.cand_pos) for r in topk.topk_cosine(frame, right, 3, by=["g"], block_rows=8).collect()}
    want = set()
    for g in (0, 1):
        ids = np.flatnonzero(group == g)
        want |= {(int(ids[a]), int(ids[b]), n) for a, b, n in brute_topk(vectors[ids], vectors[ids], 3)}
    assert got == want


def test_approximate_topk_finds_most(spark):
    rng = np.random.default_rng(6)
    right = rng.standard_normal((300, 6))
    left = right[:50] + 0.05 * rng.standard_normal((50, 6))
    l, r = as_frame(spark, left, "left"), as_frame(spark, right, "right")
    report = topk.recall(topk.topk_cosine(l, r, 5, method="approximate", bits=4), topk.topk_cosine(l, r, 5)).head()
    assert report.exact_pairs == 250 and report.recall > 0.8


def test_unit_and_cosine(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>").select(
        unit("a").alias("u"), unit("z").alias("z"), cosine("a", "a").alias("c"), cosine("a", "z").alias("n")).head()
    assert row.u == [0.6, 0.8] and row.z == [0.0, 0.0] and abs(row.c - 1) < 1e-12 and row.n is None


def ranked(spark, lists, schema="query_id long, id long, rank int"):
    return spark.createDataFrame([(q, i, n + 1) for q, ids in lists.items() for n, i in enumerate(ids)], schema)


def order_of(df):
    return [r.id for r in df.where("query_id = 1").orderBy("rank").collect()]


def reference_rrf(v, w):
    score = {}
    for ids in (v, w):
        for n, i in enumerate(ids):
            score[i] = score.get(i, 0) + 1 / (60 + n + 1)
    return sorted(score, key=lambda i: score[i], reverse=True)


def test_rrf_ties_keep_first_appearance(spark):
    v, w = ranked(spark, {1: [10, 20, 30]}), ranked(spark, {1: [20, 10, 40]})
    assert order_of(fusion.rrf_merge(v, w)) == [10, 20, 30, 40]
    assert order_of(fusion.vector_primary_merge(v, w)) == [10, 20, 30, 40]
    empty = ranked(spark, {2: [1]})
    assert order_of(fusion.vector_primary_merge(empty, w)) == [20, 10, 40]
    assert order_of(fusion.rrf_merge(v, empty)) == [10, 20, 30]


ids = st.lists(st.integers(0, 12), unique=True, min_size=1, max_size=8)


@FEW
@given(v=ids, w=ids)
def test_rrf_equals_its_definition(spark, v, w):
    merged = fusion.rrf_merge(ranked(spark, {1: v}), ranked(spark, {1: w}))
    assert order_of(merged) == reference_rrf(v, w)


TEXTS = ["the red ring", "a blue ring of rings", "red red gear", "of the", "Ring-red_ring 7"]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, f"id{i}", t) for i, t in enumerate(TEXTS)], "id long, code string, contextual_content string")


def queries_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query_text string")


def test_and_match_and_stop_words(spark, corpus):
    index = keyword.KeywordIndex.build(corpus, id_text="code", analyzer="english")
    asked = queries_of(spark, "red rings", "the of", "", "unknown red", "id3", "ID2 gears")
    got = {(r.query_id, r.id) for r in keyword.and_match(index, asked).collect()}
    assert got == {(0, 0), (0, 4), (4, 3), (5, 2)}


def test_bm25_equals_its_definition(spark, corpus):
    index = keyword.KeywordIndex.build(corpus, analyzer="simple")
    found = keyword.keyword_topk(index, queries_of(spark, "red ring")).collect()
    docs = [re.findall(r"[a-z0-9]+", t.lower()) for t in TEXTS]
    mean = sum(map(len, docs)) / len(docs)

    def score(d):
        total = 0.0
        for term in ("red", "ring"):
            df = sum(term in x for x in docs)
            tf = d.count(term)
            total += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        return total

    want = {i: score(d) for i, d in enumerate(docs) if {"red", "ring"} <= set(d)}
    assert {r.id: round(r.score, 6) for r in found} == {i: round(s, 6) for i, s in want.items()}
    assert [r.id for r in sorted(found, key=lambda r: r["rank"])] == sorted(want, key=lambda i: -want[i])


def test_index_survives_storage(spark, corpus, tmp_path):
    index = keyword.KeywordIndex.build(corpus, analyzer="simple")
    index.save(str(tmp_path / "ix"))
    loaded = keyword.KeywordIndex.load(spark, str(tmp_path / "ix"), "simple")
    columns = ["id", "term", "tf"]
    stored, built = (sorted(map(tuple, x.postings.select(*columns).collect())) for x in (loaded, index))
    assert stored == built
    terms = keyword.query_terms(queries_of(spark, "red ring"), "simple")
    asked = keyword.asked_postings(loaded.postings, terms)
    assert sorted(map(tuple, asked.select(*columns).collect())) == [r for r in built if r[1] in ("red", "ring")]
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [{keyword.BUCKET}" in plan or f"{keyword.BUCKET}#" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("text", ["RING", "r_ng", "e%r", "", "%", "_", "ue ring of", "red_ring", "7", "zz", "g-r", "d\\_r"])
def test_batched_substring_search_equals_the_predicate(spark, corpus, text):
    batched = substring.substring_topk(corpus, queries_of(spark, text), 3, ["contextual_content", "code"])
    single = substring.substring_search(corpus, text, 3, ["contextual_content", "code"])
    assert [r.id for r in batched.orderBy("rank").collect()] == [r.id for r in single.collect()]


def test_search_modes(spark, corpus):
    asked = queries_of(spark, "id1")
    assert [r.id for r in search.search("id", corpus, asked, id_column="code").collect()] == [1]
    with pytest.raises(ValueError, match="id column"):
        search.search("id", corpus, asked)
    with pytest.raises(ValueError):
        search.search("legacy", corpus, asked, legacy_method="other")
    with pytest.raises(ValueError):
        search.search("other", corpus, asked)
    with pytest.raises(ValueError):
        search.SearchConfig(use_vector=False, use_keyword=False)
    assert search.SearchConfig(k=80).candidates == 80
    assert not search.SearchConfig(rerank_allowed=False).reranks


class FirstLetter:
    def score(self, queries, texts):
        return [None if t.startswith("a") else float(len(t)) for t in texts]


def test_hybrid_with_a_model_scorer(spark, corpus):
    embedder = HashedTermEmbedder(64)
    embedded = corpus.withColumn("embedding", embed_column("contextual_content", embedder))
    index = keyword.KeywordIndex.build(corpus, analyzer="simple")
    found = search.hybrid_search(
        embedded, queries_of(spark, "red ring"), index, search.SearchConfig(k=5), embedder=embedder, scorer=FirstLetter(), display=["code"])
    rows = found.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
    assert [r.rerank_score for r in rows] == [15.0, 12.0, 12.0, 6.0, 0.0]
    assert rows[-1].code == "id1"


def test_embedder_is_called_once_per_row(spark, corpus):
    df = corpus.withColumn("v", embed_column("contextual_content", HashedTermEmbedder(8))).where(F.size("v") > 0)
    plan = df.select(unit("v"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_a_query_the_reranker_fails_on_keeps_its_merged_order(spark):
    class Failing:
        def score(self, queries, texts):
            if "bad query" in queries:
                raise ConnectionError
            return [float(len(t)) for t in texts]

    records = spark.createDataFrame([(1, "query bad"), (2, "query bad bad long"), (3, "query good text")], "id long, contextual_content string")
    queries = spark.createDataFrame([(1, "bad query"), (2, "query")], "query_id long, query_text string")
    index = keyword.KeywordIndex.build(records, analyzer="simple")
    config = search.SearchConfig(k=3, use_vector=False, use_rerank=True)
    found = search.hybrid_search(records, queries, index, config, scorer=Failing()).collect()
    by_query = {q: [(r.id, r.rerank_score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in (1, 2)}
    assert by_query[2] == [(2, 18.0), (3, 15.0), (1, 9.0)]
    merged = keyword.keyword_topk(index, queries, 3).where("query_id = 1").orderBy("rank").collect()
    assert by_query[1] == [(r.id, None) for r in merged]


@pytest.mark.parametrize("method", ["blocks", "cells", "coded"])
def test_rows_travel_a_bounded_number_of_times(spark, monkeypatch, method):
    rng = np.random.default_rng(8)
    rows = rng.standard_normal((600, 8))
    copies = []
    where = codedtopk if method == "coded" else topk
    plain = where.block_tasks
    monkeypatch.setattr(where, "block_tasks", lambda side, *rest: copies.append(side.count() / 600) or plain(side, *rest))
    left, right = as_frame(spark, rows, "left"), as_frame(spark, rows, "right")
    found = topk.topk_cosine(left, right, 3, method=method, block_rows=10)
    assert len(copies) == 2 and max(copies) <= 8
    unit_rows = rows / np.linalg.norm(rows, axis=1)[:, None]
    best = np.argsort(-np.round(unit_rows @ unit_rows.T, 9), axis=1, kind="stable")[:, :3]
    assert {(r.left_id, r.cand_pos, r.right_id) for r in found.collect()} == {
        (i, j + 1, int(b)) for i, row in enumerate(best) for j, b in enumerate(row)}


def test_posting_lists_are_never_broadcast(spark):
    docs = spark.createDataFrame([(1, "red blue"), (2, "red")], "id long, contextual_content string")
    asked = spark.createDataFrame([(7, "red blue")], "query_id long, query_text string")
    index = keyword.KeywordIndex.build(docs, analyzer="simple").written()
    hits = keyword._matched_postings(index.postings, keyword.query_terms(asked, "simple"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    # Candidates, the terms of their query, and the postings of both.
    assert plan.count("SortMergeJoin") >= 3
    assert [(r.query_id, r.id) for r in keyword.and_match(index, asked).collect()] == [(7, 1)]


@pytest.mark.parametrize("analyzer", ["simple", "english_unstemmed", "english"])
def test_an_index_for_queries_holds_their_words_alone_and_finds_the_same(spark, analyzer):
    texts = ["The red boats and nets", "a red, red net", "", "boats boating in the harbour", "RED boats", "nothing asked"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, contextual_content string")
    asked = queries_of(spark, "red boats", "the net", "absent", "boats")
    whole = keyword.KeywordIndex.build(docs, analyzer=analyzer)
    own = keyword.KeywordIndex.for_queries(docs, asked, analyzer=analyzer)
    assert set(own.lengths.collect()) == set(whole.lengths.collect())
    wanted = {r.term for r in keyword.query_terms(asked, analyzer).collect()}
    assert set(own.postings.collect()) == {r for r in whole.postings.select("id", "term", "tf").collect() if r.term in wanted}
    assert set(keyword.keyword_topk(own, asked).collect()) == set(keyword.keyword_topk(whole, asked).collect())


def test_a_given_keyword_list_is_not_searched_again(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red boat"), (2, "red net"), (3, "boat")], "id long, contextual_content string")
    asked = queries_of(spark, "red", "boat")
    index, config = keyword.KeywordIndex.build(docs, analyzer="simple"), search.SearchConfig(k=2, use_vector=False)
    expected = search.hybrid_search(docs, asked, index, config).collect()
    words = keyword.keyword_topk(index, asked)
    monkeypatch.setattr(search, "keyword_topk", lambda *_: pytest.fail("searched again"))
    assert set(search.hybrid_search(docs, asked, None, config, keyword_list=words).collect()) == set(expected)


def test_right_rows_stay_where_they_are_for_few_left_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = rng.standard_normal((700, 8))
    rows[100:300] = rows[5]
    monkeypatch.setattr(topk, "block_tasks", lambda *_: pytest.fail("right rows travel"))
    left, right = as_frame(spark, rows[:12], "left"), as_frame(spark, rows, "right").repartition(3)
    unknown = spark.createDataFrame([(900, None), (901, [])], right.schema)
    found = topk.topk_cosine(left, right.unionByName(unknown), 4, block_rows=40)
    unit_rows = rows / np.linalg.norm(rows, axis=1)[:, None]
    best = np.argsort(-np.round(unit_rows[:12] @ unit_rows.T, 9), axis=1, kind="stable")[:, :4]
    assert {(r.left_id, r.cand_pos, r.right_id) for r in found.collect()} == {
        (i, j + 1, int(b)) for i, row in enumerate(best) for j, b in enumerate(row)}


def test_hashed_terms_equal_their_definition_and_are_hashed_once(monkeypatch):
    texts = ["", " .. ", None, "a_b a", "éÉ½²Ⅷ ٣x", "́a", "中文 字", "𝒳 a", "\x00a\x00", "b\x85g\x1cq", "a b c a " * 9]
    monkeypatch.setattr(models, "CHUNK_CHARS", 12)
    embedder = HashedTermEmbedder(16)
    expected, known = np.zeros((len(texts), 16)), set()
    for i, text in enumerate(texts):
        for term in re.findall(r"[^\W_]+", text or ""):
            expected[i, int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % 16] += 1
            known.add(term)
    lengths = np.linalg.norm(expected, axis=1, keepdims=True)
    assert (embedder.embed(texts) == np.divide(expected, lengths, out=expected, where=lengths > 0)).all()
    assert set(embedder.hashes) == known
    assert embedder.embed([]).shape == (0, 16)


def test_an_embedder_with_more_settings_travels_without_what_it_remembers():
    class Prefixed(HashedTermEmbedder):
        def __init__(self, prefix, width):
            super().__init__(width)
            self.prefix = prefix

    embedder = Prefixed("x", 8)
    here = embedder.embed(["red boat"])
    copy = cloudpickle.loads(cloudpickle.dumps(embedder))
    assert (copy.prefix, copy.width, len(copy.hashes), copy.letters) == ("x", 8, 0, None)
    assert (copy.embed(["red boat"]) == here).all()
