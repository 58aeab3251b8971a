import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tandem.operators import blockmax, keyword
from tandem.session import scratch_path


def brute(rows, asked, k, every_term):
    """Top-k by plain BM25: rows (by, id, term, tf), asked (by, query, term)."""
    out = []
    for by in {r[0] for r in asked}:
        own = [r for r in rows if r[0] == by]
        length, lists = Counter(), defaultdict(dict)
        for _, i, term, tf in own:
            length[i] += tf
            lists[term][i] = tf
        n, average = len(length), sum(length.values()) / max(1, len(length))
        for query in {r[1] for r in asked if r[0] == by}:
            terms = sorted({r[2] for r in asked if r[:2] == (by, query)})
            scores, hits = Counter(), Counter()
            for term in terms:
                df = len(lists[term])
                for i, tf in lists[term].items():
                    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                    scores[i] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[i] / average))
                    hits[i] += 1
            kept = [(round(s, 9), i) for i, s in scores.items() if not every_term or hits[i] == len(terms)]
            kept.sort(key=lambda x: (-x[0], x[1]))
            out += [(by, query, i, r + 1) for r, (s, i) in enumerate(kept[:k])]
    return sorted(out)


def random_index(seed, records=400):
    rng = random.Random(seed)
    rows = []
    for by in ("a", "b"):
        for i in range(records if by == "a" else 30):
            # "common" stands in nearly all records, the others ever more rarely.
            terms = Counter(["common"] * rng.randrange(0, 5) + [f"t{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(1, 25))])
            rows += [(by, i, t, n) for t, n in terms.items()]
    asked = set()
    for q in range(25):
        asked |= {("a", q, rng.choice(["common", "t1", "t2", "missing", f"t{rng.randrange(40)}"])) for _ in range(rng.randrange(1, 6))}
        asked |= {("b", q, f"t{rng.randrange(1, 6)}") for _ in range(2)}
    return rows, sorted(asked)


@pytest.mark.parametrize("every_term, k", [(False, 3), (True, 3), (False, 500)])
def test_pruned_search_equals_plain_bm25(spark, monkeypatch, every_term, k):
    monkeypatch.setattr(blockmax, "BLOCK", 8)
    monkeypatch.setattr(blockmax, "SEEDS", 2)
    rows, asked = random_index(1)
    postings = spark.createDataFrame(rows, "by string, id long, term string, tf long")
    index = blockmax.BlockIndex.build(postings, ["by"])
    queries = spark.createDataFrame(asked, "by string, query_id long, term string")
    found = blockmax.topk_pruned(index, queries, k, every_term)
    got = sorted((r["by"], r.query_id, r.id, r["rank"]) for r in found.matches.collect())
    assert got == brute(rows, asked, k, every_term)
    reads = found.reads.agg(F.sum("blocks_read"), F.sum("blocks_total"), F.max(F.col("blocks_read") > F.col("blocks_total"))).head()
    assert not reads[2]
    if k == 3:
        assert reads[0] < 0.7 * reads[1]


def test_saved_index_searches_alike_and_skips_folders(spark):
    rows, asked = random_index(2)
    rows, asked = [(r[1], r[2], r[3]) for r in rows if r[0] == "a"], [r[1:] for r in asked if r[0] == "a"]
    index = blockmax.BlockIndex.build(spark.createDataFrame(rows, "id long, term string, tf long"))
    path = scratch_path(spark, "blocks-test")
    index.save(path)
    again = blockmax.BlockIndex.load(spark, path)
    queries = spark.createDataFrame(asked, "query_id long, term string")
    one, two = (sorted(map(tuple, blockmax.topk_pruned(i, queries, 4, False).matches.collect())) for i in (index, again))
    assert one == two and one
    few = spark.createDataFrame([(1, "t1"), (1, "t2")], "query_id long, term string")
    plan = blockmax._of_folders(again.terms, "term", few)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [term_folder" in plan or "PartitionFilters: [isnotnull(term_folder" in plan


def test_bounds_hold_for_every_block(spark, monkeypatch):
    monkeypatch.setattr(blockmax, "BLOCK", 16)
    rows, _ = random_index(3, 300)
    index = blockmax.BlockIndex.build(spark.createDataFrame([r[1:] for r in rows if r[0] == "a"], "id long, term string, tf long"))
    blocks = index.blocks.collect()
    assert all(b.n == len(b.entries) and b.bound == max(e.impact for e in b.entries) for b in blocks)
    assert sum(b.n for b in blocks) == sum(r[0] == "a" for r in rows)
    assert max(b.n for b in blocks) < 64


def test_empty_tables_and_ties(spark):
    none = spark.createDataFrame([], "id long, term string, tf long")
    asked = spark.createDataFrame([(1, "x")], "query_id long, term string")
    assert blockmax.topk_pruned(blockmax.BlockIndex.build(none), asked, 3, True).matches.count() == 0
    same = spark.createDataFrame([(i, "x", 1) for i in range(300)], "id long, term string, tf long")
    found = blockmax.topk_pruned(blockmax.BlockIndex.build(same), asked, 3, False)
    assert [r.id for r in found.matches.orderBy("rank").collect()] == [0, 1, 2]
    assert blockmax.topk_pruned(blockmax.BlockIndex.build(same), asked.limit(0), 3, False).reads.count() == 0


def test_keyword_search_both_ways(spark):
    texts = [(i, f"red wagon {i % 7} " + "blue " * (i % 3)) for i in range(60)]
    records = spark.createDataFrame(texts, "id long, contextual_content string")
    index = keyword.KeywordIndex.build(records, analyzer="simple").written()
    queries = spark.createDataFrame([(1, "red blue"), (2, "wagon 3"), (3, "nothing"), (4, "")], "query_id long, query_text string")
    plain = keyword.keyword_topk(index, queries, 5).select("query_id", "id", "score", "rank")
    pruned = keyword.keyword_topk_pruned(keyword.block_index(index), queries, "simple", 5).matches
    assert sorted(map(tuple, pruned.collect())) == sorted(map(tuple, plain.collect()))


def test_index_for_asked_terms_only(spark):
    rows, asked = random_index(4)
    postings = spark.createDataFrame(rows, "by string, id long, term string, tf long")
    queries = spark.createDataFrame(asked, "by string, query_id long, term string")
    index = blockmax.BlockIndex.build(postings, ["by"], queries)
    found = blockmax.topk_pruned(index, queries, 3, False).matches
    assert sorted((r["by"], r.query_id, r.id, r["rank"]) for r in found.collect()) == brute(rows, asked, 3, False)
    wanted = {(r[0], r[2]) for r in asked}
    held = index.records.agg(F.sum(F.size("term_nos"))).head()[0]
    assert held == sum((r[0], r[2]) in wanted for r in rows) < len(rows)


def test_texts_travel_once(spark):
    lefts = spark.createDataFrame([(1, "red")], "left_id long, text string")
    rights = spark.createDataFrame([(i, f"red wagon {i}") for i in range(20)], "right_id long, text string")
    assert [r.right_id for r in keyword.any_term_topk(lefts, rights, 2).orderBy("rank").collect()] == [0, 1]
