import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.functions.vectors import unit
from tandem.operators import codedtopk, topk


def sides(spark, left, right):
    l = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(left)], "left_id long, left_vec array<double>")
    r = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(right)], "right_id long, right_vec array<double>")
    return l, r


def rows(df):
    return sorted((r.left_id, r.cand_pos, r.right_id, round(r.cosine_score, 9)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 500])
def test_equals_the_plain_join(spark, k):
    rng = np.random.default_rng(3)
    right = rng.standard_normal((400, 24))
    right[:150] = right[0]  # copies beyond k
    right[150:200] = right[150] + 1e-4 * rng.standard_normal((50, 24))  # closer than the codes can tell
    right[200] = 0.0
    left = np.vstack([right[[0, 150, 250]], rng.standard_normal((60, 24)), np.zeros((1, 24))])
    l, r = sides(spark, left, right)
    assert rows(topk.topk_cosine(l, r, k, method="coded", block_rows=90)) == rows(topk.topk_cosine(l, r, k, method="blocks"))


def test_few_pairs_survive_and_rows_are_small(spark):
    rng = np.random.default_rng(4)
    l, r = sides(spark, rng.standard_normal((80, 64)), rng.standard_normal((1000, 64)))
    lefts, rights = (x.select(f"{s}_id", unit(f"{s}_vec").alias(f"{s}_vec")) for x, s in ((l, "left"), (r, "right")))
    codes = codedtopk.coded(lefts, "left_id", "left_vec"), codedtopk.coded(rights, "right_id", "right_vec")
    pairs = codedtopk.surviving_pairs(*codes, 1, 4, 10, 80_000).count()
    assert 800 <= pairs < 4 * 800
    # What a row brings to the blocks, against its vector: under a quarter.
    assert codes[1].select(F.max(F.length("code") + 4 + 4 + 16)).head()[0] < 64 * 8 / 4
    for r_ in codes[1].limit(20).collect():
        assert r_.error < 0.02


def test_empty_sides(spark):
    l, r = sides(spark, np.ones((2, 3)), np.ones((2, 3)))
    for a, b in ((l.limit(0), r), (l, r.limit(0))):
        assert topk.topk_cosine(a, b, 3, method="coded").count() == 0
