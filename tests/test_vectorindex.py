import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import matching, topk
from tandem.operators.vectorindex import Quantiser, VectorIndex, lloyd
from tandem.session import scratch_path


def grouped(n, width=32, seed=1):
    """Vectors around a few directions, a third of them one and the same."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((24, width))
    points = centres[rng.integers(0, 24, n)] + 0.4 * rng.standard_normal((n, width))
    points[: n // 3] = points[0]
    return points


def frame(spark, points, first=0):
    rows = [(first + i, p.tolist()) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id long, embedding array<double>")


@pytest.fixture(scope="module")
def built(spark):
    points = grouped(1500)
    vectors = frame(spark, points).unionByName(
        spark.createDataFrame([(9000, None), (9001, [])], "id long, embedding array<double>"))
    index = VectorIndex.build(vectors, scratch_path(spark, "index-test"), k=10, cell_rows=50)
    return points, vectors, index


def by_query(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.left_id, []).append((r.cand_pos, r.right_id, r.cosine_score))
    return {q: sorted(v) for q, v in out.items()}


def test_default_settings_find_nine_tenths_per_query(spark, built):
    points, vectors, index = built
    assert 1 <= index.probes < len(index.quantiser.centroids) / 2
    enough = []
    asked = vectors.where("id % 11 = 0").select(F.col("id").alias("left_id"), F.col("embedding").alias("left_vec"))
    exact = by_query(topk.topk_cosine(asked, vectors.select(F.col("id").alias("right_id"), F.col("embedding").alias("right_vec")), 10))
    found = by_query(index.search(asked, 10))
    for query, best in exact.items():
        # Of equal vectors any may be found: scores are what counts.
        worst = best[-1][2]
        enough.append(sum(s >= worst - 1e-9 for _, _, s in found[query]) >= 9)
        assert [p for p, *_ in found[query]] == list(range(1, len(found[query]) + 1))
    assert sum(enough) >= 0.99 * len(enough)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    for query, best in found.items():
        for _, right, score in best:
            assert score == pytest.approx(float(unit[query] @ unit[right]), abs=1e-8)


def test_every_row_is_filed_and_only_visited_folders_are_read(spark, built):
    _, vectors, index = built
    assert index.rows.count() == 1500
    widths = index.rows.select(F.length("code").alias("n")).distinct().collect()
    assert [r.n for r in widths] == [8]
    cells = [r[0] for r in index.rows.select("cell").distinct().limit(2).collect()]
    plan = index.rows.where(F.col("cell").isin(cells)).select("id", "code")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "vec" not in plan.split("ReadSchema")[1]


def test_rows_can_be_added(spark, built):
    points, vectors, _ = built
    index = VectorIndex.build(vectors.where("id < 1000"), scratch_path(spark, "index-test"), k=5, cell_rows=100, tuning_rows=40)
    index = index.add(vectors.where("id >= 1000"))
    assert index.rows.count() == 1500
    asked = vectors.where("id in (1200, 1400)").select(F.col("id").alias("left_id"), F.col("embedding").alias("left_vec"))
    assert {q: best[0][1] for q, best in by_query(index.search(asked, 5)).items()} == {1200: 1200, 1400: 1400}


def test_small_and_empty_tables(spark):
    empty = VectorIndex.build(frame(spark, []), scratch_path(spark, "index-test"))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "left_id long, left_vec array<double>")
    assert empty.search(asked, 3).count() == 0
    with pytest.raises(ValueError):
        empty.add(frame(spark, [np.ones(2)]))
    few = VectorIndex.build(frame(spark, [np.array([1.0, 0.0]), np.array([0.0, 1.0]), np.array([1.0, 1.0])]), scratch_path(spark, "index-test"))
    assert [r[1] for r in by_query(few.search(asked, 3))[1]] == [0, 2, 1]


def test_runs_take_a_stored_index(spark, built):
    _, vectors, index = built
    left = vectors.where("id < 40")
    found = matching.vector_candidates(left, vectors, 3, index=index)
    assert set(found.columns) == {"left_id", "right_id", "cosine_score", "cand_pos"} and found.count() == 120
    with pytest.raises(ValueError):
        matching.vector_candidates(left, vectors, 3, by=["job"], index=index)


def test_codes_keep_vectors_apart():
    points = grouped(800)
    quantiser = Quantiser.fit(points, 16)
    cell, codes = quantiser.encode(points)
    error = np.linalg.norm(points - quantiser.decode(cell, codes), axis=1)
    assert error.mean() < 0.5 * np.linalg.norm(points - quantiser.centroids[cell], axis=1).mean()
    assert len(lloyd(np.ones((50, 3)), 8, 3)) == 1


def test_full_vectors_where_codes_tell_too_little(spark, tmp_path, monkeypatch):
    """Rows without any structure: the best by code miss neighbours, however many queries there are."""
    from tandem.operators import vectorindex

    monkeypatch.setattr(vectorindex, "MOST_REFINED", 2)
    monkeypatch.setattr(vectorindex, "WORDS", 2)
    rows = np.random.default_rng(11).standard_normal((900, 32))
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, embedding array<double>")
    index = VectorIndex.build(data, str(tmp_path / "index"), k=10, cell_rows=64)
    asked = data.where("id % 100 = 0").selectExpr("id as left_id", "embedding as left_vec")
    found = index.search(asked, 10).groupBy("left_id").agg({"right_id": "collect_set"}).collect()
    unit_rows = rows / np.linalg.norm(rows, axis=1)[:, None]
    for r in found:
        best = np.argsort(-(unit_rows[r[0]] @ unit_rows.T))[:10]
        assert len(set(r[1]) & set(best.tolist())) >= 9
    assert len(found) == 9
