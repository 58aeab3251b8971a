import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tandem.operators import clustering
from tandem.operators import dbscan as dbscan_module
from tandem.operators.components import connected_components
from tandem.operators.dbscan import dbscan
from tandem.plans.cluster import cluster_records


def brute_dbscan(vectors, eps, min_samples):
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = np.sqrt(np.maximum(0, 2 - 2 * u @ u.T)) <= eps
    core = near.sum(axis=1) >= min_samples
    label, number = np.full(len(u), -1), 0
    for start in range(len(u)):
        if label[start] != -1 or not core[start]:
            continue
        stack = [start]
        while stack:
            p = stack.pop()
            if label[p] == -1:
                label[p] = number
                if core[p]:
                    stack += np.flatnonzero(near[p] & (label == -1)).tolist()
        number += 1
    return label.tolist()


def frame(spark, vectors):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>")


def labels_of(df):
    return [r.cluster_id for r in df.orderBy("id").collect()]


def blobs(seed):
    """Three blobs, a chain between two of them, noise, and a third of the rows in one
    group of copies and near copies."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((3, 6))
    parts = [c + 0.08 * rng.standard_normal((15, 6)) for c in centres]
    chain = np.array([centres[0] + t * (centres[1] - centres[0]) for t in np.linspace(0, 1, 12)])
    copies = np.tile(centres[2], (25, 1))
    copies[::2] += 1e-3 * rng.standard_normal((13, 6))
    vectors = np.vstack([*parts, chain, copies, rng.standard_normal((10, 6))])
    return vectors[rng.permutation(len(vectors))]


@pytest.mark.parametrize("seed,eps,min_samples,block_rows", [(1, 0.3, 5, 4096), (2, 0.3, 5, 12), (3, 0.15, 3, 20), (4, 1.2, 5, 10)])
def test_dbscan_equals_brute_force(spark, seed, eps, min_samples, block_rows):
    vectors = blobs(seed)
    got = labels_of(dbscan(frame(spark, vectors), eps=eps, min_samples=min_samples, block_rows=block_rows))
    assert got == brute_dbscan(vectors, eps, min_samples)


def test_dbscan_small_inputs(spark):
    one = frame(spark, np.array([[1.0, 0.0]]))
    assert labels_of(dbscan(one)) == [-1]
    assert labels_of(dbscan(one, min_samples=1)) == [0]
    assert dbscan(one.limit(0)).count() == 0
    five = frame(spark, np.tile([[0.0, 2.0]], (5, 1)))
    assert labels_of(dbscan(five)) == [0] * 5
    with pytest.raises(ValueError):
        dbscan(one, eps=0)


def test_components_of_a_long_chain_a_hub_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(100, 160)]
    edges += [(500, i) for i in range(501, 700)]
    edges += [(900 + i, 900 + (i + 1) % 7) for i in range(7)] + [(5, 5)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 700)} | {900 + i: 900 for i in range(7)}
    assert got == want


def test_hubs_and_chains_settle(spark):
    edges = [(50, i) for i in range(51, 120)] + [(200, i) for i in range(60, 100)] + [(300, 301)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 50 for i in [*range(50, 120), 200]} | {300: 300, 301: 300}


@pytest.mark.parametrize("eps, expected", [(0.3, {10: 0, 20: 1, 30: -1}), (1.0, {10: 0, 20: 0, 30: 0})])
def test_zero_vectors_are_one_point(spark, eps, expected):
    rows = [(10 + i, [0.0, 0.0]) for i in range(6)] + [(20 + i, [1.0, 0.0]) for i in range(5)] + [(30, [0.0, 1.0])]
    got = {r.id: r.cluster_id for r in dbscan(spark.createDataFrame(rows, "id long, embedding array<double>"), eps=eps).collect()}
    assert {i: got[i] for i in expected} == expected
    assert len({got[i] for i in range(10, 16)}) == 1 and len({got[i] for i in range(20, 25)}) == 1


def test_kmeans_bounds_and_groups(spark):
    data = frame(spark, blobs(5))
    labels = clustering.kmeans(data, 4)
    assert {r.cluster_id for r in labels.collect()} == {0, 1, 2, 3}
    assert labels_of(labels) == labels_of(clustering.kmeans(data, 4))
    for k, n in ((1, 10), (51, 100), (10, 10), (2, 1), (None, 10)):
        with pytest.raises(ValueError):
            clustering.check_k(k, n)
    assert clustering.check_k(9, 10) == 9
    with pytest.raises(ValueError):
        cluster_records(data, "other")


def test_plane(spark):
    wide = clustering.scale_axes(clustering.project_to_plane(frame(spark, blobs(6)))).collect()
    xs, ys = [r.x for r in wide], [r.y for r in wide]
    for axis in (xs, ys):
        assert min(axis) == pytest.approx(-1) and max(axis) == pytest.approx(1)
    narrow = clustering.scale_axes(clustering.project_to_plane(frame(spark, np.array([[1.0], [-2.0], [3.0]])))).orderBy("id").collect()
    assert [(r.x, r.y) for r in narrow] == [(1.0, 0.0), (-1.0, 0.0), (1.0, 0.0)]


def test_summaries(spark):
    labels = spark.createDataFrame([(1, 0), (2, -1), (3, 1), (4, 0)], "id long, cluster_id int")
    summary = [tuple(r) for r in clustering.group_summary(labels).collect()]
    assert summary == [(0, "Cluster 1", 2), (1, "Cluster 2", 1), (-1, "Unassigned", 1)]
    assert tuple(clustering.cluster_statistics(labels, "dbscan").head()) == (4, 2, False, False)
    noise = labels.withColumn("cluster_id", F.lit(-1))
    assert tuple(clustering.cluster_statistics(noise, "dbscan").head()) == (4, 0, True, False)
    assert tuple(clustering.cluster_statistics(noise, "kmeans").head()) == (4, 0, False, False)
    records = spark.createDataFrame([(i, f"n{i}") for i in range(1, 5)], "id long, name string")
    assert [r.name for r in clustering.cluster_export(labels, records, ["name"]).collect()] == ["n1", "n4", "n3", "n2"]


def test_points_travel_a_bounded_number_of_times(spark, monkeypatch):
    import importlib

    module = importlib.import_module("tandem.operators.dbscan")
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((500, 6))
    copies, plain = [], module.block_tasks
    monkeypatch.setattr(module, "block_tasks", lambda side, *rest: copies.append(side.count() / 500) or plain(side, *rest))
    labels_of(dbscan(frame(spark, vectors), eps=0.9, min_samples=4, block_rows=8))
    assert len(copies) == 4 and max(copies) <= 8


def wide_meeting(seed=3, n=3000):
    """One wide group of core points, and a border point beside it, as a task meets them."""
    rng = np.random.default_rng(seed)
    u = rng.standard_normal((n, 8)) + 1.0
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    points = pd.DataFrame({"id": np.arange(n), "vec": list(u), "weight": 1, "core": np.arange(n) % 100 != 0, "cell": 0, "angle": 0.5})

    class Meeting:
        def applyInPandas(self, found, _):  # noqa: N802
            self.found = found(points, points)
            return self

        def groupBy(self, *_):  # noqa: N802
            return self

        def agg(self, *_):
            return self

    return u, points, Meeting()


def tiles(lefts, rights):
    for start in range(0, len(lefts), 500):
        for at in range(0, len(rights), 300):
            yield np.arange(start, start + 500), np.arange(at, min(at + 300, len(rights)))


def test_settled_rows_are_not_compared_again(spark, monkeypatch):
    u, points, meeting = wide_meeting()
    near = np.sqrt(np.maximum(0, 2 - 2 * u @ u.T)) <= 1.0
    compared = []
    hits = dbscan_module._hits

    def counting(lefts, rights, eps):
        compared.append(len(lefts) * len(rights))
        return hits(lefts, rights, eps)

    monkeypatch.setattr(dbscan_module, "_hits", counting)
    links = dbscan_module._links(meeting, 1.0, tiles).found
    assert sum(compared) < len(points) ** 2 / 3
    core = points["core"].to_numpy()
    border = links[links["border"]]
    assert set(zip(border["u"], border["v"])) == {(a, b) for a, b in zip(*np.nonzero(near)) if not core[a] and core[b]}
    joined = links[~links["border"]]
    label = dbscan_module._merge(np.arange(len(u)), joined["u"].to_numpy(), joined["v"].to_numpy())
    every = dbscan_module._merge(np.arange(len(u)), *np.nonzero(near & core[:, None] & core[None, :]))
    assert (label[core] == every[core]).all()

    compared.clear()
    degree = dbscan_module._degrees(meeting, 1.0, tiles, 5).found["n"].to_numpy()
    assert sum(compared) < len(points) ** 2 / 4
    true = near.sum(axis=1)
    assert ((degree >= 5) == (true >= 5)).all() and (degree[true < 5] == true[true < 5]).all()


def test_a_task_keeps_no_copy_of_its_blocks():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    n, width = 8 * 512, 512
    u = rng.standard_normal((n, width))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    u[1::2] = u[::2]
    parts = [pa.ListArray.from_arrays(np.arange(0, 512 * width + 1, width, dtype=np.int32), u[at : at + 512].ravel()) for at in range(0, n, 512)]
    rest = {"id": np.arange(n), "weight": np.ones(n, np.int64), "core": np.zeros(n, bool), "cell": np.zeros(n, np.int32), "angle": np.ones(n)}
    table = pa.table({"vec": pa.chunked_array(parts)} | rest)

    class Meeting:
        def cogroup(self, _):
            return self

        def applyInArrow(self, run, _):  # noqa: N802
            self.found = run(table, table).to_pandas()
            return self

        def groupBy(self, *_):  # noqa: N802
            return self

        def agg(self, *_):
            return self

    def slices(lefts, rights):
        for at in range(0, n, 64):
            for start in range(0, n, 256):
                yield np.arange(at, at + 64), np.arange(start, start + 256)

    meeting = dbscan_module._Meeting.__new__(dbscan_module._Meeting)
    meeting.pairs = Meeting()
    tracemalloc.start()
    found = dbscan_module._degrees(meeting, 0.3, slices).found
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found["n"] == 2).all()
    assert peak < u.nbytes / 3


def test_pairs_at_eps_are_told_apart_in_double_precision():
    steps = np.r_[-1e-9, 0, 1e-9, -1e-5, 1e-5, -1e-3, 1e-3, 0.2, -0.2]
    angles = 2 * np.arcsin((0.3 + steps) / 2)
    rights = np.c_[np.cos(angles), np.sin(angles), np.zeros((len(angles), 62))]
    lefts = np.eye(1, 64)
    true = np.sqrt(np.maximum(0, 2 - 2 * (lefts @ rights.T)[0])) <= 0.3
    assert true[[0, 3, 5, 8]].all() and not true[[2, 4, 6, 7]].any()
    row, col = dbscan_module._hits(lefts, rights, 0.3)
    assert (row == 0).all() and sorted(col) == np.flatnonzero(true).tolist()
