"""A stored vector index: coarse cells, residual codes, exact re-ranking.

Inverted files with product quantisation (Jegou, Douze, Schmid: Product Quantization for Nearest
Neighbor Search, 2011). Every vector belongs to the cell of its nearest centroid and is stored
there with a code of one byte per few dimensions for what is left after the centroid. A search
visits the cells nearest to each query, compares codes, and reads full vectors for the best of
those only, so scores in the result are exact.

Cells are folders: a search lists the folders it visits and reads no other, and of those only
ids and codes until the re-ranking. Cells of any size are cut into blocks by the join.

How many cells are visited and how many vectors are re-ranked is measured when the index is
built: for a sample of its own rows the exact neighbours are searched in the whole table, and
the settings are the smallest that find the wanted share of them for every sampled row.

Centroids and codebooks are fitted on at most ``sample_rows`` rows and the settings on
``tuning_rows``; every row is indexed. Rows without a vector are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions.vectors import dot, unit
from tandem.operators.cells import matrix, to_cells
from tandem.operators.topk import BLOCK_ROWS, SCORE_DIGITS, _best, topk_cosine, visit
from tandem.session import materialise, scratch_path

CELL_ROWS = 1024
MAX_CELLS = 4096
SAMPLE_ROWS = 16_384
TUNING_ROWS = 200
# Dimensions that share a byte, and words of a codebook.
SUB_WIDTH = 4
WORDS = 256
# Share of neighbours to find for each tuning row, and most re-ranked rows per wanted one.
SHARE, MOST_REFINED = 0.97, 64
SEED = 42


def lloyd(points: np.ndarray, count: int, rounds: int, seed: int = SEED) -> np.ndarray:
    """Centres of ``count`` groups by Lloyd's algorithm; empty groups keep their centre."""
    distinct = np.unique(points, axis=0)
    if len(distinct) <= count:
        return distinct
    centres = points[np.random.default_rng(seed).choice(len(points), count, replace=False)].copy()
    for _ in range(rounds):
        group = nearest(points, centres)
        sizes = np.bincount(group, minlength=len(centres))
        order = np.argsort(group, kind="stable")
        filled = np.flatnonzero(sizes)
        sums = np.add.reduceat(points[order], np.r_[0, np.cumsum(sizes[filled])[:-1]], axis=0)
        centres[filled] = sums / sizes[filled, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    out = np.empty(len(points), np.int64)
    for start in range(0, len(points), 4096):
        out[start : start + 4096] = (points[start : start + 4096] @ centres.T - half).argmax(axis=1)
    return out


@dataclass(frozen=True)
class Quantiser:
    """Centroids and the codebook of each group of dimensions."""

    centroids: np.ndarray
    codebooks: list[np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int) -> Quantiser:
        centroids = lloyd(sample, cells, 8)
        rest = sample - centroids[nearest(sample, centroids)]
        books = [lloyd(rest[:, at : at + SUB_WIDTH], WORDS, 6, SEED + at) for at in range(0, sample.shape[1], SUB_WIDTH)]
        return cls(centroids, books)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code of each vector."""
        cell = nearest(vectors, self.centroids)
        rest = vectors - self.centroids[cell]
        parts = [nearest(rest[:, i * SUB_WIDTH : (i + 1) * SUB_WIDTH], book) for i, book in enumerate(self.codebooks)]
        return cell, np.stack(parts, axis=1).astype(np.uint8)

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        rest = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.codebooks)], axis=1)
        return self.centroids[cell] + rest


def _sample(units: DataFrame, rows: int, salt: int) -> pa.Table:
    """``id, vec`` of the rows with the smallest hashes, at most ``rows`` of them."""
    return units.orderBy(F.xxhash64("id", F.lit(salt)), "id").limit(rows).select("id", "vec").toArrow()


def _matrix(table: pa.Table) -> np.ndarray:
    return np.array(table.column("vec").to_pylist(), np.float64)


@dataclass(frozen=True)
class VectorIndex:
    """The index stored at ``path``; ``rows``: ``id, code, vec, cell`` with ``cell`` as folders."""

    rows: DataFrame
    quantiser: Quantiser | None
    probes: int
    refined: float
    path: str

    @classmethod
    def build(
        cls,
        vectors: DataFrame,
        path: str,
        k: int = 10,
        id_col: str = "id",
        vec: str = "embedding",
        cell_rows: int = CELL_ROWS,
        sample_rows: int = SAMPLE_ROWS,
        tuning_rows: int = TUNING_ROWS,
        share: float = SHARE,
    ) -> VectorIndex:
        """Builds and stores the index; settings are tuned for the ``k`` nearest."""
        spark = vectors.sparkSession
        units = materialise(_units(vectors, id_col, vec), "unit-vectors")
        n = units.count()
        if n == 0:
            _encoded(units, None).write.partitionBy("cell").mode("overwrite").parquet(f"{path}/rows")
            _settings(spark, path, None, 1, 1.0)
            return cls.load(spark, path)
        sample = _matrix(_sample(units, sample_rows, 0))
        quantiser = Quantiser.fit(sample, max(1, min(MAX_CELLS, round(n / cell_rows), len(sample) // 8)))
        _append(_encoded(units, quantiser), path, "overwrite")
        _settings(spark, path, quantiser, len(quantiser.centroids), float(MOST_REFINED))
        untuned = cls.load(spark, path)
        probes, refined = untuned._tuned(units, k, tuning_rows, share)
        _settings(spark, path, quantiser, probes, refined)
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        rows = spark.read.schema("id long, code binary, vec array<double>, cell int").parquet(f"{path}/rows")
        # One row per centroid and per codebook word.
        stored = spark.read.parquet(f"{path}/settings").orderBy("kind", "number").collect()
        facts = next(r for r in stored if r["kind"] == "facts")["values"]
        centroids = np.array([r["values"] for r in stored if r["kind"] == "centroid"])
        books: dict[int, list] = {}
        for r in stored:
            if r["kind"] == "word":
                books.setdefault(r["number"] // WORDS, []).append(r["values"])
        quantiser = Quantiser(centroids, [np.array(books[i]) for i in sorted(books)]) if len(centroids) else None
        return cls(rows, quantiser, int(facts[0]), float(facts[1]), path)

    def add(self, vectors: DataFrame, id_col: str = "id", vec: str = "embedding") -> VectorIndex:
        """The index with more rows, filed by the same centroids and codebooks."""
        if self.quantiser is None:
            raise ValueError("an empty index has nothing to file rows by: build it again")
        _append(_encoded(_units(vectors, id_col, vec), self.quantiser), self.path, "append")
        return VectorIndex.load(vectors.sparkSession, self.path)

    def search(
        self, queries: DataFrame, k: int, left_id: str = "left_id", left_vec: str = "left_vec",
        probes: int | None = None, refined: float | None = None, block_rows: int = BLOCK_ROWS,
    ) -> DataFrame:
        """``left_id, right_id, cosine_score, cand_pos``: nearest rows, scores exact, ties by id."""
        lefts = queries.select(F.col(left_id).cast("bigint").alias("left_id"), unit(left_vec).alias("left_vec"))
        lefts = lefts.where(F.size("left_vec") > 0)
        if self.quantiser is None:
            return _best(lefts.select("left_id", F.lit(0).cast("bigint").alias("right_id"), F.lit(0.0).alias("score")).where("false"), k)
        lefts = materialise(lefts, "query-vectors")
        refined = self.refined if refined is None else refined
        wanted = max(k, int(np.ceil(k * refined)))
        if not refined or lefts.count() * wanted > self.rows.count():
            return self._by_vectors(lefts, k, probes or self.probes, block_rows)
        coded = self._by_codes(lefts, wanted, probes or self.probes, block_rows)
        found = coded.select("left_id", "right_id").join(self.rows.select(F.col("id").alias("right_id"), "vec"), "right_id")
        scored = found.join(lefts, "left_id").select("left_id", "right_id", F.round(dot("left_vec", "vec"), SCORE_DIGITS).alias("score"))
        return _best(scored.distinct(), k)

    def _visited(self, lefts: DataFrame, probes: int) -> tuple[DataFrame, DataFrame]:
        """Queries with their nearest cells, and the rows of the folders that any of them visits."""
        centroids = self.quantiser.centroids
        n = min(probes, len(centroids))

        def nearest_cells(batch: pd.DataFrame, _: np.ndarray) -> Iterator[np.ndarray]:
            yield from np.argsort(-(matrix(batch["left_vec"]) @ centroids.T), axis=1, kind="stable")[:, :n]

        visits = materialise(to_cells(lefts, "left_vec", nearest_cells, centroids), "visits")
        # At most MAX_CELLS numbers; only these folders are read.
        cells = [r[0] for r in visits.select(F.explode("cells").alias("cell")).distinct().collect()]
        return visits, self.rows.where(F.col("cell").isin(cells)).withColumn("cells", F.array("cell"))

    def _by_vectors(self, lefts: DataFrame, k: int, probes: int, block_rows: int) -> DataFrame:
        """The best ``k`` of the visited cells by full vectors, each read once: for queries that would
        fetch more vectors one by one than there are, and for cells whose codes tell too little."""
        visits, rows = self._visited(lefts, probes)
        rights = rows.select(F.col("id").alias("right_id"), F.col("vec").alias("right_vec"), "cells")
        return _best(visit(visits, rights, k, block_rows, self.quantiser.centroids.shape[1]).distinct(), k)

    def _by_codes(self, lefts: DataFrame, wanted: int, probes: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
        """The best ``wanted`` rows of each query by the decoded vectors of the visited cells."""
        quantiser = self.quantiser
        shared = lefts.sparkSession.sparkContext.broadcast((quantiser.centroids, quantiser.codebooks))

        def decode(rights: pd.DataFrame) -> np.ndarray:
            codes = np.frombuffer(b"".join(rights["right_vec"]), np.uint8).reshape(len(rights), -1)
            return Quantiser(*shared.value).decode(rights["cells"].str[0].to_numpy(np.int64), codes)

        visits, rows = self._visited(lefts, probes)
        coded = rows.select(F.col("id").alias("right_id"), F.col("code").alias("right_vec"), "cells")
        return _best(visit(visits, coded, wanted, block_rows, quantiser.centroids.shape[1], decode), wanted)

    def _tuned(self, units: DataFrame, k: int, rows: int, share: float) -> tuple[int, float]:
        """Cells to visit and rows to re-rank per wanted one, measured on ``rows`` sampled rows; 0 rows
        where even ``MOST_REFINED`` miss too many: then full vectors are compared."""
        spark = units.sparkSession
        sample = _sample(units, rows, 1)
        of_row = dict(zip(sample.column("id").to_pylist(), _matrix(sample)))
        lefts = spark.createDataFrame([(i, v.tolist()) for i, v in of_row.items()], "left_id bigint, left_vec array<double>")
        # Each row's own entry is no neighbour to learn from.
        exact = topk_cosine(lefts, units, k + 1, right_id="id", right_vec="vec").where("left_id <> right_id")
        exact = materialise(exact.select("left_id", "right_id"), "exact-neighbours")
        homes = exact.join(self.rows.select(F.col("id").alias("right_id"), "cell"), "right_id").select("left_id", "cell").collect()
        needed: dict[int, list[int]] = {}
        for r in homes:
            order = np.argsort(-(of_row[r["left_id"]] @ self.quantiser.centroids.T), kind="stable")
            needed.setdefault(r["left_id"], []).append(int(np.flatnonzero(order == r["cell"])[0]) + 1)
        probes = _enough(needed, share)
        most = MOST_REFINED * k
        coded = self._by_codes(lefts, most, probes).select("left_id", "right_id", "cand_pos")
        places: dict[int, list[int]] = {}
        for r in exact.join(coded, ["left_id", "right_id"], "left").select("left_id", F.coalesce("cand_pos", F.lit(most + 1)).alias("p")).collect():
            places.setdefault(r["left_id"], []).append(r["p"])
        enough = _enough(places, share)
        return probes, enough / k if enough <= most else 0.0


def _enough(needed: dict[int, list[int]], share: float) -> int:
    """The least setting that finds ``share`` of the neighbours of every tuning row."""
    return max((sorted(v)[int(np.ceil(share * len(v))) - 1] for v in needed.values()), default=1)


def _units(vectors: DataFrame, id_col: str, vec: str) -> DataFrame:
    # Filtered before the division: a filter on the result would divide twice.
    return vectors.where(F.size(vec) > 0).select(F.col(id_col).cast("bigint").alias("id"), unit(vec).alias("vec"))


def _encoded(units: DataFrame, quantiser: Quantiser | None) -> DataFrame:
    schema = "id long, code binary, vec array<double>, cell int"
    if quantiser is None:
        return units.sparkSession.createDataFrame([], schema)
    shared = units.sparkSession.sparkContext.broadcast((quantiser.centroids, quantiser.codebooks))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Quantiser(*shared.value)
        for batch in batches:
            column = batch.column("vec")
            if batch.num_rows:
                vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                cell, codes = own.encode(vectors)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()), column, pa.array(cell, pa.int32())],
                    names=["id", "code", "vec", "cell"])

    return units.mapInArrow(encode, schema)


def _append(encoded: DataFrame, path: str, mode: str) -> None:
    """Rows by cell; ranges of ids spread a large cell over tasks."""
    written = materialise(encoded, "encoded")
    written.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.partitionBy("cell").mode(mode).parquet(f"{path}/rows")


def _settings(spark: SparkSession, path: str, quantiser: Quantiser | None, probes: int, refined: float) -> None:
    rows = [("facts", 0, [float(probes), refined])]
    if quantiser is not None:
        rows += [("centroid", i, c.tolist()) for i, c in enumerate(quantiser.centroids)]
        rows += [("word", i * WORDS + j, w.tolist()) for i, book in enumerate(quantiser.codebooks) for j, w in enumerate(book)]
    spark.createDataFrame(rows, "kind string, number long, values array<double>").write.mode("overwrite").parquet(f"{path}/settings")


def temporary_index(vectors: DataFrame, k: int, id_col: str, vec: str) -> VectorIndex:
    """An index in the shared folder, for one run over its rows."""
    return VectorIndex.build(vectors, scratch_path(vectors.sparkSession, "vector-index"), k, id_col, vec)
