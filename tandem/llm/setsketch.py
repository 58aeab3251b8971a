"""Near-duplicate groups by SetSketch registers, banded, estimated and verified.

A text's set is its distinct word shingles. Its sketch (Ertl, "SetSketch: filling the gap
between MinHash and HyperLogLog", VLDB 2021) has one register per hash function: the
smallest of the shingles' exponential variates, on an exponentially spaced scale and
truncated to the register's range. Registers of a union are the maxima of the registers, and
two registers agree with a probability close to the Jaccard similarity.

1. One pass makes set size, set identity and registers. Equal sets are one class from here
   on; only the class with the smallest id, its representative, is compared.
2. Bands of registers put representatives into buckets. Nobody pairs a bucket out: every
   member is compared with the bucket's smallest member only. For each pair the
   likelihood of the register comparison (greater, smaller, equal) gives the joint estimate;
   what passes it is verified on the full sets.
3. Components of these links label the members. Where a bucket still holds several labels,
   members of the minor labels are compared with all others of another label, in blocks of
   bounded size; a block emits a spanning forest of verified links.
4. Components of all links give the groups; copies follow their representative.

Two sets at the threshold miss each other only if they agree in no band: (1 - J^4)^32, below
1e-9 for J = 0.85 and 1e-7 for J = 0.8. Beyond that nothing is capped.

Results: null text counts as empty; a text without words has an empty set and links with
nothing. A text with fewer words than a shingle has one shingle, all its words. Rows that
repeat an id are one node. A row without an id links with nothing and is kept. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import join_hot, prepared
from tandem.operators.components import connected_components
from tandem.session import materialise

REGISTERS = 128
BAND = 4
BASE = 1.001
RATE = 20.0
LIMIT = (1 << 16) - 1
# Standard deviations of the estimate by which a pair may fall short and is still verified.
DEVIATIONS = 6.0
BLOCK = 512
CACHED_WORDS = 1_000_000
_SLICE = 1 << 15
_COLUMNS = 8192


# --- sets and sketches --------------------------------------------------------------------


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, k: int, words: _WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, letters A-Z lower-cased, words between ASCII
    white space."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.array([words[w] for w in found], np.uint64)
    size = min(k, len(hashes))
    count = len(hashes) - size + 1
    rolled = np.full(count, size, np.uint64)
    for j in range(size):
        rolled = _mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + count])
    return np.unique(rolled)


def _multipliers(m: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = _mixed(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:m] | np.uint64(1), seeds[m:]


def sketches(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """Registers of non-empty sets, one row each."""
    times, plus = _multipliers(m)
    least = np.empty((len(sets), m), np.uint64)
    first = 0
    while first < len(sets):
        last, total = first, 0
        while last < len(sets) and (total == 0 or total + len(sets[last]) <= _SLICE):
            total += len(sets[last])
            last += 1
        part = np.concatenate(sets[first:last])
        starts = np.cumsum([0, *map(len, sets[first : last - 1])])
        for i in range(m):
            least[first:last, i] = np.minimum.reduceat(part * times[i] + plus[i], starts)
        first = last
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    variates = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    scaled = np.floor(1.0 - np.log(variates) / np.log(BASE))
    return np.clip(scaled, 0, LIMIT).astype("<u2")


def joint_estimate(
    greater: np.ndarray, smaller: np.ndarray, equal: np.ndarray, size_u: np.ndarray, size_v: np.ndarray
) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from register comparisons and set sizes."""
    u = (size_u / (size_u + size_v))[:, None]
    v = 1.0 - u
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0.0, 1.0, 129)[None, :] * most

    def above(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1) / BASE) / np.log(BASE)

    p, q = above(u - v * grid), above(v - u * grid)
    tiny = 1e-12
    likelihood = (
        greater[:, None] * np.log(np.maximum(p, tiny))
        + smaller[:, None] * np.log(np.maximum(q, tiny))
        + equal[:, None] * np.log(np.maximum(1 - p - q, tiny))
    )
    best = likelihood.argmax(axis=1)
    return grid[np.arange(len(best)), best]


def _may_link(
    left: np.ndarray, right: np.ndarray, left_sizes: np.ndarray, right_sizes: np.ndarray, threshold: float
) -> np.ndarray:
    """Which pairs of a block's rows and columns the estimate leaves for verification."""
    m = left.shape[1]
    slack = DEVIATIONS * np.sqrt(threshold * (1 - threshold) / m)
    small, large = np.minimum.outer(left_sizes, right_sizes), np.maximum.outer(left_sizes, right_sizes)
    out = small >= threshold * large - 1e-9
    for i in np.flatnonzero(out.any(axis=1)):
        at = np.flatnonzero(out[i])
        wide = right[at]
        greater = (left[i][None, :] > wide).sum(axis=1)
        equal = (left[i][None, :] == wide).sum(axis=1)
        sizes = np.full(len(at), left_sizes[i], float)
        estimate = joint_estimate(greater, m - greater - equal, equal, sizes, right_sizes[at].astype(float))
        out[i, at] = estimate >= threshold - slack
    return out


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a block, as matrix products over shared shingles."""
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        values = np.concatenate(sets)
        at = np.searchsorted(shared, values)
        hit = at < len(shared)
        hit[hit] = shared[at[hit]] == values[hit]
        return owner[hit], at[hit]

    (rows, row_at), (columns, column_at) = places(left), places(right)
    total = np.zeros((len(left), len(right)), np.float64)
    for low in range(0, len(shared), _COLUMNS):
        width = min(_COLUMNS, len(shared) - low)
        a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        inside = (row_at >= low) & (row_at < low + width)
        a[rows[inside], row_at[inside] - low] = 1
        inside = (column_at >= low) & (column_at < low + width)
        b[columns[inside], column_at[inside] - low] = 1
        total += a @ b.T
    return total.round().astype(np.int64)


def block_links(
    left: list[np.ndarray], right: list[np.ndarray], possible: np.ndarray, percent: int
) -> list[tuple[int, int]]:
    """Pairs (row, column) with ``100 * intersection >= percent * union`` on the full sets,
    among the possible ones."""
    rows, columns = np.flatnonzero(possible.any(axis=1)), np.flatnonzero(possible.any(axis=0))
    if not len(rows):
        return []
    common = _common([left[i] for i in rows], [right[j] for j in columns])
    sizes = np.add.outer([len(left[i]) for i in rows], [len(right[j]) for j in columns])
    linked = (100 * common >= percent * (sizes - common)) & possible[np.ix_(rows, columns)]
    return [(int(rows[i]), int(columns[j])) for i, j in np.argwhere(linked)]


# --- Spark side ---------------------------------------------------------------------------


def sketch(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """``key, n_shingles, set_id, registers`` for each row; both are null for an empty set."""
    prepared(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for batch in batches:
            sets = [shingle_set(t, k, words) for t in batch.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            ids: list[bytes | None] = [None] * len(sets)
            registers: list[bytes | None] = [None] * len(sets)
            if full:
                made = sketches([sets[i] for i in full])
                for row, i in enumerate(full):
                    ids[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    registers[i] = made[row].tobytes()
            counts = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), counts, pa.array(ids, pa.binary()), pa.array(registers, pa.binary())],
                names=["key", "n_shingles", "set_id", "registers"],
            )

    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(make, f"key {kind}, n_shingles long, set_id binary, registers binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """``bucket, rep`` for each band of each representative."""
    width = 2 * BAND
    bands = F.array(
        *[
            F.xxhash64(F.lit(b), F.substring("registers", b * width + 1, width))
            for b in range(REGISTERS // BAND)
        ]
    )
    return classes.select("rep", F.explode(bands).alias("bucket"))


def _verified(tasks: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links ``u, v`` of tasks ``(task, side, rep, label)``: side 0 against side 1, or side 0
    within itself where a task has no side 1; equal labels are linked already."""

    def compare(rows: pa.Table) -> pa.Table:
        words = _WordHashes()
        sides = rows.column("side").to_numpy()
        reps = rows.column("rep").to_pylist()
        labels = np.array(rows.column("label").to_pylist())
        sets = [shingle_set(t, k, words) for t in rows.column("text").to_pylist()]
        registers = np.stack([np.frombuffer(r, "<u2") for r in rows.column("registers").to_pylist()])
        sizes = np.array([len(s) for s in sets])
        left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        if not len(right):
            right = left
        links: list[tuple[int, int]] = []
        if len(left):
            possible = _may_link(registers[left], registers[right], sizes[left], sizes[right], percent / 100)
            possible &= labels[left][:, None] != labels[right][None, :]
            found = block_links([sets[i] for i in left], [sets[j] for j in right], possible, percent)
            links = _forest([(reps[left[i]], reps[right[j]]) for i, j in found])
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    full = tasks.join(texts, "rep")
    return full.groupBy("task").applyInArrow(compare, "u long, v long")


def _forest(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for u, v in links:
        a, b = root(u), root(v)
        if a != b:
            parent[a] = b
            kept.append((u, v))
    return kept


def _chunk(rep: Column, count: Column) -> Column:
    return F.pmod(F.xxhash64(rep), count)


def _block_tasks(mixed: DataFrame) -> DataFrame:
    """Tasks over buckets with several labels: each chunk of members outside the bucket's
    main label meets each chunk of the main label and each other chunk of its own kind."""
    per_label = mixed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    main = per_label.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
    shape = main.select(
        "bucket",
        F.col("top.label").alias("main"),
        F.ceil(F.col("top.n") / BLOCK).alias("main_chunks"),
        F.ceil((F.col("all") - F.col("top.n")) / BLOCK).alias("minor_chunks"),
    )
    members = mixed.join(shape, "bucket")
    minor = F.col("label") != F.col("main")
    own = F.when(minor, _chunk(F.col("rep"), F.col("minor_chunks"))).otherwise(
        _chunk(F.col("rep"), F.col("main_chunks"))
    )
    minors = F.sequence(F.lit(0).cast("long"), F.col("minor_chunks") - 1)
    mains = F.sequence(F.lit(0).cast("long"), F.col("main_chunks") - 1)

    def task(kind: str, i: Column, j: Column, side: Column) -> Column:
        return F.struct(F.xxhash64("bucket", F.lit(kind), i, j).alias("task"), side.cast("int").alias("side"))

    own = own.cast("long")
    against_main = F.transform(mains, lambda j: task("main", own, j, F.lit(0)))
    from_main = F.transform(minors, lambda i: task("main", i, own, F.lit(1)))
    among = F.transform(
        minors,
        lambda i: task("minor", F.least(i, own), F.greatest(i, own), (i < own).cast("int")),
    )
    roles = F.when(minor, F.concat(against_main, among)).otherwise(from_main)
    return members.select("rep", "label", F.explode(roles).alias("t")).select("t.task", "t.side", "rep", "label")


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for each row: texts whose shingle sets share at
    least ``percent`` per cent of their union are linked, links are followed to the end, and
    a component is named by its smallest id."""
    prepared(df.sparkSession)
    source = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = materialise(sketch(source, "key", "text", k), "sketches")
    linkable = rows.where(F.col("key").isNotNull() & F.col("set_id").isNotNull())
    sets = materialise(
        linkable.groupBy("set_id").agg(
            F.min("key").alias("rep"),
            F.count(F.lit(1)).alias("n"),
            F.first("registers").alias("registers"),
        ),
        "classes",
    )
    buckets = materialise(_shared(_buckets(sets)), "buckets")
    wanted = buckets.select("rep").distinct()
    texts = materialise(_candidate_texts(source, sets, wanted), "candidates")

    # Everyone against the smallest member of each bucket; a hub's members are dealt to tasks.
    pairs = buckets.where(F.col("rep") != F.col("hub")).select("hub", "rep").distinct()
    degrees = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("chunks"))
    dealt = pairs.join(degrees, "hub").select(
        F.xxhash64("hub", _chunk(F.col("rep"), F.col("chunks"))).alias("task"), "hub", "rep"
    )
    stars = dealt.select("task", F.lit(1).alias("side"), "rep", F.col("rep").alias("label")).unionByName(
        dealt.select("task", F.lit(0).alias("side"), F.col("hub").alias("rep"), F.col("hub").alias("label")).distinct()
    )
    first_links = materialise(_verified(stars, texts, k, percent), "star-links")
    labels = materialise(connected_components(first_links), "labels")

    # Buckets whose members are not one component yet.
    labelled = buckets.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "bucket", "rep", F.coalesce("root", "rep").alias("label")
    )
    several = labelled.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("n"))
    several = several.where((F.col("a") != F.col("b")) & (F.col("n") > 2)).select("bucket")
    tasks = _block_tasks(materialise(labelled.join(several, "bucket"), "mixed"))
    more_links = _verified(tasks, texts, k, percent)
    merged = connected_components(
        first_links.unionByName(more_links).distinct()
    )
    groups = sets.join(merged.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_id", "n", F.coalesce("root", "rep").alias("component_id")
    )
    n_rows = rows.count()
    plain = rows.select("key", "n_shingles", "set_id")
    grouped = join_hot(plain.where(F.col("key").isNotNull() & F.col("set_id").isNotNull()), groups, "set_id", "n", n_rows)
    alone = plain.where(F.col("key").isNull() | F.col("set_id").isNull()).withColumn("component_id", F.col("key"))
    return grouped.select("key", "n_shingles", "component_id").unionByName(
        alone.select("key", "n_shingles", "component_id")
    ).select(
        F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _shared(buckets: DataFrame) -> DataFrame:
    """``bucket, rep, hub`` of the buckets with two members or more."""
    hubs = (
        buckets.groupBy("bucket")
        .agg(F.min("rep").alias("hub"), F.max("rep").alias("other"))
        .where(F.col("hub") != F.col("other"))
        .select("bucket", "hub")
    )
    return buckets.join(hubs, "bucket")


def _candidate_texts(source: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rep, text, registers`` of the representatives that share a bucket."""
    chosen = sets.select("rep", "registers").join(wanted, "rep")
    return source.where(F.col("key").isNotNull()).withColumnRenamed("key", "rep").join(chosen, "rep")
