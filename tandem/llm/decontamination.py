"""Benchmark decontamination: a prefix-filtered containment join of documents with item windows.

Every benchmark item is cut into windows of WINDOW consecutive words (a shorter item is one
window), and every window into shingles of SHINGLE words. A document that holds a window holds
all its shingles, so of each window's shingles, ordered by how often the corpus has them, only
the rarest has to be joined: the necessary prefix of a full containment is one token.

1. The windows' shingles are counted over all documents, and each window keeps its rarest one;
   a window with a shingle that no document has is settled already.
2. Documents emit a row at each word where a prefix shingle may start, told by a bit filter of
   bounded size, with the words around it. Nothing else of a document moves.
3. These rows meet the windows by shingle. Frequent shingles are dealt over salts by their
   count. The window's place is fixed by the shingle's place in it: it has to begin and end
   within the document (positional and length bounds), and its words have to equal the
   document's words there, compared as text.
4. The places found are united per document.

Results: null texts have no words; neither a document nor an item without words matches
anything. Rows that repeat a document id are answered one by one; items that repeat an id are
one item; an item without id marks words but counts as no item. Extra columns are ignored; an
empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import HOT_SHARE, prepared
from tandem.session import materialise

WINDOW = 10
SHINGLE = 3
# The filter has this many bits for each shingle, and never more than FILTER_LIMIT (8 MB);
# beyond that it lets more rows through and the join sorts them out.
FILTER_BITS = 32
FILTER_LIMIT = 1 << 26
# Texts are read in slices of about this many bytes (a longer text is a slice of its own).
SLICE_BYTES = 1 << 20
# A salt of a frequent shingle holds at least this many rows.
SALT_ROWS = 4096

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finaliser)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_values() -> np.ndarray:
    """A number for each byte: 0 for those that end a word, the lower-case letter's for A-Z."""
    values = _mixed(np.arange(256, dtype=_U))
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    for low, high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        values[low : high + 1] = 0
    return values


_VALUES = _byte_values()
_BASE = _U(0x9E3779B185EBCA87)


class Words:
    """The words of some texts: hash, bytes and text of each."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        values = _VALUES[np.frombuffer(self.data, np.uint8)]
        inside = np.concatenate([[False], values != 0])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        #: Words before each text, and after the last one.
        self.first = np.searchsorted(self.starts, np.concatenate([[0], ends]))
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hashes = self._hashes(values)

    def _hashes(self, values: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, _U)
        # A letter counts by its place in the word; what stands between words counts 0.
        begin = self.starts[0]
        gaps = np.diff(np.append(self.starts, len(values)))
        place = np.arange(begin, len(values)) - np.repeat(self.starts, gaps)
        powers = np.cumprod(np.full(gaps.max(), _BASE))
        return _mixed(np.add.reduceat(values[begin:] * powers[place], self.starts - begin))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``size`` words within one text."""
        count = len(self.hashes) - size + 1
        if count < 1:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        found = np.full(count, _U(size))
        for j in range(size):
            found = _mixed(found ^ self.hashes[j : j + count])
        whole = np.flatnonzero(self.text_of[:count] == self.text_of[size - 1 :])
        return whole, found[whole]

    def words(self, low: int, high: int, longest: int | None = None) -> list[str]:
        """Words ``low`` to ``high``, lower-cased; those of more than ``longest`` bytes, which
        equal no word of an item, as a dash."""
        return [
            "-" if longest is not None and e - s > longest else self.data[s:e].lower().decode()
            for s, e in zip(self.starts[low:high].tolist(), self.ends[low:high].tolist())
        ]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """The batch's texts in slices: number of the first row, texts."""
    start, size, texts = 0, 0, []
    for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
        texts.append(text)
        size += len(text)
        if size >= SLICE_BYTES:
            yield start, texts
            start, size, texts = i + 1, 0, []
    if texts:
        yield start, texts


class BitFilter:
    """Tells most hashes outside a set apart; two bits for each member."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def _places(hashes: Column, bits: int) -> Column:
        return F.explode(F.array(hashes.bitwiseAND(bits - 1), F.shiftrightunsigned(hashes, 32).bitwiseAND(bits - 1)))

    @classmethod
    def of(cls, hashes: DataFrame) -> BitFilter:
        """A filter of the column ``hash``; at most FILTER_LIMIT / 64 numbers reach the driver."""
        bits = 64
        wanted = FILTER_BITS * hashes.select(F.approx_count_distinct("hash")).head()[0]
        while bits < min(wanted, FILTER_LIMIT):
            bits *= 2
        places = hashes.select(cls._places(F.col("hash"), bits).alias("bit"))
        rows = (
            places.groupBy(F.shiftright("bit", 6).alias("word"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63).cast("int"))).alias("bits"))
            .toArrow()
        )
        words = np.zeros(bits // 64, np.int64)
        words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
        return cls(words.view(_U))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for part in (hashes, hashes >> _U(32)):
            bit = part & _U(64 * len(self.words) - 1)
            found &= (self.words[bit >> _U(6)] >> (bit & _U(63))) & _U(1) == 1
        return found


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The distinct windows of each item: ``item, window`` (its words), ``size, longest`` (bytes
    of its longest word) and ``shingles`` (their hashes in order)."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _slices(batch):
                read = Words(texts)
                made, taken = [], []
                for i in range(len(texts)):
                    low, high = int(read.first[i]), int(read.first[i + 1])
                    size = min(window, high - low)
                    for at in range(low, high - size + 1 if size else low):
                        words = read.words(at, at + size)
                        part = Words([" ".join(words).encode()])
                        hashes = part.shingles(min(shingle, size))[1].view(np.int64).tolist()
                        longest = int((part.ends - part.starts).max())
                        made.append((" ".join(words), size, longest, hashes))
                        taken.append(start + i)
                columns = list(zip(*made)) or [[]] * 4
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
                arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds)]
                keys = batch.column("item").take(pa.array(taken, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *arrays], names=["item", "window", "size", "longest", "shingles"])

    rows = items.select(F.col(key).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = items.schema[key].dataType.simpleString()
    made = rows.mapInArrow(cut, f"item {kind}, window string, size int, longest int, shingles array<long>")
    return made.dropDuplicates(["item", "window"])


def _shingle_counts(docs: DataFrame, sizes: list[int], known: BitFilter) -> DataFrame:
    """``hash, n``: occurrences over all documents of every shingle that passes the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(known.words)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = BitFilter(shared.value)
        for batch in batches:
            found = [np.zeros(0, _U)]
            for _, texts in _slices(batch):
                read = Words(texts)
                for size in sizes:
                    hashes = read.shingles(size)[1]
                    found.append(hashes[known.holds(hashes)])
            hashes, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], names=["hash", "n"])

    return docs.select("text").mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def rarest_shingles(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows that may occur, each with its rarest shingle: ``item, window, size, hash, at, n``."""
    entries = windows.select("item", "window", "size", F.size("shingles").alias("needed"), F.posexplode("shingles").alias("at", "hash"))
    rarest = F.struct("n", "hash", "at")
    return (
        entries.join(counts, "hash")
        .groupBy("item", "window")
        .agg(F.first("size").alias("size"), F.first("needed").alias("needed"), F.count(F.lit(1)).alias("found"), F.min(rarest).alias("r"))
        .where(F.col("found") == F.col("needed"))
        .select("item", "window", "size", "r.hash", "r.at", "r.n")
    )


def _candidates(docs: DataFrame, sizes: list[int], prefix: BitFilter, longest: int, window: int) -> DataFrame:
    """One row per document, ``row, key, n_words``, and one more for each place of a shingle
    that passes the filter, with ``hash, at``, the words around it and how many stand before."""
    shared = docs.sparkSession.sparkContext.broadcast(prefix.words)
    kind = docs.schema["key"].dataType.simpleString()

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix = BitFilter(shared.value)
        for batch in batches:
            for start, texts in _slices(batch):
                read = Words(texts)
                counts = np.diff(read.first)
                taken = [np.arange(len(texts))]
                hashes, at, around, ahead = [None] * len(texts), [None] * len(texts), [None] * len(texts), [None] * len(texts)
                for size in sizes:
                    place, found = read.shingles(size)
                    hit = prefix.holds(found)
                    place, found = place[hit], found[hit]
                    of = read.text_of[place]
                    low = np.maximum(read.first[of], place - (window - 1))
                    high = np.minimum(read.first[of + 1], place + window)
                    taken.append(of)
                    hashes += found.view(np.int64).tolist()
                    at += (place - read.first[of]).tolist()
                    ahead += (place - low).tolist()
                    around += [" ".join(read.words(a, b, longest)) for a, b in zip(low.tolist(), high.tolist())]
                of = np.concatenate(taken)
                rows = pa.array(of + start)
                arrays = [
                    batch.column("row").take(rows), batch.column("key").take(rows), pa.array(counts[of], pa.int64()),
                    pa.array(hashes, pa.int64()), pa.array(at, pa.int64()), pa.array(around, pa.string()), pa.array(ahead, pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "key", "n_words", "hash", "at", "around", "ahead"])

    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    return numbered.mapInArrow(emit, f"row long, key {kind}, n_words long, hash long, at long, around string, ahead int")


def _occurrences(candidates: DataFrame, prefix: DataFrame) -> DataFrame:
    """``row, start, size, item`` of every window that stands in a document."""
    frequency = prefix.groupBy("hash").agg(F.max("n").alias("n"))
    total = frequency.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    salt_rows = max(SALT_ROWS, -(-total // HOT_SHARE))
    parts = F.ceil(F.col("n") / salt_rows)
    # Fewer than HOT_SHARE shingles have more than one part.
    frequent = F.broadcast(frequency.select("hash", parts.alias("parts")).where(F.col("parts") > 1))
    dealt = candidates.join(frequent, "hash", "left").withColumn(
        "salt", F.pmod(F.xxhash64("row", "at"), F.coalesce("parts", F.lit(1)))
    )
    windows = prefix.select(
        "hash", "window", "size", "item", F.col("at").alias("inner"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("salt")
    )
    met = dealt.join(windows, ["hash", "salt"])
    start = F.col("at") - F.col("inner")
    words = F.slice(F.split("around", " "), F.col("ahead") - F.col("inner") + 1, F.col("size"))
    fits = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    return met.where(fits).where(F.array_join(words, " ") == F.col("window")).select("row", start.alias("start"), "size", "item")


def _covered(spans: Column) -> Column:
    """Words in the union of (start, size) spans."""
    def add(state: Column, span: Column) -> Column:
        end = span["start"] + span["size"]
        fresh = F.greatest(F.lit(0).cast("long"), end - F.greatest(state["end"], span["start"]))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["n"] + fresh).alias("n"))

    zero = F.lit(0).cast("long")
    return F.aggregate(F.sort_array(spans), F.struct(zero.alias("end"), zero.alias("n")), add, lambda s: s["n"])


def contamination(
    df: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
) -> DataFrame:
    """One row per row of ``df``: ``key, n_words, n_hit, n_items, items_sha256, contaminated``
    and ``items``, the ids of its items as sorted strings."""
    prepared(df.sparkSession)
    docs = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    windows = materialise(item_windows(items, item_key, item_text, window, shingle), "windows")
    facts = windows.agg(
        F.collect_set(F.least(F.col("size"), F.lit(shingle))).alias("sizes"), F.max("longest").alias("longest")
    ).head()
    sizes, longest = sorted(facts["sizes"]), facts["longest"] or 0
    known = BitFilter.of(windows.select(F.explode("shingles").alias("hash")))
    prefix = materialise(rarest_shingles(windows, _shingle_counts(docs, sizes, known)), "prefixes")
    found = materialise(_candidates(docs, sizes, BitFilter.of(prefix), longest, window), "places")
    hits = _occurrences(found.where(F.col("hash").isNotNull()).drop("key"), prefix)
    kind = docs.schema["key"].dataType
    none = F.lit(None)
    rows = found.where(F.col("hash").isNull()).select(
        "row", "key", "n_words", none.cast("struct<start:bigint,size:int>").alias("span"), none.cast("string").alias("item")
    ).unionByName(hits.select(
        "row", none.cast(kind).alias("key"), none.cast("long").alias("n_words"),
        F.struct("start", "size").alias("span"), F.col("item").cast("string").alias("item"),
    ))
    per_row = rows.groupBy("row").agg(
        F.first("key", ignorenulls=True).alias("key"), F.max("n_words").alias("n_words"),
        F.collect_set("span").alias("spans"), F.array_sort(F.collect_set("item")).alias("items"),
    )
    n_hit = _covered(F.col("spans"))
    return per_row.select(
        F.col("key").alias(key),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "items",
    )
