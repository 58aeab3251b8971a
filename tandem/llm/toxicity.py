"""Toxicity of texts whose words may be disguised: a noisy channel, then a linear score.

1. A character language model is counted over all texts: four-letter sequences within and
   at the edges of words, accents folded. Each task sends its own counts; their sum is at
   most one row per sequence of the folded alphabet.
2. Tokens with signs of disguise (digits or marks for letters, letters drawn out, letters
   set apart by marks or blanks) become lattices: each position offers the letters it may
   stand for, at a cost, and each separator may be a word edge. The Viterbi path through the lattice under the language model is
   the restored word or words. All other tokens have one path and stay as they are.
3. Word beginnings and whole words of restored texts are weighed by a logistic regression,
   fitted on a bounded sample of labelled rows over the terms that tell the classes apart
   best (likelihood-ratio test on document counts).

The labelled sample holds at most ``max_labelled`` rows, those with the smallest hash of their
id, and the regression weighs at most ``terms`` terms, chosen by that test among the twenty times
as many with the largest surplus in toxic rows. The language model, restoration and scores cover every row and whole texts.

Results: null counts as empty; a text without words has the score of the intercept. Where
labels are missing or of one kind, every score is their smoothed mean. Repeated ids are
scored row by row. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import prepared
from tandem.session import materialise

MAX_LABELLED = 20_000
TERMS = 400
RIDGE = 0.0002
CACHED_LETTERS = 8_000_000
CACHED_LENGTH = 64
LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SYMBOLS = len(LETTERS) + 1  # and the edge of a word
_GRAMS = _SYMBOLS**4
_COUNTED = 1 << 22

# What may stand for a letter (fixed values, in common use).
STAND_INS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "ø": "o",
}
STAND_IN_COST, DROP_COST, SHORTEN_COST, SHORTEN_PAIR_COST = 1.0, 0.3, 0.3, 2.5

_WORD = re.compile(r"[^\W\d_]+")
# Three or more single visible characters over any white space.
_SPACED = re.compile(r"(?<!\S)(?:\S\s++){2,}\S(?!\S)")
_BLANKS = re.compile(r"\s+")
_EDGES = ".,;:!?\"'()[]{}#%&*|-_~<>/\\=+`^"
_DRAWN_OUT = re.compile(r"([^\W\d_])\1\1", re.IGNORECASE)
_LETTER = re.compile(r"[^\W\d_]")
_STAND_IN = re.compile(r"[0-9@$!|+€£(ø]")
_APART = re.compile(r"[^\W_](?:[^\w\s]|_)+[^\W_]")
# What a word may begin or end with besides letters and digits.
_OUTER = "".join(c for c in _EDGES if c not in STAND_INS)


def folded(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def _fold_table() -> np.ndarray:
    """Alphabet position of each code point of the basic plane; 0 where it is no letter."""
    table = np.zeros(1 << 16, np.uint8)
    for point in range(0x250):
        plain = folded(chr(point))
        if plain and plain[0] in LETTERS:
            table[point] = LETTERS.index(plain[0]) + 1
    return table


def count_sequences(texts: Iterable[str], table: np.ndarray) -> np.ndarray:
    """Counts of four-symbol sequences; a run of non-letters is one edge."""
    points = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le"), "<u4")
    codes = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], 0)
    edge = codes == 0
    codes = codes[~(edge & np.append(False, edge[:-1]))].astype(np.int64)
    if len(codes) < 4:
        return np.zeros(_GRAMS, np.int64)
    grams = ((codes[:-3] * _SYMBOLS + codes[1:-2]) * _SYMBOLS + codes[2:-1]) * _SYMBOLS + codes[3:]
    return np.bincount(grams, minlength=_GRAMS)


class CharacterModel:
    """Interpolated log-probabilities of a symbol after the three before it."""

    def __init__(self, counts: np.ndarray):
        four = counts.reshape((_SYMBOLS,) * 4).astype(np.float64)
        estimate = np.full(_SYMBOLS, 1.0 / _SYMBOLS)
        for order in (1, 2, 3, 4):
            seen = four.sum(axis=tuple(range(4 - order)))
            total = seen.sum(axis=-1, keepdims=True)
            estimate = (seen + 8.0 * estimate) / (total + 8.0)
        self.log = np.log(estimate).astype(np.float32)

    def __getitem__(self, key: tuple[int, int, int, int]) -> float:
        return float(self.log[key])


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """What each position of a token may stand for: (letters, cost); a blank is a word edge."""
    steps: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(token):
        c = token[at]
        run = 1
        while at + run < len(token) and token[at + run] == c:
            run += 1
        if c in LETTERS:
            options = [(c * run, 0.0)] if run < 3 else [(c * 2, SHORTEN_COST)]
            if run > 1:
                options.append((c, SHORTEN_COST if run > 2 else SHORTEN_PAIR_COST))
        elif c in STAND_INS:
            options = [(x * min(run, 2), STAND_IN_COST) for x in STAND_INS[c]]
            if run > 1:
                options += [(x, STAND_IN_COST + SHORTEN_COST) for x in STAND_INS[c]]
            if c in "!|+(":
                options.append(("", 2 * STAND_IN_COST))
        else:
            # Nothing, or the edge of a word.
            options = [("", DROP_COST), (" ", DROP_COST)]
        steps.append(options)
        at += run
    return steps


def restore(token: str, model: CharacterModel) -> str:
    """The most likely reading of a disguised token of any length: words with blanks between."""
    # A path is its last letters and the path before them.
    states: dict[tuple[int, int, int], tuple[float, tuple | None]] = {(0, 0, 0): (0.0, None)}
    for options in lattice(folded(token)):
        reached: dict[tuple[int, int, int], tuple[float, tuple | None]] = {}
        for context, (score, path) in states.items():
            for letters, cost in options:
                total, at = score - cost, context
                if letters == " " and at[2] == 0:
                    continue  # as in the counts, edges in a row are one
                for letter in letters:
                    symbol = LETTERS.find(letter) + 1
                    total += model[(*at, symbol)]
                    at = (at[1], at[2], symbol)
                if at not in reached or total > reached[at][0]:
                    reached[at] = (total, (letters, path) if letters else path)
        states = reached
    path = max(((score + (model[(*at, 0)] if at[2] else 0.0), path) for at, (score, path) in states.items()), key=lambda x: x[0])[1]
    read = []
    while path is not None:
        letters, path = path
        read.append(letters)
    return "".join(reversed(read))


def is_disguised(core: str) -> bool:
    """Whether a token shows signs of disguise; each sign is looked for in one pass."""
    if not _LETTER.search(core):
        return False
    return bool(_STAND_IN.search(core) or _DRAWN_OUT.search(core) or _APART.search(core))


def terms_of(word: str) -> list[str]:
    """The terms of one plain word: the word and its beginnings."""
    return ["=" + word, *["^" + word[:n] for n in (4, 5, 6, 7) if len(word) > n]]


class Reader(dict):
    """Terms of a token, plain and restored; made on first use. Tokens of up to CACHED_LENGTH
    letters are kept, until they hold CACHED_LETTERS letters together."""

    def __init__(self, model: CharacterModel, wanted: dict[str, int] | None = None):
        super().__init__()
        self.model, self.wanted, self.letters = model, wanted, 0

    def __missing__(self, token: str) -> tuple:
        words = [w.lower() for w in _WORD.findall(token)]
        # Marks at the ends may be punctuation or letters: read both ways.
        for core in {token.strip(_EDGES), token.strip(_OUTER)}:
            if len(core) > 2 and is_disguised(core):
                words += restore(core, self.model).split()
        found = {t for w in words if w for t in terms_of(w)}
        value = tuple(found) if self.wanted is None else tuple(self.wanted[t] for t in found if t in self.wanted)
        if len(token) <= CACHED_LENGTH:
            if self.letters >= CACHED_LETTERS:
                self.clear()
                self.letters = 0
            self[token] = value
            self.letters += len(token)
        return value

    def terms(self, text: str) -> set:
        out: set = set()
        for token in set(text.split()):
            out.update(self[token])
        for spaced in _SPACED.findall(text):
            if _WORD.search(spaced):
                out.update(self[_BLANKS.sub("-", spaced)])
        return out


def language_model(df: DataFrame, text: str = "text") -> CharacterModel:
    """Counts all texts; at most one row per letter sequence reaches the driver."""
    prepared(df.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total, held, size = _fold_table(), np.zeros(_GRAMS, np.int64), [], 0
        for batch in batches:
            for value in batch.column("text").to_pylist():
                held.append(value)
                size += len(value)
                if size >= _COUNTED:
                    total += count_sequences(held, table)
                    held, size = [], 0
        total += count_sequences(held, table)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["gram", "n"])

    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = rows.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(_GRAMS, np.int64)
    for row in counted:
        counts[row["gram"]] = row["n"]
    return CharacterModel(counts)


def _association(a: float, b: float, n_a: float, n_b: float) -> float:
    """Likelihood ratio of a term in a of n_a and b of n_b documents."""

    def entropy(k: float, n: float, p: float) -> float:
        return sum(x * math.log(x / y) for x, y in ((k, n * p), (n - k, n * (1 - p))) if x > 0 and y > 0)

    p = (a + b) / (n_a + n_b)
    return entropy(a, n_a, p) + entropy(b, n_b, p)


def _telling_terms(sample: DataFrame, model, n_pos: int, n_neg: int, limit: int) -> list[str]:
    """The terms that tell the classes apart best, by documents that hold them."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, counts = Reader(model.value), (Counter(), Counter())
        for batch in batches:
            for value, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                counts[int(label)].update(reader.terms(value))
        names = list(counts[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([counts[1][t] for t in names], pa.int64()), pa.array([counts[0][t] for t in names], pa.int64())],
            names=["term", "pos", "neg"],
        )
        rest = [t for t in counts[0] if t not in counts[1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([counts[0][t] for t in rest], pa.int64())],
            names=["term", "pos", "neg"],
        )

    found = (
        sample.select("text", "label").mapInArrow(count, "term string, pos long, neg long")
        .groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where(F.col("pos") * n_neg > F.col("neg") * n_pos).where("pos >= 3")
        .orderBy(F.desc(F.col("pos") - F.col("neg") * (n_pos / n_neg)), "term").limit(20 * limit)
        .collect()
    )
    ranked = sorted(found, key=lambda r: (-_association(r["pos"], r["neg"], n_pos, n_neg), r["term"]))
    return [r["term"] for r in ranked[:limit]]


def classify(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    key: str = "doc_id",
    text: str = "text",
    held_out: tuple[int, int] = (5, 0),
    threshold: float = 0.5,
    max_labelled: int = MAX_LABELLED,
    terms: int = TERMS,
) -> DataFrame:
    """``key, held_out, score, predicted`` for each row. Labels are learnt only from rows whose
    crc32 of the id, as text, leaves another remainder than ``held_out`` (divisor, remainder)."""
    spark = prepared(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    divisor, remainder = held_out
    aside = F.coalesce(F.crc32(F.col("key").cast("string").cast("binary")) % divisor == remainder, F.lit(False))
    model = spark.sparkContext.broadcast(language_model(rows, "text"))

    known = (
        labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("key").isNotNull() & ~aside)
        .orderBy(F.xxhash64("key"), "key", "label")
        .limit(max_labelled)
    )
    sample = materialise(rows.join(materialise(known, "known-labels"), "key").select("text", "label"), "labelled-texts")
    n, positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).head()
    chosen: list[str] = []
    if 0 < positive < n:
        chosen = _telling_terms(sample, model, positive, n - positive, terms)
    if not chosen:
        mean = F.lit((positive + 0.5) / (n + 1.0))
        return rows.select(F.col("key").alias(key), aside.alias("held_out"), mean.alias("score")).withColumn(
            "predicted", (F.col("score") >= threshold).cast("int")
        )
    numbered = {term: i for i, term in enumerate(chosen)}
    labelled = _found(sample.select(F.col("label").alias("key"), "text"), model, numbered, "int")
    indicators = F.array(*[F.array_contains("found", i).cast("double") for i in range(len(chosen))])
    fitted = LogisticRegression(regParam=RIDGE, standardization=False, maxIter=100, labelCol="label").fit(
        materialise(labelled.select(F.col("key").cast("double").alias("label"), array_to_vector(indicators).alias("features")), "terms")
    )
    weights, intercept = fitted.coefficients.toArray().tolist(), float(fitted.intercept)
    kind = docs.schema[key].dataType.simpleString()
    weighed = _found(rows, model, numbered, kind, weights)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("weight") + intercept)))
    return weighed.select(F.col("key").alias(key), aside.alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def _found(rows: DataFrame, model, numbered: dict[str, int], kind: str, weights: list[float] | None = None) -> DataFrame:
    """``key, found``: the chosen terms in each text, or ``key, weight``: the sum of their weights."""

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.value, numbered)
        for batch in batches:
            found = [sorted(reader.terms(t)) for t in batch.column("text").to_pylist()]
            if weights is None:
                value = pa.array(found, pa.list_(pa.int32()))
            else:
                value = pa.array([float(sum(weights[i] for i in f)) for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), value], names=["key", name])

    name = "found" if weights is None else "weight"
    out = "array<int>" if weights is None else "double"
    return rows.select("key", "text").mapInArrow(look, f"key {kind}, {name} {out}")
