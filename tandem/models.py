"""Extension points for models, how they run inside tasks, and offline built-ins."""

from __future__ import annotations

import hashlib
import itertools
import sys
import time
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tandem.functions.cells import as_column
from tandem.functions.text import distinct_tokens, token_jaccard


class Embedder(Protocol):
    width: int

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        """One row per text."""


class PairScorer(Protocol):
    def score(self, queries: Sequence[str], texts: Sequence[str]) -> Sequence[float | None]:
        """One relevance score per (query, text) pair."""


class Judge(Protocol):
    def reply(self, system_prompt: str, prompt: str, max_tokens: int) -> str:
        """The model's answer to one prompt."""


# Characters whose terms are counted at a time.
CHUNK_CHARS = 1 << 22


# Terms whose hash a task remembers.
KNOWN_TERMS = 1 << 18


class _Hashes(dict):
    """The first four bytes of a term's MD5 as a number, worked out once per term."""

    def __missing__(self, term: str) -> int:
        digest = hashlib.md5(term.encode(), usedforsecurity=False).digest()
        number = self[term] = int.from_bytes(digest[:4], "big")
        return number


class HashedTermEmbedder:
    """Offline embedder: term frequencies hashed into ``width`` buckets, unit length.

    A bucket is the first eight hex digits of the term's MD5 modulo the width. Text is
    expected in lower case, as ``embed_column`` passes it.
    """

    def __init__(self, width: int = 256):
        self.width = width
        self.hashes, self.letters = _Hashes(), None

    def __getstate__(self) -> dict:
        # What was worked out here does not travel.
        return self.__dict__ | {"hashes": _Hashes(), "letters": None}

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        texts = [text or "" for text in texts]
        counts = np.zeros((len(texts), self.width))
        chunk = np.cumsum([len(text) for text in texts]) // CHUNK_CHARS
        for start, stop in itertools.pairwise(np.r_[0, np.flatnonzero(np.diff(chunk)) + 1, len(texts)]):
            counts[start:stop] = self._counts(texts[start:stop])
        lengths = np.linalg.norm(counts, axis=1, keepdims=True)
        return np.divide(counts, lengths, out=counts, where=lengths > 0)

    def _counts(self, texts: list[str]) -> np.ndarray:
        """Terms of each text by bucket; a term's bucket is worked out once for all texts."""
        if self.letters is None:  # for every code point whether it is a letter or a digit
            self.letters = np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        if len(self.hashes) > KNOWN_TERMS:
            self.hashes.clear()
        letters = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = self.letters[letters]
        starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
        if not len(starts):
            return np.zeros((len(texts), self.width))
        plain = np.where(inside, letters, ord(" ")).astype(np.uint32).tobytes().decode("utf-32-le").strip(" ")
        terms = pc.ascii_split_whitespace(pa.array([plain], pa.large_string())).flatten().dictionary_encode()
        distinct = terms.dictionary.to_numpy(zero_copy_only=False)
        buckets = np.fromiter(map(self.hashes.__getitem__, distinct), np.int64, len(distinct)) % self.width
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
        found = np.bincount(text * self.width + buckets[terms.indices.to_numpy()], minlength=len(texts) * self.width)
        return found.reshape(len(texts), self.width)


def embed_column(text: Column | str, embedder: Embedder, lowercase: bool = True) -> Column:
    """Vector of a text, computed in Arrow batches on the executors."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(np.asarray(embedder.embed(batch.fillna("").tolist()), dtype=np.float64)))

    # Not deterministic as far as the optimizer is concerned: a filter on the vector must
    # not make it call the model a second time.
    return embed.asNondeterministic()(F.lower(as_column(text)) if lowercase else as_column(text))


def score_column(query: Column | str, text: Column | str, scorer: PairScorer) -> Column:
    """Pair score from a model; a missing single score is 0. Where the model fails on a batch,
    each query of the batch is tried alone, and only those it fails on are scored null, so the
    caller falls back for them to the score it already has."""

    def scored(queries: list[str], texts: list[str]) -> list[float]:
        return [0.0 if s is None else float(s) for s in scorer.score(queries, texts)]

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in batches:
            asked, found = queries.fillna("").tolist(), texts.fillna("").tolist()
            try:
                out: list[float | None] = list(scored(asked, found))
            except Exception:  # some query of the batch
                out = [None] * len(asked)
                for rows in pd.Series(asked).groupby(asked, sort=False).indices.values():
                    try:
                        values = scored([asked[i] for i in rows], [found[i] for i in rows])
                    except Exception:  # any model failure means "no score"
                        continue
                    for i, value in zip(rows, values):
                        out[i] = value
            yield pd.Series(out, dtype="float64")

    return score.asNondeterministic()(as_column(query), as_column(text))


def overlap_score(
    pairs: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str
) -> DataFrame:
    """Built-in pair scorer: token overlap, entirely on the JVM.

    ``left`` and ``right`` hold ``(key, text)``. Every text that occurs in a pair is split
    into its tokens once, where it is stored, not once per pair. A missing text is empty.
    """

    def split(texts: DataFrame, key: str, to: str) -> DataFrame:
        used = texts.join(pairs.select(key).distinct(), key, "left_semi")
        return used.select(key, distinct_tokens("text").alias(to))

    none = F.array().cast("array<string>")
    joined = pairs.join(split(left, left_key, "__l"), left_key, "left").join(
        split(right, right_key, "__r"), right_key, "left"
    )
    score = token_jaccard(F.coalesce("__l", none), F.coalesce("__r", none))
    return joined.withColumn(name, score).drop("__l", "__r")


def model_tasks(pairs: DataFrame, *keys: str) -> DataFrame:
    """Spread model calls over all cores: the rows are few but each one is slow."""
    return pairs.repartition(pairs.sparkSession.sparkContext.defaultParallelism, *keys)


class Throttle:
    """Spaces calls evenly: at most ``per_minute`` starts a minute, 0 means no limit."""

    def __init__(self, per_minute: float):
        self.gap = 60.0 / per_minute if per_minute > 0 else 0.0
        self.last: float | None = None

    def wait(self) -> None:
        now = time.monotonic()
        if self.gap and self.last is not None and now - self.last < self.gap:
            time.sleep(self.gap - (now - self.last))
        self.last = time.monotonic()
