"""Byte-level BPE as a monoid: halves are encoded apart and joined at their boundary.

A token sequence is the BPE encoding of its bytes exactly when every two neighbours are the
encoding of their own concatenation (van Antwerpen, Neubeck: "So many tokens, so little
time", 2024). So when two encodings are joined, only a window around the boundary has to be
encoded again; once the tokens at the window's edges are compatible with the untouched
tokens next to them, nothing outside the window can change and the join is done. Otherwise
the window grows on the side that does not fit yet. Decoding is the plain homomorphism: the
bytes of two halves, concatenated.

Texts are first cut at spaces that stand between two visible characters. The splitting
pattern starts a new match at each of them, so the pieces are independent, and a cache holds
the ids of pieces seen before.

Results: null text encodes as the empty text, the empty text as no ids. Repeated rows are
encoded alike. Extra columns are passed through.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm.common import prepared

LEAF_BYTES = 24
LEAF_TOKENS = 4096
CACHED_PIECES = 800_000
CACHED_LENGTH = 24
_NONE = 1 << 62
# White space of Unicode (fixed values), as the splitting pattern sees it.
_SPACES = frozenset(
    [*map(chr, range(9, 14)), " ", "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B))]
    + ["\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
)


class BytePairs:
    """Encoder and decoder over a rank table. Travels as its ranks; caches start empty."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self._start()

    @classmethod
    def read(cls, path: str, pattern: str) -> BytePairs:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines)
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def _start(self) -> None:
        import regex

        self.token_bytes = {rank: token for token, rank in self.ranks.items()}
        self._find = regex.compile(self.pattern).findall
        self._fits: dict[tuple[int, int], bool] = {}
        self._pieces = _Cache(self._piece_ids)
        self._chunks = _Cache(self._chunk_ids)

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    # --- one piece ---

    def merged(self, piece: bytes) -> list[int]:
        """The encoding by definition: merge the pair of lowest rank, leftmost first."""
        ranks = self.ranks
        if len(piece) > 4 * LEAF_BYTES:
            return self._merged_long(piece)
        cuts = list(range(len(piece) + 1))
        open_ranks = [ranks.get(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
        while open_ranks:
            best = min(open_ranks)
            if best == _NONE:
                break
            i = open_ranks.index(best)
            del cuts[i + 1], open_ranks[i]
            if i < len(open_ranks):
                open_ranks[i] = ranks.get(piece[cuts[i] : cuts[i + 2]], _NONE)
            if i:
                open_ranks[i - 1] = ranks.get(piece[cuts[i - 1] : cuts[i + 1]], _NONE)
        return [ranks[piece[i:j]] for i, j in zip(cuts, cuts[1:])]

    def _merged_long(self, piece: bytes) -> list[int]:
        """The same over a heap of pairs, for windows that had to grow far."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        before, alive = list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n:
                rank = ranks.get(piece[i : end[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def fits(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens stay as they are."""
        known = self._fits.get((left, right))
        if known is None:
            known = self.merged(self.token_bytes[left] + self.token_bytes[right]) == [left, right]
            self._fits[left, right] = known
        return known

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encodings' concatenated bytes."""
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        back, ahead = 1, 1
        while True:
            i, j = max(0, len(left) - back), min(len(right), ahead)
            window = self.merged(self.decoded(left[i:] + right[:j]))
            left_ok = i == 0 or self.fits(left[i - 1], window[0])
            right_ok = j == len(right) or self.fits(window[-1], right[j])
            if left_ok and right_ok:
                return left[:i] + window + right[j:]
            back, ahead = back * (1 if left_ok else 2), ahead * (1 if right_ok else 2)

    def encoded(self, piece: bytes) -> list[int]:
        """The encoding of one piece by halves."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        if len(piece) <= LEAF_BYTES:
            return self.merged(piece)
        half = len(piece) // 2
        return self.joined(self.encoded(piece[:half]), self.encoded(piece[half:]))

    # --- whole texts ---

    def _piece_ids(self, piece: str) -> bytes:
        return np.array(self.encoded(piece.encode()), dtype="<u4").tobytes()

    def _chunk_ids(self, chunk: str) -> bytes:
        return b"".join([self._pieces[piece] for piece in self._find(chunk)])

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        chunks = self._chunks
        return b"".join([chunks[c] for c in independent_chunks(text)])

    def decoded(self, ids: list[int]) -> bytes:
        """Bytes of ids, concatenated up a tree."""
        if len(ids) <= LEAF_TOKENS:
            table = self.token_bytes
            return b"".join([table[i] for i in ids])
        half = len(ids) // 2
        return self.decoded(ids[:half]) + self.decoded(ids[half:])


class _Cache(dict):
    """Values made on first use. When full it starts afresh, so memory stays bounded."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, key):
        value = self._make(key)
        if len(key) <= CACHED_LENGTH and "\n" not in key:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[key] = value
        return value


def independent_chunks(text: str) -> list[str]:
    """Cuts before each space between two visible characters, where a match always starts."""
    if not text:
        return []
    parts = text.split(" ")
    spaces = _SPACES.intersection(text)
    plain = spaces <= {" ", "\n"} and not (
        "  " in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n"
    )
    if plain:
        return [parts[0], *[" " + p for p in parts[1:]]]
    chunks, current = [], parts[0]
    for part in parts[1:]:
        if part and current and part[0] not in _SPACES and current[-1] not in _SPACES:
            chunks.append(current)
            current = " " + part
        else:
            current += " " + part
    return [*chunks, current]


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def encode(df: DataFrame, pairs: BytePairs, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of each whole text as an array column."""
    shared = prepared(df.sparkSession).sparkContext.broadcast(pairs)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids_of(texts: pd.Series) -> pd.Series:
        codec = shared.value
        return texts.map(lambda t: np.frombuffer(codec.packed(t), dtype="<u4").astype("int32"))

    return df.withColumn(ids, ids_of(_text(text)))


def decode(df: DataFrame, pairs: BytePairs, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes of each id array; a null array decodes to no bytes."""
    shared = prepared(df.sparkSession).sparkContext.broadcast(pairs)

    @F.pandas_udf(T.BinaryType())
    def bytes_of(arrays: pd.Series) -> pd.Series:
        codec = shared.value
        return arrays.map(lambda a: b"" if a is None else codec.decoded(list(a)))

    return df.withColumn(out, bytes_of(F.col(ids)))


def round_trip(df: DataFrame, pairs: BytePairs, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes each text, decodes the ids, and returns digests of both:
    ``key, n_tokens, ids_sha256, decoded_sha256``. Ids stay in the task that made them."""
    shared = prepared(df.sparkSession).sparkContext.broadcast(pairs)

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            counts, id_digests, byte_digests = [], [], []
            for value in batch.column("text").to_pylist():
                packed = codec.packed(value)
                counts.append(len(packed) // 4)
                id_digests.append(hashlib.sha256(packed).hexdigest())
                ids = np.frombuffer(packed, dtype="<u4").tolist()
                byte_digests.append(hashlib.sha256(codec.decoded(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()),
                 pa.array(byte_digests, pa.string())],
                names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), _text(text).alias("text"))
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(digests, schema).withColumnRenamed("key", key)
