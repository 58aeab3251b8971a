"""Removal of repeated passages by a distributed merge sort of suffixes.

A byte is removed when a string of L bytes that covers it also starts earlier (in a smaller
document, or earlier in the same one). Which starts repeat is read off the sorted order of
suffixes with their common-prefix lengths. Sorting the suffix at every byte would move a
hundred times the corpus, so the sort is made sparse without becoming inexact:

1. Anchors. Among the K-grams of each L-byte string the one with the smallest hash (leftmost
   on ties) is its anchor. Equal strings have equal anchors at equal places, so strings only have
   to be compared where their anchors agree. An anchor serves a run of consecutive starts;
   the run's context is the text from its first start to the end of its last string. Runs
   are dealt by anchor hash as (anchor, context) hashes. Of runs with one context all but
   the first are repeats as a whole. Anchors with one context are done; first runs whose
   anchor has several contexts are contested.
2. Sort. Contested runs leave each task as sorted runs of the suffixes at their anchors,
   front-coded (length shared with the suffix before, then the rest), with the bytes left of
   the anchor beside them. A loser tree merges the runs; it knows how much each candidate
   shares with the last winner, compares those lengths first, and reads bytes only beyond
   them. The merged order comes with the common-prefix lengths of neighbours.
3. Classes. Two strings with anchor offset o are equal when the suffixes at their anchors
   share L - o bytes, a stretch of the merged order without a smaller common prefix, and the
   texts left of them share o bytes, a stretch of the order of the left parts. For each o the
   first of each class stays and the others are repeats.

An anchor with more than HOT contexts (the edge of a passage that very many documents share)
is not left to one task: its runs are split into their single strings, each a suffix of its
own, dealt by its content. Copies of a whole text meet only by digest, and only the first
one takes part in the sort.

Results: null text counts as empty. Rows that repeat an id and text are one document; rows
that repeat an id with other texts are documents of their own, ordered by a hash of the text.
A null id sorts first. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm.common import join_hot, prepared
from tandem.session import materialise

LENGTH = 100
K = 32
HOT = 20_000
PART_BYTES = 32 << 20
_WINDOWS = 1 << 20
_POSITION_BITS = 24
_NO_ID = -(1 << 63)

_RUN = np.dtype(
    [("key", "<u8"), ("context", "<u8"), ("doc", "<u4"), ("low", "<u4"), ("span", "u1"), ("offset", "u1")]
)
_MARK = np.dtype([("low", "<u4"), ("span", "u1"), ("offset", "u1"), ("state", "u1")])
_REPEAT, _CONTESTED, _CONTESTED_HOT = 0, 1, 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Scanner:
    """Anchored runs of a buffer of concatenated texts."""

    def __init__(self, length: int, k: int):
        self.length, self.k = length, k
        size = _WINDOWS + length
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        one = np.ones(1, np.uint64)
        self.powers = np.cumprod(np.append(one, np.full(size, base, np.uint64)))
        self.inverse = np.cumprod(np.append(one, np.full(size, inverse, np.uint64)))
        self.letters = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base)) | np.uint64(1)

    def runs(self, buffer: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Runs of the texts ``buffer[starts[i]:starts[i + 1]]``, with positions in the text."""
        found = []
        for low in range(0, max(0, len(buffer) - self.length + 1), _WINDOWS):
            found.append(self._slice(buffer, starts, low))
        return np.concatenate(found) if found else np.empty(0, _RUN)

    def _slice(self, buffer: np.ndarray, starts: np.ndarray, low: int) -> np.ndarray:
        length, k = self.length, self.k
        part = buffer[low : low + _WINDOWS + length - 1]
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.letters[part] * self.powers[:n], out=sums[1:])
        grams = _mixed((sums[k:] - sums[:-k]) * self.inverse[: n - k + 1])
        position_mask = np.uint64((1 << _POSITION_BITS) - 1)
        least = (grams & ~position_mask) | np.arange(len(grams), dtype=np.uint64)
        width, have = length - k + 1, 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        ends = starts[1:]
        first = np.searchsorted(starts, low, side="right") - 1
        last = np.searchsorted(starts, low + len(least) - 1, side="right") - 1
        docs = np.arange(first, last + 1)
        # Starts of whole strings, text by text.
        from_ = np.maximum(starts[docs], low)
        to = np.minimum(ends[docs] - length + 1, low + len(least))
        keep = to > from_
        docs, from_, to = docs[keep], from_[keep] - low, to[keep] - low
        if not len(docs):
            return np.empty(0, _RUN)
        change = np.zeros(len(least) + 1, bool)
        change[1:-1] = least[1:] != least[:-1]
        change[from_] = True
        change[to] = True
        inside = np.zeros(len(least) + 1, np.int32)
        np.add.at(inside, from_, 1)
        np.add.at(inside, to, -1)
        inside = np.cumsum(inside) > 0
        cuts = np.flatnonzero(change | np.append(np.zeros(len(least), bool), True))
        lows = cuts[:-1]
        highs = cuts[1:] - 1
        live = inside[lows]
        lows, highs = lows[live], highs[live]
        anchors = (least[lows] & position_mask).astype(np.int64)
        out = np.empty(len(lows), _RUN)
        spans = highs - lows
        out["key"] = grams[anchors]
        context = (sums[highs + length] - sums[lows]) * self.inverse[lows]
        out["context"] = _mixed(context + (spans * 256 + anchors - lows).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        doc = docs[np.searchsorted(from_, lows, side="right") - 1]
        out["doc"] = doc
        out["low"] = lows + low - starts[doc]
        out["span"] = spans
        out["offset"] = anchors - lows
        return out


def _first_of(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Whether each element, in the given order, starts a new combination of columns."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for column in columns:
        sorted_column = column[order]
        new[1:] |= sorted_column[1:] != sorted_column[:-1]
    return new


# --- step 1: runs by anchor and context ---------------------------------------------------


def _pack_runs(docs: np.ndarray, runs: np.ndarray, repeats: np.ndarray) -> bytes:
    """Runs, runs known as repeats, and the documents they name, as one value."""
    used, places = np.unique(np.concatenate([runs["doc"], repeats["doc"]]), return_inverse=True)
    runs, repeats = runs.copy(), repeats.copy()
    runs["doc"], repeats["doc"] = places[: len(runs)], places[len(runs) :]
    head = np.array([len(used), len(runs), len(repeats)], "<u4")
    small = np.empty(len(repeats), np.dtype([("doc", "<u4"), ("low", "<u4"), ("span", "u1")]))
    for name in small.dtype.names:
        small[name] = repeats[name]
    # Column by column: the hashes do not compress, the rest does.
    columns = [np.ascontiguousarray(runs[name]).tobytes() for name in _RUN.names]
    return b"".join([head.tobytes(), docs[used].tobytes(), small.tobytes(), *columns])


def _unpack_runs(value: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n_docs, n_runs, n_repeats = (int(x) for x in np.frombuffer(value, "<u4", 3))
    at = 12
    docs = np.frombuffer(value, "<i8", 2 * n_docs, at).reshape(-1, 2)
    at += 16 * n_docs
    kind = np.dtype([("doc", "<u4"), ("low", "<u4"), ("span", "u1")])
    repeats = np.frombuffer(value, kind, n_repeats, at)
    at += kind.itemsize * n_repeats
    runs = np.empty(n_runs, _RUN)
    for name in _RUN.names:
        column = _RUN[name]
        runs[name] = np.frombuffer(value, column, n_runs, at)
        at += column.itemsize * n_runs
    return docs, runs, repeats


def _scan(parts: int, length: int, k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner(length, k)
        docs, found, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            named = np.concatenate(docs)
            runs = np.concatenate(found)
            order = np.lexsort((runs["low"], named[runs["doc"], 1], named[runs["doc"], 0], runs["context"], runs["key"]))
            new = _first_of(order, runs["key"], runs["context"])
            same = np.zeros(len(order), bool)
            if len(order):
                same[1:] = (runs["low"][order][1:] == runs["low"][order][:-1]) & (
                    named[runs["doc"][order][1:]] == named[runs["doc"][order][:-1]]
                ).all(axis=1)
            kept, repeats = runs[order[new]], runs[order[~new & ~same]]
            part_of_kept = (kept["key"] % np.uint64(parts)).astype(np.int64)
            part_of_repeat = (repeats["key"] % np.uint64(parts)).astype(np.int64)
            numbers, values = [], []
            for part in range(parts):
                mine, theirs = kept[part_of_kept == part], repeats[part_of_repeat == part]
                if len(mine) or len(theirs):
                    numbers.append(part)
                    values.append(_pack_runs(named, mine, theirs))
            docs.clear()
            found.clear()
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(values, pa.binary())], names=["part", "value"])

        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text")
            raw = texts.cast(pa.binary())
            sizes = np.array([len(t) for t in raw.to_pylist()], np.int64)
            buffer = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            runs = scanner.runs(buffer, starts)
            runs["doc"] += sum(map(len, docs))
            docs.append(np.stack([batch.column("key").to_numpy(), batch.column("text_hash").to_numpy()], axis=1))
            found.append(runs)
            held += len(buffer)
            if held >= PART_BYTES:
                yield from flush()
                held = 0
        if docs:
            yield from flush()

    return scan


def _marks_table(docs: np.ndarray, owner: np.ndarray, marks: np.ndarray) -> pa.Table:
    """One row per document: its marks."""
    order = np.lexsort((marks["low"], owner))
    owner, marks = owner[order], marks[order]
    cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.empty(0, np.int64)
    ends = np.append(cuts[1:], len(owner)) if len(owner) else cuts
    named = docs[owner[cuts]] if len(cuts) else np.empty((0, 2), np.int64)
    return pa.table(
        {
            "key": pa.array(named[:, 0], pa.int64()),
            "text_hash": pa.array(named[:, 1], pa.int64()),
            "marks": pa.array([marks[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
        }
    )


def _settle(hot: int) -> Callable[[pa.Table], pa.Table]:
    """Marks of the runs that repeat as a whole and of the contested ones."""

    def settle(rows: pa.Table) -> pa.Table:
        unpacked = [_unpack_runs(v) for v in rows.column("value").to_pylist()]
        shift = np.cumsum([0, *[len(d) for d, _, _ in unpacked]])
        docs = np.concatenate([d for d, _, _ in unpacked])
        runs = np.concatenate([r for _, r, _ in unpacked])
        known = np.concatenate([r for _, _, r in unpacked])
        owner = np.concatenate([r["doc"].astype(np.int64) + s for (_, r, _), s in zip(unpacked, shift)])
        known_owner = np.concatenate([r["doc"].astype(np.int64) + s for (_, _, r), s in zip(unpacked, shift)])
        order = np.lexsort((runs["low"], docs[owner, 1], docs[owner, 0], runs["context"], runs["key"]))
        new = _first_of(order, runs["key"], runs["context"])
        new_key = _first_of(order, runs["key"])
        group = np.cumsum(new_key) - 1
        contexts = np.bincount(group, weights=new).astype(np.int64)[group] if len(order) else np.empty(0, np.int64)
        at_first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
        first = order[at_first]
        itself = (docs[owner[order]] == docs[owner[first]]).all(axis=1) & (runs["low"][order] == runs["low"][first])
        repeat, contested = ~new & ~itself, new & (contexts > 1)
        chosen = order[repeat | contested]
        marks = np.zeros(len(chosen) + len(known), _MARK)
        for name in ("low", "span", "offset"):
            marks[name][: len(chosen)] = runs[name][chosen]
        states = np.where(contexts > hot, _CONTESTED_HOT, _CONTESTED)
        marks["state"][: len(chosen)] = np.where(contested, states, _REPEAT)[repeat | contested]
        for name in ("low", "span"):
            marks[name][len(chosen) :] = known[name]
        return _marks_table(docs, np.concatenate([owner[chosen], known_owner]), marks)

    return settle


# --- step 2: front-coded sorted runs and their merge ---------------------------------------


def front_coded(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted suffixes: the length shared with the one before, and what follows it."""
    shared, rests, before = [], [], b""
    for suffix in suffixes:
        n = _common_prefix(before, suffix, 0)
        shared.append(n)
        rests.append(suffix[n:])
        before = suffix
    return shared, rests


def _common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


class _Run:
    """A front-coded sorted run, read suffix by suffix."""

    __slots__ = ("shared", "rests", "at", "suffix")

    def __init__(self, shared: list[int], rests: list[bytes]):
        self.shared, self.rests, self.at, self.suffix = shared, rests, 0, rests[0]

    def advance(self) -> int:
        """Steps on; the length shared with the suffix just left, or -1 at the end."""
        self.at += 1
        if self.at == len(self.rests):
            return -1
        shared = self.shared[self.at]
        self.suffix = self.suffix[:shared] + self.rests[self.at]
        return shared


def merge_runs(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, bytes, int]]:
    """Merges front-coded sorted runs: (run, place in it, suffix, length shared with the one
    before). Ties are given in any order.

    Every candidate carries the length it shares with the last winner, or with the winner
    that beat it, which is the same when they next meet. A longer share is smaller; on equal
    shares bytes are compared from there on, so no known prefix is read again."""
    streams = [_Run(*run) for run in runs]
    k = 1
    while k < len(streams):
        k *= 2
    losers = [(-1, -1)] * k  # (run, shared), run -1: empty

    def play(a: tuple[int, int], b: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """Winner and loser, the loser with the length it shares with the winner."""
        if a[0] < 0:
            return b, a
        if b[0] < 0:
            return a, b
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        x, y = streams[a[0]].suffix, streams[b[0]].suffix
        shared = _common_prefix(x, y, a[1])
        if x[shared:] <= y[shared:]:
            return a, (b[0], shared)
        return b, (a[0], shared)

    def build(node: int) -> tuple[int, int]:
        if node >= k:
            run = node - k
            return (run, 0) if run < len(streams) else (-1, -1)
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else ((0, 0) if streams else (-1, -1))
    while winner[0] >= 0:
        run, shared = winner
        stream = streams[run]
        yield run, stream.at, stream.suffix, shared
        step = stream.advance()
        candidate = (run, step) if step >= 0 else (-1, -1)
        node = (run + k) // 2
        while node:
            candidate, losers[node] = play(candidate, losers[node])
            node //= 2
        winner = candidate


_ITEM = np.dtype([("doc", "<u4"), ("anchor", "<u4"), ("least", "u1"), ("most", "u1"), ("left", "u1"), ("shared", "u1"), ("rest", "u1")])


def _emit_runs(parts: int, length: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Front-coded sorted runs of the suffixes at contested anchors, one per part and task."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple[int, int]] = []
        items: list[list[tuple[bytes, bytes, int, int, int, int]]] = [[] for _ in range(parts)]
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            numbers, values = [], []
            named = np.array(docs, np.int64).reshape(-1, 2)
            for part, mine in enumerate(items):
                if mine:
                    numbers.append(part)
                    values.append(_pack_items(named, mine))
                    mine.clear()
            docs.clear()
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(values, pa.binary())], names=["part", "value"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("key", "text_hash", "text", "marks"))
            for key, text_hash, text, values in zip(*columns):
                marks = np.frombuffer(b"".join(values), _MARK)
                marks = marks[marks["state"] != _REPEAT]
                if not len(marks):
                    continue
                raw, doc = text.encode(), len(docs)
                docs.append((key, text_hash))
                for low, span, offset, state in marks.tolist():
                    if state == _CONTESTED_HOT:
                        for start in range(low, low + span + 1):
                            string = raw[start : start + length]
                            items[_deal(string, parts)].append((string, b"", doc, start, 0, 0))
                            held += length
                    else:
                        anchor = low + offset
                        right, left = raw[anchor : low + span + length], raw[low:anchor][::-1]
                        least = max(0, offset - span)
                        items[_deal(right[:K], parts)].append((right, left, doc, anchor, least, offset))
                        held += len(right) + len(left)
            if held >= PART_BYTES:
                yield from flush()
                held = 0
        if docs:
            yield from flush()

    return emit


def _deal(content: bytes, parts: int) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little") % parts


def _pack_items(docs: np.ndarray, items: list[tuple[bytes, bytes, int, int, int, int]]) -> bytes:
    items = sorted(items)
    shared, rests = front_coded([item[0] for item in items])
    table = np.empty(len(items), _ITEM)
    owner = np.array([item[2] for item in items])
    used, table["doc"] = np.unique(owner, return_inverse=True)
    for at, name in ((3, "anchor"), (4, "least"), (5, "most")):
        table[name] = [item[at] for item in items]
    table["left"] = [len(item[1]) for item in items]
    table["shared"], table["rest"] = shared, [len(r) for r in rests]
    head = np.array([len(used), len(items)], "<u4")
    return b"".join([head.tobytes(), docs[used].tobytes(), table.tobytes(), *rests, *[item[1] for item in items]])


def _unpack_items(value: bytes) -> tuple[np.ndarray, np.ndarray, list[int], list[bytes], list[bytes]]:
    n_docs, n = (int(x) for x in np.frombuffer(value, "<u4", 2))
    docs = np.frombuffer(value, "<i8", 2 * n_docs, 8).reshape(-1, 2)
    at = 8 + 16 * n_docs
    table = np.frombuffer(value, _ITEM, n, at)
    at += _ITEM.itemsize * n

    def cut(lengths: np.ndarray) -> list[bytes]:
        nonlocal at
        out = []
        for size in lengths.tolist():
            out.append(value[at : at + size])
            at += size
        return out

    rests = cut(table["rest"])
    return docs, table, table["shared"].tolist(), rests, cut(table["left"])


def _neighbour_shares(strings: list[bytes]) -> np.ndarray:
    """Common-prefix lengths of neighbours in a sorted list; 0 for the first."""
    out = np.zeros(len(strings), np.int64)
    for i in range(1, len(strings)):
        out[i] = _common_prefix(strings[i - 1], strings[i], 0)
    return out


def _classify(length: int) -> Callable[[pa.Table], pa.Table]:
    """Merges the runs of a part and marks every string that also starts earlier."""

    def classify(rows: pa.Table) -> pa.Table:
        unpacked = [_unpack_items(v) for v in rows.column("value").to_pylist()]
        shift = np.cumsum([0, *[len(d) for d, *_ in unpacked]])
        docs = np.concatenate([u[0] for u in unpacked])
        places, shares = [], []
        base = np.cumsum([0, *[len(u[1]) for u in unpacked]]).tolist()
        for run, at, _, shared in merge_runs([(u[2], u[3]) for u in unpacked]):
            places.append(base[run] + at)
            shares.append(shared)
        places = np.array(places, np.int64)
        shares = np.array(shares, np.int64)
        table = np.concatenate([u[1] for u in unpacked])[places]
        owner = np.concatenate([u[1]["doc"].astype(np.int64) + s for u, s in zip(unpacked, shift)])[places]
        lefts = [left for u in unpacked for left in u[4]]
        lefts = [lefts[i] for i in places.tolist()]

        by_left = np.array(sorted(range(len(lefts)), key=lefts.__getitem__), np.int64)
        left_shares = _neighbour_shares([lefts[i] for i in by_left.tolist()])
        # Rows from the earliest to the latest start.
        by_start = np.lexsort((table["anchor"], docs[owner, 1], docs[owner, 0]))
        marks, owners = [], []
        for offset in range(length):
            live = by_start[(table["least"][by_start] <= offset) & (table["most"][by_start] >= offset)]
            if not len(live):
                continue
            right_class = np.cumsum(shares < length - offset)
            left_class = np.empty(len(lefts), np.int64)
            left_class[by_left] = np.cumsum(left_shares < offset)
            both = right_class[live] * (len(lefts) + 1) + left_class[live]
            _, first, inverse = np.unique(both, return_index=True, return_inverse=True)
            leader = live[first[inverse]]
            starts = table["anchor"].astype(np.int64) - offset
            itself = (docs[owner[live]] == docs[owner[leader]]).all(axis=1) & (starts[live] == starts[leader])
            repeated = live[~itself]
            made = np.zeros(len(repeated), _MARK)
            made["low"] = starts[repeated]
            marks.append(made)
            owners.append(owner[repeated])
        if not marks:
            return _marks_table(docs, np.empty(0, np.int64), np.empty(0, _MARK))
        return _marks_table(docs, np.concatenate(owners), np.concatenate(marks))

    return classify


# --- the whole operator ---------------------------------------------------------------------


def removed_spans(marks: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal removed stretches of a text from the marks of its repeats."""
    repeats = np.sort(marks[marks["state"] == _REPEAT], order="low")
    spans: list[tuple[int, int]] = []
    for low, span in zip(repeats["low"].tolist(), repeats["span"].tolist()):
        end = low + span + length
        if spans and low <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], end))
        else:
            spans.append((low, end))
    return spans


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for low, end in spans:
        out.append(raw[at:low])
        at = end
    return b"".join([*out, raw[at:]])


def repeated_spans(
    df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT
) -> DataFrame:
    """``key, row, text, copy_of, marks`` for each row: where its text repeats earlier text, as
    packed marks for ``removed_spans``; ``copy_of`` is the first document with the same text, or
    null where it is this one or the text is shorter than ``length`` bytes; ``row`` holds the
    row's other columns as ``columns`` and whether it has no text."""
    if not K <= length < 256:
        raise ValueError(f"length must be from {K} to 255 bytes")
    prepared(df.sparkSession)
    whole = df.select(
        F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.struct(
            F.struct(F.col(text).isNull().alias(text), *[F.col(f"`{c}`") for c in df.columns if c != text]).alias("columns"),
            F.col(text).isNull().alias("no_text"),
        ).alias("row"),
    ).withColumn("text_hash", F.xxhash64("text"))
    rows = whole.select("key", "text", "text_hash")
    long_rows = rows.where(F.octet_length("text") >= length)
    names = materialise(
        long_rows.select(
            "key", "text_hash", F.octet_length("text").cast("long").alias("size"),
            F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        ),
        "texts",
    )
    total = names.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).head()
    parts = max(8, total["size"] // PART_BYTES)
    groups = materialise(
        names.groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies"
    )
    copies = (
        join_hot(names, groups, "digest", "n", total["n"])
        .where(F.col("key") != F.col("first"))
        .select("key", "text_hash", F.col("first").alias("copy_of"))
        .distinct()
    )
    copies = materialise(copies, "copies-of")
    sources = long_rows.join(copies, ["key", "text_hash"], "left_anti").select("key", "text_hash", "text")
    marks_schema = "key long, text_hash long, marks binary"
    runs = sources.mapInArrow(_scan(parts, length, K), "part long, value binary")
    marks = materialise(runs.groupBy("part").applyInArrow(_settle(hot), marks_schema), "repeats")
    gathered = marks.groupBy("key", "text_hash").agg(F.collect_list("marks").alias("marks"))
    coded = rows.join(gathered, ["key", "text_hash"]).mapInArrow(_emit_runs(parts, length), "part long, value binary")
    more = materialise(coded.groupBy("part").applyInArrow(_classify(length), marks_schema), "contested")
    every = marks.unionByName(more).groupBy("key", "text_hash").agg(F.collect_list("marks").alias("marks"))
    found = every.join(copies, ["key", "text_hash"], "full")
    return whole.join(found, ["key", "text_hash"], "left").select(
        F.when(F.col("key") != _NO_ID, F.col("key")).alias("key"), "row", "text", "copy_of", "marks"
    )


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` for each row."""
    return _cut(repeated_spans(df, key, text, length).drop("row"), length, "key").withColumnRenamed("key", key)


def kept_texts(
    df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, facts: str = "cut"
) -> DataFrame:
    """The columns of ``df`` with the text less its repeats (and less the parts of characters
    that a cut goes through), and the struct ``facts`` with ``n_bytes, n_removed``; it needs a name
    that is not in use. A null text stays null."""
    if facts.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column {facts} already")
    cut = _cut(repeated_spans(df, key, text, length), length, "row", with_text=True)
    kept = F.when(~F.col("row.no_text"), F.col("kept_text")).alias(text)
    columns = [kept if c == text else F.col(f"row.columns.`{c}`").alias(c) for c in df.columns]
    return cut.select(*columns, F.struct("n_bytes", "n_removed").alias(facts))


def _cut(spans: DataFrame, length: int, carried: str, with_text: bool = False) -> DataFrame:
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for value, copy_of, marks in zip(*(batch.column(c).to_pylist() for c in ("text", "copy_of", "marks"))):
                raw = value.encode()
                stretches = [(0, len(raw))] if copy_of is not None else []
                if not stretches and marks:
                    stretches = removed_spans(np.frombuffer(b"".join(marks), _MARK), length)
                kept = kept_bytes(raw, stretches)
                facts = [len(raw), len(raw) - len(kept), len(stretches), hashlib.sha256(kept).hexdigest()]
                made.append([*facts, kept.decode(errors="ignore")] if with_text else facts)
            columns = list(zip(*made)) if made else [[]] * len(names)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(carried), *arrays], names=[carried, *names])

    schema = T.StructType([spans.schema[carried]])
    for name in names:
        schema = schema.add(name, "long" if name.startswith("n_") else "string")
    return spans.mapInArrow(cut, schema)
