"""Hierarchical multi-length packing of tokenised documents.

Every document's ids (its tokens, then one end id) are cut and routed to context-size tiers,
the longest window and its halves. A document longer than the longest window first gives
full windows of its own; what remains belongs to the smallest tier that holds it. Each tier
is packed from the longest down: an item opens a window of its tier, whole shorter items
fill the gap (the longest that fits first), and one more item is cut to close it exactly;
the cut's rest falls to its own tier. Windows are therefore full in every tier. Items
shorter than half the shortest tier only fill gaps, and what is left of them shares
windows of the longest length; one window per pack group may end up short.

Windows are dealt to steps of equal token budget: a step holds windows of one length where
enough exist, and mixed lengths only at the end of a group.

Pack groups are dealt by a hash of id and text, a few thousand documents each, so the number
of tasks grows with the input while the padding, less than a window per group, stays a
fraction of a per mille.

The tokenizer's added tokens are found within texts, as its own call finds them.

Results: null text counts as empty and yields the end id alone. Repeated rows are packed one
by one. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import string
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import prepared

CONTEXT = 2048
TIERS = (2048, 1024, 512, 256)
END_ID = 1
GROUP_DOCUMENTS = 4096
STEP_TOKENS = 32_768
CACHED_WORDS = 1_200_000

# Words of printable ASCII and Latin-1 letters: no normalisation rule joins two of them, and lower
# case maps letter by letter. All others go through the library.
_SIMPLE = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_MARKS = string.punctuation
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")
# A piece beyond this many bytes goes through the library as well.
_LONGEST_PIECE = 48
_NEVER = np.int64(1) << 62


class Merges:
    """The merge table of a tokenizers file, for many pieces of text at once.

    In each round every piece joins its leftmost pair of least rank, all pieces in one pass over
    their symbols; pieces without a pair to join are done and leave."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        names = _byte_names()
        self.inner = np.array([vocabulary[n] for n in names], np.int64)
        self.final = np.array([vocabulary[n + suffix] for n in names], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocabulary[x] << 32 | vocabulary[y] for x, y in pairs], np.int64)
        made = np.array([vocabulary[x + y] for x, y in pairs], np.int64)
        # An open table with a quarter of its places taken; later rules for a pair win.
        self.mask = (1 << (4 * len(keys)).bit_length()) - 1
        self.keys, self.ranks, self.made = (np.full(self.mask + 1, v, np.int64) for v in (-1, _NEVER, 0))
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._home(keys).tolist())):
            while self.keys[at] not in (-1, key):
                at = at + 1 & self.mask
            self.keys[at], self.ranks[at], self.made[at] = key, rank, made[rank]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).view(np.int64) & self.mask

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """The table's place of each pair, or an empty one."""
        at = self._home(keys)
        held = self.keys[at]
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & self.mask
            held = self.keys[at[open_]]
            open_ = open_[(held != keys[open_]) & (held >= 0)]
        return at

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece (none is empty) as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        letters = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.inner[letters]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.final[letters[ends]]
        of = np.repeat(np.arange(len(pieces)), lengths)
        done_symbols, done_of = [], []
        while len(symbols):
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            places = self._places(symbols[:-1] << 32 | symbols[1:])
            ranks = np.append(np.where(of[1:] == of[:-1], self.ranks[places], _NEVER), _NEVER)
            # Rank first, then position: the leftmost of the least.
            least = np.minimum.reduceat(np.where(ranks < _NEVER, ranks << 32 | np.arange(len(ranks)), _NEVER), starts)
            joins = least < _NEVER
            at = least[joins] & 0xFFFFFFFF
            symbols[at] = self.made[places[at]]
            keep = np.repeat(joins, np.diff(np.append(starts, len(symbols))))
            done_symbols.append(symbols[~keep])
            done_of.append(of[~keep])
            keep[at + 1] = False
            symbols, of = symbols[keep], of[keep]
        of, symbols = np.concatenate(done_of), np.concatenate(done_symbols)
        packed = symbols[np.argsort(of, kind="stable")].astype("<u4").tobytes()
        cuts = 4 * np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(pieces)))])
        return [packed[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


def _byte_names() -> list[str]:
    """The character that stands for each byte in the vocabulary of a byte-level tokenizer: the
    printable ones for themselves, the others for code points from 256 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class WordTokens:
    """Ids of whole texts by a tokenizers file that drops white space: words are independent,
    so each distinct word is encoded once per worker.

    Simple words are split by the file's own pattern and joined by its merge table, many at a
    time; all others, and added tokens within texts, go through the library."""

    def __init__(self, definition: str):
        import regex
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(definition)
        parts = json.loads(definition)
        model = parts["model"]
        self._merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self._split = regex.compile(parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        added = [re.escape(t["content"]) for t in parts["added_tokens"]]
        self._added = re.compile("|".join(added)) if added else None
        self._words: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        made = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in made]

    def _learn(self, words: set[str]) -> None:
        """Ids of new words, from the ids of their pieces where that is exact."""
        if len(self._words) + len(words) > CACHED_WORDS:
            self._words.clear()
            self._pieces.clear()
        split, odd = {}, []
        for word in words:
            letters = word.rstrip(_MARKS)
            if not _SIMPLE.fullmatch(word):
                odd.append(word)
            elif letters.isalpha():
                split[word] = (letters.lower(), word[len(letters) :])
            else:
                split[word] = self._split.findall(word.lower())
        known = self._pieces
        known[""] = b""
        new = {p for pieces in split.values() for p in pieces if p not in known}
        plain = [p for p in new if len(p) * 2 <= _LONGEST_PIECE]
        long = [p for p in new if len(p) * 2 > _LONGEST_PIECE]
        if plain:
            known.update(zip(plain, self._merges.encode([p.encode() for p in plain])))
        known.update(zip(long, self._encoded(long)))
        self._words.update((word, b"".join([known[p] for p in pieces])) for word, pieces in split.items())
        self._words.update(zip(odd, self._encoded(odd)))

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        # Texts with an added token or a separator that only one side takes for white space.
        whole = {
            i for i, t in enumerate(texts) if _ODD_SPACE.search(t) or (self._added is not None and self._added.search(t))
        }
        split = [[] if i in whole else t.split() for i, t in enumerate(texts)]
        out: list[bytes] = []
        start = 0
        while start < len(texts):
            # As many texts as leave the cache room for their words.
            end, new = start, set()
            while end < len(texts) and (end == start or len(new) < CACHED_WORDS // 4):
                new |= set(split[end]).difference(self._words)
                end += 1
            if len(self._words) + len(new) > CACHED_WORDS:
                new = set().union(*split[start:end])
            if new:
                self._learn(new)
            ids_of = self._words.__getitem__
            for i in range(start, end):
                out.append(self._encoded([texts[i]])[0] if i in whole else b"".join(map(ids_of, split[i])))
            start = end
        return out


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Packs items of at most ``tiers[0]`` ids; windows as lists of (item, start, length).

    Every window is full to one of the tiers' lengths, but for at most one."""
    longest, shortest = tiers[0], tiers[-1]
    pool = sorted((n, i, 0) for i, n in enumerate(lengths) if n)
    windows = []

    def fill(window: list[tuple[int, int, int]], gap: int) -> None:
        while gap and pool:
            at = bisect_right(pool, (gap, len(lengths), longest)) - 1
            if at >= 0:
                n, item, start = pool.pop(at)
            else:  # all are longer: the shortest is cut
                n, item, start = pool.pop(0)
                insort(pool, (n - gap, item, start + gap))
                n = gap
            window.append((item, start, n))
            gap -= n

    while pool and pool[-1][0] > shortest // 2:
        n, item, start = pool.pop()
        window = [(item, start, n)]
        fill(window, next(t for t in reversed(tiers) if t >= n) - n)
        windows.append(window)
    while pool:
        windows.append([])
        fill(windows[-1], longest)
    return windows


def steps(window_lengths: list[int], budget: int) -> list[int]:
    """A step for each window, longest windows first, so that all steps but the last hold
    exactly ``budget`` ids when the lengths are powers of two below it."""
    order = sorted(range(len(window_lengths)), key=lambda i: -window_lengths[i])
    step, used, out = 0, 0, [0] * len(window_lengths)
    for i in order:
        if used + window_lengths[i] > budget:
            step, used = step + 1, 0
        out[i] = step
        used += window_lengths[i]
    return out


_TOKENS = pa.schema(
    [("pack_group", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
     ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]
)


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def pack_documents(
    df: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    group_documents: int = GROUP_DOCUMENTS,
    step_tokens: int = STEP_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """Packs by a tokenizers file, given as its content. One row per piece: ``key, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, window, step_id`` and, if asked, the piece's ``ids``
    as little-endian 32-bit integers."""
    if any(a != 2 * b for a, b in zip(tiers, tiers[1:])):
        raise ValueError("each tier must be half of the one before")
    spark = prepared(df.sparkSession)
    # A worker keeps the tokenizer and what it has learnt with the broadcast value.
    shared = spark.sparkContext.broadcast({"definition": tokenizer})
    longest = tiers[0]
    end = np.array([end_id], dtype="<u4").tobytes()
    groups = max(1, df.count() // group_documents)
    kind = df.schema[key].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Full windows with their checksum, and what remains with its ids. Ids below 2^16
        travel in two bytes."""
        held = shared.value
        if "tokens" not in held:
            held["tokens"] = WordTokens(held["definition"])
        for batch in batches:
            rows, taken = [], []
            packed = held["tokens"].packed(batch.column("text").to_pylist())
            for i, (ids, group) in enumerate(zip(packed, batch.column("pack_group").to_pylist())):
                ids += end
                n = len(ids) // 4
                whole = n - n % longest
                for start in range(0, whole, longest):
                    piece = ids[4 * start : 4 * (start + longest)]
                    kept = _narrow(piece) if with_ids else None
                    rows.append((group, start, longest, zlib.crc32(piece), n, kept))
                    taken.append(i)
                if whole < n:
                    rows.append((group, whole, n - whole, None, n, _narrow(ids[4 * whole :])))
                    taken.append(i)
            columns = zip(*rows) if rows else [[] for _ in _TOKENS]
            arrays = [pa.array(list(c), f.type) for c, f in zip(columns, _TOKENS)]
            keys = batch.column("key").take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *arrays], names=["key", *_TOKENS.names])

    def pack_group(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("start", "ascending")])
        table = rows.to_pydict()
        group = table["pack_group"][0]
        open_items = [i for i, crc in enumerate(table["ids_crc32"]) if crc is None]
        full = [[(i, 0, longest)] for i, crc in enumerate(table["ids_crc32"]) if crc is not None]
        packed = pack([table["length"][i] for i in open_items], tiers)
        windows = full + [[(open_items[i], s, n) for i, s, n in w] for w in packed]
        sizes = [sum(n for _, _, n in w) for w in windows]
        padded = [s if s & (s - 1) == 0 else longest for s in sizes]
        taken, made = [], []
        for local, (window, step) in enumerate(zip(windows, steps(padded, step_tokens))):
            offset = 0
            for item, start, n in window:
                crc, ids = table["ids_crc32"][item], None
                if crc is None or with_ids:
                    ids = _wide(table["ids"][item], start, n)
                    crc = zlib.crc32(ids)
                made.append(
                    (table["start"][item] + start, n, crc, table["doc_tokens"][item],
                     (group << 32) + local, offset, padded[local], (group << 32) + step,
                     ids if with_ids else None)
                )
                taken.append(item)
                offset += n
        names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_id"]
        arrays = [pa.array(c, pa.int64()) for c in list(zip(*made))[:8]]
        keys = rows.column("key").take(pa.array(taken, pa.int64()))
        ids = pa.array([m[8] for m in made], pa.binary())
        return pa.table([keys, *arrays, ids], names=["key", *names, "ids"])

    rows = df.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(groups)).alias("pack_group"),
    )
    pieces = rows.mapInArrow(
        cut,
        f"key {kind}, pack_group long, start long, length long, ids_crc32 long, doc_tokens long, ids binary",
    )
    packed = pieces.groupBy("pack_group").applyInArrow(
        pack_group,
        f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long,"
        " offset long, window long, step_id long, ids binary",
    )
    out = packed.withColumnRenamed("key", key)
    return out if with_ids else out.drop("ids")


def _narrow(ids: bytes) -> bytes:
    """Two bytes an id where all fit, marked by a leading byte."""
    wide = np.frombuffer(ids, dtype="<u4")
    if wide.size and wide.max() >= 1 << 16:
        return b"\x04" + ids
    return b"\x02" + wide.astype("<u2").tobytes()


def _wide(stored: bytes, start: int, length: int) -> bytes:
    size = stored[0]
    piece = stored[1 + size * start : 1 + size * (start + length)]
    return np.frombuffer(piece, dtype=f"<u{size}").astype("<u4").tobytes()
