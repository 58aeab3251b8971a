"""Repair of conversation structure by a shortest-path program over runs of equal rows.

A conversation should read as an optional system row and then pairs of a user and an assistant
row. Every row has a symbol: the first letter of its role and its first fault (blank, repeated,
cut short). The cheapest edits (keep, give another role, delete, insert an empty row) form a
min-plus product of one 4 x 4 transition per row over the states start, after system, after user
and after assistant. Equal consecutive symbols are one run, a run of n rows advances through the
binary powers of its transition, which are kept for all conversations, and the choices stored
with the powers are unrolled to the audit. Equal costs are settled by the audit that sorts first.

1. Equal rows of a conversation and turn are counted together, and the first place of every
   (conversation, role, text) is found by aggregation. Texts stay where they are; 16 bytes of
   their SHA-256 stand for them in comparisons of this step and in the order of rows of one turn.
2. Rows and first places are sorted over ranges, so a conversation of any share of all rows is
   spread over tasks, and each task sends the runs of its part.
3. The runs of each conversation meet, at most one per row, and give its audit.
4. The texts meet behind their audit, sorted, and stream through it; nothing of a conversation
   but its audit is held. One hash over all texts of a conversation needs them in one task.

Results: null roles and texts are one space; rows without a turn come first, rows of one turn go
by role, then by the text's hash. A role that starts with none of s, u, a (the empty one too)
cannot be kept. Rows without a conversation id form one conversation. Extra columns are ignored,
an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import prepared
from tandem.session import materialise

# Costs of the edits (fixed values).
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
KEPT_ROLES = "sua"
LEGAL_PAIRS = ("su", "ua", "au")
FAULTS = ("", "truncated", "blank", "duplicate")
WHITE_SPACE = " \t\n\x0b\x0c\r"
# Runs of one row of the second step; a longer part of a conversation takes several.
PIECE_RUNS = 1 << 16

START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
_FAR = 1 << 60


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text`` with the faults of the exercise, dealt by the row's checksum."""
    filled = {name: F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in (conv, turn, role, text)}
    die = F.crc32(F.concat(filled[conv], F.lit(":"), filled[turn]).cast("binary")) % 20
    rows = df.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.when(die == 4, F.lit("user")).otherwise(filled[role]).alias("role"),
        F.when(die == 1, F.lit("")).when(die == 2, F.translate(filled[text], ".!?", "")).otherwise(filled[text]).alias("text"),
        F.when(die == 0, 0).when(die == 3, 2).otherwise(1).alias("times"),
    )
    return rows.withColumn("time", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("time", "times")


def _step(symbol: str) -> list[list[tuple[int, str]]]:
    """Cheapest way, and its edits, from each state to each other over one row: insertions
    before it, then an edit of the row."""
    letter, fault = symbol[0], FAULTS[int(symbol[1])]
    extra = CUT_SHORT if fault == "truncated" else 0
    ways = [[(_FAR, "")] * 4 for _ in range(4)]

    def offer(p: int, q: int, cost: int, edits: str) -> None:
        ways[p][q] = min(ways[p][q], (cost, edits))

    for p in range(4):
        at = p
        for inserted in range(4):
            cost, edits = inserted * INSERT, "I" * inserted
            offer(p, at, cost + DELETE, edits + "D")
            if fault not in ("blank", "duplicate"):
                after = _NEXT[at]
                offer(p, after, cost + REROLE + extra, edits + "R")
                if letter == "s" and at == START:
                    offer(p, SYSTEM, cost + extra, edits + "K")
                elif letter in "ua" and letter == _ROLE[after][0]:
                    offer(p, after, cost + extra, edits + "K")
            at = _NEXT[at]
    return ways


@lru_cache(maxsize=1024)
def power(symbol: str, k: int) -> list[list[tuple[int, str]]]:
    """The transition of 2^k equal rows."""
    if k == 0:
        return _step(symbol)
    half = power(symbol, k - 1)

    def joined(p: int, q: int) -> tuple[int, str]:
        cost = min(half[p][m][0] + half[m][q][0] for m in range(4))
        if cost >= _FAR:
            return _FAR, ""
        return cost, min(half[p][m][1] + half[m][q][1] for m in range(4) if half[p][m][0] + half[m][q][0] == cost)

    return [[joined(p, q) for q in range(4)] for p in range(4)]


def _simple(symbol: str) -> str:
    """What the edits depend on: rows that have to go are alike, whatever their role."""
    return "-2" if symbol[1] in "23" else symbol


def cheapest(runs: Iterable[tuple[str, int]]) -> tuple[int, str]:
    """Cost and audit of a conversation given as runs of symbols."""
    merged: list[tuple[str, int]] = []
    for symbol, n in runs:
        symbol = _simple(symbol)
        if merged and merged[-1][0] == symbol:
            n += merged.pop()[1]
        merged.append((symbol, n))
    parts = [(symbol, k) for symbol, n in merged for k in range(n.bit_length()) if n >> k & 1]
    # Cost from each state to the end, before each part.
    left = [[_CLOSING[p] * INSERT for p in range(4)]]
    for symbol, k in reversed(parts):
        after, ways = left[-1], power(symbol, k)
        left.append([min(ways[p][q][0] + after[q] for q in range(4)) for p in range(4)])
    left.reverse()
    state, audit = START, []
    for (symbol, k), before, after in zip(parts, left, left[1:]):
        ways = power(symbol, k)[state]
        edits, state = min((ways[q][1], q) for q in range(4) if ways[q][0] + after[q] == before[state])
        audit.append(edits)
    return left[0][START], "".join(audit) + "I" * _CLOSING[state]


@lru_cache(maxsize=65_536)
def _cheapest_short(runs: tuple[tuple[str, int], ...]) -> tuple[int, str]:
    return cheapest(runs)


def counts(runs: list[tuple[str, int]]) -> tuple[int, int, int, int]:
    """Blank, repeated and cut-short rows, and pairs of neighbours that should not meet."""
    by_fault = [0] * 4
    illegal, last = 0, None
    for symbol, n in runs:
        by_fault[int(symbol[1])] += n
        illegal += n - 1 + (last is not None and last + symbol[0] not in LEGAL_PAIRS)
        last = symbol[0]
    return by_fault[2], by_fault[3], by_fault[1], illegal


def _symbol_letter(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin(*KEPT_ROLES), first).otherwise(F.lit("-"))


def _fault(text: Column) -> Column:
    """Number of the fault that the text itself shows."""
    body = F.rtrim(text, F.lit(WHITE_SPACE))
    return F.when(body == "", 2).when(F.substring(body, -1, 1).isin(".", "!", "?"), 0).otherwise(1)


_PIECE = "symbols string, lengths array<long>, first_turn long, last_turn long, turns long, task int, number long"


def _pieces(rows: DataFrame, kind: str) -> DataFrame:
    """Runs of the sorted rows, a row per conversation and task (or per PIECE_RUNS runs)."""

    def collapse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        none = object()
        conv, runs, turns, number = none, [], [None, None, 0], 0
        first_at, done = None, []

        def close() -> None:
            nonlocal runs, turns, number
            if runs:
                symbols, lengths = "".join(s for s, _ in runs), [n for _, n in runs]
                done.append((conv, symbols, lengths, *turns, task, number))
                number += 1
            runs, turns = [], [None, None, 0]

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "digest", "letter", "fault", "n")]
            for c, turn, role, digest, letter, fault, n in zip(*columns):
                if c != conv or conv is none:
                    close()
                    conv = c
                if n is None:  # the first place of this role and text
                    first_at = (c, turn, role, digest)
                    continue
                if len(runs) >= PIECE_RUNS:
                    close()
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
                repeated = n if first_at != (c, turn, role, digest) else n - 1
                for part, many in ((f"{letter}{fault}", n - repeated), (f"{letter}{fault if fault == 2 else 3}", repeated)):
                    if many:
                        if runs and runs[-1][0] == part:
                            many += runs.pop()[1]
                        runs.append((part, many))
            yield from _emit(done)
        close()
        yield from _emit(done)

    def _emit(done: list[tuple]) -> Iterator[pa.RecordBatch]:
        if done:
            names = ["conv", "symbols", "lengths", "first_turn", "last_turn", "turns", "task", "number"]
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done)))), schema=schema)
            done.clear()

    schema = pa.schema([
        ("conv", _arrow(rows, "conv")), ("symbols", pa.string()), ("lengths", pa.list_(pa.int64())), ("first_turn", pa.int64()),
        ("last_turn", pa.int64()), ("turns", pa.int64()), ("task", pa.int32()), ("number", pa.int64()),
    ])
    return rows.mapInArrow(collapse, f"conv {kind}, {_PIECE}")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


_FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _audits(pieces: DataFrame, kind: str) -> DataFrame:
    """One row per conversation from its pieces in order: the counts, cost and audit."""
    schema = pa.schema([("conv", _arrow(pieces, "conv")), *[(f, pa.int64()) for f in _FACTS], ("audit", pa.string())])

    def settle(conv, parts: list[tuple]) -> tuple:
        runs: list[tuple[str, int]] = []
        low = high = None
        turns = 0
        for symbols, lengths, first_turn, last_turn, n_turns in parts:
            if symbols is None:
                continue
            runs += zip(map("".join, zip(symbols[0::2], symbols[1::2])), lengths)
            if first_turn is not None:
                turns += n_turns - (first_turn == high)
                low, high = first_turn if low is None else low, last_turn
        joined: list[tuple[str, int]] = []
        for symbol, n in runs:
            if joined and joined[-1][0] == symbol:
                n += joined.pop()[1]
            joined.append((symbol, n))
        cost, audit = _cheapest_short(tuple(joined)) if len(joined) <= 16 else cheapest(joined)
        gaps = 0 if low is None else high - low + 1 - turns
        return (conv, gaps, *counts(joined), cost, audit)

    def settle_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, parts, done = None, [], []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("conv", "symbols", "lengths", "first_turn", "last_turn", "turns")]):
                if parts and row[0] != conv:
                    done.append(settle(conv, parts))
                    parts = []
                conv = row[0]
                parts.append(row[1:])
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*done)))), schema=schema)
                done = []
        if parts:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, [[v] for v in settle(conv, parts)])), schema=schema)

    sorted_pieces = pieces.repartition("conv").sortWithinPartitions("conv", "task", "number")
    return sorted_pieces.mapInArrow(settle_all, f"conv {kind}, {', '.join(f + ' long' for f in _FACTS)}, audit string")


class _Reader:
    """Follows one audit along the rows of its conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = _NEXT[self.state]
            yield _ROLE[self.state], "", "I"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """The rows that stand for this one in the repaired conversation."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        if edit == "K" and role[0] == "s":
            self.state = SYSTEM
        else:
            self.state = _NEXT[self.state]
        yield _ROLE[self.state] if edit == "R" else role, text, edit


def _followed(audits: DataFrame, rows: DataFrame) -> DataFrame:
    """Audit rows, each before the sorted texts of its conversation."""
    heads = audits.withColumns({
        "kind": F.lit(0), "turn": F.lit(None).cast("long"), "role": F.lit(None).cast("string"),
        "digest": F.lit(None).cast("binary"), "text": F.lit(None).cast("string")})
    bodies = rows.withColumns({**{f: F.lit(None).cast("long") for f in _FACTS}, "audit": F.lit(None).cast("string"), "kind": F.lit(1)})
    return heads.unionByName(bodies.select(*heads.columns)).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest")


def _prepared_rows(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Rows with the hash of their text, and the audits of all conversations."""
    kind = rows.schema["conv"].dataType.simpleString()
    hashed = rows.withColumn("digest", F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16))
    keys = ["conv", "turn", "role", "digest"]
    keyed = materialise(hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(_fault(F.col("text"))).alias("fault")), "turns")
    first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    places = keyed.groupBy("conv", "role", "digest").agg(first.alias("first")).select(
        "conv", F.col("first.turn").alias("turn"), "role", "digest", F.lit(None).cast("long").alias("n"), F.lit(None).cast("int").alias("fault"))
    both = keyed.select(*keys, "n", "fault").unionByName(places).withColumn("letter", _symbol_letter(F.col("role")))
    ordered = both.repartitionByRange(*keys).sortWithinPartitions(*keys, F.col("n").asc_nulls_first())
    pieces = _pieces(ordered, kind)
    empty = convs.select("conv").distinct().select(
        "conv", *[F.lit(None).cast(t).alias(c) for c, t in (field.split() for field in _PIECE.split(", "))])
    return hashed, _audits(pieces.unionByName(empty), kind), kind


def repair_report(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conversation of ``convs`` (column ``conv``): ``conv, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256``. ``rows``: ``conv, turn, role, text``."""
    prepared(rows.sparkSession)
    hashed, audits, kind = _prepared_rows(rows, convs)
    schema = pa.schema([
        ("conv", _arrow(rows, "conv")), *[(f, pa.int64()) for f in _FACTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = reader = digest = None
        done: list[tuple] = []
        mark = b""

        def add(made: Iterator[tuple[str, str, str]]) -> None:
            nonlocal mark
            for role, text, _ in made:
                digest.update(mark + f"{role}:{text}".encode())
                mark = b"\n"

        def close() -> None:
            if head is not None:
                add(reader.inserted())
                done.append((*head, digest.hexdigest()))

        for batch in batches:
            for kind_, role, text, *facts in zip(*[batch.column(c).to_pylist() for c in ("kind", "role", "text", "conv", *_FACTS, "audit")]):
                if kind_ == 0:
                    close()
                    head, reader, digest, mark = facts, _Reader(facts[-1]), hashlib.sha256(), b""
                else:
                    add(reader.row(role, text))
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*done)))), schema=schema)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*done)))), schema=schema)

    return _followed(audits, hashed).mapInArrow(
        read, f"conv {kind}, {', '.join(f + ' long' for f in _FACTS)}, audit string, repaired_sha256 string")


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: ``conv, position, role, text, edit``."""
    prepared(rows.sparkSession)
    hashed, audits, kind = _prepared_rows(rows, rows)
    schema = pa.schema([
        ("conv", _arrow(rows, "conv")), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = reader = None
        position = 0

        def numbered(made: Iterator[tuple[str, str, str]]) -> Iterator[tuple]:
            nonlocal position
            for row in made:
                yield (conv, position, *row)
                position += 1

        def packed(done: list[tuple]) -> Iterator[pa.RecordBatch]:
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*done)))), schema=schema)

        for batch in batches:
            done: list[tuple] = []
            for kind_, c, role, text, audit in zip(*[batch.column(c).to_pylist() for c in ("kind", "conv", "role", "text", "audit")]):
                if kind_ == 0:
                    if reader is not None:
                        done += numbered(reader.inserted())
                    conv, reader, position = c, _Reader(audit), 0
                else:
                    done += numbered(reader.row(role, text))
            yield from packed(done)
        if reader is not None:
            yield from packed(list(numbered(reader.inserted())))

    return _followed(audits, hashed).mapInArrow(read, f"conv {kind}, position long, role string, text string, edit string")


def damaged_repairs(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The report of every conversation of ``df`` after the damage of the exercise."""
    report = repair_report(damaged(df, conv, turn, role, text), df.select(F.col(conv).alias("conv")))
    return report.withColumnRenamed("conv", conv)
