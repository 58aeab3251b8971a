"""Substring predicates: wildcard patterns, escaped text, row and cluster filters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tandem.functions.cells import as_column, cell_text, quoted

# Default limits on user-supplied filters; each is a parameter where it applies.
MAX_CLUSTER_FILTERS = 10
MAX_CLUSTER_VALUES = 100
MAX_REVIEW_TEXT = 500

# A backslash before a wildcard or a backslash quotes it; before any other character it
# only stands for that character.
_QUOTED = r"(?s)(\\[%_\\])|\\(.)"


def wildcard_pattern(text: Column | str) -> Column:
    """``%text%`` for ``like``; ``%`` and ``_`` in the text stay wildcards."""
    body = F.lit(text) if isinstance(text, str) else text
    return F.regexp_replace(F.concat(F.lit("%"), body, F.lit("%")), _QUOTED, "$1$2")


def ilike_contains(c: Column | str, text: Column | str) -> Column:
    """Case-insensitive substring match; ``%`` and ``_`` in the text stay wildcards."""
    if isinstance(text, str):
        fixed = re.sub(_QUOTED, lambda m: m[1] or m[2], f"%{text}%")
        return as_column(c).ilike(fixed)
    return F.ilike(as_column(c), wildcard_pattern(text))


def text_contains(c: Column | str, text: str) -> Column:
    """Case-insensitive substring match of the literal text."""
    return F.contains(F.lower(F.coalesce(as_column(c), F.lit(""))), F.lower(F.lit(text)))


@dataclass(frozen=True)
class RowFilter:
    column: str
    op: str = "contains"
    value: str | None = None

    @property
    def target(self) -> str:
        return self.column.strip()

    @property
    def needle(self) -> str:
        return (self.value or "").strip()


@dataclass(frozen=True)
class _Operator:
    """What a row-filter operator tests on a cell text, and what it asks of its value."""

    test: Callable[[Column, str], Column]
    takes_text: bool = False
    takes_pattern: bool = False

    def fault(self, needle: str) -> str | None:
        if (self.takes_text or self.takes_pattern) and not needle:
            return "has nothing to look for"
        if self.takes_pattern and (reason := pattern_fault(needle)):
            return f"has a pattern that does not compile ({reason})"
        return None


def _contains(cell: Column, needle: str) -> Column:
    return F.contains(F.lower(cell), F.lower(F.lit(needle)))


def _same(cell: Column, needle: str) -> Column:
    return F.lower(cell) == F.lower(F.lit(needle))


# The operator names.
ROW_FILTERS: Mapping[str, _Operator] = {
    "empty": _Operator(lambda cell, _: cell == ""),
    "not_empty": _Operator(lambda cell, _: cell != ""),
    "contains": _Operator(_contains, takes_text=True),
    "not_contains": _Operator(lambda cell, needle: ~_contains(cell, needle), takes_text=True),
    "equals": _Operator(_same),
    "not_equals": _Operator(lambda cell, needle: ~_same(cell, needle)),
    "regex": _Operator(lambda cell, needle: F.regexp_like(cell, F.lit(needle)), takes_pattern=True),
}


def pattern_fault(pattern: str) -> str | None:
    """Why the engine that runs the pattern refuses it; None if it compiles."""
    java = SparkSession.active().sparkContext._jvm.java.util.regex
    try:
        java.Pattern.compile(pattern)
    except Exception as e:
        return str(getattr(e, "java_exception", e)).splitlines()[0]
    return None


def _operator(f: RowFilter) -> _Operator | None:
    return ROW_FILTERS.get(f.op.strip().lower())


def row_filter(filters: Sequence[RowFilter], columns: Iterable[str]) -> Column:
    """All filters must hold; an unknown column or operator, or a pattern that does not
    compile, keeps no row."""
    known = set(columns)

    def predicate(f: RowFilter) -> Column:
        operator = _operator(f)
        if operator is None or f.target not in known:
            return F.lit(False)
        if operator.takes_pattern and pattern_fault(f.needle):
            return F.lit(False)
        return operator.test(cell_text(quoted(f.target)), f.needle)

    return reduce(and_, map(predicate, filters), F.lit(True))


def require_valid(filters: Sequence[RowFilter], columns: Iterable[str]) -> None:
    """Raises on the first filter that could not do what it says."""
    known = set(columns)
    for position, f in enumerate(filters, start=1):
        operator = _operator(f)
        reason = None if f.target in known else "names a column that the table lacks"
        if reason is None and operator is not None:
            reason = operator.fault(f.needle)
        if reason:
            raise ValueError(f"row filter {position} on {f.column!r} {reason}")


@dataclass(frozen=True)
class ClusterFilter:
    """Any of the values within one column. Blank values and repeats do not count."""

    column: str
    values: tuple[str, ...]

    @classmethod
    def of(cls, column: str, values: Iterable[object]) -> ClusterFilter:
        wanted: dict[str, None] = {}
        for value in values:
            text = "" if value is None else str(value).strip()
            if text:
                wanted[text] = None
        return cls(column.strip(), tuple(wanted))

    def __bool__(self) -> bool:
        return bool(self.column and self.values)

    def predicate(self) -> Column:
        return reduce(or_, [ilike_contains(quoted(self.column), v) for v in self.values])


def cluster_filters(
    filters: Iterable[tuple[str, Sequence[str]]],
    columns: Iterable[str],
    max_columns: int = MAX_CLUSTER_FILTERS,
    max_values: int = MAX_CLUSTER_VALUES,
) -> list[ClusterFilter]:
    """Filters that ask for something; the last one on a column counts."""
    last = {f.column: f for f in (ClusterFilter.of(*pair) for pair in filters) if f}
    strangers = last.keys() - set(columns)
    if strangers:
        raise ValueError(f"the table has no column {', '.join(sorted(strangers))}")
    n_values = sum(len(f.values) for f in last.values())
    if len(last) > max_columns or n_values > max_values:
        raise ValueError(
            f"{len(last)} columns and {n_values} values to filter by; {max_columns} and {max_values} are allowed"
        )
    return list(last.values())


def cluster_filter(filters: Iterable[ClusterFilter]) -> Column:
    """Any value within a column, every column."""
    return reduce(and_, [f.predicate() for f in filters], F.lit(True))
