"""Registered queries with their ANSI-SQL counterparts, by area."""

from __future__ import annotations

import importlib
import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AREAS = ("prepare", "retrieval", "compare", "review", "profile", "cluster", "stream")


def register(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        key = name or query.__name__
        QUERIES[key] = query
        if sql is not None:
            ORACLES[key] = sql
        return query

    return add


def load_all() -> None:
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
