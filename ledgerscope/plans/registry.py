"""Registry of named queries: id -> (spark builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    build: Builder
    sql: str | None


_REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query id {name}")
        _REGISTRY[name] = Entry(name, fn, sql)
        return fn
    return deco


def entries() -> dict[str, Entry]:
    return dict(_REGISTRY)
