"""Query registry: key -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    note: str = ""


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, note: str = ""):
    def deco(fn):
        if name in REGISTRY:
            raise KeyError(f"duplicate query key {name}")
        REGISTRY[name] = Entry(name, fn, sql, note)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    # importing the modules fills the registry
    import importlib
    for m in ("q_search", "q_segments", "q_relations", "q_text", "q_extract", "q_mutate", "q_vector", "q_versions", "q_jobs"):
        importlib.import_module(f"{__package__}.{m}")
    return REGISTRY
