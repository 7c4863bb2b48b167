"""Query registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Run
    sql: str | None
    covers: str  # ids of the operator inventory


ENTRIES: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``run(spark, sf_dir)`` under a name, with its SQL when there is one."""

    def add(run: Run) -> Run:
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(name, run, sql, covers)
        return run

    return add


def load_all() -> dict[str, Entry]:
    from codegrove.catalog import (  # noqa: F401
        chunk_queries, graph_queries, incremental_queries, prompt_queries, search_queries, source_queries,
        text_queries,
    )

    return ENTRIES
