"""One entry per registered query: the Spark callable and, where SQL can state it, the oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFunction = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: QueryFunction
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    def register(function: QueryFunction) -> QueryFunction:
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = Entry(function, sql)
        return function

    return register
