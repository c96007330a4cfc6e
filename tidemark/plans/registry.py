"""Every query by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        ENTRIES[name] = Entry(run, sql)
        return run

    return add


def r6(*names: str) -> list[Column]:
    """Scores to six places, off the halves, so that neither the order of a sum nor the rule for ties shows."""
    return [F.round(F.col(n) + 1e-9, 6).alias(n) for n in names]


def sql6(*names: str) -> str:
    return ", ".join(f"round({n} + 1e-9, 6) AS {n}" for n in names)
