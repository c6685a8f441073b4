"""Every query this repository answers, with its checking statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    oracle: str | None


ENTRIES: dict[str, Entry] = {}


def add(name: str, run: Query, oracle: str | None = None) -> None:
    if name in ENTRIES:
        raise ValueError(f"{name} is registered twice")
    ENTRIES[name] = Entry(run, oracle)
