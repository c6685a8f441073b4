"""How result columns are shown to both engines.

A column list is text such as ``"machine_id hour_window:ts avg_temp:6 total:n"``:
``ts`` and ``d`` print times and dates, ``n`` makes a whole number 64 bit, a digit
rounds a double, no suffix keeps the value as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testbed.oracle import day_text, half_up, statement, ts_text


def parse(spec: str) -> list[tuple[str, str]]:
    return [(name, kind) for name, _, kind in (part.partition(":") for part in spec.split())]


def present(df: DataFrame, spec: str) -> DataFrame:
    columns = []
    for name, kind in parse(spec):
        column = F.col(f"`{name}`")
        if kind == "ts":
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind == "d":
            column = F.date_format(column, "yyyy-MM-dd")
        elif kind == "n":
            column = column.cast("bigint")
        elif kind:
            column = F.round(column.cast("double"), int(kind))
        columns.append(column.alias(name))
    return df.select(*columns)


def shown(source: str, spec: str, tail: str = "") -> str:
    """``select .. from source``, printed the same way; ``source`` is a relation or a bracketed query."""
    columns = []
    for name, kind in parse(spec):
        column = f'"{name}"'
        if kind == "ts":
            column = ts_text(column)
        elif kind == "d":
            column = day_text(column)
        elif kind == "n":
            column = f"cast({column} as bigint)"
        elif kind:
            column = half_up(column, int(kind))
        columns.append(f'{column} as "{name}"')
    return statement(f"select {', '.join(columns)} from {source} {tail}".strip())
