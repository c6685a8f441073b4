"""Keep one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "_millrace_rank"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def keep_latest(df: DataFrame, keys: Sequence[str], latest_by: Sequence[Column | str], ties: Sequence[Column] = ()) -> DataFrame:
    """The newest row of each key.

    ``latest_by`` columns are compared in turn, greatest first, NULL last. ``ties``
    are ready-made sort columns used next. A hash of the whole row settles what is
    left, so a rerun picks the same row.

    The filter on the row number lets the planner cut every map task down to one
    row per key before the shuffle, so a key that owns a third of the table sends
    one row per task, not its whole history.
    """
    order = [as_column(c).desc_nulls_last() for c in latest_by]
    order += list(ties) or [F.xxhash64(*df.columns).asc()]
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).where(F.col(_RANK) == 1).drop(_RANK)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key under an explicit ordering."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).where(F.col(_RANK) == 1).drop(_RANK)


def dedup_latest(df: DataFrame, keys: Sequence[str], latest_by: Sequence[Column | str] = ()) -> DataFrame:
    """Bronze de-duplication: latest row per key; a hash of the row decides where the order does not. All rows without keys."""
    return keep_latest(df, keys, latest_by) if keys else df
