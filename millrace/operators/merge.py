"""Incremental updates of plain tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.dedup import keep_latest
from millrace.session import freeing_shuffles

LOOKED_UP = 100_000  # keys that ``fresh_rows`` sends to every task

def has_key(keys: Sequence[str]) -> Column:
    """No part of the key is missing."""
    return reduce(and_, (F.col(k).isNotNull() for k in keys))


def anti_join_existing(
    rows: DataFrame, existing: DataFrame | None, keys: Sequence[str], latest_by: Sequence[str] = ()
) -> DataFrame:
    """Rows whose key is not stored yet; all rows when there is no table.

    A NULL in the key equals nothing, so such rows all pass. Of rows that share a new key the
    latest by ``latest_by`` is taken. Repeats inside ``rows`` are dropped first: the store may not hold the key yet, and
    one key repeated millions of times would otherwise meet in one join task.
    """
    keys = list(keys)
    unkeyed = rows.where(~has_key(keys))
    fresh = keep_latest(rows.where(has_key(keys)), keys, latest_by)
    if existing is None:
        return fresh.unionByName(unkeyed)
    # ``fresh`` lies by its key already, so only the stored keys move; looking up which of them the rows have would move
    # the keys of all rows once more, after computing the rows again.
    known = existing.select(*keys).distinct()
    # A join on named keys moves them to the front; the table's column order is kept.
    return fresh.join(known, keys, "left_anti").select(*rows.columns).unionByName(unkeyed)


def fresh_rows(rows: DataFrame, existing: DataFrame | None, keys: Sequence[str], latest_by: Sequence[str] = ()) -> DataFrame:
    """The rows of ``anti_join_existing``, for wide rows that can be read twice: whole rows are seldom moved.

    First only a 64-bit hash of each key moves, to tell which occur more than once or may be stored; a row whose hash is
    neither is new and stays where it is. The others, also those that merely share a hash, are compared by their keys. If there
    are many of them, but few keys that are not stored (a batch that is delivered again), rows of the latter are
    looked up. Otherwise all rows move.
    """
    spark, keys, mark = rows.sparkSession, list(keys), "_millrace_mark"
    keyed, unkeyed = rows.where(has_key(keys)), rows.where(~has_key(keys))

    def few(found: DataFrame) -> list | None:
        """The rows, unless there are more than may be sent to every task."""
        with freeing_shuffles(spark):
            some = found.limit(LOOKED_UP + 1).collect()
        return some if len(some) <= LOOKED_UP else None

    def sent(some: list, like: DataFrame) -> DataFrame:
        return F.broadcast(spark.createDataFrame(some, like.schema))

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn(mark, F.xxhash64(*keys))

    marks = marked(keyed.select(*keys)).select(mark, F.lit(1).alias("_n"))
    if existing is not None:
        stored = marked(existing.where(has_key(keys)).select(*keys)).select(mark, F.lit(1).alias("_n"))
        marks = marks.unionByName(stored)
    several = marks.groupBy(mark).agg(F.sum("_n").alias("_n")).where("_n > 1").select(mark)
    some = few(several)
    if some == []:
        return rows
    if some is not None:
        looked_at = sent(some, several)
        once = marked(keyed).join(looked_at, mark, "left_anti").select(*rows.columns)
        again = marked(keyed).join(looked_at, mark, "left_semi").select(*rows.columns)
        if existing is not None:
            existing = marked(existing.select(*keys)).join(looked_at, mark, "left_semi").select(*keys)
        return once.unionByName(anti_join_existing(again, existing, keys, latest_by)).unionByName(unkeyed)
    if existing is not None:
        new = keyed.select(*keys).distinct().join(existing.select(*keys).distinct(), keys, "left_anti")
        some = few(new)
        if some == []:
            return unkeyed
        if some is not None:
            found = keyed.join(sent(some, new), keys, "left_semi").select(*rows.columns)
            return keep_latest(found, keys, latest_by).unionByName(unkeyed)
    return anti_join_existing(rows, existing, keys, latest_by)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str], latest_by: Sequence[str] = ()) -> DataFrame:
    """Target plus the rows whose key it does not hold. A stored version of a key stays; of several new ones the latest
    by ``latest_by`` is taken."""
    return target.unionByName(anti_join_existing(rows, target, keys, latest_by), allowMissingColumns=True)


def incremental_filter(source: DataFrame, target: DataFrame | None, ts_col: str) -> DataFrame:
    """Source rows at or after the newest target row.

    The bound is fetched first (one row) and used as a literal, so the parquet reader
    can skip row groups by it; a join with the bound could not be pushed down.
    """
    return from_bound(source, target.agg(F.max(ts_col)).first()[0] if target is not None else None, ts_col)


def from_bound(source: DataFrame, bound: dt.datetime | None, ts_col: str) -> DataFrame:
    """Source rows at or after a known bound (``days.newest_value`` finds it without scanning the target)."""
    return source.where(F.col(ts_col) >= F.lit(bound or dt.datetime(1900, 1, 1)))


def merge_by_key(target: DataFrame, updates: DataFrame, keys: Sequence[str], latest_by: Sequence[str] = ()) -> DataFrame:
    """Insert-or-update: updates replace target rows of the same key, other target rows stay.

    A NULL key never matches, so such rows are inserted. Columns new in the updates
    are added (NULL for old rows).
    """
    keys = list(keys)
    keyed = F.lit(True)
    for key in keys:
        keyed = keyed & F.col(key).isNotNull()
    latest = keep_latest(updates.where(keyed), keys, latest_by)
    kept = target.join(latest.select(*keys), keys, "left_anti").select(*target.columns)
    merged = kept.unionByName(latest, allowMissingColumns=True)
    return merged.unionByName(updates.where(~keyed), allowMissingColumns=True)


def merge_schema_append(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows whose schema may have gained columns."""
    return target.unionByName(rows, allowMissingColumns=True)
