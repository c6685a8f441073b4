"""Tables partitioned by day whose changes become current in one step.

A change writes the days it concerns into a version folder of its own, ``<path>/data/millrace_version=<version>/<day>=<value>``, beside
what is there. It is current once its manifest, ``<path>/log/<number>.json``, has been renamed into place: the manifest
lists every day with the version folder that holds it, and the table's columns. Readers take the newest manifest, so
they never see a half-written change, and a writer that stops before the rename has changed nothing: its folders
are in no manifest and go with the next clean-up. Old manifests are old states of the table.

A manifest has one entry per calendar day, so it is small whatever the table holds. One writer at a time is assumed; of two
that start from the same state the later one finds its manifest number taken and fails.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.dedup import keep_latest
from millrace.operators.merge import has_key, merge_by_key

NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # the folder value of rows without a day
SMALL_FILE = 64 << 20
_VERSION = "millrace_version"


@dataclass(frozen=True)
class State:
    number: int
    at: dt.datetime
    day_col: str
    schema: T.StructType
    days: dict[str, str]  # day, as in its folder's name, and the version that holds it


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _children(spark: SparkSession, path: str) -> list:
    fs, p = _fs(spark, path)
    return list(fs.listStatus(p)) if fs.exists(p) else []


def _manifests(spark: SparkSession, path: str) -> list[int]:
    names = (s.getPath().getName() for s in _children(spark, f"{path}/log"))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def _load(spark: SparkSession, path: str, number: int) -> State:
    found = json.loads(spark.read.option("wholetext", True).text(f"{path}/log/{number:012d}.json").first()[0])
    schema = T.StructType.fromJson(found["schema"])
    return State(number, dt.datetime.fromisoformat(found["at"]), found["day_col"], schema, found["days"])


def state(spark: SparkSession, path: str, at: dt.datetime | None = None) -> State | None:
    """The newest state of the table, or the one that was newest at a given time; None without one."""
    for number in reversed(_manifests(spark, path)):
        found = _load(spark, path, number)
        if at is None or found.at <= at:
            return found
    return None


def _commit(spark: SparkSession, path: str, new: State) -> None:
    """The one atomic step: the manifest is written under a hidden name and renamed."""
    text = json.dumps({"at": new.at.isoformat(), "day_col": new.day_col, "schema": new.schema.jsonValue(), "days": new.days}, sort_keys=True)
    fs, final = _fs(spark, f"{path}/log/{new.number:012d}.json")
    _, hidden = _fs(spark, f"{path}/log/.{uuid.uuid4().hex}")
    out = fs.create(hidden, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(final) or not fs.rename(hidden, final):
        fs.delete(hidden, False)
        raise RuntimeError(f"{path} was changed by another writer")


def _read(spark: SparkSession, path: str, now: State, days: Sequence[str]) -> DataFrame:
    folders = [f"{path}/data/{_VERSION}={now.days[d]}/{now.day_col}={d}" for d in days]
    if not folders:
        return spark.createDataFrame([], now.schema)
    # The columns are known, so no footer is read to find them.
    rows = spark.read.schema(now.schema).option("basePath", f"{path}/data").parquet(*folders)
    return rows.select(*now.schema.fieldNames())


def read_days(spark: SparkSession, path: str, at: dt.datetime | None = None, days: Sequence[str] | None = None) -> DataFrame:
    """The table, as it is or was at a given time; with ``days`` (ISO dates) only these."""
    now = state(spark, path, at)
    if now is None:
        raise ValueError(f"{path} has no state" + (f" at {at}" if at else ""))
    return _read(spark, path, now, sorted(now.days if days is None else set(days) & set(now.days)))


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_manifests(spark, path))


def _day(day_col: str) -> Column:
    return F.coalesce(F.col(day_col).cast("string"), F.lit(NO_DAY))


def _days_of(rows: DataFrame, day_col: str) -> set[str]:
    """The days that occur: a short list, they are calendar days."""
    return {r[0] for r in rows.select(_day(day_col)).distinct().collect()}


def publish_days(
    spark: SparkSession, path: str, rows: DataFrame, day_col: str, replaced: Sequence[str], at: dt.datetime | None = None, before: State | None = None
) -> State:
    """Put ``rows`` in the place of the ``replaced`` days; all other days stay. ``rows`` must lie in replaced or new days."""
    number = before.number + 1 if before else 1
    version = f"{number:012d}-{uuid.uuid4().hex[:8]}"
    folder = f"{path}/data/{_VERSION}={version}"
    # Tasks hold whole days, and a day that is too large for one task is cut by measured bytes.
    rows.hint("rebalance", day_col).write.partitionBy(day_col).parquet(folder)
    new = [s.getPath().getName().split("=", 1)[1] for s in _children(spark, folder) if s.isDirectory()]
    kept = {d: v for d, v in (before.days if before else {}).items() if d not in set(replaced)}
    overlap = set(new) & set(kept)
    if overlap:
        raise ValueError(f"rows lie in days that are not replaced: {sorted(overlap)[:3]}")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
    after = State(number, at or dt.datetime.now(), day_col, schema, kept | {d: version for d in new})
    _commit(spark, path, after)
    return after


def append_days(spark: SparkSession, path: str, rows: DataFrame, day_col: str, at: dt.datetime | None = None) -> State:
    """Add rows to their days. Days that get rows are rewritten, so they keep few files."""
    return _change(spark, path, rows, day_col, lambda old, new: old.unionByName(new, allowMissingColumns=True), lambda _: set(), at)


def _change(
    spark: SparkSession,
    path: str,
    rows: DataFrame,
    day_col: str,
    combine: Callable[[DataFrame, DataFrame], DataFrame],
    more_days: Callable[[DataFrame], set[str]],
    at: dt.datetime | None,
) -> State:
    """Combine rows with the days they lie in and the ``more_days`` of the table that they concern."""
    before = state(spark, path)
    rows = rows.persist()
    try:
        filled = _days_of(rows, day_col)
        if before is None:
            return publish_days(spark, path, combine(rows.limit(0), rows), day_col, (), at)
        table = _read(spark, path, before, sorted(before.days))
        concerned = (filled | more_days(table)) & set(before.days)
        merged = combine(_read(spark, path, before, sorted(concerned)), rows)
        # The table's column order stays, new columns follow.
        names = before.schema.fieldNames()
        merged = merged.select(*names, *(c for c in merged.columns if c not in names))
        return publish_days(spark, path, merged, day_col, sorted(concerned), at, before)
    finally:
        rows.unpersist()


def merge_days(
    spark: SparkSession,
    path: str,
    updates: DataFrame,
    keys: Sequence[str],
    day_col: str,
    latest_by: Sequence[str] = (),
    at: dt.datetime | None = None,
    newest_wins: bool = False,
) -> State:
    """Insert-or-update: the latest update of a key takes the place of its row, whatever day that lay in.

    With ``newest_wins`` a stored row stays if it comes after the update by ``latest_by``, so late updates undo nothing.

    Only days with updates, or with an old version of an updated key, are rewritten. Rows without a day form a day of
    their own. Columns that only one side has are kept, NULL for the other side's rows. Rows without a full key replace
    nothing; they are added unless a row with the same values, NULLs included, is stored already. Running a merge again
    gives the same table. Columns of map type are not supported.
    """
    keys = list(keys)

    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        latest = keep_latest(new.where(has_key(keys)), keys, latest_by)
        stored, unkeyed = old.where(~has_key(keys)).alias("s"), new.where(~has_key(keys)).alias("u")
        # A NULL equals a NULL here, and nothing else.
        same = reduce(and_, (F.col(f"s.{c}").eqNullSafe(F.col(f"u.{c}")) for c in new.columns if c in old.columns))
        for c in (c for c in new.columns if c not in old.columns):
            same = same & F.col(f"u.{c}").isNull()
        added = unkeyed.join(stored, same, "left_anti")
        if newest_wins:
            both = old.where(has_key(keys)).unionByName(latest, allowMissingColumns=True)
            rest = old.where(~has_key(keys)).unionByName(added, allowMissingColumns=True)
            return keep_latest(both, keys, latest_by).unionByName(rest, allowMissingColumns=True)
        return merge_by_key(old, latest, keys).unionByName(added, allowMissingColumns=True)

    def moved_from(table: DataFrame) -> set[str]:
        return _days_of(table.join(updates.where(has_key(keys)).select(*keys), keys, "left_semi"), day_col)

    return _change(spark, path, updates, day_col, combine, moved_from, at)


# --- bounds and maintenance --------------------------------------------------------------------------


def newest_value(spark: SparkSession, path: str, column: str):
    """The greatest value of a column that grows with the day: the newest day is known without a scan, and only its
    rows are read. None for a table without dated rows."""
    now = state(spark, path)
    dated = sorted(d for d in now.days if d != NO_DAY) if now else []
    while dated:
        found = _read(spark, path, now, [dated.pop()]).agg(F.max(column)).first()[0]
        if found is not None:
            return found
    return None


def compact_days(spark: SparkSession, path: str, at: dt.datetime | None = None, small: int = SMALL_FILE) -> list[str]:
    """Rewrite the days whose files are small on average; the days are returned. Sizes come from the file listing."""
    now = state(spark, path)
    chosen = []
    for day, version in sorted(now.days.items()) if now else []:
        fs, p = _fs(spark, f"{path}/data/{_VERSION}={version}/{now.day_col}={day}")
        sizes = [s.getLen() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")]
        if len(sizes) > 1 and sum(sizes) < small * len(sizes):
            chosen.append(day)
    if chosen:
        publish_days(spark, path, _read(spark, path, now, chosen), now.day_col, chosen, at, now)
    return chosen


def expire_days(spark: SparkSession, path: str, now: dt.datetime, keep: int = 5, days: int = 7) -> tuple[int, int]:
    """Drop states older than ``days``, but never the newest ``keep``, then every day folder that no state left needs.

    Folders of no state are left alone while they are younger than ``days``: a writer may be about to commit them. Returns
    how many states and folders went.
    """
    numbers = _manifests(spark, path)
    limit = now - dt.timedelta(days=days)
    states = {n: _load(spark, path, n) for n in numbers}
    doomed = [n for n in numbers[: max(len(numbers) - keep, 0)] if states[n].at < limit]
    for n in doomed:
        fs, p = _fs(spark, f"{path}/log/{n:012d}.json")
        fs.delete(p, False)
    needed = {(v, d) for n in numbers if n not in doomed for d, v in states[n].days.items()}
    known = {(v, d) for n in numbers for d, v in states[n].days.items()}
    gone = 0
    for folder in _children(spark, f"{path}/data"):
        version = folder.getPath().getName().removeprefix(f"{_VERSION}=")
        for child in _children(spark, folder.getPath().toString()):
            day = child.getPath().getName().split("=", 1)[-1]
            young = dt.datetime.fromtimestamp(child.getModificationTime() / 1000) >= limit
            if not child.isDirectory() or (version, day) in needed or ((version, day) not in known and young):
                continue
            fs, p = _fs(spark, child.getPath().toString())
            fs.delete(p, True)
            gone += 1
    return len(doomed), gone


def day_files(spark: SparkSession, path: str) -> DataFrame:
    """day, files and bytes of the current state, from the listing."""
    now = state(spark, path)
    rows = []
    for day, version in sorted(now.days.items()) if now else []:
        fs, p = _fs(spark, f"{path}/data/{_VERSION}={version}/{now.day_col}={day}")
        sizes = [s.getLen() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")]
        rows.append((day, len(sizes), sum(sizes)))
    return spark.createDataFrame(rows, "day string, files int, bytes long")
