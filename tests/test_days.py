"""Day tables: changes become current in one step, and old states stay readable."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators import days
from millrace.session import scratch

AT = [dt.datetime(2024, 3, n) for n in range(1, 10)]
SCHEMA = "k string, v long, d string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).withColumn("d", F.col("d").cast("date"))


def content(df, *columns):
    return sorted((tuple(str(x) for x in r) for r in df.select(*(columns or ("k", "v", "d"))).collect()))


FIRST = [("a", 1, "2024-01-01"), ("b", 1, "2024-01-01"), ("c", 1, "2024-01-02"), (None, 5, None)]
SECOND = [("a", 2, "2024-01-03"), ("c", 2, "2024-01-02"), ("e", 1, None)]
AFTER = [("a", 2, "2024-01-03"), ("b", 1, "2024-01-01"), ("c", 2, "2024-01-02"), ("e", 1, None), (None, 5, None)]


def as_text(rows):
    return sorted(tuple(str(x) for x in r) for r in rows)


@pytest.mark.parametrize("step", ["write", "commit"])
def test_a_merge_that_stops_half_way_changes_nothing(spark, monkeypatch, step):
    path = scratch(spark, "days")
    days.merge_days(spark, path, frame(spark, FIRST), ["k"], "d")
    with monkeypatch.context() as patch:

        def stop(*_):
            raise KeyboardInterrupt

        # Before the new folders are listed, or after that and before the manifest is renamed.
        listed = days._children
        if step == "write":
            patch.setattr(days, "_children", lambda s, p: stop() if "/data/millrace_version=" in p else listed(s, p))
        else:
            patch.setattr(days, "_commit", stop)
        with pytest.raises(KeyboardInterrupt):
            days.merge_days(spark, path, frame(spark, SECOND), ["k"], "d")
    assert content(days.read_days(spark, path)) == as_text(FIRST)
    for _ in range(2):
        days.merge_days(spark, path, frame(spark, SECOND), ["k"], "d")
        assert content(days.read_days(spark, path)) == as_text(AFTER)


def test_rows_without_key_are_told_apart_by_their_nulls(spark):
    path = scratch(spark, "days")
    schema = "k string, a string, b string, d string"
    days.merge_days(spark, path, frame(spark, [(None, "x", None, "2024-01-01")], schema), ["k"], "d")
    more = frame(spark, [(None, None, "x", "2024-01-01"), (None, "x", None, "2024-01-01")], schema)
    for _ in range(2):
        days.merge_days(spark, path, more, ["k"], "d")
    assert content(days.read_days(spark, path), "a", "b") == [("None", "x"), ("x", "None")]


def test_only_days_concerned_are_rewritten(spark):
    path = scratch(spark, "days")
    first = days.merge_days(spark, path, frame(spark, FIRST), ["k"], "d")
    second = days.merge_days(spark, path, frame(spark, [("c", 9, "2024-01-02")]), ["k"], "d")
    assert {d for d in second.days if second.days[d] != first.days[d]} == {"2024-01-02"}


def test_states_are_readable_as_of_a_time_until_they_expire(spark):
    path = scratch(spark, "days")
    for n, at in enumerate(AT[:4]):
        days.merge_days(spark, path, frame(spark, [("a", n, f"2024-01-0{n % 2 + 1}"), (f"x{n}", n, "2024-01-05")]), ["k"], "d", at=at)
    assert content(days.read_days(spark, path, AT[1])) == as_text([("a", 1, "2024-01-02"), ("x0", 0, "2024-01-05"), ("x1", 1, "2024-01-05")])
    assert days.read_days(spark, path).count() == 5
    with pytest.raises(ValueError):
        days.read_days(spark, path, dt.datetime(2023, 1, 1))
    states, folders = days.expire_days(spark, path, dt.datetime.now() + dt.timedelta(days=30), keep=2)
    assert states == 2 and folders > 0
    assert days.expire_days(spark, path, dt.datetime.now() + dt.timedelta(days=30), keep=2) == (0, 0)
    assert days.read_days(spark, path).count() == 5 and days.read_days(spark, path, AT[2]).count() == 4
    with pytest.raises(ValueError):
        days.read_days(spark, path, AT[1])


def test_folders_of_a_stopped_write_go_once_they_are_old(spark, monkeypatch):
    path = scratch(spark, "days")
    days.merge_days(spark, path, frame(spark, FIRST), ["k"], "d")
    with monkeypatch.context() as patch:
        patch.setattr(days, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError))
        with pytest.raises(RuntimeError):
            days.merge_days(spark, path, frame(spark, SECOND), ["k"], "d")
    assert days.expire_days(spark, path, dt.datetime.now()) == (0, 0)
    assert days.expire_days(spark, path, dt.datetime.now() + dt.timedelta(days=9))[1] > 0
    assert content(days.read_days(spark, path)) == as_text(FIRST)


def test_the_second_of_two_writers_fails(spark):
    path = scratch(spark, "days")
    before = days.merge_days(spark, path, frame(spark, FIRST), ["k"], "d")
    days.publish_days(spark, path, frame(spark, [("z", 1, "2024-02-01")]), "d", (), before=before)
    with pytest.raises(RuntimeError):
        days.publish_days(spark, path, frame(spark, [("y", 1, "2024-02-02")]), "d", (), before=before)
    assert days.read_days(spark, path).count() == 5


def test_rows_outside_the_replaced_days_are_refused(spark):
    path = scratch(spark, "days")
    before = days.merge_days(spark, path, frame(spark, FIRST), ["k"], "d")
    with pytest.raises(ValueError):
        days.publish_days(spark, path, frame(spark, [("z", 1, "2024-01-01")]), "d", (), before=before)


def test_new_columns_append_and_empty_tables(spark):
    path = scratch(spark, "days")
    assert days.state(spark, path) is None and days.newest_value(spark, path, "v") is None
    days.append_days(spark, path, frame(spark, []), "d")
    assert days.read_days(spark, path).count() == 0 and days.newest_value(spark, path, "v") is None
    days.append_days(spark, path, frame(spark, FIRST), "d")
    more = spark.createDataFrame([("n", 7, "2024-01-01", 1.5)], "k string, v long, d string, w double").withColumn("d", F.col("d").cast("date"))
    days.append_days(spark, path, more, "d")
    assert content(days.read_days(spark, path, days=["2024-01-01"]), "k", "w") == [("a", "None"), ("b", "None"), ("n", "1.5")]


def test_the_bound_reads_the_newest_day_only(spark):
    path = scratch(spark, "days")
    days.append_days(spark, path, frame(spark, [("a", n, f"2024-01-0{n}") for n in range(1, 8)] + [("n", 99, None)]), "d")
    assert days.newest_value(spark, path, "v") == 7
    files = days._read(spark, path, days.state(spark, path), ["2024-01-07"]).inputFiles()
    assert files and all("d=2024-01-07" in f for f in files)


def test_compaction_takes_days_with_small_files(spark):
    path = scratch(spark, "days")
    rows = frame(spark, [(str(n), n, f"2024-01-0{n % 2 + 1}") for n in range(400)])
    before = days.append_days(spark, path, rows, "d", AT[0])
    # A day written by many tasks.
    parts = rows.where("d = '2024-01-02'").repartition(6)
    folder = f"{path}/data/millrace_version={before.days['2024-01-02']}/d=2024-01-02"
    parts.drop("d").write.mode("overwrite").parquet(folder)
    assert {r.day: r.files for r in days.day_files(spark, path).collect()} == {"2024-01-01": 1, "2024-01-02": 6}
    was = content(days.read_days(spark, path))
    assert days.compact_days(spark, path, AT[1]) == ["2024-01-02"]
    assert {r.files for r in days.day_files(spark, path).collect()} == {1} and content(days.read_days(spark, path)) == was
    assert days.compact_days(spark, path, AT[2]) == [] and days.read_days(spark, path, AT[0]).count() == 400
