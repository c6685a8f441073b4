import datetime as dt
import threading
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import days, merge, tables
from millrace.plans import bronze, schemas
from millrace.session import scratch, shared_root


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_merge_by_key(spark):
    target = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "k string, v int")
    updates = spark.createDataFrame([("b", 2, "x"), ("b", 3, "y"), ("c", 1, "z"), (None, 9, "n")], "k string, v int, extra string")
    merged = merge.merge_by_key(target, updates, ["k"], ["v"])
    assert rows_of(merged) == sorted(
        [("a", 1, None), ("b", 3, "y"), ("c", 1, "z"), (None, 1, None), (None, 9, "n")], key=repr
    )


def test_insert_ignore_keeps_the_first_version(spark):
    target = spark.createDataFrame([("a", 1)], "k string, v int")
    rows = spark.createDataFrame([("a", 2), ("b", 2), ("b", 2)], "k string, v int")
    assert rows_of(merge.insert_ignore(target, rows, ["k"])) == [("a", 1), ("b", 2)]


def test_anti_join_removes_repeats_within_the_batch(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "h string, o int")
    assert merge.anti_join_existing(rows, None, ["h", "o"]).count() == 2
    stored = spark.createDataFrame([("b", 2)], "h string, o int")
    assert rows_of(merge.anti_join_existing(rows, stored, ["h", "o"])) == [("a", 1)]


def test_incremental_filter(spark):
    rows = spark.createDataFrame([(i, dt.datetime(2024, 1, i)) for i in range(1, 6)], "i int, ts timestamp")
    assert merge.incremental_filter(rows, None, "ts").count() == 5
    assert merge.incremental_filter(rows, rows.where("i < 1"), "ts").count() == 5
    assert [r["i"] for r in merge.incremental_filter(rows, rows.where("i <= 3"), "ts").orderBy("i").collect()] == [3, 4, 5]


def test_incremental_bound_reaches_the_scan(spark):
    path = scratch(spark, "bound")
    spark.range(10).select(F.timestamp_seconds("id").alias("ts")).write.parquet(path)
    rows = spark.read.parquet(path)
    plan = merge.incremental_filter(rows, rows, "ts")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan


def test_days_that_lose_their_last_row_disappear(spark):
    path = scratch(spark, "days")
    day = lambda n: dt.date(2024, 1, n)
    first = spark.createDataFrame([("a", day(1), 1), ("b", day(2), 1), ("c", day(2), 1)], "k string, d date, v int")
    days.merge_days(spark, path, first, ["k"], "d")
    moved = spark.createDataFrame([("a", day(3), 2), ("b", day(2), 2)], "k string, d date, v int")
    for _ in range(2):
        days.merge_days(spark, path, moved, ["k"], "d")
        got = rows_of(days.read_days(spark, path).select("k", "d", "v"))
        assert got == [("a", day(3), 2), ("b", day(2), 2), ("c", day(2), 1)]


def test_versions(spark):
    root = scratch(spark, "lake")
    at = [dt.datetime(2024, 1, d) for d in range(1, 9)]
    for i, when in enumerate(at):
        tables.publish(spark.range(i + 1), root, "gold", "t", when)
    assert [w for w, _ in tables.versions(spark, root, "gold", "t")] == at
    assert tables.read_as_of(spark, root, "gold", "t").count() == 8
    assert tables.read_as_of(spark, root, "gold", "t", dt.datetime(2024, 1, 3, 12)).count() == 3
    with pytest.raises(ValueError):
        tables.read_as_of(spark, root, "gold", "t", dt.datetime(2023, 1, 1))
    assert len(tables.expire_versions(spark, root, "gold", "t", dt.datetime(2024, 1, 20))) == 3
    assert tables.expire_versions(spark, root, "gold", "t", dt.datetime(2024, 1, 20)) == []
    assert [w for w, _ in tables.versions(spark, root, "gold", "t")] == at[3:]


def test_a_version_without_success_marker_is_not_read(spark):
    root = scratch(spark, "lake")
    tables.publish(spark.range(3), root, "gold", "t", dt.datetime(2024, 1, 1))
    path = tables.publish(spark.range(9), root, "gold", "t", dt.datetime(2024, 1, 2))
    fs, p = tables._path(spark, path + "/_SUCCESS")
    fs.delete(p, False)
    assert tables.read_as_of(spark, root, "gold", "t").count() == 3


def test_ensure_tables_leaves_filled_tables_alone(spark):
    root = scratch(spark, "lake")
    assert sorted(tables.ensure_tables(spark, root, "bronze", schemas.PLACEHOLDERS)) == sorted(schemas.PLACEHOLDERS)
    path = tables.table_path(root, "bronze", "trackwise_capas")
    assert spark.read.parquet(path).schema == schemas.RAW_ENVELOPE
    assert tables.ensure_tables(spark, root, "bronze", schemas.PLACEHOLDERS) == []
    with pytest.raises(ValueError):
        tables.table_path(root, "platinum", "t")


def test_a_busy_day_is_cut_into_several_partitions(spark):
    rows = spark.range(0, 40000, 1, 8).select(
        "id", F.when(F.col("id") < 39000, F.lit("2024-01-01 00:00:00")).otherwise("2024-01-02 00:00:00").cast("timestamp").alias("ts")
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        clustered = bronze.cluster_by_day(rows, "ts")
        assert clustered.columns == rows.columns and clustered.count() == 40000
        path = scratch(spark, "clustered")
        clustered.write.parquet(path)
        busy = spark.read.parquet(path).where("ts < '2024-01-02'").select(F.col("_metadata.file_path")).distinct()
        assert busy.count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_shared_folder_comes_from_the_session(spark):
    assert scratch(spark, "x").startswith(shared_root(spark))
    assert scratch(spark, "x") != scratch(spark, "x")


def test_partitioned_writes_make_few_files(spark):
    path = scratch(spark, "few")
    days = spark.range(0, 8000, 1, 8).withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int")))
    tables.write_layer_table(days, path, ["d"])
    assert tables.storage_files(spark, {"t": path}).count() == 10


def test_rows_without_key_pass_the_anti_join_and_the_latest_version_wins(spark):
    stored = spark.createDataFrame([("s", 1)], "k string, v long")
    rows = spark.createDataFrame([("s", 9), ("n", 1), ("n", 2), (None, 3), (None, 3)], "k string, v long")
    got = merge.anti_join_existing(rows, stored, ["k"], ["v"]).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("n", 2), (None, 3), (None, 3)]))


def test_merge_into_days_loses_no_row_and_no_column(spark, tmp_path):
    path = str(tmp_path / "t")
    first = [("a", 1, "x", None), ("b", 2, "y", None), (None, 3, "z", "2024-01-01"), ("c", 4, "w", "2024-01-01")]
    days.merge_days(spark, path, spark.createDataFrame(first, "k string, v long, note string, d string").withColumn("d", F.col("d").cast("date")), ["k"], "d")
    more = [("b", 20, 7, None), (None, 5, 8, "2024-01-01")]
    updates = spark.createDataFrame(more, "k string, v long, extra long, d string").withColumn("d", F.col("d").cast("date"))
    for _ in range(2):
        days.merge_days(spark, path, updates, ["k"], "d")
        got = days.read_days(spark, path).select("k", "v", "note", "extra").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(
            map(str, [("a", 1, "x", None), ("b", 20, None, 7), (None, 3, "z", None), ("c", 4, "w", None), (None, 5, None, 8)])
        )


def test_stored_keys_are_compared_without_moving_the_new_ones_again(spark):
    new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1), (None, 1)], "k string, v int")
    old = spark.createDataFrame([("b",), ("b",), (None,)], "k string")
    got = merge.anti_join_existing(new, old, ["k"], ["v"])
    assert sorted((tuple(r) for r in got.collect()), key=repr) == [("a", 2), (None, 1), (None, 1)]
    # The rows are computed twice, for those with a key and those without; no third time for a list of their keys.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 0


def test_tables_are_written_at_the_same_time(spark, tmp_path, monkeypatch):
    """A table's write begins while another's still runs, and all tables are written in full."""
    write, meeting, joined = tables.write_layer_table, threading.Barrier(2), []

    def with_another(df, path):
        joined.append(path)
        if len(joined) <= 2:
            meeting.wait(timeout=60)
        write(df, path)

    monkeypatch.setattr(tables, "write_layer_table", with_another)
    written = {str(tmp_path / f"t{i}"): spark.range(10 * i) for i in range(6)}
    tables.write_layer_tables(written)
    assert [spark.read.parquet(path).count() for path in written] == [0, 10, 20, 30, 40, 50]


def test_a_failed_write_is_raised(spark, tmp_path):
    taken = tmp_path / "file"
    taken.write_text("")
    with pytest.raises(Exception, match="file"):
        tables.write_layer_tables({str(tmp_path / "good"): spark.range(3), f"{taken}/below": spark.range(2)})
    assert spark.read.parquet(str(tmp_path / "good")).count() == 3


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_a_write_leaves_no_shuffle_files_and_packs_its_table(spark, tmp_path):
    before = _shuffle_files(spark)
    held = [spark.range(1000).repartition(3, "id").withColumn("n", F.lit(n)) for n in range(3)]
    tables.write_layer_table(held[0], str(tmp_path / "a"))
    tables.append_layer_table(held[1], str(tmp_path / "a"))
    tables.write_layer_tables({str(tmp_path / "b"): held[2]})
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2000 and spark.read.parquet(str(tmp_path / "b")).count() == 1000
    for _ in range(50):  # files go in the background
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.2)
    assert _shuffle_files(spark) <= before + 4  # those of the two counts
    assert list((tmp_path / "a").glob("*.zstd.parquet"))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


@pytest.mark.parametrize("looked_up", [0, 2, 5, 1000])
def test_fresh_rows_are_those_of_the_anti_join(spark, monkeypatch, looked_up):
    monkeypatch.setattr(merge, "LOOKED_UP", looked_up)
    rows = [(f"h{i % 11}" if i % 9 else None, i % 3 if i % 7 else None, i % 5, f"payload {i % 5} {i % 11}") for i in range(120)]
    new = spark.createDataFrame(rows, "h string, o int, v int, p string")
    for known in ([], [("h1", 1), ("h1", 1), ("h2", 2), (None, 1), ("h99", 0)], [(f"h{i % 11}", i % 3) for i in range(40)], [(r[0], r[1]) for r in rows]):
        old = spark.createDataFrame(known, "h string, o int") if known else None
        got = merge.fresh_rows(new, old, ["h", "o"], ["v"])
        assert got.columns == new.columns
        assert rows_of(got) == rows_of(merge.anti_join_existing(new, old, ["h", "o"], ["v"]))
    alone = new.where("h is not null and o is not null").dropDuplicates(["h", "o"]).localCheckpoint()
    assert rows_of(merge.fresh_rows(alone, None, ["h", "o"])) == rows_of(alone)


def test_new_raw_rows_are_not_moved(spark):
    rows = spark.createDataFrame([(f"h{i}", i, "payload") for i in range(20)], "h string, o int, p string")
    old = spark.createDataFrame([("h3", 3)], "h string, o int")
    plan = merge.fresh_rows(rows.union(rows.where("o = 5")), old, ["h", "o"], ["p"]).select("p")._jdf.queryExecution().optimizedPlan().toString()
    first, others = plan.split("LeftAnti", 2)[:2]
    assert "Window" not in first.split("Join")[0] and "broadcast" in others.split("\n")[0]
    assert merge.fresh_rows(rows, old.where("o = 9"), ["h", "o"], ["p"]) is rows
