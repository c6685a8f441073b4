"""Offset ranges: every record once, partitions and topics that appear later, runs that stop half way."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators import tables
from millrace.plans import schemas
from millrace.session import scratch
from millrace.sources import offsets

NOW = dt.datetime(2024, 2, 1, 6)
MES, CAPA = "mes.production_orders", "trackwise.capas"


def records(spark, *rows):
    full = [(b"k", f"{t}-{p}-{o}".encode(), t, p, o, NOW) for t, p, o in rows]
    return spark.createDataFrame(full, schemas.KAFKA_RECORD)


def run(spark, root, day, rows, **options):
    found = offsets.ingest_topics(spark, records(spark, *rows), root, [MES, CAPA], dt.datetime(2024, 2, day), now=F.lit(NOW), **options)
    return sorted(tuple(r) for r in found.collect())


def stored(spark, root):
    path = tables.table_path(root, "bronze", "mes_production_orders")
    return sorted(r["_raw_payload"] for r in spark.read.parquet(path).collect()) if tables.exists(spark, path) else []


def test_each_record_once_over_growing_files(spark):
    root = scratch(spark, "lake")
    first = [(MES, 0, 3), (MES, 0, 4), (MES, 1, 9)]
    assert run(spark, root, 1, first, bootstrap=True) == [(MES, 0, 0, 5), (MES, 1, 0, 10)]
    more = first + [(MES, 0, 5), (MES, 2, 1), (CAPA, 0, 7)]
    # A new partition of a known topic starts at 0, a new topic at its newest record.
    assert run(spark, root, 2, more) == [(MES, 0, 5, 6), (MES, 1, 10, 10), (MES, 2, 0, 2), (CAPA, 0, 8, 8)]
    assert stored(spark, root) == sorted(f"{t}-{p}-{o}" for t, p, o in more if t == MES)
    assert run(spark, root, 3, more) == [(MES, 0, 6, 6), (MES, 1, 10, 10), (MES, 2, 2, 2), (CAPA, 0, 8, 8)]
    assert len(stored(spark, root)) == 5
    # Partitions whose records are gone keep their ends.
    assert run(spark, root, 4, [(CAPA, 0, 8)])[-1] == (CAPA, 0, 8, 9) and len(stored(spark, root)) == 5


def test_without_bootstrap_a_first_run_reads_nothing(spark):
    root = scratch(spark, "lake")
    assert run(spark, root, 1, [(MES, 0, 3)]) == [(MES, 0, 4, 4)]
    assert stored(spark, root) == []
    offsets.init_offsets(spark, records(spark, (MES, 0, 7)), root, [MES], dt.datetime(2024, 2, 2))
    assert run(spark, root, 3, [(MES, 0, 7), (MES, 0, 8)]) == [(MES, 0, 8, 9)]
    assert stored(spark, root) == [f"{MES}-0-8"]


def test_a_run_that_stops_before_the_ranges_are_saved_is_repeated(spark, monkeypatch):
    root, rows = scratch(spark, "lake"), [(MES, 0, 1), (MES, 0, 2)]
    with monkeypatch.context() as patch:
        patch.setattr(offsets.tables, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError))
        with pytest.raises(RuntimeError):
            run(spark, root, 1, rows, bootstrap=True)
    assert len(stored(spark, root)) == 2
    assert run(spark, root, 1, rows, bootstrap=True) == [(MES, 0, 0, 3)] and len(stored(spark, root)) == 2


def test_topics_and_offsets_prune_the_scan(spark):
    path = scratch(spark, "records")
    records(spark, (MES, 0, 1), (MES, 0, 9), (CAPA, 0, 2)).write.parquet(path)
    ranges = spark.createDataFrame([(MES, 0, 5, 10), (CAPA, 0, 3, 3)], offsets.RANGES)
    found = offsets.in_ranges(spark.read.schema(schemas.KAFKA_RECORD).parquet(path), ranges)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [r["offset"] for r in found.collect()] == [9]
    assert ">= 5" in plan and MES in plan and "BroadcastHashJoin" in plan


def test_the_newest_version_of_a_key_is_stored(spark):
    root = scratch(spark, "lake")
    rows = [(b"k", b'{"record_id": "%s", "status": "%d"}' % (k, o), "tms.training_completions", 0, o, NOW) for k, o in ((b"a", o) for o in range(40))]
    rows += [(b"k", b'{"record_id": "b", "status": "late"}', "tms.training_completions", 1, 2, NOW + dt.timedelta(hours=1))]
    rows += [(b"k", b'{"record_id": "b", "status": "early"}', "tms.training_completions", 0, 99, NOW)]
    batch = spark.createDataFrame(rows, schemas.KAFKA_RECORD).repartition(4)
    from millrace.streaming.jobs import land_records

    for _ in range(2):
        land_records(batch, root, F.lit(NOW))
    table = spark.read.parquet(tables.table_path(root, "bronze", "tms_training_completions"))
    assert sorted((r["record_id"], r["status"]) for r in table.collect()) == [("a", "39"), ("b", "late")]
    assert table.schema.fieldNames() == schemas.TMS_TRAINING.fieldNames()
