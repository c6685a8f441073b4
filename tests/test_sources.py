import datetime as dt
import json

from pyspark.sql import functions as F

from millrace.plans import bronze, schemas
from millrace.sources import cdc, files, kafka

NOW = dt.datetime(2024, 2, 1, 6)


def records(spark, rows):
    full = [(k, v, t, 0, o, NOW) for k, v, t, o in rows]
    return spark.createDataFrame(full, schemas.KAFKA_RECORD)


def test_csv_columns_are_matched_by_name(spark, tmp_path):
    (tmp_path / "orders.csv").write_text("order_id,status,quantity\nA,\"x, y\",5\nB,,\n")
    schema = schemas._struct("order_id string, status string, quantity int")
    got = bronze.typed(files.read_csv(spark, str(tmp_path / "orders.csv"), schema), schema).orderBy("order_id").collect()
    assert [tuple(r) for r in got] == [("A", "x, y", 5), ("B", None, None)]


def test_preferred_source(spark, tmp_path):
    schema = schemas._struct("order_id string, quantity int")
    (tmp_path / "o.csv").write_text("order_id,quantity\nC,1\n")
    glob = str(tmp_path / "drop" / "*.json")
    pick = lambda: files.preferred_source(spark, glob, str(tmp_path / "o.csv"), schema, "S", F.lit(NOW)).collect()
    assert [(r["order_id"], r["_nifi_flow"]) for r in pick()] == [("C", "csv_seed")]
    (tmp_path / "drop").mkdir()
    (tmp_path / "drop" / "0.json").write_text("[]")
    assert pick()[0]["_nifi_flow"] == "csv_seed"  # a drop without rows does not count
    (tmp_path / "drop" / "1.json").write_text('{"order_id": "J",\n "quantity": 2}')
    assert [(r["order_id"], r["quantity"], r["_nifi_flow"]) for r in pick()] == [("J", "2", "nifi_s3_ingest")]


def test_json_lines_last_record_wins(spark, tmp_path):
    lines = [{"id": "a", "v": "1"}, {"id": "b", "v": "1"}, {"v": "0"}, {"id": "", "v": "0"}, {"id": "a", "v": "2"}]
    (tmp_path / "1.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    (tmp_path / "2.jsonl").write_text('{"id": "b", "v": "3"}\n')
    got = files.load_jsonl_latest(spark, str(tmp_path), "id", schemas._struct("id string, v string"))
    assert {r["id"]: r["v"] for r in got.collect()} == {"a": "2", "b": "3"}


def test_changed_files(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("x\n")
    first = files.file_listing(spark, str(tmp_path), "*.csv")
    assert files.changed_files(first, None).count() == 2
    manifest = spark.createDataFrame(first.collect(), first.schema)
    assert files.changed_files(files.file_listing(spark, str(tmp_path)), manifest).count() == 0
    (tmp_path / "b.csv").write_text("x\ny\n")
    (tmp_path / "c.csv").write_text("z\n")
    changed = files.changed_files(files.file_listing(spark, str(tmp_path)), manifest)
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in changed.collect()) == ["b.csv", "c.csv"]


def test_envelope(spark):
    row = bronze.raw_envelope(records(spark, [(b"k", b'{"a": 1}', "iqms.deviations", 7)]), F.lit(NOW)).first()
    assert row["_source_system"] == "IQMS" and row["_kafka_offset"] == 7 and len(row["_row_hash"]) == 64
    assert (row["_ingest_year"], row["_ingest_month"], row["_ingest_day"]) == (2024, 2, 1)


def test_training_and_inventory_projections(spark):
    rows = [(b"k1", b'{"record_id": "r"}', "tms.training_completions", 1), (b"k2", b'{"department": "QA"}', "tms.training_completions", 2), (None, b"{}", "tms.training_completions", 3)]
    assert sorted(r["record_id"] for r in bronze.project_training(records(spark, rows), F.lit(NOW)).collect()) == ["k2", "r"]
    payload = b'{"document_number": "49", "quantity": 123.987, "posting_date": "2024-01-05", "movement_type": "101", "valuation_amount_inr": "oops"}'
    got = bronze.project_topic("sap.inventory_movements", records(spark, [(b"k", payload, "sap.inventory_movements", 1), (b"k", b"{}", "sap.inventory_movements", 2)]), F.lit(NOW)).collect()
    assert len(got) == 1
    assert (got[0]["planned_qty"], got[0]["actual_qty"], got[0]["cost_center"], got[0]["total_cost"]) == (123, 123, "101", None)


def test_change_events(spark):
    event = lambda op, after, ts: json.dumps({"before": None, "after": after, "op": op, "source": {"table": "t", "ts_ms": ts}}).encode()
    rows = [
        (b"1", event("c", {"id": "1", "q": 5}, 10), "cdc", 1),
        (b"1", event("u", {"id": "1", "q": 6}, 20), "cdc", 2),
        (b"2", event("d", None, 30), "cdc", 3),
        (b"2", None, "cdc", 4),
        (b"3", b"not json", "cdc", 5),
        (b"4", b"{}", "cdc", 6),
    ]
    good, dead = cdc.cdc_unwrap(records(spark, rows), schemas._struct("id string, q int"))
    assert sorted((r["id"], r["q"], r["__op"]) for r in good.collect()) == [("1", 5, "c"), ("1", 6, "u")]
    assert sorted(r["offset"] for r in dead.collect()) == [5, 6]
    assert [(r["q"], r["__source_ts_ms"]) for r in cdc.cdc_latest(good, ["id"]).collect()] == [(6, 20)]


def test_messages(spark):
    df = spark.createDataFrame([("A", None), ("B", "x")], "id string, v string")
    got = sorted(tuple(r) for r in kafka.publish_envelope(df, "t").collect())
    assert got == [("A", '{"id":"A","v":null}', "t"), ("B", '{"id":"B","v":"x"}', "t")]
    assert kafka.offsets_json({"t": {1: 5, 0: 3}}) == '{"t": {"0": 3, "1": 5}}'
