"""Queries over the whole lake and suites over one table, on given tables of a few rows."""

import datetime as dt

import pytest

from testbed import governance, models, registered

T = dt.datetime(2024, 1, 3, 5)


def given(spark, path, events):
    """The tables that the lake is built from: ``events`` events, one order, two lines, one document."""
    made = {
        "events": ([(i, T, i, "click", 1.0) for i in range(events)], "event_id long, ts timestamp, user_id long, event_type string, value double"),
        "orders": (
            [(1, 7, "F", 100.0, T, "1-URGENT")],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
        ),
        "lineitem": (
            [(1, 2, 3, n, 5.0, 50.0, 0.1, 0.01, "A", "F", T) for n in (1, 2)],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
            "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
        ),
        "documents": ([(1, "text", "en", "src0", 4)], "doc_id long, text string, lang string, source string, n_chars long"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def test_the_lake_follows_its_tables(spark, tmp_path):
    counted = registered()["union_counts"].run
    for events in (3, 5):
        found = {r["table"]: r["rows"] for r in counted(spark, given(spark, tmp_path, events)).collect()}
        assert found["bronze.mes_events"] == found["silver.silver_mes_events"] == events
        assert found["bronze.sap_ecc_orders"] == found["silver.silver_sap_inventory"] == 2


def test_the_lake_deduplicates_a_bronze_table_once(spark, tmp_path, monkeypatch):
    built = []
    monkeypatch.setitem(models.inputs._LOADS, "sap_ecc_orders", lambda rows, load=models.inputs._LOADS["sap_ecc_orders"]: built.append(1) or load(rows))
    tables = models.lake(spark, given(spark, tmp_path, 3))
    assert len(built) == 1
    assert "Window" not in tables["bronze.sap_ecc_orders"]._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("name", "columns"), [("run_suite", None), ("run_suite_quality_tests", {"test_id", "test_type", "batch_number", "result_value", "result"})])
def test_a_suite_stores_only_what_it_reads_again(spark, tmp_path, monkeypatch, name, columns):
    kept = []
    monkeypatch.setattr(governance, "stored", lambda spark, df, label: kept.append(set(df.columns)) or df)
    found = registered()[name].run(spark, given(spark, tmp_path, 3)).collect()
    assert kept == ([columns] if columns else [])
    assert len(found) == 6 and all(r["total"] == 2 for r in found)
