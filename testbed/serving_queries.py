"""Dashboard and report queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from millrace.operators import tables
from millrace.plans import registry, serving
from millrace.session import scratch
from testbed import inputs
from testbed.catalogue import add
from testbed.columns import present, shown
from testbed.models import bronze_relation, model
from testbed.oracle import half_up, mean2, statement

PLANT = "P1"
OEE = "date '2001-11-05'"
CAPA_DAY, CAPA_SQL_DAY = dt.date(2024, 8, 20), "date '2024-08-20'"
TRAINING_DAY, TRAINING_SQL_MONTH = dt.date(2001, 7, 15), "date '2001-07-01'"
RECENT = f"production_date >= {OEE} - 7 and plant = '{PLANT}'"
FLOW_TABLES = ("mes_events", "iqms_orders", "trackwise_deviations", "sap_ecc_orders")
RATE_TABLES = {
    "MES": "mes_production_orders",
    "IQMS": "iqms_quality_tests",
    "TMS": "tms_training_completions",
    "Trackwise": "trackwise_capas",
}


def _oee(spark, sf):
    return model(spark, sf, "gold_manufacturing_oee_mart")


def _spread(df, spark):
    """Ingest times spread over a few days, so the last-day filter has something to leave out."""
    return df.withColumn("_ingested_at", F.lit(inputs.INGESTED) - F.expr("make_interval(0, 0, 0, 0, 0, cast(_row_no % 3000 as int))"))


def ingest_rate(spark, sf):
    bronze = inputs.bronze_tables(spark, sf)
    numbered = {
        "MES": bronze["mes_production_orders"].withColumn("_row_no", F.col("_kafka_offset")),
        "IQMS": bronze["iqms_quality_tests"].withColumn("_row_no", F.col("_kafka_offset")),
        "TMS": bronze["tms_training_completions"].withColumn("_row_no", F.regexp_extract("record_id", "([0-9]+)$", 1).cast("bigint")),
        "Trackwise": bronze["trackwise_capas"].withColumn("_row_no", F.col("_kafka_offset")),
    }
    spread = {metric: _spread(df, spark) for metric, df in numbered.items()}
    return present(serving.ingest_rate(spread, inputs.INGESTED), "time:ts metric value")


def _rate_sql() -> str:
    parts = []
    for metric, number, source in (
        ("MES", "_kafka_offset", "b_mes_production_orders"),
        ("IQMS", "_kafka_offset", "b_iqms_quality_tests"),
        ("TMS", "regexp_extract(record_id, '([0-9]+)$', 1)::bigint", "b_tms_training"),
        ("Trackwise", "_kafka_offset", "b_trackwise_capas"),
    ):
        parts.append(
            f"select date_trunc('minute', stamp) as time, '{metric}' as metric, count(*) as value from (select _ingested_at "
            f"- ({number} % 3000) * interval 1 minute as stamp from {source}) "
            "where stamp >= timestamp '2024-02-01 06:30:00' - interval 24 hour group by 1"
        )
    return "(" + " union all ".join(parts) + ")"


def storage_bytes(spark, sf):
    """Listed files and bytes per table, next to the rows the table holds."""
    root = scratch(spark, "lake")
    bronze = inputs.bronze_tables(spark, sf)
    paths = {name: tables.table_path(root, "bronze", name) for name in registry.BRONZE_TABLES}
    tables.write_layer_tables({path: bronze[name] for name, path in paths.items()})
    listed = tables.storage_files(spark, paths)
    # Byte counts depend on the writer; that there are some does not.
    sizes = serving.storage_bytes(listed).select("table", (F.col("storage_bytes") > 0).alias("has_bytes"))
    rows = serving.row_counts({name: spark.read.parquet(path) for name, path in paths.items()})
    every = rows.rollup("table").agg(F.sum("rows").alias("rows")).withColumn("table", F.coalesce("table", F.lit("all")))
    return every.join(sizes, "table")


def serve_latest(spark, sf):
    raw = inputs.bronze_tables(spark, sf)["mes_production_orders"]
    return present(serving.latest_rows(raw), "_source_system _kafka_key _ingested_at:ts payload_preview")


LATEST = """(select _source_system, _kafka_key, _ingested_at, substr(_raw_payload, 1, 100) as payload_preview
    from b_mes_production_orders order by _ingested_at desc, _kafka_offset desc, _row_hash limit 10)"""


def freshness(spark, sf):
    bronze = inputs.bronze_tables(spark, sf)
    return present(serving.freshness({n: bronze[n] for n in registry.BRONZE_TABLES}), "table rows last_ingest:ts")


FRESH = (
    "("
    + " union all ".join(
        f"select '{n}' as \"table\", count(*) as rows, max(_ingested_at) as last_ingest from {bronze_relation(n)}" for n in registry.BRONZE_TABLES
    )
    + ")"
)


def flow_count(spark, sf):
    bronze = inputs.bronze_tables(spark, sf)
    return present(serving.flow_count({n: bronze[n] for n in FLOW_TABLES}), "flow_rows:n")


def demo_trace(spark, sf):
    """Orders of one number range followed from bronze into silver."""
    bronze = inputs.bronze_tables(spark, sf)
    layers = {"bronze.iqms_orders": bronze["iqms_orders"], "silver.silver_production_orders": model(spark, sf, "silver_production_orders")}
    return serving.demo_trace(layers, "order_id", "ORD-1")


TRACE = """select 'bronze.iqms_orders' as "table", order_id as key, count(*) as rows from b_iqms_orders where order_id like 'ORD-1%' group by 2
    union all select 'silver.silver_production_orders', order_id, count(*) from s_production_orders where order_id like 'ORD-1%' group by 2"""


def chart_metrics(spark, sf):
    metrics = serving.chart_metrics(model(spark, sf, "gold_oee_dashboard"), model(spark, sf, "gold_quality_kpis"))
    return present(metrics, "chart series time:ts value:9")


CHARTS = f"""(select 'total_batches' as chart, null as series, null::timestamp as time, sum(total_batches)::double as value from g_quality_kpis
    union all select 'quality_rate', product_code, hour_window, {mean2('quality_rate')} from g_oee_dashboard group by 2, 3
    union all select 'avg_temp', null, hour_window, avg(avg_temp) from g_oee_dashboard group by 3
    union all select 'released_batches', product_code, null, sum(released_batches)::double from g_quality_kpis group by 2)"""

GUARDED = (
    "SELECT product_code, batch_status, count(*) AS batches, sum(total_deviations) AS deviations FROM {gold_batch_summary} "
    "GROUP BY product_code, batch_status ORDER BY product_code, batch_status"
)


def guarded(spark, sf):
    return serving.guarded_select(spark, GUARDED, {"gold_batch_summary": model(spark, sf, "gold_batch_summary")})


def register() -> None:
    add(
        "serve_oee_score",
        lambda s, sf: present(serving.oee_score(_oee(s, sf), PLANT, inputs.OEE_AS_OF), "oee:6"),
        shown(f"(select {mean2('oee_score', 10000)} as oee from g_manufacturing_oee_mart where {RECENT})", "oee:6"),
    )
    add(
        "serve_oee_trend",
        lambda s, sf: present(
            serving.oee_trend(_oee(s, sf), PLANT, inputs.OEE_AS_OF), "time:d availability:6 performance:6 quality_rate:6"
        ),
        shown(
            f"(select production_date as time, {mean2('availability', 10000)} as availability, "
            f"{mean2('performance', 10000)} as performance, {mean2('quality_rate', 10000)} as quality_rate from g_manufacturing_oee_mart where {RECENT} group by 1)",
            "time:d availability:6 performance:6 quality_rate:6",
        ),
    )
    add(
        "serve_volume_topk",
        lambda s, sf: serving.volume_topk(_oee(s, sf), PLANT, inputs.OEE_AS_OF),
        statement(
            f"select machine_id, sum(total_actual_qty)::bigint as volume from g_manufacturing_oee_mart where {RECENT} "
            "group by 1 order by 2 desc, 1 limit 10"
        ),
    )
    add(
        "serve_pass_rate_trend",
        lambda s, sf: present(serving.pass_rate_trend(_oee(s, sf), inputs.OEE_AS_OF), "time:d pass_rate:6"),
        shown(
            f"(select production_date as time, {mean2('quality_pass_rate_pct')} as pass_rate from g_manufacturing_oee_mart "
            f"where production_date >= {OEE} - 30 group by 1)",
            "time:d pass_rate:6",
        ),
    )
    add(
        "serve_capa_by_department",
        lambda s, sf: serving.capa_by_department(model(s, sf, "gold_compliance_capa_mart"), CAPA_DAY),
        statement(
            "select department, sum(open_capas)::bigint as open_capas, sum(overdue_capas)::bigint as overdue_capas from "
            f"g_compliance_capa_mart where report_month >= date_trunc('month', {CAPA_SQL_DAY} - interval 3 month) group by 1"
        ),
    )
    add(
        "serve_rag_distribution",
        lambda s, sf: serving.rag_distribution(model(s, sf, "gold_compliance_capa_mart")),
        statement('select compliance_rag_status, count(*) as "count" from g_compliance_capa_mart group by 1'),
    )
    add(
        "serve_overdue_training",
        lambda s, sf: serving.overdue_training(model(s, sf, "gold_training_compliance_mart"), TRAINING_DAY),
        statement(f"select sum(overdue_trainings)::bigint as overdue from g_training_compliance_mart where report_month = {TRAINING_SQL_MONTH}"),
    )
    add("serve_ingest_rate", ingest_rate, shown(_rate_sql(), "time:ts metric value"))
    add(
        "serve_storage_bytes",
        storage_bytes,
        statement(
            'select coalesce(t, \'all\') as "table", sum(n)::bigint as rows, true as has_bytes from ('
            + " union all ".join(f"select '{n}' as t, count(*) as n from {bronze_relation(n)}" for n in registry.BRONZE_TABLES)
            + ") group by rollup (t)"
        ),
    )
    add("serve_latest_rows", serve_latest, shown(LATEST, "_source_system _kafka_key _ingested_at:ts payload_preview"))
    add(
        "serve_orders_by_status",
        lambda s, sf: present(
            serving.orders_by_status(model(s, sf, "silver_production_orders")),
            "product_code status total_orders avg_planned_qty:1 avg_actual_qty:1 avg_yield:3",
        ),
        shown(
            "(select product_code, status, count(*) as total_orders, avg(planned_qty) as avg_planned_qty, avg(actual_qty) as avg_actual_qty, "
            f"{mean2('yield')} as avg_yield from s_production_orders group by 1, 2)",
            "product_code status total_orders avg_planned_qty:1 avg_actual_qty:1 avg_yield:3",
        ),
    )
    add(
        "serve_mean_yield",
        lambda s, sf: present(serving.mean_yield(model(s, sf, "silver_production_orders")), "product_code mean_yield:4"),
        shown(
            f"(select product_code, avg(y) as mean_yield from (select product_code, {half_up(mean2('yield'), 3)} as y "
            "from s_production_orders group by product_code, status) group by 1)",
            "product_code mean_yield:4",
        ),
    )
    add(
        "serve_quality_by_product",
        lambda s, sf: present(
            serving.quality_by_product(model(s, sf, "gold_oee_dashboard")),
            "product_code quality_rate:3 total_events pass_count fail_count",
        ),
        shown(
            f"(select product_code, {mean2('quality_rate')} as quality_rate, sum(total_events)::bigint as total_events, "
            "sum(pass_count)::bigint as pass_count, sum(fail_count)::bigint as fail_count from g_oee_dashboard group by 1)",
            "product_code quality_rate:3 total_events pass_count fail_count",
        ),
    )
    for key, keys, by_product in (
        ("serve_batch_status", "product_code batch_status", True),
        ("serve_batch_status_total", "batch_status", False),
    ):
        spec = f"{keys} batch_count avg_yield:2 total_critical"
        add(
            key,
            lambda s, sf, by=by_product, spec=spec: present(serving.batch_status(model(s, sf, "gold_batch_summary"), by), spec),
            shown(
                f"(select {keys.replace(' ', ', ')}, count(*) as batch_count, {mean2('yield_pct')} as avg_yield, "
                "sum(critical_deviations)::bigint as total_critical from g_batch_summary group by all)",
                spec,
            ),
        )
    add(
        "serve_batch_topk",
        lambda s, sf: present(
            serving.batch_topk(model(s, sf, "gold_batch_summary")),
            "batch_id product_code yield_pct:2 total_deviations critical_deviations batch_status",
        ),
        shown(
            "(select * from g_batch_summary order by critical_deviations desc, batch_id limit 10)",
            "batch_id product_code yield_pct:2 total_deviations critical_deviations batch_status",
        ),
    )
    kpis = "report_date:d product_code total_batches right_first_time_pct:2 avg_yield_pct:2 total_deviations:n critical_deviation_rate:2"
    add(
        "serve_kpi_ranking",
        lambda s, sf: present(serving.kpi_ranking(model(s, sf, "gold_quality_kpis")), kpis),
        shown("g_quality_kpis", kpis),
    )
    add("serve_freshness", freshness, shown(FRESH, "table rows last_ingest:ts"))
    add("serve_chart_metrics", chart_metrics, shown(CHARTS, "chart series time:ts value:9"))
    detail = "batch_id product_code production_start:ts production_end:ts actual_qty:4 yield_pct:2 batch_status"
    add(
        "serve_detail_table",
        lambda s, sf: present(serving.detail_table(model(s, sf, "gold_batch_summary")), detail),
        shown("g_batch_summary", detail),
    )
    add(
        "serve_flow_count",
        flow_count,
        statement(
            "select count(*) as flow_rows from (select _nifi_flow from b_mes_events union all select _nifi_flow from b_iqms_orders union all "
            "select _nifi_flow from b_trackwise_deviations union all select _nifi_flow from b_sap_ecc_orders) where _nifi_flow = 'nifi_s3_ingest'"
        ),
    )
    add("serve_demo_trace", demo_trace, statement(TRACE))
    add(
        "guarded_select",
        guarded,
        statement(
            "select product_code, batch_status, count(*) as batches, sum(total_deviations)::bigint as deviations from g_batch_summary "
            "group by 1, 2 order by 1, 2 limit 100"
        ),
    )
