"""Sources, sinks, bronze operators and table updates as queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from millrace.operators import days, merge, quality, tables
from millrace.operators.dedup import dedup_latest
from millrace.plans import bronze, schemas, serving
from millrace.plans.suites import SUITES
from millrace.session import scratch
from millrace.sources import cdc, files, kafka, offsets
from millrace.streaming import jobs
from testbed import inputs
from testbed.catalogue import add
from testbed.columns import present, shown
from testbed.models import COLUMNS, SHARED, relation, stored_bronze, stored_models
from testbed.oracle import INGESTED_SQL, scalar, statement

RAW_MES = " ".join(COLUMNS["bronze_mes_events"].split()[:11])
RAW_ORDERS = " ".join(COLUMNS["bronze_iqms_orders"].split()[:10])
STREAM_TABLES = ["mes_production_orders", "iqms_quality_tests", "iqms_deviations", "trackwise_capas"]


def as_text(df):
    """All columns as text, as a CSV file holds them."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def sql_text(name: str) -> str:
    columns = ", ".join(f'cast("{c}" as varchar) as "{c}"' for c in inputs.INPUTS[name].columns)
    return f"(select {columns} from {name})"


def csv_of(spark, sf, name: str) -> str:
    path = scratch(spark, f"{name}.csv")
    as_text(inputs.spark_input(spark, sf, name)).write.option("header", True).csv(path)
    return path


def json_documents_of(spark, sf, name: str, key: str) -> str:
    """Files of one JSON document each; a document is an array of at most a few hundred records."""
    path = scratch(spark, f"{name}.json")
    rows = as_text(inputs.spark_input(spark, sf, name))
    bundle = F.floor(F.regexp_extract(key, "([0-9]+)$", 1).cast("bigint") / 500)
    documents = rows.groupBy(bundle.alias("_bundle")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    documents.select("value").write.option("maxRecordsPerFile", 1).option("ignoreNullFields", "false").text(path)
    return path + "/*"


def scan_csv(spark, sf):
    read = files.read_csv(spark, csv_of(spark, sf, "raw_mes_events"), schemas.MES_EVENTS)
    return present(bronze.typed(read, schemas.MES_EVENTS), RAW_MES)


def scan_json(spark, sf):
    read = files.read_json_drop(spark, json_documents_of(spark, sf, "raw_mes_events", "event_id"), schemas.MES_EVENTS)
    return present(bronze.typed(read, schemas.MES_EVENTS), RAW_MES)


def preferred_source(spark, sf):
    nowhere = scratch(spark, "no-drop") + "/*.json"
    drop = json_documents_of(spark, sf, "raw_trackwise_deviations", "deviation_id")
    with_drop = files.preferred_source(spark, drop, nowhere, schemas.TRACKWISE_DEVIATIONS, "TrackWise", inputs.now())
    orders_csv = csv_of(spark, sf, "raw_iqms_orders")
    without = files.preferred_source(spark, nowhere, orders_csv, schemas.IQMS_ORDERS, "IQMS", inputs.now())
    keep = ("batch_id", "product_code", "status", "_source", "_nifi_flow")
    return with_drop.select(F.col("deviation_id").alias("key"), *keep).unionByName(
        without.select(F.col("order_id").alias("key"), *keep)
    )


PREFERRED = (
    "select deviation_id as key, batch_id, product_code, status, 'TrackWise' as _source, 'nifi_s3_ingest' as _nifi_flow "
    "from raw_trackwise_deviations union all "
    "select order_id, batch_id, product_code, status, 'IQMS', 'csv_seed' from raw_iqms_orders"
)


def record_files(spark, sf, *names: str) -> str:
    """Kafka-shaped records of several topics in one folder."""
    path = scratch(spark, "records")
    for name in names:
        tables.append_layer_table(inputs.spark_input(spark, sf, name).select(*schemas.KAFKA_RECORD.fieldNames()), path)
    return path


def bronze_replay(spark, sf):
    records = kafka.read_record_files(spark, record_files(spark, sf, "kafka_trackwise_capas", "kafka_iqms_deviations"))
    path = scratch(spark, "replayed")
    tables.append_layer_table(bronze.raw_envelope(records, inputs.now()), path)
    return present(spark.read.parquet(path), COLUMNS["bronze_raw_envelope"])


def publish_envelope(spark, sf):
    return kafka.publish_envelope(as_text(inputs.spark_input(spark, sf, "raw_iqms_orders")), "raw.iqms.orders")


def sql_row_json(name: str) -> str:
    fields = ", ".join(f"\"{c}\": \"{c}\"" for c in inputs.INPUTS[name].columns)
    return f"cast(to_json({{{fields}}}) as varchar)"


def split_to_json(spark, sf):
    read = files.read_csv(spark, csv_of(spark, sf, "raw_iqms_orders"), schemas.IQMS_ORDERS)
    split = files.split_to_json(read)
    return split.select("record", F.regexp_extract("source_filename", r"\.([a-z]+)$", 1).alias("file_kind"))


def mes_bronze(spark, sf):
    return inputs.bronze_tables(spark, sf)["mes_events"]


def write_layer_table(spark, sf):
    path = tables.table_path(scratch(spark, "lake"), "bronze", "mes_events")
    rows = mes_bronze(spark, sf).withColumn("event_date", F.to_date("event_ts"))
    for _ in range(2):  # the second write replaces the first
        tables.write_layer_table(bronze.cluster_by_day(rows, "event_ts"), path, ["event_date"], rebalance=False)
    return present(spark.read.parquet(path), COLUMNS["bronze_mes_events"] + " event_date:d")


def append_layer_table(spark, sf):
    path = tables.table_path(scratch(spark, "lake"), "bronze", "iqms_orders")
    rows = inputs.bronze_tables(spark, sf)["iqms_orders"]
    started = F.col("actual_start").isNotNull()
    for part in (rows.where(started), rows.where(~started), rows.where(F.lit(False))):
        tables.append_layer_table(part, path)
    return present(spark.read.parquet(path), COLUMNS["bronze_iqms_orders"])


def ensure_tables(spark, sf):
    root = scratch(spark, "lake")
    tables.ensure_tables(spark, root, "bronze", schemas.PLACEHOLDERS)
    path = tables.table_path(root, "bronze", "tms_training_completions")
    tables.append_layer_table(inputs.bronze_tables(spark, sf)["tms_training_completions"], path)
    tables.ensure_tables(spark, root, "bronze", schemas.PLACEHOLDERS)  # must leave the filled table alone
    return serving.row_counts(
        {name: spark.read.parquet(tables.table_path(root, "bronze", name)) for name in schemas.PLACEHOLDERS}
    )


ENSURED = (
    "select 'tms_training_completions' as \"table\", count(*) as rows from b_tms_training union all "
    "select name, 0 from (values ('trackwise_capas'), ('mes_production_orders'), ('iqms_quality_tests'), "
    "('iqms_deviations')) v(name)"
)


def cdc_rows(spark, sf):
    return cdc.cdc_unwrap(inputs.spark_input(spark, sf, "kafka_cdc_orders"), CDC_SCHEMA)


CDC_SCHEMA = schemas._struct("order_id string, product_code string, quantity int, status string")
CDC_COLUMNS = "order_id product_code quantity status __op __table __source_ts_ms _offset"
CDC_SQL = """(select json_extract_string(value, '$.after.order_id') as order_id,
    json_extract_string(value, '$.after.product_code') as product_code, (value->>'$.after.quantity')::int as quantity,
    value->>'$.after.status' as status, value->>'$.op' as __op, value->>'$.source.table' as __table,
    (value->>'$.source.ts_ms')::bigint as __source_ts_ms, "offset" as _offset
    from kafka_cdc_orders where json_valid(value) and json_type(value, '$.after') = 'OBJECT')"""


def changed_files(spark, sf):
    """Reload only what changed: two event types get a further file after the first load."""
    path = scratch(spark, "drops")
    events = inputs.table(spark, sf, "events")
    events.write.partitionBy("event_type").parquet(path)
    manifest = scratch(spark, "manifest")
    files.file_listing(spark, path, "*.parquet").write.parquet(manifest)
    events.where("event_type in ('error', 'click')").write.mode("append").partitionBy("event_type").parquet(path)
    fresh = files.rows_of_changed_files(spark.read.parquet(path), files.load_manifest(spark, manifest))
    return fresh.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.max("event_id").alias("last_event"))


def jsonl_latest(spark, sf):
    """Two drops of JSON lines; the later one corrects every third record."""
    path = scratch(spark, "training")
    payload = F.col("value").cast("string").alias("value")
    first = inputs.spark_input(spark, sf, "kafka_tms_training")
    first.select(payload).write.text(f"{path}/drop=1")
    corrected = first.where("offset % 3 = 0").select(F.replace(payload, F.lit('"completed"'), F.lit('"OVERDUE"')).alias("value"))
    corrected.write.text(f"{path}/drop=2")
    schema = schemas._struct("record_id string, department string, status string, score string, scheduled_date string")
    return files.load_jsonl_latest(spark, path + "/*", "record_id", schema)


JSONL = f"""select record_id, department, case when o % 3 = 0 and status = 'completed' then 'OVERDUE' else status end as status,
    score, scheduled_date
    from (select {scalar('record_id', 'value')} as record_id, {scalar('department', 'value')} as department,
                 {scalar('status', 'value')} as status, {scalar('score', 'value')} as score,
                 {scalar('scheduled_date', 'value')} as scheduled_date, "offset" as o from kafka_tms_training)
    where record_id is not null"""

SAP_COLUMNS = COLUMNS["bronze_sap_orders"]
SAP_SQL = f"""(select {scalar('document_number', 'value')} as po_number, {scalar('material_code', 'value')} as material_code,
    {scalar('plant', 'value')} as plant, {scalar('storage_location', 'value')} as storage_location,
    trunc(({scalar('quantity', 'value')})::double)::int as planned_qty, trunc(({scalar('quantity', 'value')})::double)::int as actual_qty,
    {scalar('uom', 'value')} as uom, ({scalar('posting_date', 'value')})::date as posting_date,
    {scalar('movement_type', 'value')} as cost_center, ({scalar('valuation_amount_inr', 'value')})::double as total_cost,
    'INR' as currency, 'SAP_ECC_KAFKA' as _source, {INGESTED_SQL} as _ingested_at, 'kafka_bronze_ingest' as _nifi_flow
    from kafka_sap_inventory where {scalar('document_number', 'value')} is not null)"""


def bronze_sap(spark, sf):
    return present(bronze.project_inventory(inputs.spark_input(spark, sf, "kafka_sap_inventory"), inputs.now()), SAP_COLUMNS)


def anti_join_existing(spark, sf):
    rows = inputs.bronze_tables(spark, sf)["iqms_quality_tests"]
    stored = rows.where("_kafka_offset % 2 = 0")
    return merge.anti_join_existing(rows, stored, schemas.RAW_KEYS).select("_row_hash", "_kafka_offset", "_kafka_key")


def _training_versions(spark, sf):
    """Training records, every third one a second time with another status and a later offset; a tenth is stored before."""
    records = inputs.spark_input(spark, sf, "kafka_tms_training")
    later = records.where("offset % 3 = 0").withColumns(
        {
            "value": F.regexp_replace(F.col("value").cast("string"), '"status": *"[^"]*"', '"status": "REVISED"').cast("binary"),
            "offset": F.col("offset") + 1_000_000_000,
        }
    )
    return records.unionByName(later)


def anti_join_latest(spark, sf):
    """Keyed records into bronze in two batches: of several new versions the newest is stored, a stored one stays."""
    records, root = _training_versions(spark, sf), scratch(spark, "lake")
    for batch in (records.where("offset % 10 = 0 and offset < 1000000000"), records):
        jobs.land_records(batch.select(*schemas.KAFKA_RECORD.fieldNames()), root, inputs.now())
    table = spark.read.parquet(tables.table_path(root, "bronze", "tms_training_completions"))
    return table.select("record_id", "employee_id", "status")


LATEST = f"""select record_id, employee_id, case when n % 3 = 0 and n % 10 <> 0 then 'REVISED' else status end as status
    from (select *, cast(regexp_extract(record_id, '([0-9]+)$', 1) as bigint) as n from b_tms_training)"""


def ingest_offsets(spark, sf):
    """Three runs over growing record files: a topic from its start, then with a partition and a topic that are new
    (which starts at its newest record), then without anything new. The ranges of the second run and what is stored."""
    root, names = scratch(spark, "lake"), ("kafka_mes_production_orders", "kafka_trackwise_capas")
    records = kafka.read_record_files(spark, record_files(spark, sf, *names))
    topics = ("mes.production_orders", "trackwise.capas")
    first = records.where("topic = 'mes.production_orders' and partition < 2 and offset < 20000")
    offsets.ingest_topics(spark, first, root, topics, dt.datetime(2024, 2, 1), bootstrap=True, now=inputs.now())
    found = offsets.ingest_topics(spark, records, root, topics, dt.datetime(2024, 2, 2), now=inputs.now())
    offsets.ingest_topics(spark, records, root, topics, dt.datetime(2024, 2, 3), now=inputs.now())
    stored = spark.read.parquet(tables.table_path(root, "bronze", "mes_production_orders"))
    total = stored.agg(F.count(F.lit(1)).alias("start_offset")).select(
        F.lit("stored").alias("topic"), F.lit(None).cast("int").alias("partition"), "start_offset", F.lit(None).cast("long").alias("end_offset")
    )
    return found.unionByName(total)


OFFSETS = """select topic, partition, case when topic = 'trackwise.capas' then max("offset") + 1 when partition = 2 then 0
            else max("offset") filter (where "offset" < 20000) + 1 end as start_offset, max("offset") + 1 as end_offset
        from (select topic, partition, "offset" from kafka_mes_production_orders union all select topic, partition, "offset" from kafka_trackwise_capas)
        group by topic, partition
    union all select 'stored', null, (select count(*) from (select distinct _row_hash, _kafka_offset from b_mes_production_orders)), null"""


def dedup(spark, sf):
    raw = inputs.spark_input(spark, sf, "raw_sap_ecc_orders")
    return present(dedup_latest(raw, ["po_number"], ["posting_date", "total_cost"]), " ".join(SAP_COLUMNS.split()[:11]))


def cluster_by_day(spark, sf):
    rows = mes_bronze(spark, sf).withColumn("event_date", F.to_date("event_ts"))
    return present(bronze.cluster_by_day(rows, "event_ts"), "event_id event_ts:ts event_date:d")


def with_metadata(spark, sf):
    raw = inputs.spark_input(spark, sf, "raw_sop_documents")
    return present(bronze.with_metadata(raw, "Document Index", "csv_seed", inputs.now()), COLUMNS["bronze_sop_documents"])


def bronze_extent(spark, sf):
    return present(bronze.extent(mes_bronze(spark, sf), "event_ts"), "row_count min_event_ts:ts max_event_ts:ts")


def dual_land(spark, sf):
    root = scratch(spark, "lake")
    main, demo = (tables.table_path(root, "bronze", t) for t in ("iqms_orders", "demo_iqms_orders"))
    orders = inputs.bronze_tables(spark, sf)["iqms_orders"]
    tables.write_layer_table(orders, main)
    extra = orders.withColumns({"order_id": F.concat(F.lit("DEMO-"), "order_id"), "_nifi_flow": F.lit("csv_demo_ingest")})
    return tables.dual_land(extra, demo, main)


def incremental_filter(spark, sf):
    """The bound comes from the newest day of the target, the only one that is read."""
    rows, path = mes_bronze(spark, sf), scratch(spark, "target")
    target = rows.where(F.col("event_ts") < F.lit(dt.datetime(2024, 1, 20))).withColumn("event_date", F.to_date("event_ts"))
    days.append_days(spark, path, target, "event_date")
    return present(merge.from_bound(rows, days.newest_value(spark, path, "event_ts"), "event_ts"), "event_id event_ts:ts status")


def _split_for_merge(spark, sf):
    rows = inputs.bronze_tables(spark, sf)["iqms_orders"].select("order_id", "batch_id", "quantity", "status")
    number = F.regexp_extract("order_id", "([0-9]+)$", 1).cast("bigint")
    target = rows.where(number % 4 != 0)
    updates = rows.where(number % 2 == 0).withColumns({"status": F.lit("UPDATED"), "revision": F.lit(2)})
    return target, updates


_ORDER_NO = "regexp_extract(order_id, '([0-9]+)$', 1)::bigint"


def merge_by_key(spark, sf):
    target, updates = _split_for_merge(spark, sf)
    return merge.merge_by_key(target, updates, ["order_id"])


def merge_schema_append(spark, sf):
    target, updates = _split_for_merge(spark, sf)
    return merge.merge_schema_append(target, updates)


def insert_ignore(spark, sf):
    target, updates = _split_for_merge(spark, sf)
    return merge.insert_ignore(target, updates, ["order_id"])


def partition_merge(spark, sf):
    """Events merged into their day partitions: corrections, new events, and events that move to another day."""
    path = scratch(spark, "merged")
    rows = mes_bronze(spark, sf).select("event_id", "machine_id", "status", "event_ts")
    number = F.regexp_extract("event_id", "([0-9]+)$", 1).cast("bigint")
    dated = rows.withColumn("event_date", F.to_date("event_ts"))
    days.merge_days(spark, path, dated.where(number % 5 != 0), ["event_id"], "event_date", ["event_ts"])
    moved = rows.where(number % 5 == 0).withColumn("event_ts", F.col("event_ts") + F.expr("interval 1 day"))
    fixed = rows.where(number % 10 == 3).withColumn("status", F.lit("FIXED"))
    later = rows.where(number % 10 == 7).withColumn("event_ts", F.col("event_ts") + F.expr("interval 3 day"))
    updates = moved.unionByName(fixed).unionByName(later).withColumn("event_date", F.to_date("event_ts"))
    for _ in range(2):  # repeating the merge changes nothing
        days.merge_days(spark, path, updates, ["event_id"], "event_date", ["event_ts"])
    return present(days.read_days(spark, path), "event_id machine_id status event_ts:ts event_date:d")


PARTITION_MERGE = """(select event_id, machine_id, case when n % 10 = 3 then 'FIXED' else status end as status, moved as event_ts,
    moved::date as event_date
    from (select *, regexp_extract(event_id, '([0-9]+)$', 1)::bigint as n,
                 event_ts + (case regexp_extract(event_id, '([0-9]+)$', 1)::bigint % 10 when 0 then 1 when 5 then 1 when 7 then 3 else 0 end)
                            * interval 1 day as moved
          from b_mes_events))"""


def run_metrics(spark, sf):
    source = stored_bronze(spark, sf, *SHARED[:4])
    silver_names = ("silver_mes_events", "silver_production_orders", "silver_quality_events")
    gold_names = ("gold_oee_dashboard", "gold_batch_summary", "gold_quality_kpis", "gold_production_efficiency")
    built = stored_models(spark, sf, *silver_names, *gold_names, bronze=source)
    silver, gold = ({n: built[n] for n in names} for names in (silver_names, gold_names))
    first = {n: source[n] for n in ("mes_events", "iqms_orders", "trackwise_deviations", "sap_ecc_orders", "sop_documents")}
    suites = {n: quality.run_suite(silver[n], SUITES[n]) for n in ("silver_mes_events", "silver_quality_events")}
    return serving.run_metrics({"bronze": first, "silver": silver, "gold": gold}, suites)


def _counts(*names: str) -> str:
    return " + ".join(f"(select count(*) from {relation(n)})" for n in names)


METRICS = f"""select 'bronze' as layer, 'rows' as metric, (select count(*) from b_mes_events) + (select count(*) from b_iqms_orders)
      + (select count(*) from b_trackwise_deviations) + (select count(*) from b_sap_ecc_orders)
      + (select count(*) from b_sop_documents) as value
    union all select 'silver', 'rows', {_counts('silver_mes_events', 'silver_quality_events', 'silver_production_orders')}
    union all select 'gold', 'rows', {_counts('gold_oee_dashboard', 'gold_batch_summary', 'gold_quality_kpis', 'gold_production_efficiency')}
    union all select 'checks', 'total', 9
    union all select 'checks', 'passed', (select count(*) from (
        select count(*) filter (where event_id is null or batch_id is null or event_ts is null) = 0 as ok from s_mes_events
        union all select count(*) filter (where status not in ('PASS', 'FAIL', 'WARNING')) = 0 from s_mes_events
        union all select count(*) filter (where parameter_value < 0 or parameter_value > 1000) = 0 from s_mes_events
        union all select count(*) between 400 and 600 from s_mes_events
        union all select count(distinct event_id) = count(event_id) from s_mes_events
        union all select count(*) filter (where deviation_id is null) = 0 from s_quality_events
        union all select count(*) filter (where batch_id is null) = 0 from s_quality_events
        union all select count(*) filter (where severity not in ('CRITICAL', 'MAJOR', 'MINOR')) = 0 from s_quality_events
        union all select count(*) filter (where severity_score < 1 or severity_score > 3) = 0 from s_quality_events) where ok)"""


def register() -> None:
    add("scan_csv", scan_csv, shown("raw_mes_events", RAW_MES))
    add("scan_json", scan_json, shown("raw_mes_events", RAW_MES))
    add("preferred_source", preferred_source, statement(PREFERRED))
    add(
        "bronze_replay",
        bronze_replay,
        shown("(select * from b_trackwise_capas union all select * from b_iqms_deviations)", COLUMNS["bronze_raw_envelope"]),
    )
    add(
        "publish_envelope",
        publish_envelope,
        statement(
            f"select order_id as key, {sql_row_json('raw_iqms_orders')} as value, 'raw.iqms.orders' as topic "
            f"from {sql_text('raw_iqms_orders')}"
        ),
    )
    add(
        "split_to_json",
        split_to_json,
        statement(f"select {sql_row_json('raw_iqms_orders')} as record, 'csv' as file_kind from {sql_text('raw_iqms_orders')}"),
    )
    add(
        "write_layer_table",
        write_layer_table,
        shown("(select *, event_ts::date as event_date from b_mes_events)", COLUMNS["bronze_mes_events"] + " event_date:d"),
    )
    add("append_layer_table", append_layer_table, shown("b_iqms_orders", COLUMNS["bronze_iqms_orders"]))
    add("ensure_tables", ensure_tables, statement(ENSURED))
    add("anti_join_latest", anti_join_latest, statement(LATEST))
    add("ingest_offsets", ingest_offsets, statement(OFFSETS))
    add("cdc_unwrap", lambda s, sf: present(cdc_rows(s, sf)[0], CDC_COLUMNS), shown(CDC_SQL, CDC_COLUMNS))
    add(
        "cdc_dead_letters",
        lambda s, sf: present(cdc_rows(s, sf)[1], "key topic partition offset value"),
        shown("kafka_cdc_orders", "key topic partition offset value", "where value is not null and not json_valid(value)"),
    )
    add(
        "cdc_latest",
        lambda s, sf: present(cdc.cdc_latest(cdc_rows(s, sf)[0], ["order_id"]), CDC_COLUMNS),
        shown(CDC_SQL, CDC_COLUMNS, "qualify row_number() over (partition by order_id order by __source_ts_ms desc, _offset desc) = 1"),
    )
    add(
        "changed_files",
        changed_files,
        "select event_type, count(*) as rows, max(event_id) as last_event from events "
        "where event_type in ('error', 'click') group by event_type",
    )
    add("load_jsonl_latest", jsonl_latest, statement(JSONL))
    add("run_metrics", run_metrics, statement(METRICS))
    add("bronze_sap", bronze_sap, shown(SAP_SQL, SAP_COLUMNS))
    add(
        "anti_join_existing",
        anti_join_existing,
        statement("select distinct _row_hash, _kafka_offset, _kafka_key from b_iqms_quality_tests where _kafka_offset % 2 = 1"),
    )
    add("dedup_latest", dedup, shown("b_sap_ecc_orders", " ".join(SAP_COLUMNS.split()[:11])))
    add(
        "cluster_by_day",
        cluster_by_day,
        shown("(select *, event_ts::date as event_date from b_mes_events)", "event_id event_ts:ts event_date:d"),
    )
    add("with_metadata", with_metadata, shown("b_sop_documents", COLUMNS["bronze_sop_documents"]))
    add(
        "bronze_extent",
        bronze_extent,
        shown(
            "(select count(*) as row_count, min(event_ts) as min_event_ts, max(event_ts) as max_event_ts from b_mes_events)",
            "row_count min_event_ts:ts max_event_ts:ts",
        ),
    )
    add(
        "dual_land",
        dual_land,
        statement("select count(*) as demo_rows, count(*) as rows_before, 2 * count(*) as rows_after from b_iqms_orders"),
    )
    add(
        "incremental_filter",
        incremental_filter,
        shown(
            "b_mes_events",
            "event_id event_ts:ts status",
            "where event_ts >= (select max(event_ts) from b_mes_events where event_ts < timestamp '2024-01-20')",
        ),
    )
    add(
        "merge_by_key",
        merge_by_key,
        statement(
            f"select order_id, batch_id, quantity, case when {_ORDER_NO} % 2 = 0 then 'UPDATED' else status end as status, "
            f"case when {_ORDER_NO} % 2 = 0 then 2 end as revision from b_iqms_orders"
        ),
    )
    add(
        "merge_schema_append",
        merge_schema_append,
        statement(
            f"select order_id, batch_id, quantity, status, null::int as revision from b_iqms_orders where {_ORDER_NO} % 4 <> 0 "
            f"union all select order_id, batch_id, quantity, 'UPDATED', 2 from b_iqms_orders where {_ORDER_NO} % 2 = 0"
        ),
    )
    add(
        "insert_ignore",
        insert_ignore,
        statement(
            f"select order_id, batch_id, quantity, case when {_ORDER_NO} % 4 = 0 then 'UPDATED' else status end as status, "
            f"case when {_ORDER_NO} % 4 = 0 then 2 end as revision from b_iqms_orders"
        ),
    )
    add("merge_into_days", partition_merge, shown(PARTITION_MERGE, "event_id machine_id status event_ts:ts event_date:d"))
