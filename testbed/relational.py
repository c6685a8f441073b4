"""One query per relational primitive and scalar family, over the silver and gold tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import (
    cap_at,
    compact_whitespace,
    complete_units,
    empty_safe_words,
    iso_timestamp,
    month_start,
    percent,
    ratio,
    severity_score,
    upper_trim,
    with_json_fields,
)
from millrace.operators.lookup import lookup_join
from millrace.operators.nearest import nearest_dated
from millrace.plans import gold, serving, silver
from testbed import inputs
from testbed.catalogue import add
from testbed.columns import present, shown
from testbed.models import LAKE_SQL, lake, model
from testbed.oracle import half_up, scalar, statement

OEE_DAY = "date '2001-11-05'"


def filter_predicates(spark, sf):
    events = model(spark, sf, "silver_mes_events")
    low = F.col("parameter_name").isin("temperature", "pressure") & F.col("parameter_value").between(2, 30)
    kept = events.where(
        F.col("order_id").isNotNull() & low & ~F.col("shift").isin("C") & F.col("machine_id").like("MCH-00%") & (F.col("status") != "FAIL")
    )
    return present(kept, "event_id machine_id parameter_name parameter_value:6 shift status")


FILTERED = (
    "where order_id is not null and parameter_name in ('temperature', 'pressure') and parameter_value between 2 and 30 "
    "and shift not in ('C') and machine_id like 'MCH-00%' and status <> 'FAIL'"
)


def join_inner(spark, sf):
    """Events and deviations of one batch."""
    tables = inputs.bronze_tables(spark, sf)
    batches = tables["mes_events"].groupBy("batch_id").agg(F.count(F.lit(1)).alias("events"))
    return lookup_join(
        tables["trackwise_deviations"].select("deviation_id", "batch_id", "severity"), batches, ["batch_id"], "inner", salted=True, task_rows=2
    )


def join_latest_lookup(spark, sf):
    """Every event with its batch's latest order; hot batches spread, as on tables too large to broadcast."""
    tables = inputs.bronze_tables(spark, sf)
    latest = silver.latest_order_per_batch(tables["iqms_orders"])
    events = tables["mes_events"].select("event_id", "batch_id")
    return lookup_join(events, latest, ["batch_id"], salted=True, task_rows=3).select(
        "event_id", "batch_id", "order_id", "order_status", "planned_quantity"
    )


def join_left_composite(spark, sf):
    made = model(spark, sf, "silver_mes_production_orders", columns=["machine_id", "start_time", "actual_qty"])
    tested = model(spark, sf, "silver_iqms_quality_tests", columns=["machine_id", "tested_at", "pass_fail_flag"])
    orders = made.groupBy("machine_id", F.to_date("start_time").alias("day")).agg(
        F.sum("actual_qty").alias("made")
    )
    tests = tested.groupBy("machine_id", F.to_date("tested_at").alias("day")).agg(
        F.count_if("pass_fail_flag").alias("passed")
    )
    return present(orders.join(tests, ["machine_id", "day"], "left"), "machine_id day:d made passed")


def join_left_filtered(spark, sf):
    built = (
        model(spark, sf, "silver_trackwise_capas", columns=["product_code", "opened_date"]),
        model(spark, sf, "silver_iqms_deviations", columns=["product_code", "detected_at", "severity"]),
    )
    capas = built[0].groupBy("product_code", month_start(F.col("opened_date")).alias("month")).agg(F.count(F.lit(1)).alias("capas"))
    critical = (
        built[1].where("severity = 'CRITICAL'")
        .groupBy("product_code", month_start(F.to_date("detected_at")).alias("month"))
        .agg(F.count(F.lit(1)).alias("critical"))
    )
    return present(capas.join(critical, ["product_code", "month"], "left"), "product_code month:d capas critical")


def join_full_chain(spark, sf):
    key = ["product_code", "batch_number"]
    sides = [
        model(spark, sf, name, columns=key).groupBy(*key).agg(F.count(F.lit(1)).alias(alias))
        for name, alias in (
            ("silver_mes_production_orders", "orders"),
            ("silver_iqms_quality_tests", "tests"),
            ("silver_iqms_deviations", "deviations"),
        )
    ]
    return sides[0].join(sides[1], key, "full").join(sides[2], key, "full")


def semi_join_duplicates(spark, sf):
    """Raw purchase-order lines whose number occurs more than once."""
    raw = inputs.spark_input(spark, sf, "raw_sap_ecc_orders").select("po_number", "plant", "total_cost")
    repeated = raw.groupBy("po_number").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return present(raw.join(repeated, "po_number", "left_semi"), "po_number plant total_cost:2")


def join_nearest_date(spark, sf):
    """Each deviation with the stock document of its product effective nearest to the report."""
    tables = inputs.bronze_tables(spark, sf)
    posted = tables["sap_ecc_orders"].select(
        F.replace("material_code", F.lit("MAT"), F.lit("API")).alias("product_code"), "posting_date", "cost_center", "po_number"
    )
    started = tables["iqms_orders"].select("order_id", "product_code", "actual_start")
    matched = nearest_dated(started, posted, "product_code", "actual_start", "posting_date", ["cost_center", "po_number"])
    return present(matched, "order_id product_code actual_start:ts posting_date:d cost_center po_number")


# The pairs of a product and a calendar moment are few; each is ranked against all postings of the product.
NEAREST = """(select o.order_id, o.product_code, o.actual_start, m.posting_date, m.cost_center, m.po_number
    from b_iqms_orders o
    left join (
        select s.product_code, s.actual_start, p.posting_date, p.cost_center, p.po_number
        from (select distinct product_code, actual_start from b_iqms_orders) s
        join (select replace(material_code, 'MAT', 'API') as product_code, posting_date, cost_center, po_number
              from b_sap_ecc_orders
              qualify row_number() over (partition by material_code, posting_date order by cost_center, po_number) = 1) p
          on p.product_code = s.product_code
        qualify row_number() over (
            partition by s.product_code, s.actual_start
            order by abs(date_sub('day', p.posting_date::timestamp, s.actual_start)) nulls last, p.cost_center, p.po_number) = 1) m
      on m.product_code = o.product_code and m.actual_start is not distinct from o.actual_start)"""


def agg_basic(spark, sf):
    sap = model(spark, sf, "silver_sap_inventory")
    return present(
        sap.groupBy("material_code").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("planned_qty").alias("planned"),
            F.avg("planned_qty").alias("avg_planned"),
            F.min("posting_date").alias("first_day"),
            F.max("total_cost").alias("top_cost"),
            F.min("currency").alias("currency"),
        ),
        "material_code n planned:2 avg_planned:6 first_day:d top_cost:2 currency",
    )


def agg_conditional(spark, sf):
    events = model(spark, sf, "silver_mes_events")
    return present(
        events.groupBy("product_code").agg(
            F.count_if(F.col("status") == "PASS").alias("passed"),
            F.sum(F.when(F.col("dq_status") == "FAIL", 1).otherwise(0)).alias("failed_checks"),
            F.avg(F.when(F.col("parameter_name") == "temperature", F.col("parameter_value"))).alias("avg_temp"),
        ),
        "product_code passed failed_checks avg_temp:4",
    )


def agg_multi_key(spark, sf):
    orders = model(spark, sf, "silver_mes_production_orders")
    keys = ["machine_id", "plant", "shift", F.to_date("start_time").alias("day"), "_ingest_year", "_ingest_month", "_ingest_day"]
    grouped = orders.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("duration_minutes").alias("minutes"))
    return present(grouped, "machine_id plant shift day:d _ingest_year _ingest_month _ingest_day n minutes")


def agg_distinct_having(spark, sf):
    raw = inputs.spark_input(spark, sf, "raw_sap_ecc_orders")
    return raw.groupBy("po_number").agg(F.countDistinct("material_code").alias("materials"), F.count(F.lit(1)).alias("lines")).where("lines > 1")


def window_lag(spark, sf):
    efficiency = gold.production_efficiency(model(spark, sf, "silver_production_orders"))
    return present(efficiency, "line_id week_start:d avg_yield_pct:2 trend_vs_prior_week")


def topk_scrap(spark, sf):
    oee = model(spark, sf, "gold_manufacturing_oee_mart")
    return present(serving.scrap_topk(oee, inputs.OEE_AS_OF), "machine_id plant avg_scrap_pct:6 total_rejected")


TOPK_SCRAP = f"""(select machine_id, plant, avg(avg_scrap_pct) as avg_scrap_pct, sum(total_rejected_qty)::bigint as total_rejected
    from g_manufacturing_oee_mart where production_date >= {OEE_DAY} - 7 group by machine_id, plant
    order by avg(avg_scrap_pct) desc, 1, 2 limit 5)"""

def union_counts(spark, sf):
    """Rows of all tables of the three layers."""
    return serving.row_counts(lake(spark, sf))


def layer_totals(spark, sf):
    layers: dict[str, dict] = {}
    for name, df in lake(spark, sf).items():
        layers.setdefault(name.split(".")[0], {})[name] = df
    return serving.layer_totals(layers)


UNION_COUNTS = " union all ".join(
    f"select '{name}' as \"table\", count(*) as rows from {source}" for name, source in LAKE_SQL.items()
)
LAYER_TOTALS = " union all ".join(
    f"select '{layer}' as layer, " + " + ".join(f"(select count(*) from {source})" for name, source in LAKE_SQL.items() if name.startswith(layer)) + " as total_rows"
    for layer in ("bronze", "silver", "gold")
)


def pivot_status(spark, sf):
    return serving.pivot_status(model(spark, sf, "silver_production_orders"), ["COMPLETE", "IN_PROGRESS", "PLANNED"])


# --- scalar families -----------------------------------------------------------------------------------


def scalar_string(spark, sf):
    docs = inputs.table(spark, sf, "documents")
    given = F.col("text").isNotNull()
    return docs.select(
        "doc_id",
        upper_trim(F.concat(F.lit("  "), "source", F.lit(" "))).alias("upper_source"),
        F.replace("source", F.lit("src"), F.lit("SRC-")).alias("renamed"),
        F.substring("text", 1, 100).alias("preview"),
        F.split_part(F.concat("lang", F.lit("."), "source"), F.lit("."), F.lit(2)).alias("second_part"),
        F.lower("source").endswith("1").alias("ends_with_one"),
        F.when(given, F.length(compact_whitespace(F.col("text")))).alias("compact_length"),
        # A text without words has an empty last word, a missing text none.
        F.when(given, F.coalesce(F.try_element_at(empty_safe_words(F.col("text")), F.lit(-1)), F.lit(""))).alias("last_word"),
    )


SCALAR_STRING = r"""select doc_id, upper(trim(concat('  ', source, ' '))) as upper_source, replace(source, 'src', 'SRC-') as renamed,
    substr(text, 1, 100) as preview, split_part(concat(lang, '.', source), '.', 2) as second_part,
    ends_with(lower(source), '1') as ends_with_one, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) as compact_length,
    regexp_extract(trim(regexp_replace(text, '\s+', ' ', 'g')), '(\S+)$', 1) as last_word from documents"""


def scalar_null(spark, sf):
    events = inputs.spark_input(spark, sf, "raw_mes_events")
    return events.select(
        "event_id",
        "event_ts",
        F.coalesce("unit", F.lit("UNKNOWN")).alias("unit"),
        F.nullif("shift", F.lit("A")).alias("not_a"),
        F.when(F.col("status") == "pass", "ok").when(F.col("status").isNull(), "missing").otherwise("other").alias("verdict"),
        severity_score(F.nullif(F.upper("status"), F.lit("PASS"))).alias("points"),
        ratio(F.col("parameter_value"), F.nullif(F.col("parameter_value"), F.lit(20.0))).alias("self_ratio"),
    ).transform(lambda df: present(df, "event_id event_ts:ts unit not_a verdict points self_ratio:6"))


SCALAR_NULL = """(select event_id, event_ts, coalesce(unit, 'UNKNOWN') as unit, nullif(shift, 'A') as not_a,
    case when status = 'pass' then 'ok' when status is null then 'missing' else 'other' end as verdict, 0 as points,
    case when parameter_value <> 20 and parameter_value <> 0 then 1.0::double end as self_ratio from raw_mes_events)"""


def scalar_math(spark, sf):
    lines = inputs.table(spark, sf, "lineitem")
    return present(
        lines.select(
            "l_orderkey",
            "l_linenumber",
            F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("unit_price"),
            F.abs(F.col("l_quantity") - 25).alias("distance"),
            F.least(F.col("l_quantity"), F.lit(30.0)).alias("capped"),
            F.greatest(F.col("l_quantity") - 10, F.lit(0.0)).alias("floored"),
            cap_at(F.col("l_extendedprice"), 1000.0).alias("cap"),
            percent(F.col("l_quantity"), F.col("l_quantity") + 50).alias("share"),
        ),
        "l_orderkey l_linenumber unit_price:2 distance:2 capped:2 floored:2 cap:2 share:2",
    )


SCALAR_MATH = f"""(select l_orderkey, l_linenumber, {half_up('l_extendedprice / l_quantity', 2)} as unit_price, abs(l_quantity - 25) as distance,
    least(l_quantity, 30) as capped, greatest(l_quantity - 10, 0) as floored, least(l_extendedprice, 1000) as cap,
    {half_up('l_quantity * 100.0::double / (l_quantity + 50)', 2)} as share from lineitem)"""


def scalar_date(spark, sf):
    orders = inputs.spark_input(spark, sf, "raw_iqms_orders")
    start, end = F.col("actual_start"), F.col("actual_end")
    return present(
        orders.select(
            "order_id",
            complete_units("SECOND", start, end).alias("seconds"),
            complete_units("MINUTE", start, end).alias("minutes"),
            complete_units("DAY", F.col("planned_start"), F.lit(inputs.INGESTED)).alias("days"),
            F.date_trunc("minute", start).alias("minute"),
            F.date_trunc("hour", end).alias("hour"),
            F.to_date(F.date_trunc("week", end)).alias("week"),
            month_start(F.to_date(end)).alias("month"),
            F.year(end).alias("y"),
            F.month(end).alias("m"),
            F.dayofmonth(end).alias("d"),
            (end - F.expr("interval 24 hours")).alias("day_before"),
            iso_timestamp(F.replace(end.cast("string"), F.lit(" "), F.lit("T"))).alias("parsed"),
        ),
        "order_id seconds minutes days minute:ts hour:ts week:d month:d y:n m:n d:n day_before:ts parsed:ts",
    )


SCALAR_DATE = f"""(select order_id, date_sub('second', actual_start, actual_end) as seconds,
    date_sub('minute', actual_start, actual_end) as minutes, date_sub('day', planned_start, timestamp '2024-02-01 06:30:00') as days,
    date_trunc('minute', actual_start) as minute, date_trunc('hour', actual_end) as hour, date_trunc('week', actual_end) as week,
    date_trunc('month', actual_end) as month, year(actual_end) as y, month(actual_end) as m, day(actual_end) as d,
    actual_end - interval 24 hour as day_before, actual_end as parsed from raw_iqms_orders)"""


def scalar_json(spark, sf):
    records = inputs.spark_input(spark, sf, "kafka_iqms_deviations").select("offset", F.col("value").cast("string").alias("value"))
    parsed = with_json_fields(records, F.col("value"), ["deviation_id", "description", "root_cause", "absent"])
    return parsed.select(
        "offset", "deviation_id", "description", "root_cause", "absent", F.get_json_object("value", "$.severity").alias("severity"),
        F.to_json(F.struct("deviation_id", "root_cause"), {"ignoreNullFields": "false"}).alias("back"),
    )


SCALAR_JSON = f"""select "offset", {scalar('deviation_id', 'value')} as deviation_id, {scalar('description', 'value')} as description,
    {scalar('root_cause', 'value')} as root_cause, null::varchar as absent, value->>'$.severity' as severity,
    cast(to_json({{"deviation_id": value->>'$.deviation_id', "root_cause": value->>'$.root_cause'}}) as varchar) as back
    from kafka_iqms_deviations"""


def scalar_hash(spark, sf):
    return inputs.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("row_hash"))


def scalar_conversion(spark, sf):
    events = inputs.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    return present(
        events.select(
            "event_id",
            k.try_cast("int").alias("k_int"),
            F.concat(k, F.lit("x")).try_cast("int").alias("bad_int"),
            F.concat(k, F.lit(".75")).try_cast("double").try_cast("int").alias("cut_int"),
            k.try_cast("double").alias("k_double"),
            F.when(F.col("event_id") % 2 == 0, "true").otherwise("maybe").try_cast("boolean").alias("flag"),
            F.col("ts").cast("string").substr(1, 10).try_cast("date").alias("day"),
            F.col("ts").cast("string").try_cast("timestamp").alias("at"),
        ),
        "event_id k_int k_double:2 bad_int cut_int flag day:d at:ts",
    )


SCALAR_CONVERSION = """(select event_id, try_cast(props->>'$.k' as int) as k_int, try_cast(concat(props->>'$.k', 'x') as int) as bad_int,
    trunc(try_cast(concat(props->>'$.k', '.75') as double))::int as cut_int, try_cast(props->>'$.k' as double) as k_double,
    try_cast(case when event_id % 2 = 0 then 'true' else 'maybe' end as boolean) as flag, ts::date as day, ts as at from events)"""


def scalar_array(spark, sf):
    """The array functions chunking is made of."""
    docs = inputs.table(spark, sf, "documents").withColumn("words", empty_safe_words(F.col("text")))
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(100))
    return docs.where(F.size("words") > 0).select(
        "doc_id",
        F.size("words").alias("word_count"),
        F.size(starts).alias("windows"),
        F.array_join(F.slice("words", 1, 5), " ").alias("first_words"),
        F.array_join(F.transform(F.slice("words", 1, 3), lambda w: F.substring(w, 1, 1)), "").alias("initials"),
    )


SCALAR_ARRAY = r"""select doc_id, len(w) as word_count, (len(w) - 1) // 100 + 1 as windows, array_to_string(w[1:5], ' ') as first_words,
    array_to_string(list_transform(w[1:3], lambda x: substr(x, 1, 1)), '') as initials
    from (select doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') as w from documents)
    where not (len(w) = 1 and w[1] = '')"""


def register() -> None:
    add(
        "filter_predicates",
        filter_predicates,
        shown("s_mes_events", "event_id machine_id parameter_name parameter_value:6 shift status", FILTERED),
    )
    add(
        "join_inner",
        join_inner,
        statement(
            "select d.deviation_id, d.batch_id, d.severity, n.events from b_trackwise_deviations d "
            "join (select batch_id, count(*) as events from b_mes_events group by 1) n using (batch_id)"
        ),
    )
    add(
        "join_latest_lookup",
        join_latest_lookup,
        statement(
            "select e.event_id, e.batch_id, o.order_id, o.order_status, o.planned_quantity from b_mes_events e left join batch_order o using (batch_id)"
        ),
    )
    add(
        "join_left_composite",
        join_left_composite,
        shown(
            "(select o.machine_id, o.day, o.made, t.passed from (select machine_id, start_time::date as day, sum(actual_qty)::bigint as made "
            "from s_mes_production_orders group by 1, 2) o left join (select machine_id, tested_at::date as day, "
            "count(*) filter (where pass_fail_flag) as passed from s_iqms_quality_tests group by 1, 2) t using (machine_id, day))",
            "machine_id day:d made passed",
        ),
    )
    add(
        "join_left_filtered",
        join_left_filtered,
        shown(
            "(select c.product_code, c.report_month as month, c.n as capas, d.n as critical from (select product_code, "
            "date_trunc('month', opened_date)::date as report_month, count(*) as n from s_trackwise_capas group by 1, 2) c "
            "left join critical_months d using (product_code, report_month))",
            "product_code month:d capas critical",
        ),
    )
    add(
        "join_full_chain",
        join_full_chain,
        statement("select product_code, batch_number, orders, tests, devs as deviations from risk_batches"),
    )
    add(
        "semi_join_duplicates",
        semi_join_duplicates,
        shown(
            "raw_sap_ecc_orders",
            "po_number plant total_cost:2",
            "where po_number in (select po_number from raw_sap_ecc_orders group by 1 having count(*) > 1)",
        ),
    )
    add(
        "join_nearest_date",
        join_nearest_date,
        shown(NEAREST, "order_id product_code actual_start:ts posting_date:d cost_center po_number"),
    )
    add(
        "agg_basic",
        agg_basic,
        shown(
            "(select material_code, count(*) as n, sum(planned_qty) as planned, avg(planned_qty) as avg_planned, min(posting_date) as first_day, "
            "max(total_cost) as top_cost, any_value(currency) as currency from s_sap_inventory group by 1)",
            "material_code n planned:2 avg_planned:6 first_day:d top_cost:2 currency",
        ),
    )
    add(
        "agg_conditional",
        agg_conditional,
        shown(
            "(select product_code, count(*) filter (where status = 'PASS') as passed, count(*) filter (where dq_status = 'FAIL') as failed_checks, "
            "avg(parameter_value) filter (where parameter_name = 'temperature') as avg_temp from s_mes_events group by 1)",
            "product_code passed failed_checks avg_temp:4",
        ),
    )
    add(
        "agg_multi_key",
        agg_multi_key,
        shown(
            "(select machine_id, plant, shift, start_time::date as day, _ingest_year, _ingest_month, _ingest_day, count(*) as n, "
            "sum(duration_minutes)::bigint as minutes from s_mes_production_orders group by 1, 2, 3, 4, 5, 6, 7)",
            "machine_id plant shift day:d _ingest_year _ingest_month _ingest_day n minutes",
        ),
    )
    add(
        "agg_distinct_having",
        agg_distinct_having,
        statement(
            "select po_number, count(distinct material_code) as materials, count(*) as lines from raw_sap_ecc_orders group by 1 having count(*) > 1"
        ),
    )
    add(
        "window_lag_trend",
        window_lag,
        shown("g_production_efficiency", "line_id week_start:d avg_yield_pct:2 trend_vs_prior_week"),
    )
    add("topk_scrap", topk_scrap, shown(TOPK_SCRAP, "machine_id plant avg_scrap_pct:6 total_rejected"))
    add("union_counts", union_counts, statement(UNION_COUNTS))
    add("layer_totals", layer_totals, statement(LAYER_TOTALS))
    add(
        "pivot_status",
        pivot_status,
        statement(
            "select product_code, count(*) filter (where status = 'COMPLETE') as \"COMPLETE\", count(*) filter (where status = 'IN_PROGRESS') "
            "as \"IN_PROGRESS\", count(*) filter (where status = 'PLANNED') as \"PLANNED\" from s_production_orders group by 1"
        ),
    )
    add("scalar_string", scalar_string, SCALAR_STRING)
    add("scalar_null", scalar_null, shown(SCALAR_NULL, "event_id event_ts:ts unit not_a verdict points self_ratio:6"))
    add(
        "scalar_math",
        scalar_math,
        shown(SCALAR_MATH, "l_orderkey l_linenumber unit_price:2 distance:2 capped:2 floored:2 cap:2 share:2"),
    )
    add(
        "scalar_date",
        scalar_date,
        shown(
            SCALAR_DATE,
            "order_id seconds minutes days minute:ts hour:ts week:d month:d y:n m:n d:n day_before:ts parsed:ts",
        ),
    )
    add("scalar_json", scalar_json, statement(SCALAR_JSON))
    add("scalar_hash", scalar_hash, "select doc_id, sha256(text) as row_hash from documents")
    add(
        "scalar_conversion",
        scalar_conversion,
        shown(SCALAR_CONVERSION, "event_id k_int k_double:2 bad_int cut_int flag day:d at:ts"),
    )
    add("scalar_array", scalar_array, SCALAR_ARRAY)
