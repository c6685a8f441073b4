"""Checks, profiles, lineage, access and maintenance as queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from millrace.operators import days, lineage, quality, secure, sketches, tables
from millrace.plans import pipeline, registry, serving
from millrace.plans.suites import GATE_SUITES, IQMS_QUALITY_TESTS, MES_EVENTS, MES_PRODUCTION_ORDERS, SAP_INVENTORY
from millrace.session import scratch
from testbed import inputs
from testbed.catalogue import add
from testbed.columns import present, shown
from testbed.models import COLUMNS, LAKE_SQL, SHARED_BY_MODELS, all_models, lake, model, relation, stored, stored_bronze, stored_models
from testbed.oracle import statement

_DAYS = [dt.datetime(2024, 1, day, 3) for day in (1, 5, 10, 20, 28, 29, 30)]
RESULT = "position type column group valid total success"


def _share(valid: str, total: str) -> str:
    return f"coalesce(({valid})::double / nullif({total}, 0), 0)"


def _expectation_sql(table: str, position: int, spec: dict) -> str:
    """One expectation stated as counts over the relation."""
    kind, kw = spec["type"], spec["kwargs"]
    column = kw.get("column", "")
    group = spec.get("group", kind)
    mostly = float(kw.get("mostly", 1.0))
    if kind == quality.NOT_NULL:
        valid, total, ok = f"count({column})", "count(*)", f"1 - {_share(f'count({column})', 'count(*)')} <= 1 - {mostly}::double"
    elif kind == quality.BETWEEN:
        low, high = kw.get("min_value"), kw.get("max_value")
        tests = [f"{column} {'>' if kw.get('strictly') else '>='} {low}"] if low is not None else []
        tests += [f"{column} <= {high}"] if high is not None else []
        valid, total = f"count(*) filter (where {' and '.join(tests)})", f"count({column})"
        ok = f"{_share(valid, total)} >= {mostly}::double"
    elif kind == quality.IN_SET:
        values = ", ".join(f"'{v}'" for v in kw["value_set"])
        valid, total = f"count(*) filter (where {column} in ({values}))", f"count({column})"
        ok = f"{valid} = {total}"
    elif kind == quality.UNIQUE:
        valid, total = f"count(distinct {column})", f"count({column})"
        ok = f"{_share(valid, total)} >= {mostly}::double"
    else:
        valid = total = "count(*)"
        ok = f"count(*) between {kw['min_value']} and {kw['max_value']}"
    return (
        f"select {position} as position, '{kind}' as type, '{column}' as \"column\", '{group}' as \"group\", {valid} as valid, "
        f"{total} as total, {ok} as success from {table}"
    )


def suite_sql(table: str, suite: list[dict]) -> str:
    return " union all ".join(_expectation_sql(table, i, e) for i, e in enumerate(suite))


def _silver(name: str):
    return lambda spark, sf: model(spark, sf, name)


def suite_results(spark, sf, name: str, suite: list[dict]):
    """A suite over one table. What takes several passes is stored first, with the columns that the suite looks at."""
    table = model(spark, sf, name)
    alone = [e for e in suite if e["type"] == quality.UNIQUE and "approximate" not in e["kwargs"]]
    if len(alone) + (len(alone) < len(suite)) > 1:
        looked_at = {e["kwargs"].get("column") for e in suite}
        table = stored(spark, table.select(*[c for c in table.columns if c in looked_at]), name)
    return quality.run_suite(table, suite)


def add_suite(key: str, name: str, suite: list[dict]) -> None:
    add(
        key,
        lambda spark, sf: present(suite_results(spark, sf, name, suite), RESULT),
        statement(suite_sql(relation(name), suite)),
    )


def add_check(key: str, run, oracle: str) -> None:
    add(key, run, statement(f"select '{key[6:]}' as \"check\", {oracle}"))


def all_checks(spark, sf):
    """Every declared test of every silver and gold table."""
    built = all_models(spark, sf)
    results = [quality.run_checks(n, built[n], m.checks, built) for n, m in registry.MODELS.items() if m.checks]
    merged = results[0]
    for result in results[1:]:
        merged = merged.unionByName(result)
    return merged


def _check_sql(table: str, check: dict) -> str:
    source, column, kind = relation(table), check["column"], check["check"]
    if kind == "not_null":
        count = f"(select count(*) from {source} where {column} is null)"
    elif kind == "unique":
        count = f"(select count(*) from (select {column} from {source} where {column} is not null group by 1 having count(*) > 1))"
    elif kind == "accepted_values":
        values = ", ".join(f"'{v}'" for v in check["values"])
        count = f"(select count(distinct {column}) from {source} where {column} not in ({values}))"
    else:
        count = (
            f"(select count(*) from {source} where {column} is not null and {column} not in "
            f"(select {check['field']} from {relation(check['to'])} where {check['field']} is not null))"
        )
    return f"select '{table}' as \"table\", '{kind}' as \"check\", '{column}' as \"column\", {count} as failures, {count} = 0 as success"


ALL_CHECKS = " union all ".join(
    _check_sql(n, c) for n, m in registry.MODELS.items() for c in m.checks
)


def publish_gate(spark, sf):
    """Gold rows are handed out only when the silver checks hold; here they do not, then they do."""
    events = stored_models(spark, sf, "silver_mes_events")["silver_mes_events"]
    strict = quality.run_suite(events, MES_EVENTS)
    relaxed = quality.run_suite(events, [e for e in MES_EVENTS if e["type"] != quality.ROW_COUNT])
    gates = [("with_row_count", quality.publish_gate(strict)), ("without_row_count", quality.publish_gate(relaxed))]
    parts = [
        registry.build("gold_oee_dashboard", {"silver_mes_events": events}, inputs.context())
        .where(F.lit(passed))
        .agg(F.lit(name).alias("gate"), F.lit(passed).alias("open"), F.count(F.lit(1)).alias("gold_rows"))
        for name, passed in gates
    ]
    return parts[0].unionByName(parts[1])


PUBLISH_GATE = """with_counts as (select (select count(*) from s_mes_events) between 400 and 600 as ok)
    select 'with_row_count' as gate, ok as open, case when ok then (select count(*) from g_oee_dashboard) else 0 end as gold_rows from with_counts
    union all select 'without_row_count', true, (select count(*) from g_oee_dashboard)"""

SAMPLE = {"type": quality.UNIQUE, "kwargs": {"column": "po_number"}}


def failing_samples(spark, sf):
    """Five raw order lines with a repeated number, shown by what all choices share."""
    raw = inputs.spark_input(spark, sf, "raw_sap_ecc_orders").select("po_number", "plant", "total_cost")
    picked = quality.failing_samples(raw, SAMPLE)
    missing = quality.failing_samples(
        inputs.spark_input(spark, sf, "raw_mes_events"), {"type": quality.NOT_NULL, "kwargs": {"column": "unit"}}
    )
    return picked.agg(F.lit("unique").alias("sample"), F.count(F.lit(1)).alias("rows"), F.min("po_number").alias("first")).unionByName(
        missing.agg(F.lit("not_null").alias("sample"), F.count(F.lit(1)).alias("rows"), F.max("unit").alias("first"))
    )


SAMPLES = """select 'unique' as sample, 5 as rows, min(po_number) as first from (select po_number from raw_sap_ecc_orders group by 1 having count(*) > 1)
    union all select 'not_null', least(5, count(*)), null from raw_mes_events where unit is null"""


def profile(spark, sf):
    """Every column of the order lines."""
    return quality.profile_columns(inputs.bronze_tables(spark, sf)["sap_ecc_orders"])


PROFILE = " union all ".join(
    f"select '{c}' as \"column\", count(*) filter (where {c} is null) as null_count, min({c})::varchar as min_value, "
    f"max({c})::varchar as max_value from b_sap_ecc_orders"
    for c in COLUMNS["bronze_sap_orders"].replace(":", " ").split()
    if len(c) > 2
)


def kept_results(spark, sf):
    """A suite's results kept as JSON and read back."""
    found = suite_results(spark, sf, "silver_mes_production_orders", MES_PRODUCTION_ORDERS)
    return quality.save_results(found, scratch(spark, "results"))


_ABOUT = [
    {"type": quality.UNIQUE, "kwargs": {"column": "event_id", "mostly": 0.9, "approximate": 0.02}},
    {"type": quality.UNIQUE, "kwargs": {"column": "machine_id", "mostly": 0.9, "approximate": 0.02}},
    {"type": quality.NOT_NULL, "kwargs": {"column": "batch_id"}},
]


def approximate_suite(spark, sf):
    """Unique shares from one pass; far enough from the limit for the estimate to settle them."""
    events = model(spark, sf, "silver_mes_events")
    return quality.run_suite(events, _ABOUT).select("position", "column", "total", "success")


APPROXIMATE = " union all ".join(
    f"select {i} as position, '{c}' as \"column\", count({c}) as total, count(distinct {c}) >= 0.9 * count({c}) as success from s_mes_events"
    for i, c in enumerate(("event_id", "machine_id"))
) + " union all select 2, 'batch_id', count(*), count(*) = count(batch_id) from s_mes_events"


def sketched(spark, sf):
    """Distinct values from sketches kept per day and merged, held against the exact number within 3 %."""
    events = stored(spark, model(spark, sf, "silver_mes_events").withColumn("event_date", F.to_date("event_ts")), "events")
    columns = ("event_id", "machine_id", "batch_id")
    path = scratch(spark, "sketches")
    for half in (F.dayofmonth("event_ts") % 2 == 0, F.dayofmonth("event_ts") % 2 == 1):
        sketches.day_sketches(events.where(half), "event_date", columns).write.mode("append").parquet(path)
    merged = sketches.merged(spark.read.parquet(path))
    exact = events.agg(*(F.countDistinct(c).alias(c) for c in columns)).select(
        F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in columns)))
    )
    close = F.abs(F.col("approx_distinct") - F.col("exact")) <= 0.03 * F.col("exact")
    return merged.join(exact, "column").select("column", "rows", "values", F.when(close, F.col("exact")).alias("distinct"))


SKETCHED = " union all ".join(
    f"select '{c}' as \"column\", count(*) as rows, count({c}) as values, count(distinct {c}) as distinct from s_mes_events"
    for c in ("event_id", "machine_id", "batch_id")
)


# --- day tables ----------------------------------------------------------------------------------------


def _event_days(spark, sf, path):
    """Events by day in four changes: three drops and a correction of every fifth event."""
    events = inputs.bronze_tables(spark, sf)["mes_events"].withColumn("event_date", F.to_date("event_ts"))
    events = stored(spark, events, "events")
    number = F.regexp_extract("event_id", "([0-9]+)$", 1).cast("bigint")
    for i in range(3):
        days.merge_days(spark, path, events.where(number % 3 == i), ["event_id"], "event_date", ["event_ts"], at=_DAYS[i])
    fixed = events.where(number % 5 == 0).withColumn("status", F.lit("FIXED"))
    days.merge_days(spark, path, fixed, ["event_id"], "event_date", ["event_ts"], at=_DAYS[3])


def days_as_of(spark, sf):
    """A day table as it was after each change, read after older states have expired."""
    path = scratch(spark, "days")
    _event_days(spark, sf, path)
    days.expire_days(spark, path, dt.datetime(2024, 2, 1), keep=3)
    parts = [
        days.read_days(spark, path, at).agg(
            F.lit(str(at)).alias("as_of"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "FIXED").alias("fixed")
        )
        for at in _DAYS[1:4]
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


DAYS_AS_OF = " union all ".join(
    f"select '{_at}' as as_of, count(*) as rows, count(*) filter (where {_fixed}) as fixed from "
    f"(select regexp_extract(event_id, '([0-9]+)$', 1)::bigint as n from b_mes_events) where n % 3 <= {_last}"
    for _at, _last, _fixed in (("2024-01-05 03:00:00", 1, "false"), ("2024-01-10 03:00:00", 2, "false"), ("2024-01-20 03:00:00", 2, "n % 5 = 0"))
)


def compact_days(spark, sf):
    """Days written as several small files, then rewritten by what the listing says; the rows stay."""
    path = scratch(spark, "days")
    events = stored(spark, inputs.bronze_tables(spark, sf)["mes_events"], "events").withColumn("event_date", F.to_date("event_ts"))
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "16k")
    try:
        days.append_days(spark, path, events, "event_date")
    finally:
        spark.conf.set(setting, before)
    days.compact_days(spark, path)
    left = days.day_files(spark, path).where("files > 1").count()
    return present(days.read_days(spark, path).withColumn("small_days", F.lit(left)), COLUMNS["bronze_mes_events"] + " small_days")


def update_incremental(spark, sf):
    """An incremental table over two loads: the second brings everything, of which only new days are read and merged."""
    path, source = scratch(spark, "incremental"), dict(inputs.bronze_tables(spark, sf).items())
    source["mes_events"] = stored(spark, source["mes_events"], "events")
    early = source | {"mes_events": source["mes_events"].where("event_ts < timestamp '2024-01-20'")}
    for load in (early, source):
        pipeline.update_incremental(spark, path, "silver_mes_events", load, inputs.context())
    return present(days.read_days(spark, path), COLUMNS["silver_mes_events"])


def pipeline_counts(spark, sf):
    """The whole run with its gate: what it published, and whether gold was opened."""
    root = scratch(spark, "lake")
    run = pipeline.run_pipeline(
        spark, root, stored_bronze(spark, sf, *SHARED_BY_MODELS), inputs.EVENTS_AS_OF, inputs.INGESTED, strict=False, results_path=scratch(spark, "results")
    )
    counts = serving.row_counts({registry.qualified(n): spark.read.parquet(p) for n, p in run.published.items()})
    return counts.withColumn("gate_open", F.lit(run.passed))


def _gate_sql() -> str:
    checks = " and ".join(f"(select bool_and(success) from ({_check_sql(n, c)}))" for n, m in registry.MODELS.items() for c in m.checks)
    suites = " and ".join(f"(select bool_and(success) from ({suite_sql(relation(n), s)}))" for n, s in GATE_SUITES.items() if s)
    return f"{checks} and {suites}"


PIPELINE = " union all ".join(
    f"select '{t}' as \"table\", count(*) as rows, ({_gate_sql()}) as gate_open from {r}"
    for t, r in LAKE_SQL.items()
    if not t.startswith("bronze")
)


# --- lineage -------------------------------------------------------------------------------------------

def _tracked_counts(spark, sf):
    return serving.row_counts(lake(spark, sf))


def _edges(spark):
    return lineage.lineage_edges(spark, registry.MODELS)


def lineage_edges(spark, sf):
    counts = stored(spark, _tracked_counts(spark, sf), "counts")  # read for both ends
    return lineage.with_volumes(_edges(spark), counts)


def lineage_closure(spark, sf):
    counts = stored(spark, _tracked_counts(spark, sf), "counts")
    return lineage.with_volumes(lineage.lineage_closure(_edges(spark)), counts)


_COUNTS = "(" + " union all ".join(f"select '{t}' as t, count(*) as n from {r}" for t, r in LAKE_SQL.items()) + ")"
_EDGE_VALUES = ", ".join(
    f"('{registry.qualified(n)}', '{registry.qualified(i)}')" for n in registry.MODELS for i in registry.MODELS[n].inputs
)
LINEAGE = (
    f"vols as {_COUNTS}, edges(downstream, upstream) as (values {_EDGE_VALUES}) "
    "select downstream, upstream, u.n as upstream_rows, d.n as downstream_rows from edges "
    "left join vols u on u.t = upstream left join vols d on d.t = downstream"
)
CLOSURE = (
    f"vols as {_COUNTS}, edges(downstream, upstream) as (values {_EDGE_VALUES}), "
    "walk as (select downstream, upstream, 1 as depth from edges union all "
    "select w.downstream, e.upstream, w.depth + 1 from walk w join edges e on e.downstream = w.upstream), "
    "short as (select downstream, upstream, min(depth) as depth from walk group by 1, 2) "
    "select downstream, upstream, depth, u.n as upstream_rows, d.n as downstream_rows from short "
    "left join vols u on u.t = upstream left join vols d on d.t = downstream"
)


def with_list(body: str, recursive: bool = False) -> str:
    """A statement whose own WITH entries follow the needed relations."""
    text = statement(f"@@{body}")
    head, _, tail = text.partition(" @@")
    text = f"{head}, {tail}" if tail else f"with {text[2:]}"
    return text.replace("with ", "with recursive ", 1) if recursive else text


# --- access --------------------------------------------------------------------------------------------


def visible_tables(spark, sf):
    """What each role may read, with the rows behind it."""
    catalog = _tracked_counts(spark, sf).select(
        F.split_part("table", F.lit("."), F.lit(1)).alias("layer"), F.split_part("table", F.lit("."), F.lit(2)).alias("table"), "rows"
    )
    catalog = stored(spark, catalog, "catalog")
    rules = secure.policy_table(spark)
    parts = [
        secure.visible_tables(catalog, rules, role).select(F.lit(role).alias("role"), "layer", "table", "rows")
        for role in ("data_engineer", "analyst", "qa_team", "executive")
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


VISIBLE = (
    f"vols as {_COUNTS} select role, split_part(t, '.', 1) as layer, split_part(t, '.', 2) as \"table\", n as rows "
    "from vols join (values ('data_engineer', 'bronze'), ('data_engineer', 'silver'), ('data_engineer', 'gold'), "
    "('analyst', 'silver'), ('analyst', 'gold')) r(role, layer) on r.layer = split_part(t, '.', 1) "
    "union all select role, 'gold', split_part(t, '.', 2), n from vols join (values ('qa_team', 'gold.gold_compliance_capa_mart'), "
    "('qa_team', 'gold.gold_quality_risk_mart'), ('qa_team', 'gold.gold_training_compliance_mart'), ('executive', 'gold.gold_manufacturing_oee_mart'), "
    "('executive', 'gold.gold_training_compliance_mart'), ('executive', 'gold.gold_sap_inventory_mart')) r(role, t) using (t)"
)

_PLANT_POLICY = secure.Policy("executive", ("silver",), row_filter="plant", hashed=("batch_number",))


def secure_view(spark, sf):
    orders = model(spark, sf, "silver_mes_production_orders").select("order_id", "plant", "batch_number", "status")
    return secure.secure_view(orders, _PLANT_POLICY, "P2")


# --- maintenance ---------------------------------------------------------------------------------------


def _published(spark, sf, root):
    """Seven versions of a table, each with the orders of one more weekday remainder."""
    orders = stored(spark, inputs.bronze_tables(spark, sf)["iqms_orders"].select("order_id", "quantity"), "orders")
    number = F.regexp_extract("order_id", "([0-9]+)$", 1).cast("bigint")
    for i, day in enumerate(_DAYS):
        tables.publish(orders.where(number % 7 <= i), root, "silver", "orders", day)


def read_as_of(spark, sf):
    root = scratch(spark, "lake")
    _published(spark, sf, root)
    parts = [
        tables.read_as_of(spark, root, "silver", "orders", at).agg(
            F.lit(str(at)).alias("as_of"), F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("quantity")
        )
        for at in (dt.datetime(2024, 1, 6), dt.datetime(2024, 1, 20, 3), dt.datetime(2024, 2, 1))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


READ_AS_OF = " union all ".join(
    f"select '{at}' as as_of, count(*) as rows, sum(quantity)::bigint as quantity from b_iqms_orders "
    f"where regexp_extract(order_id, '([0-9]+)$', 1)::bigint % 7 <= {last}"
    for at, last in (("2024-01-06 00:00:00", 1), ("2024-01-20 03:00:00", 3), ("2024-02-01 00:00:00", 6))
)


def expire_versions(spark, sf):
    """Versions left after keeping five and a week; each with its rows."""
    root = scratch(spark, "lake")
    _published(spark, sf, root)
    tables.expire_versions(spark, root, "silver", "orders", dt.datetime(2024, 2, 1))
    left = tables.versions(spark, root, "silver", "orders")
    parts = [spark.read.parquet(path).agg(F.lit(str(at)).alias("version"), F.count(F.lit(1)).alias("rows")) for at, path in left]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


EXPIRED = " union all ".join(
    f"select '{at}' as version, count(*) as rows from b_iqms_orders where regexp_extract(order_id, '([0-9]+)$', 1)::bigint % 7 <= {i}"
    for i, at in enumerate(_DAYS)
    if i >= 2
)


def compact_table(spark, sf):
    """A table of many small files, rewritten: the same rows in fewer files."""
    root = scratch(spark, "lake")
    orders = inputs.bronze_tables(spark, sf)["iqms_orders"]
    tables.publish(orders.repartition(40), root, "silver", "orders", dt.datetime(2024, 1, 1))
    tables.compact_table(spark, root, "silver", "orders", dt.datetime(2024, 1, 2))
    listed = [path for _, path in tables.versions(spark, root, "silver", "orders")]
    before, after = (tables.storage_files(spark, {"t": path}).count() for path in listed)
    rows = tables.read_as_of(spark, root, "silver", "orders")
    return present(rows.withColumn("fewer_files", F.lit(after < before)), COLUMNS["bronze_iqms_orders"] + " fewer_files")


def analyze_tables(spark, sf):
    """Statistics of a catalogued table as the planner will see them."""
    database = "millrace_" + scratch(spark, "x").rsplit("-", 1)[-1][:8]
    path = scratch(spark, "analyzed")
    tables.write_layer_table(inputs.bronze_tables(spark, sf)["sap_ecc_orders"], path)
    spark.sql(f"create database `{database}` location '{scratch(spark, 'db')}'")
    spark.sql(f"create table `{database}`.sap_ecc_orders using parquet location '{path}'")
    tables.analyze_tables(spark, database, ["sap_ecc_orders"])
    parts = []
    for column in ("po_number", "actual_qty", "posting_date"):
        described = spark.sql(f"describe extended `{database}`.sap_ecc_orders `{column}`")
        parts.append(
            described.where("info_name = 'num_nulls'").select(
                F.lit(column).alias("column"), F.col("info_value").cast("bigint").alias("num_nulls")
            )
        )
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rows = spark.read.parquet(path).count()
    spark.sql(f"drop database `{database}` cascade")  # the described values are already fetched
    return merged.withColumn("row_count", F.lit(rows).cast("bigint"))


ANALYZED = " union all ".join(
    f"select '{c}' as \"column\", count(*) filter (where {c} is null) as num_nulls, count(*) as row_count from b_sap_ecc_orders"
    for c in ("po_number", "actual_qty", "posting_date")
)


def register() -> None:
    events = _silver("silver_mes_events")
    add_check(
        "check_not_null",
        lambda s, sf: quality.check_not_null(events(s, sf), "order_id"),
        "'order_id' as \"column\", count(*) as failures from s_mes_events where order_id is null",
    )
    add_check(
        "check_unique",
        lambda s, sf: quality.check_unique(inputs.spark_input(s, sf, "raw_sap_ecc_orders"), "po_number"),
        "'po_number' as \"column\", count(*) as failures from (select po_number from raw_sap_ecc_orders group by 1 having count(*) > 1)",
    )
    add_check(
        "check_accepted_values",
        lambda s, sf: quality.check_accepted_values(events(s, sf), "parameter_name", ["temperature", "pressure"]),
        "'parameter_name' as \"column\", count(distinct parameter_name) as failures from s_mes_events "
        "where parameter_name not in ('temperature', 'pressure')",
    )
    add_check(
        "check_relationships",
        lambda s, sf: quality.check_relationships(
            inputs.bronze_tables(s, sf)["trackwise_deviations"], "batch_id", inputs.bronze_tables(s, sf)["mes_events"], "batch_id"
        ),
        "'batch_id' as \"column\", count(*) as failures from b_trackwise_deviations where batch_id not in (select batch_id from b_mes_events)",
    )
    add("run_checks", all_checks, statement(ALL_CHECKS))

    only = lambda kind, suite: [e for e in suite if e["type"] == kind]
    add_suite("expect_not_null", "silver_iqms_quality_tests", only(quality.NOT_NULL, IQMS_QUALITY_TESTS))
    add_suite("expect_between", "silver_sap_inventory", only(quality.BETWEEN, SAP_INVENTORY))
    add_suite("expect_in_set", "silver_mes_production_orders", only(quality.IN_SET, MES_PRODUCTION_ORDERS))
    add_suite("expect_unique_ratio", "silver_iqms_quality_tests", only(quality.UNIQUE, IQMS_QUALITY_TESTS))
    add_suite("expect_row_count", "silver_mes_events", only(quality.ROW_COUNT, MES_EVENTS))
    add_suite("run_suite", "silver_mes_production_orders", MES_PRODUCTION_ORDERS)
    add_suite("run_suite_quality_tests", "silver_iqms_quality_tests", IQMS_QUALITY_TESTS)
    add_suite("run_suite_inventory", "silver_sap_inventory", SAP_INVENTORY)
    add(
        "suite_groups",
        lambda s, sf: quality.suite_groups(quality.run_suite(stored(s, events(s, sf), "events"), MES_EVENTS)),
        statement(
            'select "group", bool_and(success) as success, count(*) as expectations from ('
            + suite_sql("s_mes_events", MES_EVENTS)
            + ') group by "group"'
        ),
    )
    add("failing_samples", failing_samples, statement(SAMPLES))
    add("profile_columns", profile, statement(PROFILE))
    add(
        "save_results",
        lambda s, sf: present(kept_results(s, sf), RESULT),
        statement(suite_sql("s_mes_production_orders", MES_PRODUCTION_ORDERS)),
    )
    add("expect_unique_approximate", approximate_suite, statement(APPROXIMATE))
    add("distinct_sketches", sketched, statement(SKETCHED))
    add("days_as_of", days_as_of, statement(DAYS_AS_OF))
    add("compact_days", compact_days, shown("(select *, 0 as small_days from b_mes_events)", COLUMNS["bronze_mes_events"] + " small_days"))
    add("update_incremental", update_incremental, shown("s_mes_events", COLUMNS["silver_mes_events"]))
    add("run_pipeline", pipeline_counts, statement(PIPELINE))
    add("publish_gate", publish_gate, with_list(PUBLISH_GATE))
    add("lineage_edges", lineage_edges, with_list(LINEAGE))
    add("lineage_closure", lineage_closure, with_list(CLOSURE, recursive=True))
    add("visible_tables", visible_tables, with_list(VISIBLE))
    add(
        "secure_view",
        secure_view,
        statement("select order_id, plant, sha256(batch_number) as batch_number, status from s_mes_production_orders where plant = 'P2'"),
    )
    add("read_as_of", read_as_of, statement(READ_AS_OF))
    add("expire_versions", expire_versions, statement(EXPIRED))
    add("compact_table", compact_table, shown("(select *, true as fewer_files from b_iqms_orders)", COLUMNS["bronze_iqms_orders"] + " fewer_files"))
    add("analyze_tables", analyze_tables, statement(ANALYZED))
