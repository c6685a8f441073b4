"""Lookup joins under skew, nearest matches against brute force, latest rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.dedup import dedup_latest, keep_latest
from millrace.operators.lookup import BUCKETS, hot_buckets, lookup_join
from millrace.operators.nearest import nearest_dated


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_keep_latest_breaks_ties_the_same_way(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", None, "z"), ("b", None, "p"), (None, 2, "q"), (None, 3, "r")]
    results = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "k string, o int, v string").repartition(3)
        results.add(tuple(rows_of(keep_latest(df, ["k"], ["o"]))))
    assert len(results) == 1
    kept = {r[0]: r[1] for r in results.pop()}
    assert kept == {"a": 1, "b": None, None: 3}


def test_dedup_modes(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, o int")
    assert dedup_latest(df, []).count() == 3
    assert dedup_latest(df, ["k"]).count() == 2
    assert rows_of(dedup_latest(df, ["k"], ["o"])) == [("a", 2), ("b", 1)]


def test_latest_row_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    plan = keep_latest(df, ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_plain_join(spark, how):
    # A third of the facts has one key, another third has none.
    facts = spark.range(900).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 50).cast("int").alias("k"),
    )
    lookup = spark.range(40).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))
    salted = lookup_join(facts, lookup, ["k"], how, salted=True, task_rows=20)
    assert rows_of(salted) == rows_of(facts.join(lookup, "k", how))


def test_hot_rows_are_spread(spark, every_partition):
    facts = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).cast("int").alias("k"))
    assert [r["_millrace_salts"] for r in hot_buckets(facts, ["k"], task_rows=100).collect()] == [21]
    lookup = spark.range(4000).select(F.col("id").cast("int").alias("k"), F.lit("v").alias("v"))
    joined = lookup_join(facts, lookup, ["k"], salted=True, task_rows=100)
    sizes = [r["count"] for r in joined.where("k = 1").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2001 and len(sizes) > 1


def test_any_number_of_hot_keys(spark):
    """5,000 keys of ten rows each are all hot; each is salted by its own weight and no row is lost."""
    facts = spark.range(60_000).select("id", F.when(F.col("id") < 50_000, F.col("id") % 5000).otherwise(F.col("id")).alias("k"))
    lookup = spark.range(70_000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    hot = hot_buckets(facts, ["k"], task_rows=4)
    assert 4000 < hot.count() <= BUCKETS
    joined = lookup_join(facts, lookup, ["k"], "inner", salted=True, task_rows=4)
    assert joined.count() == 60_000 and joined.where("v <> 3 * k").count() == 0


def test_adaptive_execution_splits_hot_keys(spark):
    """The plain join is cut at run time: a key with half of all rows is read by several tasks."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        ids = spark.range(0, 60_000, 1, 8)
        facts = ids.select("id", F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"))
        joined = lookup_join(facts, ids.select(F.col("id").alias("k"), F.lit("v").alias("v")), ["k"])
        assert joined.count() == 60_000
        assert joined.collect() and "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_null_keys_match_nothing(spark):
    facts = spark.createDataFrame([(1, None), (2, "a")], "id int, k string")
    lookup = spark.createDataFrame([(None, "null"), ("a", "A")], "k string, v string")
    for salted in (True, False):
        got = lookup_join(facts, lookup, ["k"], salted=salted, task_rows=1)
        assert rows_of(got.select("id", "v")) == [(1, None), (2, "A")]


def brute_force(orders, offers):
    def whole_days(day, ts):
        seconds = (ts - dt.datetime.combine(day, dt.time())).total_seconds()
        return abs(int(seconds / 86400))

    picked = {}
    for number, product, ts in orders:
        fitting = [o for o in offers if o[0] == product and product is not None]

        def rank(offer):
            gap = None if offer[1] is None or ts is None else whole_days(offer[1], ts)
            return (gap is None, gap or 0, offer[2] is None, offer[2] or "", offer[3])

        picked[number] = min(fitting, key=rank)[1:] if fitting else (None, None, None)
    return picked


@pytest.mark.parametrize("seed", range(6))
def test_nearest_match_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    start = dt.datetime(1969, 12, 20)
    offers = []
    for n in range(25):
        day = None if rng.random() < 0.1 else (start + dt.timedelta(days=rng.randint(0, 40))).date()
        offers.append((rng.choice("AB"), day, rng.choice(["c1", "c2", None]), f"p{n:02d}"))
    offers.append(("N", None, "c9", "p99"))  # a product without any dated offer
    orders = []
    for n in range(80):
        ts = None if rng.random() < 0.1 else start + dt.timedelta(days=rng.randint(-5, 45), hours=rng.choice([0, 0, 1, 23]))
        orders.append((n, rng.choice(["A", "B", "N", "none", None]), ts))
    got = nearest_dated(
        spark.createDataFrame(orders, "n int, product string, ts timestamp"),
        spark.createDataFrame(offers, "product string, day date, cost string, id string"),
        "product",
        "ts",
        "day",
        ["cost", "id"],
    )
    assert {r["n"]: (r["day"], r["cost"], r["id"]) for r in got.collect()} == brute_force(orders, offers)
    assert got.count() == len(orders)


def test_nearest_match_without_candidates(spark):
    orders = spark.createDataFrame([(1, "A", dt.datetime(2024, 1, 1))], "n int, product string, ts timestamp")
    empty = spark.createDataFrame([], "product string, day date, cost string")
    assert nearest_dated(orders, empty, "product", "ts", "day", ["cost"]).first()["day"] is None


def test_texts_do_not_force_a_sort_of_all_rows(spark):
    from millrace.plans import silver

    sap = spark.createDataFrame([], "material_code string, plant string, storage_location string, planned_qty int, actual_qty int, uom string, posting_date date, cost_center string, total_cost double, currency string")
    plan = silver.stock_profiles(sap)._jdf.queryExecution().sparkPlan().toString()
    lowest = [line for line in plan.splitlines() if "Aggregate" in line][-1]
    assert "HashAggregate" in lowest
