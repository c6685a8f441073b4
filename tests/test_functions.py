import datetime as dt

from pyspark.sql import functions as F

from millrace.functions import (
    cap_at,
    complete_units,
    empty_safe_words,
    iso_timestamp,
    mean_of_rounded,
    month_start,
    percent,
    ratio,
    severity_score,
    with_json_fields,
)
from testbed import registered


def one(spark, column, rows=((1,),), schema="x int"):
    return spark.createDataFrame(rows, schema).select(column.alias("v")).first()["v"]


def test_ratio_and_percent_are_null_on_zero(spark):
    assert one(spark, ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, percent(F.lit(1), F.lit(0))) is None
    assert one(spark, percent(F.lit(1), F.lit(3))) == 33.33


def test_mean_of_rounded_does_not_depend_on_order(spark):
    values = [95.0, 95.01, 94.99, 95.03, None, 95.02]
    means = set()
    for rows in (values, values[::-1]):
        df = spark.createDataFrame([(v,) for v in rows], "x double").repartition(3)
        means.add(df.agg(mean_of_rounded(F.col("x")).alias("v")).first()["v"])
    assert means == {95.01}
    assert spark.createDataFrame([], "x double").agg(mean_of_rounded(F.col("x")).alias("v")).first()["v"] is None


def test_cap(spark):
    rows = [(None,), (5.0,), (1000.0,), (1000.5,)]
    df = spark.createDataFrame(rows, "x double").select(cap_at(F.col("x"), 1000.0))
    assert [r[0] for r in df.collect()] == [0.0, 5.0, 1000.0, 1000.0]


def test_iso_timestamps(spark):
    texts = ["2024-01-02T03:04:05", "2024-01-02 03:04:05.5", "2024-01-02T03:04:05Z", "2024-01-02T05:04:05+02:00", "soon", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(iso_timestamp(F.col("x"))).collect()]
    base = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert got == [base, base.replace(microsecond=500000), base, base, None, None]


def test_complete_units_cut_towards_zero(spark):
    a, b = F.lit(dt.datetime(2024, 1, 1, 0, 0, 59)), F.lit(dt.datetime(2024, 1, 1, 0, 1, 1))
    assert one(spark, complete_units("MINUTE", a, b)) == 0
    assert one(spark, complete_units("SECOND", a, b)) == 2
    assert one(spark, complete_units("DAY", F.lit(dt.datetime(2024, 1, 3)), F.lit(dt.datetime(2024, 1, 1, 1)))) == -1


def test_month_start_is_a_date(spark):
    assert one(spark, month_start(F.lit(dt.date(2024, 2, 29)))) == dt.date(2024, 2, 1)


def test_severity_points(spark):
    rows = [("CRITICAL",), ("MAJOR",), ("MINOR",), ("other",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "s string").select(severity_score(F.col("s"))).collect()] == [3, 2, 1, 0, 0]


def test_json_fields(spark):
    payloads = [
        '{"a": "x", "b": 1.50, "c": true}',
        '{"a": {"n": 1}, "b": [1], "c": null}',
        '{"a": "{draft}", "b": "[1]"}',
        '{"a": "x", "b"',
        "",
        None,
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string")
    got = {r["i"]: (r["a"], r["b"], r["c"]) for r in with_json_fields(df, F.col("p"), ["a", "b", "c"]).collect()}
    assert len(got) == len(payloads)
    assert got[0][0] == "x" and float(got[0][1]) == 1.5 and got[0][2] == "true"
    assert got[1] == (None, None, None)
    assert got[2] == ("{draft}", "[1]", None)
    assert got[4] == (None, None, None) and got[5] == (None, None, None)


def test_malformed_json_gives_no_fields(spark):
    df = spark.createDataFrame([('{"a": "x", "b": broken}',)], "p string")
    assert with_json_fields(df, F.col("p"), ["b"]).first()["b"] is None


def test_payload_is_parsed_once(spark):
    df = with_json_fields(spark.createDataFrame([('{"a": 1, "b": 2}',)], "p string"), F.col("p"), ["a", "b"])
    plan = df.where("a is not null and b is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("json_tuple(") == 1


def test_words_match_python_split(spark):
    texts = ["", "  ", "a", " a  b\tc\n", "x y z", "p\x1cq\x1dr", "u　v\u0085w", "a​b", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["w"] for r in df.select("i", empty_safe_words(F.col("t")).alias("w")).collect()}
    assert got == {i: (t or "").split() for i, t in enumerate(texts)}


def test_nested_values_are_told_apart_from_bracketed_strings(spark):
    rows = [('{"a": "[x", "b": {"c": 1}, "d": "1"}',), ('{"a": [1], "b": "{y}", "d": null}',), ('{"a": "p", "b": 2, "d": "[1]"}',), ("{broken",), (None,)]
    df = spark.createDataFrame(rows, "payload string")
    got = with_json_fields(df, F.col("payload"), ["a", "b", "d"]).drop("payload")
    assert [tuple(r) for r in got.collect()] == [("[x", None, "1"), (None, "{y}", None), ("p", "2", "[1]"), (None,) * 3, (None,) * 3]


def test_last_word_of_a_text_without_words(spark, tmp_path):
    texts = [(1, " one \t two "), (2, ""), (3, "  \n"), (4, None)]
    rows = [(i, text, "en", "src1", len(text or "")) for i, text in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = registered()["scalar_string"].run(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r["compact_length"], r["last_word"]) for r in found] == [(7, "two"), (0, ""), (0, ""), (None, None)]
