"""Distinct counts from sketches that are kept per day and merged, so a new day never needs the old ones read again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG2_REGISTERS = 14  # 16,384 registers of a sketch: a relative standard error of about 0.8 %


def day_sketches(rows: DataFrame, day_col: str, columns: Sequence[str], registers: int = LOG2_REGISTERS) -> DataFrame:
    """day, column, rows, values (not null) and sketch: one row per day and column, from one pass.

    Columns are sketched as text. Tasks combine their sketches before the shuffle, so a busy day costs a few KB a task.
    """
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for i, name in enumerate(columns):
        text = F.col(name).cast("string")
        aggregates += [F.count(name).alias(f"_n{i}"), F.hll_sketch_agg(text, registers).alias(f"_s{i}")]
    parts = [
        F.struct(F.lit(name).alias("column"), F.col("_rows").alias("rows"), F.col(f"_n{i}").alias("values"), F.col(f"_s{i}").alias("sketch"))
        for i, name in enumerate(columns)
    ]
    found = rows.groupBy(F.col(day_col).alias("day")).agg(*aggregates)
    return found.select("day", F.inline(F.array(*parts)))


def merged(sketches: DataFrame) -> DataFrame:
    """column, rows, values and approx_distinct over all days of ``day_sketches`` rows."""
    found = sketches.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("values").alias("values"), F.hll_union_agg("sketch", False).alias("_all")
    )
    return found.select("column", "rows", "values", F.hll_sketch_estimate("_all").alias("approx_distinct"))


def unique_share(sketches: DataFrame) -> DataFrame:
    """column and share: distinct values over values, at most 1; null for a column without values."""
    found = merged(sketches)
    return found.select("column", F.least(F.lit(1.0), F.col("approx_distinct") / F.nullif("values", F.lit(0))).alias("share"))
