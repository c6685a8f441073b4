"""Joins of a large table to a table that holds one row per key.

One batch, product or user may own a third of the large table, and a plain shuffle join
would send that third to one task. Adaptive execution splits such tasks by measured size,
whatever the number of hot keys; ``session`` switches it on, also where the split costs
another shuffle. Where it is off, as in streams, ``salted`` gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16  # of the frequency sketch: the rows it can have at most
TASK_ROWS = 1_000_000  # rows of a hot bucket that share a salt

_BUCKET = "_millrace_bucket"
_SALT = "_millrace_salt"
_SALTS = "_millrace_salts"


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate for a plan; nothing runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def hot_buckets(df: DataFrame, keys: Sequence[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """Buckets of keys with more than ``task_rows`` rows, and the salts their weight asks for.

    Rows are counted by a hash of the key, so the result has ``BUCKETS`` rows at most however many keys are hot, and
    counts of tasks and days add up. The keys of a hot bucket are all salted; that changes no result.
    """
    counted = df.dropna(subset=list(keys)).groupBy(_bucket(keys).alias(_BUCKET)).agg(F.count(F.lit(1)).alias("_n"))
    return counted.where(F.col("_n") > task_rows).select(_BUCKET, F.ceil(F.col("_n") / task_rows).cast("int").alias(_SALTS))


def lookup_join(facts: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left", *, salted: bool = False, task_rows: int = TASK_ROWS) -> DataFrame:
    """Left or inner join to a lookup that is unique on ``keys``. A missing key matches nothing.

    With ``salted``, a fact's salt comes from a hash of the row (stable when a task is retried), in as many values as its
    bucket's weight asks for, and the lookup rows of hot buckets are repeated once per salt. Rows without a key are
    spread over ``BUCKETS`` salts. The sketch that is broadcast has ``BUCKETS`` rows at most.
    """
    if how not in ("left", "inner"):
        raise ValueError("lookup_join supports left and inner joins")
    keys = list(keys)
    if not salted:
        return facts.join(lookup, keys, how)
    hot = F.broadcast(hot_buckets(facts, keys, task_rows))
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    spread = lambda salts: F.pmod(F.xxhash64(*facts.columns), salts).cast("int")
    marked = facts.withColumn(_BUCKET, _bucket(keys)).join(hot, _BUCKET, "left")
    salt = F.when(no_key, spread(F.lit(BUCKETS))).otherwise(spread(F.coalesce(_SALTS, F.lit(1))))
    marked = marked.withColumn(_SALT, salt).drop(_BUCKET, _SALTS)
    repeated = lookup.dropna(subset=keys).withColumn(_BUCKET, _bucket(keys)).join(hot, _BUCKET, "left")
    every = F.explode(F.sequence(F.lit(0), F.coalesce(_SALTS, F.lit(1)) - 1))
    repeated = repeated.withColumn(_SALT, every).drop(_BUCKET, _SALTS)
    return marked.join(repeated, [*keys, _SALT], how).drop(_SALT)
