"""Column helpers that fix the semantics shared by all layers.

Every helper returns a plain Column, so the work stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: white space as Python's str.split() sees it. Spelled out, it matches faster than a Unicode class.
WHITESPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

# Points per deviation severity.
SEVERITY_POINTS = {"CRITICAL": 3, "MAJOR": 2, "MINOR": 1}


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, NULL where the whole is zero or NULL."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, rounded; NULL on an empty whole."""
    return F.round(F.try_divide(part * F.lit(100.0), whole.cast("double")), digits)


def mean_of_rounded(value: Column, digits: int = 2) -> Column:
    """Average of a column already rounded to ``digits`` places.

    The sum runs over whole numbers, so it does not depend on the order in which
    tasks deliver their partial sums: a retried task cannot move a result across
    a rounding boundary.
    """
    scale = 10**digits
    return F.try_divide(
        F.sum(F.round(value * F.lit(float(scale))).cast("bigint")).cast("double"),
        (F.count(value) * F.lit(scale)).cast("double"),
    )


def cap_at(value: Column, limit: float) -> Column:
    """The value but never above ``limit``; a missing value counts as zero."""
    return F.least(F.coalesce(value, F.lit(0.0)), F.lit(limit))


def upper_trim(value: Column) -> Column:
    return F.upper(F.trim(value))


def iso_timestamp(text: Column) -> Column:
    """ISO text (with T or blank, with or without fraction or zone) as timestamp, NULL if unreadable."""
    return F.try_to_timestamp(text)


def complete_units(unit: str, start: Column, end: Column) -> Column:
    """Whole units between two timestamps, cut towards zero."""
    return F.timestamp_diff(unit, start, end)


def month_start(day: Column) -> Column:
    """First day of the month, as DATE."""
    return F.trunc(day, "MM")


def severity_score(severity: Column) -> Column:
    points = F.lit(0)
    for name, score in SEVERITY_POINTS.items():
        points = F.when(severity == name, F.lit(score)).otherwise(points)
    return points


def with_json_fields(df: DataFrame, payload: Column, names: Iterable[str]) -> DataFrame:
    """Add named top-level scalars of a JSON text as string columns, all from one parse.

    ``json_tuple`` is a generator, so neither a later filter nor a later projection can
    multiply the parse, as they do with one path expression per field. A nested object or
    array yields NULL, and so does a malformed payload. Only a value that begins like a
    nested one is looked at again, to tell it from a string that starts with a bracket. That
    rare case is a lambda, outside the code generated for a row; measured, this takes less time.
    """
    names = list(names)
    text, found = "_json_text", {name: f"_json_{i}" for i, name in enumerate(names)}
    wide = df.withColumn(text, payload).select("*", F.json_tuple(text, *names).alias(*found.values()))

    def scalar(name: str) -> Column:
        value = F.col(found[name])
        node = lambda t: F.try_variant_get(F.try_parse_json(t), f"$.{name}", "variant")
        is_string = F.exists(F.array(text), lambda t: F.schema_of_variant(node(t)) == "STRING")
        return F.when(~value.startswith("{") & ~value.startswith("["), value).when(is_string, value)

    kept = [c for c in df.columns if c not in found]
    return wide.select(*kept, *[scalar(name).alias(name) for name in names])


def compact_whitespace(text: Column) -> Column:
    """Words joined by single blanks, no blank at either end; NULL becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " "))


def empty_safe_words(text: Column) -> Column:
    """Array of words; an empty or blank text has no words (not one empty word)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITESPACE), "")
