"""Match each row to the dated candidate nearest in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.dedup import keep_first
from millrace.operators.lookup import lookup_join

# Slot of a fact row that has no timestamp; no calendar day maps to it.
NO_DAY = -2_147_483_648

_SLOT = "_millrace_slot"


def _slot(ts: Column) -> Column:
    """Calendar day and whether the time is past midnight, as one integer."""
    day = F.to_date(ts)
    past_midnight = (ts > day.cast("timestamp")).cast("int")
    return F.when(ts.isNull(), F.lit(NO_DAY)).otherwise(F.unix_date(day) * 2 + past_midnight)


def nearest_dated(
    facts: DataFrame,
    candidates: DataFrame,
    key: str,
    fact_ts: str,
    candidate_date: str,
    prefer: Sequence[str],
) -> DataFrame:
    """Left join of every fact to the one candidate of its key with the fewest whole days between them.

    Ties go to the smaller ``prefer`` columns (NULL last). Candidates without a date
    rank behind dated ones; for a fact without a timestamp all candidates tie.

    Pairing every fact with every candidate of its key would multiply the table, so
    the match is solved once per (key, calendar day): reduce candidates to the best
    per day, walk each key's days forwards and backwards to find the neighbours,
    and look the answer up. A key has at most one row per calendar day and kind
    in that walk, however many facts it owns.
    """
    payload = [c for c in candidates.columns if c != key]
    preference = [F.col(c).asc_nulls_last() for c in prefer]
    best_of_day = keep_first(candidates.where(F.col(key).isNotNull()), [key, candidate_date], preference)
    offers = best_of_day.select(
        key,
        F.col(candidate_date).alias("_day"),
        F.lit(0).alias("_kind"),
        F.struct(*[F.col(c).alias(c) for c in payload]).alias("_pick"),
        F.lit(None).cast("int").alias(_SLOT),
    )

    slotted = facts.withColumn(_SLOT, _slot(F.col(fact_ts)))
    wanted = slotted.select(key, _SLOT).where(F.col(key).isNotNull()).distinct()
    day_of_slot = F.date_from_unix_date(F.floor(F.col(_SLOT) / 2).cast("int"))
    demands = wanted.select(
        key,
        F.when(F.col(_SLOT) != NO_DAY, day_of_slot).alias("_day"),
        F.lit(1).alias("_kind"),
        F.lit(None).cast(offers.schema["_pick"].dataType).alias("_pick"),
        _SLOT,
    )

    def ranked(pick: str, *first) -> Column:
        # Structs compare field by field with NULL first, hence the leading null flags.
        fields = list(first)
        for name in prefer:
            fields += [F.col(f"{pick}.{name}").isNull(), F.col(f"{pick}.{name}")]
        return F.struct(*fields)

    up_to_here = (Window.unboundedPreceding, Window.currentRow)
    forward = Window.partitionBy(key).orderBy("_day", "_kind").rowsBetween(*up_to_here)
    backward = Window.partitionBy(key).orderBy(F.col("_day").desc(), F.col("_kind").desc()).rowsBetween(*up_to_here)
    dated = F.when(F.col("_day").isNotNull(), F.col("_pick"))
    answered = (
        offers.unionByName(demands)
        .withColumn("_dated", dated)
        .withColumns(
            {
                "_before": F.last("_dated", ignorenulls=True).over(forward),
                "_after": F.last("_dated", ignorenulls=True).over(backward),
                # For a fact without a timestamp, or a key without a dated candidate.
                "_any": F.min_by("_pick", F.when(F.col("_kind") == 0, ranked("_pick"))).over(Window.partitionBy(key)),
            }
        )
        .where(F.col("_kind") == 1)
    )
    before_gap = F.datediff(F.col("_day"), F.col(f"_before.{candidate_date}"))
    after_gap = F.datediff(F.col(f"_after.{candidate_date}"), F.col("_day")) - F.pmod(F.col(_SLOT), F.lit(2))
    after_wins = F.col("_before").isNull() | (ranked("_after", after_gap) < ranked("_before", before_gap))
    nearest = F.when(F.col("_after").isNotNull() & after_wins, F.col("_after")).otherwise(F.col("_before"))
    chosen = F.when(F.col("_day").isNull(), F.col("_any")).otherwise(F.coalesce(nearest, F.col("_any")))
    answers = answered.select(key, _SLOT, chosen.alias("_pick")).select(key, _SLOT, "_pick.*")
    return lookup_join(slotted, answers, [key, _SLOT], "left").drop(_SLOT)
