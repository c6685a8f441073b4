"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and an order-free checksum."""
    mark = F.xxhash64("a", "b")
    low, high = mark.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(mark, 33)
    found = edges.agg(F.count(F.lit(1)), F.sum(low), F.sum(high)).first()
    return found[0], (found[1] or 0) * (1 << 40) + (found[2] or 0)


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Edges run from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b")))


def connected(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node in ``edges`` (a, b: bigint).

    Self-links, repeated and null links are allowed and add nothing. Each round is a table in the shared folder; rounds
    grow with the logarithm of the longest path. Degrees are only counted through combined aggregates and joins that
    adaptive execution can split, so a node with very many links is no single task's work.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(ordered.distinct(), "links")
    state = _state(now)
    while state[0]:
        now = written(_small(written(_large(now).distinct(), "links")).distinct(), "links")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
