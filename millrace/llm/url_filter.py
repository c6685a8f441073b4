"""URL rules decided by cascades of Bloom filters, exact for every key that occurs in the corpus.

Level 0 of a cascade encodes the listed keys. The corpus's complete key universe is then known, so the keys that
wrongly pass are known too; level 1 encodes those, level 2 the listed keys that wrongly pass level 1, and so on until
nobody passes wrongly. A key is listed if the first level that rejects it is odd. The test is one expression: pages
are neither joined nor shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, written

MAX_BITS = 1 << 27  # of one cascade: a literal of 22 MB in the plan
_PER_CHAR = 6  # bits held by one printable character of a filter
_BLOCK = 4096  # characters put together by one group


@dataclass(frozen=True)
class Level:
    bits: int
    probes: int
    chars: bytes


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z in lower case; empty for null or without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _positions(key: Column, number: int, bits: int, probes: int) -> list[Column]:
    mixed = F.xxhash64(key, F.lit(number))
    first, step = F.shiftrightunsigned(mixed, 32), mixed.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1).cast("bigint"))
    return [(first + step * F.lit(i).cast("bigint")) % F.lit(bits).cast("bigint") for i in range(probes)]


def passes(key: Column, number: int, level: Level) -> Column:
    found = F.lit(True)
    for at in _positions(key, number, level.bits, level.probes):
        index = F.floor(at / F.lit(_PER_CHAR)).cast("int")
        char = F.substring(F.lit(level.chars), index + 1, F.lit(1)).cast("string")
        found = found & (F.getbit(F.ascii(char) - 48, (at % _PER_CHAR).cast("int")) == 1)
    return found


def contains(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed."""
    answer = F.lit(len(levels) % 2 == 1)
    for number in reversed(range(len(levels))):
        answer = F.when(passes(key, number, levels[number]), answer).otherwise(F.lit(number % 2 == 1))
    return answer


def _filled(keys: DataFrame, number: int, bits: int, probes: int) -> bytes:
    """The filter's characters; groups of ``_BLOCK`` are assembled by the executors, ``bits`` bounds the whole."""
    size = -(-bits // _PER_CHAR)
    at = F.explode(F.array(*_positions(F.col("key"), number, bits, probes)))
    ones = keys.select(at.alias("at")).select(
        F.floor(F.col("at") / _PER_CHAR).alias("i"), F.expr(f"shiftleft(1, cast(at % {_PER_CHAR} as int))").alias("v")
    )
    zeros = keys.sparkSession.range(size).select(F.col("id").alias("i"), F.lit(0).alias("v"))
    chars = ones.unionByName(zeros).groupBy("i").agg(F.bit_or("v").alias("v"))
    blocks = chars.groupBy(F.floor(F.col("i") / _BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("c"))
    text = F.array_join(F.transform("c", lambda x: F.char(x["v"] + 48)), "")
    return "".join(r[1] for r in blocks.select("block", text).orderBy("block").collect()).encode()


def build_cascade(universe: DataFrame, max_bits: int = MAX_BITS) -> list[Level]:
    """Levels for ``universe``: distinct keys, each with ``listed``.

    The first level lets about as many strangers pass as there are listed keys, later ones a quarter: all levels
    together take about 1.44 n (log2(strangers / n) + 4) bits for n listed keys. A list beyond ``max_bits`` is refused
    with ValueError; its owner then splits it and applies the parts in turn.
    """
    levels: list[Level] = []
    counts = {r[0]: r[1] for r in universe.groupBy("listed").count().collect()}
    rate = min(0.25, max(2.0**-20, counts.get(True, 0) / max(1, counts.get(False, 0))))
    while True:
        number = len(levels)
        wanted = universe.where(F.col("listed") == F.lit(number % 2 == 0))
        for i, level in enumerate(levels):
            wanted = wanted.where(passes(F.col("key"), i, level))
        n = wanted.count()
        if not n:
            return levels
        probes = max(1, round(-math.log2(rate)))
        bits = max(64, math.ceil(n * probes * 1.4427))
        if bits + sum(x.bits for x in levels) > max_bits:
            raise ValueError(f"the list needs more than {max_bits} bits of filters; split it")
        levels.append(Level(bits, probes, _filled(wanted, number, bits, probes)))
        rate = 0.25


def _candidates(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Every rule that could fit: host suffixes with as many labels, and path starts as long, as some rule has."""
    parts = F.split(host, r"\.")
    ends = F.transform(
        F.filter(F.array(*map(F.lit, labels)), lambda n: n <= F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    starts = F.transform(
        F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n)
    )
    return F.flatten(F.transform(ends, lambda e: F.transform(starts, lambda s: F.concat(e, s))))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url).

    ``rules`` has rule (host and path start, like ``net/``) and action (allow or block); null rules are left out and
    repeated ones count once; with both actions, block holds. A rule fits its host and all subdomains if the path
    starts with its path; the longest fitting rule wins, and among equally long ones the longer host. A key is looked
    up in the cascades of both actions. A page whose keys are in neither gets ``default``: it is not listed. Null urls,
    urls without :// and an empty table are no special case. Only page_id and url are read.
    """
    wanted = rules.where(F.col("rule").isNotNull()).select(ascii_lower(F.substring_index("rule", "/", 1)).alias("h"), "rule", "action")
    wanted = wanted.select(F.concat("h", F.expr("substring(rule, length(h) + 1)")).alias("key"), "h", "action")
    shape = wanted.agg(
        F.sort_array(F.collect_set(F.size(F.split("h", r"\.")))), F.sort_array(F.collect_set(F.length("key") - F.length("h")))
    ).first()
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not shape[0]:
        return seen.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    options = _candidates(F.col("host"), F.col("path"), shape[0], shape[1])
    keys = seen.select("host", "path").distinct().select(F.explode(options).alias("key"), F.lit("seen").alias("action"))
    universe = keys.unionByName(wanted.select("key", "action")).groupBy("key").agg(
        F.max(F.col("action") == "block").alias("block"), F.max(F.col("action") == "allow").alias("allow")
    )
    universe = written(universe, "url-keys")
    block = build_cascade(universe.select("key", F.col("block").alias("listed")), max_bits)
    allow = build_cascade(universe.select("key", F.col("allow").alias("listed")), max_bits)
    fits = F.filter(
        F.transform(
            options,
            lambda k: F.struct(
                F.length(k).alias("n"),
                F.length(F.substring_index(k, "/", 1)).alias("h"),
                k.alias("rule"),
                F.when(contains(k, block), "block").when(contains(k, allow), "allow").alias("verdict"),
            ),
        ),
        lambda x: x["verdict"].isNotNull(),
    )
    best = F.array_max(fits)
    return seen.select(
        "page_id", "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict")
    )
