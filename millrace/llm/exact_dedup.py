"""Exact de-duplication through an extendible-hash index kept on shared files.

The key of a text is its 64-bit hash. The directory doubles, one key bit at a time,
until no bucket holds more than ``capacity`` distinct keys; a bucket at the largest
depth simply overflows. Each map task first reduces equal texts to one row, so a text
with a third of all rows sends one row per task. The task that gets a key's texts
compares their bytes by grouping them: different texts under one key become a chain.
Entries are written bucket by bucket as Parquet below ``spark.checkpoint.dir``, each
bucket by the task that owns it. A row finds its entry as in any extendible hash: the
upper bits of its key name a slot, the directory names the slot's bucket, and the key
is looked up in that bucket; only texts in a chain of two or more are compared again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import whole_text, written

CAPACITY = 20_000  # distinct keys of a bucket
MAX_DEPTH = 14  # the directory has 2**MAX_DEPTH slots at most


def text_key(text: Column, key_bits: int = 64) -> Column:
    """The upper ``key_bits`` bits of the text's hash; fewer bits give collisions, for tests."""
    key = F.xxhash64(text)
    return key if key_bits == 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - key_bits), 64 - key_bits)


def directory(slots: dict[int, int], capacity: int, max_depth: int) -> list[tuple[int, int]]:
    """(slot, bucket) of each slot at the final depth.

    ``slots`` counts distinct keys by their upper ``max_depth`` bits, so it has at most
    2**max_depth entries. The global depth grows until the split buckets fit. A bucket
    is named by 2**depth + prefix, which tells buckets of all depths apart.
    """
    done: dict[int, int] = {}
    todo = [(0, 0)]  # local depth, prefix
    for depth in range(max_depth + 1):
        level: dict[int, int] = {}
        for slot, n in slots.items():
            prefix = slot >> (max_depth - depth)
            level[prefix] = level.get(prefix, 0) + n
        split = []
        for d, prefix in todo:
            if level.get(prefix, 0) > capacity and depth < max_depth:
                split += [(d + 1, prefix * 2), (d + 1, prefix * 2 + 1)]
            else:
                first = prefix << (max_depth - depth)
                for slot in range(first, first + (1 << (max_depth - depth))):
                    done[slot] = (1 << depth) + prefix
        todo = split
    return sorted(done.items())


def _slot(max_depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - max_depth).alias("slot")


def build_index(
    docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, key_bits: int = 64
) -> tuple[DataFrame, DataFrame]:
    """The index: key, bucket, chain, keep_id, group_size, and text where the chain is longer than one; and its directory:
    slot and bucket, 2**max_depth rows at most.

    ``docs`` has doc_id and text; other columns are not read. A null text counts as empty. Of equal texts the
    largest doc_id is kept; a group without any doc_id keeps null. An empty table gives an empty index.
    """
    texts = docs.select("doc_id", whole_text().alias("text")).withColumn("key", text_key(F.col("text"), key_bits))
    grouped = texts.groupBy("key", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Bytes were compared by the grouping; the entries travel on without their texts.
    entries = written(grouped.select("key", "keep_id", "group_size"), "dedup-entries")
    chains = entries.groupBy("key").agg(
        F.count(F.lit(1)).alias("chain"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
    )
    counted = {r[0]: r[1] for r in chains.groupBy(_slot(max_depth)).agg(F.count(F.lit(1))).collect()}  # 2**max_depth rows at most
    spark = docs.sparkSession
    slots = spark.createDataFrame(directory(counted, capacity, max_depth), "slot bigint, bucket bigint")
    placed = chains.withColumn("slot", _slot(max_depth)).join(F.broadcast(slots), "slot").drop("slot")
    owners = placed.withColumn("text", F.lit(None).cast("string")).repartition("bucket").sortWithinPartitions("bucket", "key")
    index = written(owners, "dedup-index")
    shared = index.where("chain > 1").select("key", "bucket", "chain")
    if shared.isEmpty():
        return index, slots
    again = texts.join(shared, "key").groupBy("key", "bucket", "chain", "text")
    chained = again.agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return written(index.where("chain = 1").unionByName(chained), "dedup-chained"), slots


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, key_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest doc_id of equal texts stays. Rows that repeat a doc_id with the same text share its fate;
    a null doc_id stays only in a group that has no other id. Null text equals the empty text.
    """
    index, slots = build_index(docs, capacity, max_depth, key_bits)
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("key", text_key(F.col("text"), key_bits))
    rows = rows.withColumn("text_sha256", F.sha2("text", 256)).withColumn("slot", _slot(max_depth))
    rows = rows.join(F.broadcast(slots), "slot")
    short = rows.select("doc_id", "bucket", "key", F.unhex("text_sha256").alias("sha"))
    found = short.join(index.where("chain = 1").select("bucket", "key", "keep_id", "group_size"), ["bucket", "key"])
    out = found.select("doc_id", "keep_id", "group_size", F.lower(F.hex("sha")).alias("text_sha256"))
    chained = index.where("chain > 1").select("bucket", "key", "text", "keep_id", "group_size")
    if not chained.isEmpty():
        out = out.unionByName(rows.join(chained, ["bucket", "key", "text"]).select(*out.columns))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, **limits) -> DataFrame:
    """``docs``, all its columns, without the rows whose text a larger doc_id also has. Null doc_ids are never dropped."""
    groups = exact_groups(docs, **limits)
    gone = written(groups.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "dedup-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
