"""What the operators of this subpackage share: whole texts, shared tables, held-out rows, bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import scratch

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_MADE: list[str] = []  # tables written by this driver, oldest first

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole_text(column: Column | str = "text") -> Column:
    """The text itself; a missing one counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case, every other character unchanged."""
    return F.translate(column, UPPER, LOWER)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again.

    This cuts the lineage in a way that outlives any executor. The shuffle files of
    the write go as soon as the table is complete, so a chain of steps never holds
    more than one step's shuffle on disk.
    """
    spark = df.sparkSession
    path = scratch(spark, f"llm-{label}")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_made() -> int:
    """How many tables ``written`` has made so far: a mark for ``drop_tables``."""
    return len(_MADE)


def drop_tables(spark: SparkSession, since: int, until: int) -> None:
    """Delete the tables made between two marks. Nothing that is still to be read may depend on them."""
    for path in _MADE[since:until]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows that no model learns from: CRC-32 of the id as text, modulo 4, is 2. A missing id is never held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(docs: DataFrame, marks: DataFrame, label: str, max_rows: int, max_chars: int) -> list[tuple[str, object]]:
    """Whole texts and labels of at most ``max_rows`` rows and ``max_chars`` characters of each label.

    ``marks`` holds doc_id and ``label``, ``docs`` doc_id and text; rows without text or label are left out, and so are
    texts longer than a quarter of ``max_chars``, before anything is ranked. Rows are taken in the order of a hash of
    the id until a bound is reached, so the choice depends on neither partitions nor size. Ids whose hash lies
    beyond about twice the share that ``max_rows`` needs are left out before the shuffle, so no task ranks all
    rows of a label. labels x ``max_chars`` bounds what the driver gets.
    """
    known = marks.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", label)
    numbers = known.groupBy(label).agg(F.count(F.lit(1)).alias("_number"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    first = place * F.col("_number") <= 2 * max_rows + 100
    picked = known.join(F.broadcast(numbers), label).where(first).select("doc_id", label).distinct()
    fits = F.length("text") <= max_chars // 4  # null lengths fit nothing
    texts = docs.where(fits).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    by_text = Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    rows = texts.withColumn("_rank", F.row_number().over(by_text)).where(F.col("_rank") <= max_rows)
    rows = rows.withColumn("_sum", F.sum(F.length("text")).over(Window.partitionBy(label).orderBy("_rank")))
    rows = rows.where(F.col("_sum") <= max_chars).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), label)
    return [(r[0], r[1]) for r in rows.select("text", label).collect()]
