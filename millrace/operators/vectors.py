"""Nearest neighbours of a set of query vectors: exact by blocks, or through random-projection buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Vector elements of one side of a cell: 16 MB as 8-byte numbers.
CELL_VALUES = 2 << 20
# Queries and corpus rows of one matrix product, so a score matrix stays near 8 MB.
PRODUCT_QUERIES, PRODUCT_ROWS = 256, 4096
SAMPLED = 1024  # scores of a query that its first bound comes from
MAX_K = 10

TABLES, BITS, PROBES = 8, 12, 16
_MAX_BITS, _MAX_FLIPS = 20, 3

_HITS = "query_id bigint, hit_id bigint, score double"


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _best(rows: np.ndarray, keys: np.ndarray, scores: np.ndarray, k: int):
    """The k best (highest score, then smallest key) entries of every row."""
    order = np.lexsort((keys, -scores, rows))
    rows, keys, scores = rows[order], keys[order], scores[order]
    index = np.arange(len(rows))
    starts = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, dtype=bool)
    keep = index - np.maximum.accumulate(np.where(starts, index, 0)) < k if len(rows) else starts
    return rows[keep], keys[keep], scores[keep]


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of every row, as a bound that k scores reach; none where there are fewer than k."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return np.where(np.isnan(floor), -np.inf, floor)


def _below(floor: np.ndarray) -> np.ndarray:
    """What a score must reach to be the floor or more once rounded; a column, one row for each query."""
    return (floor - 1e-12 - 1e-15 * np.abs(floor))[:, None]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), width)


def _cell(k: int, metric: str, width: int, cell_values: int = CELL_VALUES) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best corpus rows of a cell for every query of the cell; nothing else leaves it. No side of a product has
    more than ``cell_values`` elements."""
    at_once = max(1, cell_values // max(1, width))
    query_step, row_step = min(PRODUCT_QUERIES, at_once), min(PRODUCT_ROWS, at_once)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        query_ids, row_ids = (t.column("id").to_numpy() for t in (left, right))
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if len(query_ids) and len(row_ids):
            queries, rows = _matrix(left.column("v"), width), _matrix(right.column("v"), width)
            if metric == "cosine":
                queries, rows = _unit_rows(queries), _unit_rows(rows)
            parts = []
            for start in range(0, len(queries), query_step):
                some = queries[start : start + query_step]
                own, waiting, floor = (held[0][:0], held[1][:0], held[2][:0]), [], None
                for first in range(0, len(rows), row_step):
                    scores = some @ rows[first : first + row_step].T
                    if floor is None:
                        floor = _kth(scores[:, :SAMPLED], k)
                        bound = _below(floor)
                    # Only what may still be among a query's k best is looked at again.
                    at, column = np.nonzero(scores >= bound)
                    if len(at):
                        # Rounded, so equal vectors tie whatever cell they came in.
                        waiting.append((at + start, row_ids[first + column], np.round(scores[at, column], 12)))
                    if sum(len(w[0]) for w in waiting) >= k * len(some):
                        own, waiting = _best(*(np.concatenate(c) for c in zip(own, *waiting)), k), []
                        found = np.bincount(own[0] - start, minlength=len(some))
                        floor[found == k] = own[2][np.cumsum(found)[found == k] - 1]
                        bound = _below(floor)
                own = _best(*(np.concatenate(c) for c in zip(own, *waiting)), k)
                parts.append(own)
            held = tuple(np.concatenate(columns) for columns in zip(*parts))
        at, keys, scores = held
        columns = [pa.array(query_ids[at], pa.int64()), pa.array(keys, pa.int64()), pa.array(scores, pa.float64())]
        return pa.Table.from_arrays(columns, ["query_id", "hit_id", "score"])

    return run


def _vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v of the rows whose vector is there and has no missing element."""
    whole = F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull())
    return rows.where(whole).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))


def _sizes(rows: DataFrame) -> tuple[int, int]:
    """Number of rows and elements of the widest vector."""
    count, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    return int(count), int(width or 0)


def _blocks(count: int, width: int, cell_values: int) -> int:
    return max(1, -(-count * width // cell_values))


def _grid(queries: int, rows: int, width: int, cell_values: int, cores: int) -> tuple[int, int]:
    """Blocks of queries and of corpus rows. Every row goes to as many cells as the other side has blocks, so blocks never
    hold less than ``CELL_VALUES`` elements, except to give every core a cell."""
    moved = max(cell_values, CELL_VALUES)
    across = _blocks(queries, width, moved)
    return across, max(_blocks(rows, width, moved), -(-cores // across))


def _every(number: int | Column) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(number) - 1))


def _own(blocks: int | Column) -> Column:
    """The block of a row, by its id."""
    return F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("hit_id").asc())
    ranked = hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "hit_id", "score")


def _checked(k: int, metric: str) -> None:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must lie between 1 and {MAX_K}")
    if metric not in ("cosine", "dot"):
        raise ValueError("metric must be cosine or dot")


def vector_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 4,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    metric: str = "cosine",
    where=None,
    cell_values: int = CELL_VALUES,
) -> DataFrame:
    """The k most similar corpus rows of every query, exactly: ``query_id, rank, hit_id, score``.

    Both sides are cut into blocks of ``CELL_VALUES`` elements (``cell_values`` if more) by a hash of the id, and every pair
    of blocks is a cell, scored in a task of its own by matrix products with ``cell_values`` elements a side at most. A query row goes to as many cells as the corpus has blocks, a
    corpus row to as many as the queries have; with one block of queries the corpus moves once. Each cell passes on its
    k best rows per query, and a second ranking merges them. No row passes through the driver.

    ``where`` filters the corpus before scoring. Vectors that are missing, have missing elements or another size than
    the queries' match nothing. Zero vectors score 0 by cosine.
    """
    _checked(k, metric)
    corpus = corpus if where is None else corpus.where(where)
    wanted, rows = _vectors(queries, id_col, vector_col), _vectors(corpus, id_col, vector_col)
    count, width = _sizes(wanted)
    wanted, rows = (side.where(F.size("v") == width) for side in (wanted, rows))
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    across, down = _grid(count, rows.count(), width, cell_values, cores)
    left = wanted.select("id", "v", _own(across).alias("a"), _every(down).alias("b"))
    right = rows.select("id", "v", _every(across).alias("a"), _own(down).alias("b"))
    cells = left.groupBy("a", "b").cogroup(right.groupBy("a", "b"))
    return _ranked(cells.applyInArrow(_cell(k, metric, width, cell_values), _HITS), k)


def _planes(tables: int, bits: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(width, tables * bits))


def _bucketed(rows: DataFrame, planes: np.ndarray, tables: int, bits: int, probes: int, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns, table and bucket of every row: its own bucket of each table and the ``probes`` - 1 next ones.

    The next ones flip the bits whose projections lie nearest to zero, by the sum of their squares.
    """
    flips = [f for n in range(_MAX_FLIPS + 1) for f in combinations(range(bits), n)]
    masks = np.array([sum(1 << i for i in f) for f in flips], np.int64)
    chosen = np.array([[i in f for i in range(bits)] for f in flips], float)
    probes = min(probes, len(flips))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = _matrix(batch.column("v"), planes.shape[0]) @ planes
            for table in range(tables):
                part = found[:, table * bits : (table + 1) * bits]
                own = (part > 0) @ (1 << np.arange(bits))
                cost = part**2 @ chosen.T
                best = np.argpartition(cost, probes - 1, axis=1)[:, :probes] if probes < len(flips) else np.arange(len(flips))[None].repeat(len(part), 0)
                bucket = (own[:, None] ^ masks[best]).ravel()
                at = np.repeat(np.arange(len(part)), probes)
                columns = [batch.column(c).take(pa.array(at)) for c in keep]
                columns += [pa.array(np.full(len(at), table, np.int32)), pa.array(bucket.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "table", "bucket"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", table int, bucket int")


def vector_topk_lsh(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 4,
    *,
    tables: int = TABLES,
    bits: int = BITS,
    probes: int = PROBES,
    seed: int = 7,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    metric: str = "cosine",
    where=None,
    cell_values: int = CELL_VALUES,
) -> DataFrame:
    """Approximate ``vector_topk``: only rows that share a bucket with a query are scored, and those exactly.

    Each of ``tables`` hash tables gives a vector ``bits`` signs of random projections; a query also looks into the
    ``probes`` - 1 buckets it most nearly falls in. A bucket is a cell like those of ``vector_topk``: one with more than
    ``cell_values`` elements on a side is cut into blocks, each pair of blocks a task, so a bucket that holds a third of
    all vectors is not one task. Bucket sizes are at most ``tables`` x 2^``bits`` rows. Missing and odd-sized vectors
    match nothing. Measure with ``recall`` before use: near-uniform vectors need few bits and many probes.
    """
    _checked(k, metric)
    if not 1 <= bits <= _MAX_BITS:
        raise ValueError(f"bits must lie between 1 and {_MAX_BITS}")
    corpus = corpus if where is None else corpus.where(where)
    wanted, rows = _vectors(queries, id_col, vector_col), _vectors(corpus, id_col, vector_col)
    _, width = _sizes(wanted)
    wanted, rows = (side.where(F.size("v") == width) for side in (wanted, rows))
    planes = _planes(tables, bits, width, seed)
    bucket = ("table", "bucket")

    def blocks(side: DataFrame, number: int, name: str) -> DataFrame:
        """Blocks of every bucket that the side has; the sizes need no vectors."""
        sized = _bucketed(side, planes, tables, bits, number, ("id",)).groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"))
        return sized.select(*bucket, F.ceil(F.col("n") * width / cell_values).cast("int").alias(name))

    sizes = F.broadcast(blocks(wanted, probes, "across").join(blocks(rows, 1, "down"), list(bucket)))
    left = _bucketed(wanted, planes, tables, bits, probes, ("id", "v")).join(sizes, list(bucket))
    left = left.select(*bucket, "id", "v", _own(F.col("across")).alias("a"), _every(F.col("down")).alias("b"))
    right = _bucketed(rows, planes, tables, bits, 1, ("id", "v")).join(sizes, list(bucket))
    right = right.select(*bucket, "id", "v", _every(F.col("across")).alias("a"), _own(F.col("down")).alias("b"))
    cells = left.groupBy(*bucket, "a", "b").cogroup(right.groupBy(*bucket, "a", "b"))
    hits = cells.applyInArrow(_cell(k, metric, width), _HITS)
    return _ranked(hits.groupBy("query_id", "hit_id").agg(F.max("score").alias("score")), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: exact hits, those of them that ``found`` has, and their share (null without exact hits)."""
    pair = ["query_id", "hit_id"]
    both = exact.select(*pair).join(found.select(*pair, F.lit(1).alias("_hit")), pair, "left")
    counted = both.agg(F.count(F.lit(1)).alias("exact_hits"), F.count("_hit").alias("found_hits"))
    return counted.withColumn("recall", F.col("found_hits") / F.nullif("exact_hits", F.lit(0)))
