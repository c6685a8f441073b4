"""SimHash near-duplicates found at the anchors of a covering code.

Fingerprints are folded to 46 bits (the upper 18 are added to the lower ones, which never raises a distance) and read as
two words of the binary Golay code of length 23. That code is perfect with covering radius 3, so its pairs of codewords
are anchors such that every fingerprint has one home anchor, at most 3 away in either half. A fingerprint goes to every
anchor whose distance beyond 3, summed over both halves, is at most the threshold: about 61 anchors for threshold 2. If
two fingerprints differ in at most that many bits, the home of one is among the anchors of the other, so no link is lost.

Equal fingerprints are one entry. Each task compares the entries of its anchors in sorted order and passes on only links
that join something new within the task, never all pairs of a group. Components come from star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written
from millrace.llm.components import connected
from millrace.llm.words import releasing

THRESHOLD = 2
BLOCK = 100_000  # entries of a hot anchor that are compared with as many others in one task
_BUCKET_BITS, _CELL_BITS, _MOST_BLOCKS = 16, 17, 362  # cells of an anchor: 362 * 362 < 2**17
_FOLD, _HALF = 46, 23
_CHECKS = 11
_GENERATOR = 0xAE3  # fixed value: generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1
_PART = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: str, shingle: int = 3) -> int:
    """64 bits; a bit is set where over half the shingles' hashes have it. Without words: zero."""
    raw = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
    if not raw:
        return 0
    # Words are the pieces between spaces, so a shingle is a slice of the joined text.
    ends = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 32), len(raw))
    starts = np.append(0, ends[:-1] + 1)
    if len(ends) <= shingle:
        spans = [raw]
    else:
        spans = map(raw.__getitem__, map(slice, starts[: len(starts) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, spans, repeat(42)), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _PART):
        part = hashes[i : i + _PART]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(hashes))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fingerprint (a signed long) of every row; a null text counts as empty."""

    @F.pandas_udf("bigint")
    def mark(texts: pd.Series) -> pd.Series:
        found = np.array([fingerprint(t if isinstance(t, str) else "", shingle) for t in texts], np.uint64)
        return pd.Series(found.view(np.int64))

    return docs.select("doc_id", mark("text").alias("fingerprint"))


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator polynomial."""
    words = words.astype(np.int64)
    for bit in range(_HALF - 1, _CHECKS - 1, -1):
        words = np.where(words >> bit & 1 == 1, words ^ _GENERATOR << bit - _CHECKS, words)
    return words


class Anchors:
    """The anchors near each fingerprint."""

    def __init__(self, threshold: int = THRESHOLD):
        self.threshold = threshold
        errors = [(0, 0)]
        for weight in range(1, 4 + threshold):
            errors += [(sum(1 << i for i in at), weight) for at in combinations(range(_HALF), weight)]
        masks = np.array([e for e, _ in errors], np.int64)
        beyond = np.array([max(0, w - 3) for _, w in errors])
        of = _syndrome(masks)
        order = np.lexsort((beyond, of))
        self.masks, self.beyond = masks[order], beyond[order]
        self.first = np.searchsorted(of[order], np.arange((1 << _CHECKS) + 1))

    def _near(self, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, codeword, distance beyond 3) of all codewords in reach."""
        marks = _syndrome(halves)
        sizes = self.first[marks + 1] - self.first[marks]
        row = np.repeat(np.arange(len(halves)), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.first[marks], sizes)
        return row, halves[row] ^ self.masks[at], self.beyond[at]

    def of(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, whether it is the row's home) for an array of unsigned fingerprints."""
        folded = ((prints ^ prints >> np.uint64(_FOLD)) & np.uint64((1 << _FOLD) - 1)).astype(np.int64)
        low_row, low, low_far = self._near(folded & (1 << _HALF) - 1)
        high_row, high, high_far = self._near(folded >> _HALF)
        sizes = np.bincount(high_row, minlength=len(prints))
        first = np.cumsum(sizes) - sizes
        # Every near low word with every near high word of the same row.
        left = np.repeat(np.arange(len(low_row)), sizes[low_row])
        skip = np.repeat(np.cumsum(sizes[low_row]) - sizes[low_row], sizes[low_row])
        right = np.arange(len(left)) - skip + first[low_row[left]]
        far = low_far[left] + high_far[right]
        keep = far <= self.threshold
        left, right = left[keep], right[keep]
        return low_row[left], high[right] << _HALF | low[left], far[keep] == 0


def _links(prints: np.ndarray, anchors: np.ndarray, home: np.ndarray, threshold: int) -> tuple[list[int], list[int]]:
    """Links among entries sorted by anchor: a spanning forest of all pairs in reach that share an anchor."""
    nodes, own = np.unique(prints, return_inverse=True)
    root = np.arange(len(nodes))
    a_out: list[int] = []
    b_out: list[int] = []
    at, step = np.arange(len(prints)), 0
    while True:
        step += 1
        at = at[at + step < len(prints)]
        at = at[anchors[at] == anchors[at + step]]
        if not len(at):
            return a_out, b_out
        to = at + step
        close = (home[at] | home[to]) & (np.bitwise_count(prints[at] ^ prints[to]) <= threshold)
        a, b = own[at[close]], own[to[close]]
        new = root[a] != root[b]
        if not new.any():
            continue
        for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True):
            rx, ry = root[x], root[y]
            while root[rx] != rx:
                rx = root[rx]
            while root[ry] != ry:
                ry = root[ry]
            if rx != ry:
                root[max(rx, ry)] = min(rx, ry)
                a_out.append(int(nodes[x]))
                b_out.append(int(nodes[y]))
        while (root != root[root]).any():
            root = root[root]


def _bucket(anchors: np.ndarray) -> np.ndarray:
    return (anchors.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)


def hot_anchors(prints: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> np.ndarray:
    """Blocks that the anchors of each bucket are cut into: more than one only where a bucket holds over ``block`` entries
    and over four times the average. Entries are counted by a hash of the anchor, so counts are few whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, total = Anchors(threshold), np.zeros(1 << _BUCKET_BITS, np.int64)
        for batch in batches:
            found = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(found), 2000):
                _, anchor, _ = near.of(found[start : start + 2000].view(np.uint64))
                total += np.bincount(_bucket(anchor), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = prints.select("fingerprint").mapInArrow(releasing(count), "bucket bigint, n bigint")
    total = np.zeros(1 << _BUCKET_BITS, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():  # 2**_BUCKET_BITS rows at most
        total[bucket] = n
    blocks = np.minimum(-(-total // block), _MOST_BLOCKS)
    return np.where(total > max(block, 4 * total.mean()), blocks, 1)


def links(prints: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints in reach of each other. ``prints``: distinct ``fingerprint``.

    The entries of a hot anchor are cut into blocks by a hash of the fingerprint; every pair of blocks is a cell of its own,
    so an anchor that most fingerprints lie near is many tasks, and all its pairs are still compared.
    """
    blocks = hot_anchors(prints, threshold, block)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Anchors(threshold)
        for batch in batches:
            found = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(found), 2000):
                part = found[start : start + 2000]
                row, anchor, home = near.of(part.view(np.uint64))
                number = blocks[_bucket(anchor)]
                own = (part[row].view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)).astype(np.int64) % number
                # An entry goes to its block's cell with every block; a cell is named by its smaller block first.
                again = np.repeat(np.arange(len(row)), number)
                other = np.arange(len(again)) - np.repeat(np.cumsum(number) - number, number)
                low, high = np.minimum(own[again], other), np.maximum(own[again], other)
                cell = anchor[again] << _CELL_BITS | low * _MOST_BLOCKS + high
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array(part[row][again]), pa.array(home[again])], ["anchor", "fingerprint", "home"]
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple[np.ndarray, ...]] = []

        def found(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            anchors, prints, home = (np.concatenate(x) for x in zip(*parts, strict=True))
            a, b = _links(prints, anchors, home, threshold)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            new = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(new[0]):
                continue
            cut = int(np.searchsorted(new[0], new[0][-1]))  # the last anchor may go on in the next batch
            if cut:
                yield found([*rest, tuple(x[:cut] for x in new)])
                rest = []
            rest.append(tuple(x[cut:] for x in new))
        if rest:
            yield found(rest)

    placed = prints.select("fingerprint").mapInArrow(releasing(replicate), "anchor bigint, fingerprint bigint, home boolean")
    return placed.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(releasing(compare), "a bigint, b bigint")


def near_groups(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links reach, itself included; null doc_ids are never the smallest, so a
    component of null ids only has null. Null and wordless texts have fingerprint zero and link like any other. Repeated
    rows share a fingerprint. An empty table gives an empty result.
    """
    marked = written(fingerprints(docs, shingle), "simhash-docs")
    prints = written(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-prints")
    joined = connected(written(links(prints, threshold), "simhash-links"))
    placed = prints.join(joined.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    placed = written(placed.withColumn("component", F.coalesce("component", "fingerprint")), "simhash-placed")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(placed.join(least, "component").select("fingerprint", "component_id"), "simhash-named")
    out = marked.join(named, "fingerprint")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")

