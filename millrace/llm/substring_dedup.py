"""Removal of passages that an earlier document also has.

1. Seeds. Of the ``GRAM``-word sequences inside every window, the one with the smallest hash is the window's seed. Equal
   windows have equal seeds, and neighbouring windows mostly share theirs, so there are about five windows to a seed.
2. Candidates. Seeds that occur in two documents are found by a combined aggregate and joined back to their documents.
   Only windows with such a seed go on.
3. Confirmation. Candidate windows are grouped by their 64-bit hash; those of two documents are recurring passages.
4. Automata. Each task receives documents together with the windows that an earlier document has. Runs of such windows
   are recurring passages; those of a shard of documents are compiled into an Aho-Corasick automaton over words, and the
   shard's documents are streamed through it, which finds every occurrence, also repeated and overlapping ones.

Passages are shipped only to the documents that hold them, so the work grows with the input and not with its square, and
a shard holds ``PASSAGE_WORDS`` words at most, so automata stay small at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written

WINDOW, GRAM = 13, 5
PASSAGE_WORDS = 200_000  # words of the passages of one automaton, unless one document alone has more
_BASE = 0x9E3779B97F4A7C15
_LAST = (1 << 63) - 1  # stands for a missing doc_id: later than any other


class WordHashes:
    """64-bit hashes of all words of many texts, by array operations over their bytes.

    A word's hash is a polynomial of its bytes modulo 2**64, taken from running sums and divided by the power of its start.
    """

    def __init__(self) -> None:
        self.space = np.zeros(256, bool)
        self.space[list(b" \t\n\v\f\r")] = True
        self.powers, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        for name, base in (("powers", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            setattr(self, name, np.multiply.accumulate(out))

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = b" ".join(texts)
        if len(raw) >= len(self.powers):
            self._grow(max(2 * len(raw), 1 << 16))
        codes = np.frombuffer(raw, np.uint8)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = ~self.space[codes]
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[::2], edges[1::2]
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.powers[: len(raw)], out=total[1:])
        marks = (total[ends] - total[starts]) * self.inverse[starts]
        marks ^= marks >> np.uint64(32)
        marks *= np.uint64(0xD6E8FEB86659FD93)
        marks ^= marks >> np.uint64(29)
        limits = np.cumsum([len(t) + 1 for t in texts])
        return np.split(marks, np.searchsorted(starts, limits[:-1]))


def rolling(marks: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all sequences of ``size`` words, from the words' hashes."""
    out = np.zeros(max(0, len(marks) - size + 1), np.uint64)
    for i in range(size):
        out = out * np.uint64(_BASE) + marks[i : i + len(out)]
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def seeds_of(marks: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The seed of every window."""
    grams = rolling(marks, gram)
    return np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).min(axis=1)


def _marked(batch: pd.DataFrame, hashes: WordHashes, most: int = 500_000) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(row, text in UTF-8, its words' hashes), hashed for many texts at once."""
    part: list[bytes] = []
    first = size = 0
    for i, text in enumerate(batch["text"]):
        part.append(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b"")
        size += len(part[-1])
        if size >= most or i + 1 == len(batch):
            for j, marks in enumerate(hashes(part)):
                yield first + j, part[j], marks
            part, first, size = [], i + 1, 0


def _pairs(found: list[tuple[int, np.ndarray]], name: str) -> pd.DataFrame:
    if not found:
        return pd.DataFrame({name: np.zeros(0, np.int64), "d": np.zeros(0, np.int64)})
    ids = np.repeat(np.array([d for d, _ in found], np.int64), [len(x) for _, x in found])
    return pd.DataFrame({name: np.concatenate([x for _, x in found]).view(np.int64), "d": ids})


def runs(hits: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive positions."""
    cuts = np.flatnonzero(np.diff(hits) > 1)
    return list(zip(hits[np.r_[0, cuts + 1]].tolist(), hits[np.r_[cuts, len(hits) - 1]].tolist(), strict=True))


def covered(ids: tuple[int, ...], automaton: ahocorasick.Automaton, own: int) -> np.ndarray:
    """Which words lie in an occurrence of a passage whose windows all start in documents before ``own``."""
    edge = np.zeros(len(ids) + 1, np.int64)
    for end, (first, size) in automaton.iter(ids):
        if first < own:
            edge[end - size + 1] += 1
            edge[end + 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def remove_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, kept_text, n_words and n_removed of every row of ``docs`` (doc_id, text).

    Words covered by a window of ``window`` words that also starts in a document with a smaller doc_id are removed; the
    rest is joined by one space. Windows are judged on the input. A null doc_id counts as later than any other, rows with
    one doc_id as one document. Null, empty and short texts lose nothing; no row is dropped.
    """
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("d"))

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = WordHashes()
        for batch in batches:
            ids, found = batch["d"].to_numpy(), []
            for i, _, marks in _marked(batch, store):
                if len(marks) >= window:
                    found.append((ids[i], np.unique(seeds_of(marks, window, gram))))
            yield _pairs(found, "seed")

    all_seeds = written(rows.select("d", "text").mapInPandas(seeds, "seed bigint, d bigint"), "passages-seeds")
    shared = all_seeds.groupBy("seed").agg(F.min("d").alias("least"), F.max("d").alias("last")).where("least < last")
    of_doc = all_seeds.join(shared.select("seed"), "seed").groupBy("d").agg(F.collect_set("seed").alias("seeds"))
    of_doc = written(of_doc, "passages-of-documents")

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = WordHashes()
        for batch in batches:
            ids, known, found = batch["d"].to_numpy(), batch["seeds"].tolist(), []
            for i, _, marks in _marked(batch, store):
                if len(marks) >= window:
                    hit = np.isin(seeds_of(marks, window, gram), np.asarray(known[i], np.int64).view(np.uint64))
                    found.append((ids[i], np.unique(rolling(marks, window)[hit])))
            yield _pairs(found, "passage")

    sides = rows.select("d", "text").join(of_doc, "d")
    windows = written(sides.mapInPandas(candidates, "passage bigint, d bigint"), "passages-windows")
    first = windows.groupBy("passage").agg(F.min("d").alias("least"), F.max("d").alias("last")).where("least < last")
    later = windows.join(first.select("passage", "least"), "passage").where("least < d")
    earlier = later.groupBy("d").agg(F.collect_set(F.struct("passage", "least")).alias("passages"))
    earlier = written(earlier.select("d", "passages.passage", "passages.least"), "passages-earlier")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = WordHashes()

        def shard(rows: list[tuple[int, bytes, list[tuple[int, int, int]]]], own: np.ndarray) -> Iterator[tuple[int, tuple[str, int, int]]]:
            names: dict[bytes, int] = {}
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            texts = []
            for _, raw, passages in rows:
                words = raw.split()
                ids = tuple(names.setdefault(w, len(names)) for w in words) if passages else ()
                for start, end, first in passages:
                    phrase = ids[start:end]
                    if first < automaton.get(phrase, (_LAST + 1, 0))[0]:
                        automaton.add_word(phrase, (first, end - start))
                texts.append((words, ids))
            if len(automaton):
                automaton.make_automaton()
            for (i, _, passages), (words, ids) in zip(rows, texts, strict=True):
                left = words
                if passages:
                    gone = covered(ids, automaton, own[i])
                    left = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                yield i, (b" ".join(left).decode("utf-8", "surrogatepass"), len(words), len(words) - len(left))

        for batch in batches:
            own, marked, least = batch["d"].to_numpy(), batch["passage"].tolist(), batch["least"].tolist()
            kept: dict[int, tuple[str, int, int]] = {}
            waiting: list[tuple[int, bytes, list[tuple[int, int, int]]]] = []
            n = 0
            for i, raw, marks in _marked(batch, store):
                passages: list[tuple[int, int, int]] = []
                if marked[i] is not None and len(marks) >= window:
                    known = np.asarray(marked[i], np.int64)
                    order = np.argsort(known)
                    hashes = rolling(marks, window).view(np.int64)
                    place = np.minimum(np.searchsorted(known[order], hashes), len(known) - 1)
                    hits = np.flatnonzero(known[order][place] == hashes)
                    firsts = np.asarray(least[i], np.int64)[order][place]
                    if len(hits):
                        passages = [(p, q + window, int(firsts[p : q + 1].max())) for p, q in runs(hits)]
                waiting.append((i, raw, passages))
                n += sum(q - p for p, q, _ in passages)
                if n >= PASSAGE_WORDS or len(waiting) >= 500:
                    kept.update(shard(waiting, own))
                    waiting, n = [], 0
            kept.update(shard(waiting, own))
            out = pd.DataFrame([kept[i] for i in range(len(batch))], columns=["kept_text", "n_words", "n_removed"])
            out.insert(0, "doc_id", batch["doc_id"])
            yield out

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(earlier, "d", "left").select("doc_id", "d", "text", "passage", "least").mapInPandas(
        cut, f"doc_id {doc_type}, kept_text string, n_words bigint, n_removed bigint"
    )


def passage_digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of ``remove_passages``."""
    out = remove_passages(docs, window, gram)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
