"""A worker's bounded memory of words, and what it gives back."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

TEXTS, CHARS = 2000, 4_000_000  # of a group of texts handled at once, unless one text alone is longer


class WordStore:
    """Rows of numbers by word, computed once: ``learn`` gets new words and returns an array with a row for each.

    Once more than ``most`` words are known, all are forgotten and those needed are learned again.
    """

    def __init__(self, learn: Callable[[list[str]], np.ndarray], most: int):
        self.learn, self.most = learn, most
        self.known: dict[str, int] = {}
        self.table: np.ndarray | None = None

    def rows(self, words: Sequence[str]) -> np.ndarray:
        """The row of each word."""
        distinct = set(words)
        new = [w for w in distinct if w not in self.known]
        if new and len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(distinct)
        if new:
            first = len(self.known)
            found = self.learn(new)
            if self.table is None or not first:
                self.table = found
            else:
                if first + len(new) > len(self.table):
                    more = np.zeros((max(len(new), len(self.table)), found.shape[1]), found.dtype)
                    self.table = np.concatenate([self.table, more])
                self.table[first : first + len(new)] = found
            self.known.update((w, first + i) for i, w in enumerate(new))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return self.table[at]


def release() -> None:
    """Hand freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` (batches in, batches out), with its memory handed back at the end: later tasks reuse the worker."""

    @functools.wraps(run)
    def released(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return released


def groups(texts: Sequence[str], most: int = CHARS, number: int = TEXTS) -> Iterator[tuple[int, int]]:
    """Start and end of groups of texts, so that words are looked up for many texts at once."""
    start = chars = 0
    for i, text in enumerate(texts):
        chars += len(text)
        if chars >= most or i - start >= number:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def sums(values: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """Row sums of consecutive parts of ``values``; an empty part sums to zero."""
    sizes = np.asarray(sizes, np.int64)
    out = np.zeros((len(sizes), values.shape[1]))
    if len(values):
        full = sizes > 0
        starts = np.cumsum(sizes) - sizes
        out[full] = np.add.reduceat(values, starts[full])
    return out
