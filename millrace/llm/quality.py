"""Quality scores from learned hashed n-gram vectors.

Every word gives a hashed vector for itself and for its character n-grams, every pair of neighbouring words one more; a
word repeated at once always gives the same pair. Their average is the document's vector, a softmax layer on top gives
the probability of label 1. All vectors are learned by stochastic gradient descent in numpy on a bounded sample.

After training, the layer is folded into the vectors: a bucket then holds one number, its share of the log odds, and a
document's log odds are the mean over its features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_sample, held_out, whole_text
from millrace.llm.words import WordStore, groups, sums

BUCKETS = 1 << 18
GRAMS = (3, 4)
THRESHOLD = 0.7
STORE = 200_000  # words that a worker remembers
CHARS = 300_000  # of texts scored at once, unless one text alone is longer


def word_buckets(words: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode(errors="replace")) for w in words], np.int64) & BUCKETS - 1


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character n-grams (of the UTF-8 bytes) of the marked words, and the word of each."""
    raw = [f"<{w}>".encode(errors="replace") for w in words]
    text = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(raw)), list(map(len, raw)))
    buckets, owners = [], []
    for n in GRAMS:
        mixed = np.full(max(0, len(text) - n + 1), n, np.int64)
        for k in range(n):
            mixed = (mixed * 0x01000193 + text[k : k + len(mixed)]) & 0xFFFFFFFF
        inside = owner[: len(mixed)] == owner[n - 1 :][: len(mixed)]
        buckets.append((mixed ^ mixed >> 15)[inside] & BUCKETS - 1)
        owners.append(owner[: len(mixed)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, from the words' hashes; one bucket of its own for a word and itself."""
    pairs = (hashes[:-1] * 0x9E3779B1 + hashes[1:] * 0x85EBCA6B) >> 7 & BUCKETS - 1
    return np.where(hashes[:-1] == hashes[1:], BUCKETS, pairs)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    own = word_buckets(words)
    all_of = np.concatenate([own, gram_buckets(words)[0], pair_buckets(own)])
    buckets, counts = np.unique(all_of, return_counts=True)
    return buckets, counts.astype(float)


def train(sample: list[tuple[str, int]], size: int = 8, updates: int = 400, rate: float = 0.5, batch: int = 32, seed: int = 7) -> tuple[np.ndarray, float]:
    """Log odds of each bucket and the constant; labels weigh alike whatever their numbers in the sample.

    The rows are passed over until about ``updates`` batches were seen, so a small sample is learned as well as a large one.
    """
    rng = np.random.default_rng(seed)
    if len({y for _, y in sample}) < 2:
        return np.zeros(BUCKETS + 1, np.float32), 0.0
    rows = [(f[0], f[1] / f[1].sum(), float(y)) for f, y in ((features(t), y) for t, y in sample) if len(f[0])]
    vectors = rng.uniform(-1 / size, 1 / size, (BUCKETS + 1, size))
    layer, bias = np.zeros((size, 2)), np.zeros(2)
    ones = sum(y for *_, y in rows)
    weight = {1.0: len(rows) / max(1, 2 * ones), 0.0: len(rows) / max(1, 2 * (len(rows) - ones))}
    steps, epochs = 0, max(1, round(updates * batch / max(1, len(rows))))
    total = epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), batch):
            picked = [rows[i] for i in order[start : start + batch]]
            ids = np.concatenate([r[0] for r in picked])
            share = np.concatenate([r[1] for r in picked])
            ends = np.cumsum([len(r[0]) for r in picked])
            doc = np.repeat(np.arange(len(picked)), [len(r[0]) for r in picked])
            mean = np.add.reduceat(vectors[ids] * share[:, None], np.r_[0, ends[:-1]])
            logits = mean @ layer + bias
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            y = np.array([r[2] for r in picked])
            error = (prob - np.stack([1 - y, y], 1)) * np.array([weight[v] for v in y])[:, None]
            step = rate * (1 - steps / total)
            back = error @ layer.T
            layer -= step * mean.T @ error / len(picked) * 4
            bias -= step * error.mean(axis=0)
            unique, inverse = np.unique(ids, return_inverse=True)
            for k in range(size):  # summed over the batch: vectors are rare, their gradients small
                vectors[unique, k] -= step * np.bincount(inverse, share * back[doc, k], len(unique))
            steps += 1
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


class Scorer:
    """Scores texts; remembers each word's sum, number of features and bucket, ``STORE`` words at most."""

    def __init__(self, odds: np.ndarray, constant: float, prior: float):
        self.odds, self.constant = odds, constant + prior
        self.store = WordStore(self._learn, STORE)

    def _learn(self, words: list[str]) -> np.ndarray:
        own = word_buckets(words)
        grams, owner = gram_buckets(words)
        total = self.odds[own] + np.bincount(owner, self.odds[grams], len(words))
        return np.stack([total, 1 + np.bincount(owner, minlength=len(words)), own], 1)

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for start, end in groups(texts, CHARS):
            words = [t.split() for t in texts[start:end]]
            sizes = np.array(list(map(len, words)))
            mean = np.zeros(len(words))
            if sizes.any():
                each = self.store.rows([w for x in words for w in x])
                last = np.cumsum(sizes[sizes > 0]) - 1
                pairs = np.append(self.odds[pair_buckets(each[:, 2].astype(np.int64))].astype(float), 0)
                pairs[last] = 0  # the next word is another text's
                total = sums(np.stack([each[:, 0] + pairs, each[:, 1] + 1], 1), sizes)
                mean = total[:, 0] / np.maximum(total[:, 1] - (sizes > 0), 1)
            out[start:end] = 1 / (1 + np.exp(-np.clip(mean + self.constant, -50, 50)))
        return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 1000, max_chars: int = 3_000_000) -> tuple[np.ndarray, float, float]:
    """Log odds by bucket, constant, and log odds of the labels, from labelled rows that are not held out.

    Of each label at most ``max_rows`` rows and ``max_chars`` characters are used, chosen by a hash of the id. Labels
    other than 0 and 1, and rows without text, teach nothing. Without rows of both labels every text scores the prior.
    """
    marks = labels.where("quality in (0, 1)").select("doc_id", "quality").distinct()
    marks = marks.where(~held_out())
    numbers = {r[0]: r[1] for r in marks.groupBy("quality").count().collect()}
    prior = float(np.log((numbers.get(1, 0) + 1) / (numbers.get(0, 0) + 1)))
    return *train(bounded_sample(docs, marks, "quality", max_rows, max_chars)), prior


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds: int) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    A null text counts as empty; an empty text scores the constant of the model. predicted is 1 from ``threshold`` on.
    Very long texts are scored whole. Repeated rows give repeated rows, an empty table an empty result.
    """
    odds, constant, prior = fit(docs, labels, **bounds)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(odds, constant, prior)
        for texts in batches:
            yield pd.Series(scorer.score(list(texts)))

    scored = docs.select("doc_id", score(whole_text()).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
