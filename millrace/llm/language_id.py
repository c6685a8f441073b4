"""Language identification by unigram pieces, summed over all segmentations.

The vocabulary is that of a public tokenizer, given by its path. Each language has a probability for every piece. The
probability of a word is the sum over all ways to cut it into pieces, found by the forward algorithm; a text scores the
product over its words. Piece probabilities come from expectation maximisation with the same sums on a bounded sample.

A word starts with the tokenizer's space mark, letters are lower-cased first, and a word of over ``MAX_WORD`` characters
is cut into parts of that length. Distinct words are scored once per worker and kept in a bounded store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_sample, held_out
from millrace.llm.words import WordStore, groups, releasing, sums

MAX_WORD = 48
STORE, PREDICTION_STORE = 200_000, 400_000  # words that a task remembers, where memory is short and where it is not
CHARS = 500_000  # of texts whose words are looked up at once, unless one text alone is longer
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = "▁"
_UNKNOWN_CHAR = 1e-7  # share of mass a language gives to characters outside the vocabulary, before training


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Lattice:
    """Finds the pieces in words of equal length, all words at once."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.unknown = self.size  # any character that is no piece
        lengths: dict[int, list[int]] = {}
        for number, piece in enumerate(pieces):
            lengths.setdefault(len(piece), []).append(number)
        self.tables = {}
        for length, found in lengths.items():
            marks = self._prefixes(np.array([list(map(ord, pieces[i])) for i in found], np.uint64))[:, -1]
            order = np.argsort(marks)
            self.tables[length] = marks[order], np.array(found, np.int64)[order]
        self.longest = max(lengths, default=1)
        self.powers = np.ones(MAX_WORD + 2, np.uint64)
        for i in range(1, len(self.powers)):
            self.powers[i : i + 1] = self.powers[i - 1 : i] * _BASE

    @staticmethod
    def _prefixes(codes: np.ndarray) -> np.ndarray:
        """Polynomial hashes of all prefixes, modulo 2**64."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for i in range(codes.shape[1]):
            out[:, i + 1] = out[:, i] * _BASE + codes[:, i] + np.uint64(1)
        return out

    def arcs(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, words that have a piece there, the pieces), ends in ascending order.

        ``words`` must be sorted, longest first.
        """
        sizes = np.array([len(w) for w in words])
        codes = np.zeros((len(words), sizes[0]), np.uint64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes[np.arange(sizes[0]) < sizes[:, None]] = flat
        prefix = self._prefixes(codes)
        for end in range(1, sizes[0] + 1):
            active = int(np.searchsorted(-sizes, -end, side="right"))
            tail = np.ascontiguousarray(prefix[:active, end])
            for length in range(1, min(end, self.longest) + 1):
                hashes, numbers = self.tables.get(length, (None, None))
                if length == 1:
                    ids = np.full(active, self.unknown)
                elif hashes is None:
                    continue
                if hashes is not None:
                    marks = tail - prefix[:active, end - length] * self.powers[length]
                    at = np.searchsorted(hashes, marks)
                    at[at == len(hashes)] = 0
                    hit = np.nonzero(hashes[at] == marks)[0]
                    if length == 1:
                        ids[hit] = numbers[at[hit]]
                if length == 1:
                    yield end - 1, end, np.arange(active), ids
                elif len(hit):
                    yield end - length, end, hit, numbers[at[hit]]

    def log_forward(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """log of the summed probability of each word in each language."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        ranked = [words[i] for i in order]
        sizes = np.array([len(w) for w in ranked])
        alpha = np.zeros((sizes[0] + 1, len(words), p.shape[1]))
        alpha[0] = 1
        logs = np.zeros((len(words), p.shape[1]))
        scaled = 0
        for start, end, at, ids in self.arcs(ranked):
            if end > scaled + 8:  # far from underflow: the newest complete value becomes 1
                scaled = end - 1
                active = int(np.searchsorted(-sizes, -end, side="right"))
                by = alpha[scaled, :active].copy()
                logs[:active] += np.log(by)
                alpha[max(0, scaled - self.longest) : scaled + 1, :active] /= by
            alpha[end, at] += alpha[start, at] * p[ids]
        out = np.empty_like(logs)
        out[order] = logs + np.log(alpha[sizes, np.arange(len(words))])
        return out

    def expected(self, words: list[str], weights: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected piece counts by language; ``weights``: how often each word occurs in each language.

        ``words`` must be sorted, longest first, and short enough not to underflow.
        """
        sizes = np.array([len(w) for w in words])
        arcs = list(self.arcs(words))
        alpha = np.zeros((sizes[0] + 1, len(words), p.shape[1]))
        alpha[0] = 1
        for start, end, at, ids in arcs:
            alpha[end, at] += alpha[start, at] * p[ids]
        beta = np.zeros_like(alpha)
        beta[sizes, np.arange(len(words))] = 1
        counts = np.zeros_like(p)
        share = weights / np.maximum(alpha[sizes, np.arange(len(words))], 1e-300)
        for start, end, at, ids in reversed(arcs):
            part = p[ids] * beta[end, at]
            beta[start, at] += part
            part = part * alpha[start, at] * share[at]
            for k in range(p.shape[1]):
                counts[:, k] += np.bincount(ids, part[:, k], len(p))
        return counts


def words_of(text: str) -> list[str]:
    """The words as the model sees them."""
    return text.lower().split()


def parts_of(word: str) -> list[str]:
    """The word with its space mark, in parts of ``MAX_WORD`` characters if it is longer."""
    word = _SPACE + word
    return [word[i : i + MAX_WORD] for i in range(0, len(word), MAX_WORD)]


def train(sample: list[tuple[str, str]], pieces: list[str], rounds: int = 3, prior: float = 0.02) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities: (pieces + unknown) x languages."""
    langs = sorted({lang for _, lang in sample})
    lattice = Lattice(pieces)
    seen: dict[str, np.ndarray] = {}
    for text, lang in sample:
        k = langs.index(lang)
        for word in (part for w in words_of(text) for part in parts_of(w)):
            if word not in seen:
                seen[word] = np.zeros(len(langs))
            seen[word][k] += 1
    p = np.full((lattice.size + 1, len(langs)), 1 / max(1, lattice.size))
    p[lattice.unknown] = _UNKNOWN_CHAR
    words = sorted(seen, key=lambda w: (-len(w), w))
    for _ in range(rounds if words else 0):
        counts = np.full_like(p, prior)
        for start in range(0, len(words), 10_000):
            part = words[start : start + 10_000]
            counts += lattice.expected(part, np.array([seen[w] for w in part]), p)
        p = counts / counts.sum(axis=0)
        p[lattice.unknown] = np.maximum(p[lattice.unknown] / 1000, 1e-12)  # spread over the many unseen characters
    return langs, p


class Scorer:
    """Scores texts; remembers words, ``store`` at most."""

    def __init__(self, pieces: list[str], langs: list[str], p: np.ndarray, store: int = STORE):
        lattice = Lattice(pieces)
        self.langs, self.store = langs, WordStore(lambda words: self._logs(lattice, words, p), store)

    @staticmethod
    def _logs(lattice: Lattice, words: list[str], p: np.ndarray) -> np.ndarray:
        cut = [parts_of(w) for w in words]
        parts = [x for each in cut for x in each]
        logs = [lattice.log_forward(parts[i : i + 10_000], p) for i in range(0, len(parts), 10_000)]
        return sums(np.concatenate(logs), list(map(len, cut)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and probability of each text."""
        langs, shares = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return langs, shares
        known = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
        whole = [texts[i] for i in known]
        for start, end in groups(whole, CHARS):
            words = [words_of(t) for t in whole[start:end]]
            logs = sums(self.store.rows([w for each in words for w in each]), list(map(len, words)))
            best = logs.argmax(axis=1)
            share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            for i, k, x in zip(known[start:end], best, share, strict=True):
                langs[i], shares[i] = self.langs[k], x
        return langs, shares


def identify(docs: DataFrame, pieces: list[str], langs: list[str], p: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text; nothing else is read).

    ``und`` with score 0 where the text is null or has no letter, or where no language was learned. Equally likely
    languages: the first by name. Repeated rows give repeated rows, an empty table an empty result.
    """
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(pieces, langs, p, PREDICTION_STORE)
        for batch in batches:
            found, shares = scorer.predict([t if isinstance(t, str) else None for t in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": found, "score": shares})

    return docs.select("doc_id", "text").mapInPandas(releasing(score), f"doc_id {doc_type}, lang_pred string, score double")


def fit(docs: DataFrame, vocabulary: str, max_rows: int = 300, max_chars: int = 400_000) -> tuple[list[str], list[str], np.ndarray]:
    """Pieces, languages and probabilities, learned from rows that are not held out and have text and lang.

    Of each language at most ``max_rows`` rows and ``max_chars`` characters are used, chosen by a hash of the id
    (``bounded_sample``).
    """
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    pieces = read_pieces(vocabulary)
    return pieces, *train(bounded_sample(docs, known, "lang", max_rows, max_chars), pieces)


def predict_languages(docs: DataFrame, vocabulary: str, **bounds: int) -> DataFrame:
    """doc_id, held_out, lang_pred and score: ``fit`` on ``docs``, then ``identify`` every row."""
    pieces, langs, p = fit(docs, vocabulary, **bounds)
    out = identify(docs, pieces, langs, p)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, vocabulary: str, wanted: list[str] | None = None, **bounds: int) -> DataFrame:
    """``docs``, all its columns, without rows whose language is ``und`` or not in ``wanted`` (None: any learned one).

    Null texts and texts without a letter are ``und`` and go. Where no row has both text and lang nothing is learned, so
    every row goes. Repeated rows share their fate; very long texts are scored whole; an empty table stays empty.
    """
    pieces, langs, p = fit(docs, vocabulary, **bounds)
    wanted = langs if wanted is None else wanted

    @F.pandas_udf("boolean")
    @releasing
    def accepted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(pieces, langs, p)
        for texts in batches:
            found, _ = scorer.predict([t if isinstance(t, str) else None for t in texts])
            yield pd.Series([lang in wanted for lang in found], dtype=bool)

    return docs.where(accepted("text"))
