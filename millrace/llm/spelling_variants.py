"""Spelling variants: words one inserted, deleted or replaced code point apart, found in FM-indexes of the vocabulary.

A word is cut into two halves. Of two words that differ by one error, the half without the error stands unchanged at
the same end of both, so the search matches either half exactly and goes on across the other half with one error
allowed. Both directions are used: one index holds the words as written and is searched from their ends, the other
holds them reversed and is searched from their starts. As whole words are sought, each search starts at a delimiter
and keeps its direction; a state is an interval of suffix ranks and an error count.

The vocabulary grows with the corpus, so no index holds all of it. Words that can match share the exact half, which
is the key they are spread by: keys are hashed into shards of about ``SHARD_CHARS`` characters, and a key with more
is cut into blocks, each searched for every block of the words that ask for it. No word is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, whole_text, written

SHARD_CHARS = 1_000_000  # characters of an index, delimiters included
TYPO_PERIOD = 97
_END, _MARK = 0, 1  # codes of the end of an index and of the delimiter; letters follow
_BITS = 7  # a-z, U+00C0 to U+00FF and both marks are fewer than 128
_SMALL = 24  # intervals up to this size are read out, larger ones are asked for every letter
_CELLS = 2_000_000  # cells of the arrays that one step may hold

_FOUND = "word string, n long, n_near long, best_n long, best string"


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, period: int = TYPO_PERIOD) -> DataFrame:
    """word and n of every word with enough code points and occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. Where ``period`` divides the CRC-32
    of ``<doc_id>:<run>``, the code point at that number modulo the run's length is left out. A null text has no runs;
    a null doc_id counts as empty. Repeated rows count each time.
    """
    runs = F.explode(F.split(ascii_lower(whole_text()), "[^a-zÀ-ÿ]+"))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), runs.alias("_run"))
    found = found.where(F.length("_run") >= least_length)
    found = found.withColumn("_h", F.crc32(F.concat_ws(":", "_id", "_run").cast("binary")))
    at = (F.col("_h") % F.length("_run")).cast("int")
    cut = F.concat(F.substr("_run", F.lit(1), at), F.substr("_run", at + 2))
    words = found.select(F.when(F.col("_h") % period == 0, cut).otherwise(F.col("_run")).alias("word"))
    counted = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


class Index:
    """FM-index of distinct words: ranks of all suffixes of ``|w1|w2|...|``."""

    def __init__(self, words: list[str]):
        points = np.frombuffer(("|" + "|".join(words) + "|").encode("utf-32-le"), np.uint32)
        letters = np.unique(points)
        self.letters = letters[letters != ord("|")]
        codes = np.searchsorted(self.letters, points).astype(np.int64) + _MARK + 1
        codes[points == ord("|")] = _MARK
        text = np.append(codes, _END)
        self.size, self.sigma = len(text), len(self.letters) + _MARK + 1
        order = self._suffixes(text)
        self.before = text[order - 1]  # the character before each suffix, by rank
        by_letter = np.argsort(self.before, kind="stable")
        self.steps = self.before[by_letter] * self.size + by_letter
        marks = np.flatnonzero(text == _MARK)
        self.first_mark = 1
        self.word_of = np.searchsorted(marks, order[1 : 1 + len(marks)])

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Positions in the order of their suffixes; ranks by the first characters are doubled until all differ."""
        width = 63 // _BITS
        key = np.zeros(len(text), np.int64)
        padded = np.concatenate([text, np.zeros(width, np.int64)])
        for i in range(width):
            key = (key << _BITS) | padded[i : i + len(text)]
        while True:
            order = np.argsort(key, kind="stable")
            ranks = np.empty(len(text), np.int64)
            ranks[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
            if ranks[order[-1]] == len(text) - 1:
                return order
            later = np.zeros(len(text), np.int64)
            later[: len(text) - width] = ranks[width:] + 1 if width < len(text) else 0
            key, width = ranks * (len(text) + 1) + later, width * 2

    def extend(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of ``letter`` followed by what [low, high) stands for."""
        start = letter * self.size
        return np.searchsorted(self.steps, start + low), np.searchsorted(self.steps, start + high)

    def encode(self, word: str) -> np.ndarray:
        """Codes from the last character to the first, then the delimiter; characters of no word get a code past all."""
        points = np.frombuffer(word[::-1].encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.letters, points)
        known = self.letters[np.minimum(at, len(self.letters) - 1)] == points
        return np.append(np.where(known, at + _MARK + 1, self.sigma), _MARK)

    def others(self, low: np.ndarray, high: np.ndarray, not_this: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State number and letter of every letter but ``not_this`` that stands before an interval's suffixes."""
        size = high - low
        small = np.flatnonzero(size <= _SMALL)
        sizes = size[small]
        state = np.repeat(small, sizes)
        at = np.arange(len(state)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[state]
        codes = np.unique(state * self.sigma + self.before[at])
        large = np.flatnonzero(size > _SMALL)
        every = (large[:, None] * self.sigma + np.arange(_MARK + 1, self.sigma)).ravel()
        codes = np.concatenate([codes, every])
        state, letter = codes // self.sigma, codes % self.sigma
        keep = (letter > _MARK) & (letter != not_this[state])
        return state[keep], letter[keep]


def near_words(index: Index, words: list[str], exact: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and numbers of indexed words one error away, the error before the last ``exact[i]`` characters."""
    asked, found = [], []
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop + 1 - start) * (len(words[order[stop]]) + 1) <= _CELLS // index.sigma:
            stop += 1
        some = order[start:stop]
        for a, b in _search(index, [words[i] for i in some], np.array([exact[i] for i in some])):
            asked.append(np.asarray(some)[a])
            found.append(b)
        start = stop
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *asked]), np.concatenate([none, *found])


def _search(index: Index, words: list[str], exact: np.ndarray):
    """Pairs found by all ``words`` at once, one character a step. Every word has one state without error."""
    length = np.array([len(w) for w in words])
    pattern = np.full((len(words), length.max() + 2), _MARK, np.int64)
    for i, word in enumerate(words):
        pattern[i, : len(word) + 1] = index.encode(word)
    marks = len(index.word_of)
    q = np.arange(len(words))
    low, high = np.full(len(q), index.first_mark), np.full(len(q), index.first_mark + marks)
    none = np.zeros(0, np.int64)
    w_q, w_at, w_low, w_high = none, none, none, none  # states after the error: word, next position, interval
    for j in range(int(length.max()) + 2):
        if not len(q) and not len(w_q):
            return
        new = []
        if len(q):
            letter = pattern[q, j]
            next_low, next_high = index.extend(letter, low, high)
            open_ = j >= exact[q]
            branch = np.flatnonzero(open_ & (next_high - next_low < high - low))
            if len(branch):
                state, other = index.others(low[branch], high[branch], letter[branch])
                state = branch[state]
                a, b = index.extend(other, low[state], high[state])
                some = b > a
                state, a, b = state[some], a[some], b[some]
                inside = j < length[q[state]]
                new.append((q[state], np.full(len(state), j), a, b))  # the other word has one more
                new.append((q[state][inside], np.full(inside.sum(), j + 1), a[inside], b[inside]))  # it has another
            less = np.flatnonzero(open_ & (j < length[q]))
            less = less[pattern[q[less], j] != pattern[q[less], j + 1]]  # of equal neighbours only the last is left out
            new.append((q[less], np.full(len(less), j + 1), low[less], high[less]))
            on = (next_high > next_low) & (j < length[q])
            q, low, high = q[on], next_low[on], next_high[on]
        if new:
            w_q, w_at, w_low, w_high = (np.concatenate([now, *more]) for now, *more in zip((w_q, w_at, w_low, w_high), *new))
        if not len(w_q):
            continue
        # All states take their next character, those that lag behind by an insertion included.
        while True:
            a, b = index.extend(pattern[w_q, w_at], w_low, w_high)
            some = b > a
            w_q, w_at, w_low, w_high = w_q[some], w_at[some], a[some], b[some]
            done = w_at == length[w_q]
            if done.any():
                yield w_q[done], index.word_of[w_low[done] - index.first_mark]
            w_q, w_at, w_low, w_high = w_q[~done], w_at[~done] + 1, w_low[~done], w_high[~done]
            if len(q) or not len(w_q):
                break


def _match_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """The near words of one shard's words, as a count and the best of them for each word that asks."""
    found = {name: [] for name in ("word", "n", "n_near", "best_n", "best")}
    for forward, part in rows.groupby("forward"):
        targets, asking = part[part["target"]].drop_duplicates("word"), part[part["asks"]]
        if not len(targets) or not len(asking):
            continue
        known, words = targets["word"].tolist(), asking["word"].tolist()
        index = Index(known if forward else [w[::-1] for w in known])
        # The second half may be the longer one.
        exact = [len(w) - len(w) // 2 if forward else len(w) // 2 for w in words]
        a, b = near_words(index, words if forward else [w[::-1] for w in words], exact)
        pairs = zip(a.tolist(), b.tolist())
        if forward:  # the other direction has found those with an equal first half
            pairs = [(i, j) for i, j in pairs if not known[j].startswith(words[i][: len(words[i]) // 2])]
        count, best = [0] * len(words), [None] * len(words)
        numbers = targets["n"].tolist()
        for i, j in pairs:
            count[i] += 1
            mark = (-numbers[j], known[j])
            if best[i] is None or mark < best[i]:
                best[i] = mark
        found["word"] += words
        found["n"] += asking["n"].tolist()
        found["n_near"] += count
        found["best_n"] += [None if m is None else -m[0] for m in best]
        found["best"] += [None if m is None else m[1] for m in best]
    return pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in found.items()})


def _spread(words: DataFrame, shard_chars: int) -> tuple[DataFrame, int]:
    """Rows of every shard, and the number of shards for small keys: words to be found (``target``) and words that ask (``asks``), with their direction.

    A word of m code points can be found by words of m - 1 to m + 1, so it stands under the halves of these lengths.
    """
    size = F.length("word")
    rows = None
    for forward in (False, True):
        # Length of the unchanged half of a word of x code points: the first x // 2, or all that follows them.
        half = (lambda x: x - F.floor(x / 2)) if forward else (lambda x: F.floor(x / 2))
        lengths = F.explode(F.array_distinct(F.array(*(half(size + d).cast("int") for d in (-1, 0, 1)))))
        some = words.select("word", "n", lengths.alias("_len"))
        key = F.right("word", F.col("_len")) if forward else F.left("word", F.col("_len"))
        asks = F.col("_len") == half(size).cast("int")
        some = some.select(F.lit(forward).alias("forward"), key.alias("key"), "word", "n", asks.alias("asks"))
        rows = some if rows is None else rows.unionByName(some)
    rows = written(rows, "halves")
    weights = rows.groupBy("forward", "key").agg(F.sum(F.length("word") + 1).alias("chars"))
    total = weights.agg(F.sum("chars")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_chars))
    sized = rows.join(weights.where(F.col("chars") > shard_chars), ["forward", "key"], "left")
    blocks = F.coalesce(F.ceil(F.col("chars") / shard_chars), F.lit(1)).cast("int")
    sized = sized.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("word", F.lit(1)), "_blocks"))
    # A word is found in its own block by the askers of every block, and asks in every block from its own.
    every, own = F.sequence(F.lit(0), F.col("_blocks") - 1), F.col("_own").cast("int")

    def cell(t: Column, a: Column, target: Column, asks: Column) -> Column:
        return F.struct(t.alias("t"), a.alias("a"), target.alias("target"), asks.alias("asks"))

    yes, no = F.lit(True), F.lit(False)
    cells = F.concat(
        F.transform(every, lambda x: cell(own, x, yes, no)),
        F.transform(F.filter(every, lambda x: F.col("asks")), lambda x: cell(x, own, no, yes)),
    )
    laid = sized.select("forward", "key", "word", "n", "_blocks", F.explode(cells).alias("c"))
    # Keys of one block share shards; each pair of blocks of a larger key is a shard of its own.
    small = F.pmod(F.xxhash64("forward", "key"), F.lit(shards)).cast("string")
    pair = F.concat_ws("/", F.col("forward").cast("string"), "key", F.col("c.t"), F.col("c.a"))
    shard = F.when(F.col("_blocks") == 1, small).otherwise(pair)
    return laid.select(shard.alias("shard"), "forward", "word", "n", "c.target", "c.asks"), shards


def variants(words: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """word, n, n_near, form and form_n of each of ``words`` (word, n; each word once).

    ``form`` is the near word of largest n (ties: smallest in code-point order) if that is at least twice the word's.
    """
    rows, shards = _spread(words, shard_chars)
    found = rows.repartition(shards, "shard").groupBy("shard").applyInPandas(_match_shard, _FOUND)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best")))
    summed = found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    taken = -F.col("b.less") >= 2 * F.col("n")
    return summed.select(
        "word", "n", "n_near", F.when(taken, F.col("b.best")).alias("form"), F.when(taken, -F.col("b.less")).alias("form_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """word and root of every word that has a form: the last of the forms, found by doubling the steps taken.

    Counts at least double from word to form, so there are no cycles and few rounds.
    """
    now = written(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(further, "root", "left")
        now = written(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def group_variants(docs: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of ``docs`` (doc_id, text; other columns play no part).

    An empty table, null and empty texts give no words. Very long words are searched like any other.
    """
    forms = written(variants(written(vocabulary(docs), "words"), shard_chars), "forms")
    rooted = forms.join(roots(forms), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
