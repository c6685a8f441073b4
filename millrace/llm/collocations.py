"""Collocations: frequent phrases per language, counted level by level with double-array tries.

Level k starts from candidates of k words: phrases whose first and last k - 1 words are candidates too and stand next
to each other in the text often enough (Apriori). A candidate trie goes to all tasks as a double array. A task turns
its texts into word numbers, moves the states of all text positions one word further at a time by array operations,
and counts the accepting states; the counts of all tasks are summed. Neighbouring positions that both accept give the
candidates of the next level.

What is broadcast is bounded: candidates beyond ``SHARD_PHRASES`` or ``SHARD_BYTES`` are cut into shards, each with its
own trie and its own pass over the texts. The phrase at the neighbouring position may lie in another shard; whether it is a
candidate at all is asked of a filter of all shards' candidates, which all tasks get. What the filter lets through wrongly is counted
like the rest, exactly, and is then too rare: if the longer phrase is frequent, both of its parts are.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, UPPER, whole_text, written

MOST_WORDS, LEAST_COUNT, TOP = 5, 100, 2000
SHARD_PHRASES, SHARD_BYTES = 500_000, 32_000_000
UNKNOWN_LANG = "und"
_CHUNK = 4_000_000  # bytes split into words at once, up to the next end of a piece
_FILTER_BITS = 28  # a filter has 2 ** 28 bits (32 MB) at most, 16 or more for each candidate below that
_TOGETHER = 16  # children of nodes that find their place in a trie together
_DRAWN = 4096  # slots tried at least in a round of that
_HELD = 500_000  # distinct words or pairs that a task holds before it passes them on

# 0xFF never occurs in UTF-8: it marks the end of a piece.
_BREAK = b"\xff"
_TABLE = bytes.maketrans((UPPER + "\t" + ".,;:!?\n\x0b\x0c\r").encode(), (LOWER + " ").encode() + _BREAK * 10)


def split_words(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Words of some texts in order, A-Z in lower case, with a mark between any two pieces."""
    data = _BREAK.join(texts).translate(_TABLE)
    start = 0
    while start < len(data):
        stop = data.find(_BREAK, start + _CHUNK)
        stop = len(data) if stop < 0 else stop + 1
        yield data[start:stop].replace(_BREAK, b" \xff ").split()
        start = stop


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """Words of the texts of each language of a batch."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        texts.setdefault(lang, []).append(text)
    for lang, some in texts.items():
        for words in split_words(some):
            yield lang, words


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def passed() -> Iterator[pa.RecordBatch]:
        for lang, counter in held.items():
            counter.pop(_BREAK, None)
            names = pa.array([w.decode() for w in counter], pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counter), pa.string()), names, pa.array(list(counter.values()), pa.int64())],
                names=["lang", "phrase", "f"],
            )
        held.clear()

    for batch in batches:
        for lang, words in _by_lang(batch):
            held.setdefault(lang, Counter()).update(words)
            if sum(map(len, held.values())) > _HELD:
                yield from passed()
    yield from passed()


class Trie:
    """Double-array trie of phrases of equal length, given as rows of word numbers (1 and up), sorted and distinct.

    The child of state s by word x is state base[s] + x, if check of that is s. ``accept`` is the row of a whole phrase.
    """

    def __init__(self, phrases: np.ndarray):
        count, depth = phrases.shape
        parents, labels = [], []  # of the nodes in order of level
        first, above = 1, np.zeros(count, np.int64)  # the root is node 0
        differs = np.zeros(count, bool)
        differs[:1] = True
        for level in range(depth):
            differs[1:] |= phrases[1:, level] != phrases[:-1, level]
            node = first + np.cumsum(differs) - 1
            parents.append(above[differs])
            labels.append(phrases[differs, level])
            first, above = int(node[-1]) + 1, node
        parent, label = np.concatenate(parents), np.concatenate(labels)
        base = self._place(parent, label, first)
        slot = np.zeros(first, np.int64)
        slot[1:] = base[parent] + label
        size = int(slot.max()) + 1
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.accept = np.full(size, -1, np.int32)
        self.base[slot] = base
        self.check[slot[1:]] = slot[parent]
        self.accept[slot[above]] = np.arange(count)
        self.depth = depth

    @staticmethod
    def _place(parent: np.ndarray, label: np.ndarray, nodes: int) -> np.ndarray:
        """A base for every node so that no two nodes share a slot; those with most children first.

        Large nodes are fitted one by one, from a floor that leaves crowded slots behind. Small ones of equal size are
        fitted together: each tries free slots at random, those that meet nobody stay, and where hardly any does the
        array grows. Only children fill the gaps. So the time is about in proportion to the nodes.
        """
        base = np.zeros(nodes, np.int64)
        order = np.lexsort((label, parent))
        parent, label = parent[order], label[order]
        starts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        sizes = np.diff(np.append(starts, len(parent)))
        widest = int(label.max()) + 1
        taken = np.zeros(2 * len(parent) + 2 * widest + 4096, bool)
        taken[0] = True  # the root
        floor = 1
        for i in np.argsort(-sizes, kind="stable"):
            if sizes[i] <= _TOGETHER:
                break
            children = label[starts[i] : starts[i] + sizes[i]]
            steps, at, windows = children - children[0], floor, 0
            while True:
                if at + steps[-1] + 4096 >= len(taken):
                    taken = np.concatenate([taken, np.zeros(len(taken) + int(steps[-1]), bool)])
                free = np.flatnonzero(~taken[at : at + 1024])[:256] + at
                fits = free[~taken[free[:, None] + steps[:8]].any(axis=1)]
                fits = fits[~taken[fits[:, None] + steps].any(axis=1)]
                if len(fits):
                    break
                windows += 1
                at += 1024 if len(free) < 256 else int(free[-1]) + 1 - at
            taken[fits[0] + steps] = True
            base[parent[starts[i]]] = fits[0] - children[0]
            if windows > 4:
                floor = at
        draw, owner = np.random.default_rng(0), np.zeros(len(taken), np.int32)
        for size in range(_TOGETHER, 1, -1):
            left = starts[sizes == size]
            while len(left):
                free = np.flatnonzero(~taken[: len(taken) - widest])
                tries = max(1, _DRAWN // len(left))  # of each node in a round
                number = np.arange(len(left) * tries)
                node = left[number // tries]
                first = draw.choice(free, len(number)) if len(free) else np.zeros(len(number), np.int64)
                children = label[node[:, None] + np.arange(size)]
                slots = first[:, None] + children - children[:, :1]
                alone = np.flatnonzero(~taken[slots].any(axis=1))
                owner[slots[alone]] = number[alone, None]
                alone = alone[(owner[slots[alone]] == number[alone, None]).all(axis=1)]
                fits = alone[np.unique(number[alone] // tries, return_index=True)[1]]
                taken[slots[fits]] = True
                base[parent[node[fits]]] = first[fits] - children[fits, 0]
                if len(fits) < len(number) / 500 and len(fits) < len(left):
                    more = len(taken) // 8 + widest // 4 + 64
                    taken, owner = np.concatenate([taken, np.zeros(more, bool)]), np.concatenate([owner, np.zeros(more, np.int32)])
                left = np.delete(left, number[fits] // tries)
        # An only child fits anywhere.
        single = starts[sizes == 1]
        if len(single):
            free = np.flatnonzero(~taken)
            free = np.concatenate([free, len(taken) + np.arange(max(0, len(single) - len(free)))])[: len(single)]
            base[parent[single]] = free - label[single]
        return base

    def matches(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which a phrase starts, and its row. All positions move on together."""
        size = len(self.base)
        padded = np.concatenate([words, np.zeros(self.depth, words.dtype)])
        at, state = np.arange(len(words)), np.zeros(len(words), np.int64)
        for level in range(self.depth):
            word = padded[at + level]
            to = self.base[state] + word
            known = (word > 0) & (to > 0) & (to < size)
            known[known] = self.check[to[known]] == state[known]
            at, state = at[known], to[known]
        return at, self.accept[state]


class _Shard:
    """Candidates of a shard with their trie: what a pass needs."""

    def __init__(self, own: list[tuple[str, str]]):
        phrases = sorted(set(own))
        words: dict[str, dict[bytes, int]] = {}
        number = 0
        rows = []
        for lang, phrase in phrases:
            known = words.setdefault(lang, {})
            row = []
            for word in phrase.encode().split(b" "):
                if word not in known:
                    number += 1
                    known[word] = number
                row.append(known[word])
            rows.append(row)
        table = np.array(rows, np.int64)
        order = np.lexsort(table.T[::-1])
        self.words, self.phrases = words, [phrases[i] for i in order]
        self.trie = Trie(table[order])


def _hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def _mixed(found: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of sequences that are one word longer."""
    found = (found ^ words) * np.uint64(0x9E3779B97F4A7C15)
    return found ^ (found >> np.uint64(29))


class _Members:
    """A filter of all candidates of a level: two bits of a hash for each. It holds all of them, and some others."""

    def __init__(self, total: int):
        self.width = min(_FILTER_BITS, max(10, (16 * total).bit_length()))
        self.bits = np.zeros(1 << self.width - 3, np.uint8)

    def _slots(self, hashes: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64((1 << self.width) - 1)
        return [((hashes >> np.uint64(shift)) & mask).astype(np.int64) for shift in (0, 32)]

    def add(self, phrases: list[tuple[str, str]]) -> None:
        known: dict[bytes, int] = {}
        rows = [[lang.encode() + _BREAK, *phrase.encode().split(b" ")] for lang, phrase in phrases]
        table = np.array([[known.get(w) or known.setdefault(w, _hash(w)) for w in row] for row in rows], np.uint64)
        found = np.zeros(len(table), np.uint64)
        for column in table.T:
            found = _mixed(found, column)
        for slot in self._slots(found):
            np.bitwise_or.at(self.bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))

    def holds(self, lang: str, sequences: Iterator[np.ndarray], count: int) -> np.ndarray:
        """Of ``count`` sequences, given by the hashes of their first, second, ... words."""
        found = _mixed(np.zeros(count, np.uint64), np.uint64(_hash(lang.encode() + _BREAK)))
        for words in sequences:
            found = _mixed(found, words)
        one, two = ((self.bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 for slot in self._slots(found))
        return (one & two).astype(bool)


class _Pairs:
    """Counts of pairs of numbers, the second below ``base``; few enough are held at once."""

    def __init__(self, base: int):
        self.base = base
        self.pairs, self.counts, self.waiting, self.n_waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether so many are held that they should be passed on."""
        self.waiting.append(a.astype(np.int64) * self.base + b)
        self.n_waiting += len(a)
        if self.n_waiting > 4 * _HELD:
            self._merge()
        return len(self.pairs) > 4 * _HELD

    def _merge(self) -> None:
        new, each = np.unique(np.concatenate(self.waiting), return_counts=True)
        distinct, where = np.unique(np.concatenate([self.pairs, new]), return_inverse=True)
        self.counts = np.bincount(where, np.concatenate([self.counts, each]), len(distinct)).astype(np.int64)
        self.pairs, self.waiting, self.n_waiting = distinct, [], 0

    def taken(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and second numbers and counts of all pairs, which are held no longer."""
        if self.waiting:
            self._merge()
        a, b, n = self.pairs // self.base, self.pairs % self.base, self.counts
        self.pairs, self.counts = self.pairs[:0], self.counts[:0]
        return a, b, n


def _rows(a: np.ndarray, b: pa.Array | None, n: np.ndarray, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(a), 100_000):
        part = slice(i, i + 100_000)
        second = pa.nulls(len(a[part]), kind) if b is None else b[part]
        yield pa.RecordBatch.from_arrays([pa.array(a[part].astype(np.int32)), second, pa.array(n[part])], names=["a", "b", "f"])


def _pass(shared, find_next: bool):
    """One pass over the texts with all candidates: (a, null, count) of each phrase and (a, b, count) of neighbouring ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: _Shard = shared.value
        total = len(shard.phrases)
        counts, pairs = np.zeros(total, np.int64), _Pairs(total)

        def passed() -> Iterator[pa.RecordBatch]:
            a, b, n = pairs.taken()
            yield from _rows(a, pa.array(b.astype(np.int32)), n, pa.int32())

        for batch in batches:
            for lang, words in _by_lang(batch):
                known = shard.words.get(lang)
                if known is None:
                    continue
                numbers = np.fromiter((known.get(w, 0) for w in words), np.int64, len(words))
                at, phrase = shard.trie.matches(numbers)
                counts += np.bincount(phrase, minlength=total)
                if find_next and len(at) > 1:
                    near = np.diff(at) == 1
                    if pairs.add(phrase[:-1][near], phrase[1:][near]):
                        yield from passed()
        yield from passed()
        some = np.flatnonzero(counts)
        yield from _rows(some, None, counts[some], pa.int32())

    return run


def _pass_of_shard(shared, find_next: bool):
    """One pass over the texts with one shard of the candidates: (a, null, count) of each phrase, and (a, next word, count)
    where the words from the second one on are held by the filter of all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, members = shared.value
        total, depth = len(shard.phrases), shard.trie.depth
        counts, pairs = np.zeros(total, np.int64), _Pairs(1 << 31)
        hashes: dict[bytes, int] = {}
        nexts: dict[bytes, int] = {}  # words that follow a phrase

        def hashed(word: bytes) -> int:
            return hashes.get(word) or hashes.setdefault(word, _hash(word))

        def passed() -> Iterator[pa.RecordBatch]:
            a, b, n = pairs.taken()
            names = pa.array([w.decode() for w in nexts], pa.string())
            nexts.clear()
            yield from _rows(a, names.take(pa.array(b, pa.int64())), n, pa.string())

        for batch in batches:
            for lang, words in _by_lang(batch):
                known = shard.words.get(lang)
                if known is None:
                    continue
                distinct = list(dict.fromkeys(words))
                place = dict(zip(distinct, range(len(distinct))))
                places = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                numbers = np.fromiter((known.get(w, 0) for w in distinct), np.int64, len(distinct))
                at, phrase = shard.trie.matches(numbers[places])
                counts += np.bincount(phrase, minlength=total)
                if not find_next:
                    continue
                inside = at + depth < len(places)
                at, phrase = at[inside], phrase[inside]
                whole = places[at + depth] != place.get(_BREAK, -1)
                at, phrase = at[whole], phrase[whole]
                if len(hashes) > _HELD:
                    hashes.clear()
                by_place = np.fromiter(map(hashed, distinct), np.uint64, len(distinct))
                near = members.holds(lang, (by_place[places[at + k]] for k in range(1, depth + 1)), len(at))
                last, which = np.unique(places[at[near] + depth], return_inverse=True)
                numbered = np.fromiter((nexts.setdefault(distinct[i], len(nexts)) for i in last), np.int64, len(last))
                if pairs.add(phrase[near], numbered[which]) or len(nexts) > _HELD:
                    yield from passed()
        yield from passed()
        some = np.flatnonzero(counts)
        yield from _rows(some, None, counts[some], pa.string())

    return run


def _named(shared, sharded: bool):
    """Numbers of phrases back to words; a pair becomes the phrase one word longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = (shared.value[0] if sharded else shared.value).phrases
        for batch in batches:
            langs, names = [], []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                lang, phrase = phrases[a]
                langs.append(lang)
                names.append(phrase if b is None else f"{phrase} {b if sharded else phrases[b][1].rsplit(' ', 1)[-1]}")
            arrays = [pa.array(langs, pa.string()), pa.array(names, pa.string()), batch.column("f")]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column("b").is_valid()], names=["lang", "phrase", "f", "longer"])

    return run


def _level(texts: DataFrame, candidates: DataFrame, find_next: bool, least: int, shard_phrases: int) -> DataFrame | None:
    """lang, phrase, f and longer: exact counts of the candidates (lang, phrase), and candidates one word longer."""
    spark = texts.sparkSession
    size = candidates.agg(F.count(F.lit(1)), F.sum(F.octet_length("phrase"))).first()
    if not size[0]:
        return None
    shards = max(math.ceil(size[0] / shard_phrases), math.ceil(size[1] / SHARD_BYTES))
    marked = candidates.withColumn("_s", F.pmod(F.xxhash64("lang", "phrase"), F.lit(shards)))

    def members(number: int) -> list[tuple[str, str]]:
        return [(r[0], r[1]) for r in marked.where(F.col("_s") == number).select("lang", "phrase").collect()]

    everyone = _Members(size[0] if shards > 1 else 0)
    if shards > 1 and find_next:
        for i in range(shards):
            if own := members(i):
                everyone.add(own)
    found = None
    for i in range(shards):
        own = members(i)
        if not own:
            continue
        one = shards == 1
        shared = spark.sparkContext.broadcast(_Shard(own) if one else (_Shard(own), everyone))
        run, second = (_pass, "int") if one else (_pass_of_shard, "string")
        part = texts.mapInArrow(run(shared, find_next), f"a int, b {second}, f long")
        part = part.groupBy("a", "b").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        part = written(part.mapInArrow(_named(shared, not one), "lang string, phrase string, f long, longer boolean"), "phrases")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    return found


def phrase_counts(
    docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, shard_phrases: int = SHARD_PHRASES
) -> tuple[DataFrame, DataFrame]:
    """(lang, n): all word occurrences of each language, and (lang, phrase, words, f): every phrase of at most
    ``most_words`` words and at least ``least`` occurrences."""
    lang, text = F.coalesce("lang", F.lit(UNKNOWN_LANG)).alias("lang"), whole_text().cast("binary").alias("text")
    texts = docs.select(lang, text)
    words = texts.mapInArrow(_count_words, "lang string, phrase string, f long")
    words = written(words.groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    candidates, counts = words.where(F.col("f") >= least), None
    for size in range(1, most_words + 1):
        level = _level(texts, candidates, size < most_words, least, shard_phrases)
        if level is None:
            break
        now = level.where(~F.col("longer")).select("lang", "phrase", F.lit(size).alias("words"), "f")
        counts = now if counts is None else counts.unionByName(now)
        candidates = level.where("longer")
    if counts is None:
        counts = words.where("false").select("lang", "phrase", F.lit(1).alias("words"), "f")
    return totals, counts


def score_phrases(totals: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n and score of every phrase of two words or more, by its lowest-scoring cut.

    Products are decimals of 38 digits: exact as long as 1000 * a * n has no more.
    """
    parts = counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("f_part"))
    whole = counts.where(F.col("words") > 1).withColumnRenamed("f", "a")
    cuts = whole.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    split = F.split("phrase", " ")
    cuts = cuts.withColumn("first", F.array_join(F.slice(split, 1, F.col("cut")), " "))
    cuts = cuts.withColumn("rest", F.array_join(F.slice(split, F.col("cut") + 1, F.col("words")), " "))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("first"), F.col("f_part").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("rest"), F.col("f_part").alias("r")), ["lang", "rest"])
    cuts = cuts.join(F.broadcast(totals), "lang")  # one row for each language
    big = {c: F.col(c).cast("decimal(19,0)") for c in "alrn"}
    top = F.lit(1000).cast("decimal(4,0)") * (big["a"] * big["n"])
    cuts = cuts.withColumn("_top", top).withColumn("_below", big["l"] * big["r"])
    cuts = cuts.withColumn("score", F.expr("_top div _below"))
    least = F.min(F.struct("score", "cut", "l", "r")).alias("least")
    lowest = cuts.groupBy("lang", "phrase", "words", "a", "n").agg(least)
    return lowest.select("lang", "phrase", "words", "a", "least.l", "least.r", "n", "least.score")


def maximal(scored: DataFrame) -> DataFrame:
    """Without phrases that lie inside a longer one of the same count.

    Counts never rise from a phrase to a longer one, so if any longer one has the same count, one that is a single word
    longer has it too.
    """
    words = F.split("phrase", " ")
    ends = F.array(*(F.array_join(F.slice(words, start, F.col("words") - 1), " ") for start in (1, 2)))
    inside = scored.where(F.col("words") > 2).select("lang", F.explode(ends).alias("phrase"), "a")
    return scored.join(inside, ["lang", "phrase", "a"], "left_anti")


def collocations(
    docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, top: int = TOP, shard_phrases: int = SHARD_PHRASES
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` phrases of each language of ``docs`` (lang, text).

    A null lang counts as ``und``, a null text as empty; an empty table gives no rows. Repeated rows count each time,
    ties are settled by count and then by the phrase's bytes, and other columns play no part.
    """
    totals, counts = phrase_counts(docs, most_words, least, shard_phrases)
    left = maximal(written(score_phrases(totals, counts), "scored"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
