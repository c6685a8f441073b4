"""Phrase counts and collocations against plain Python over all positions."""

import collections
import re
import time

import numpy as np
import pytest

from millrace.llm import collocations as collocations_of
from millrace.llm.collocations import Trie, collocations, phrase_counts, split_words

SCHEMA = "lang string, text string"
LOWER = {i: i + 32 for i in range(65, 91)}


def plain_counts(rows, most, least):
    totals, counts = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    return +totals, {p: f for p, f in counts.items() if f >= least}


def plain(rows, most=5, least=100, top=2000):
    totals, f = plain_counts(rows, most, least)
    found = collections.defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        inside = (
            f.get((lang, q)) for (other, q) in f if other == lang and len(q) > len(p)
            if any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        )
        if any(g >= a for g in inside):
            continue
        n = totals[lang]
        score, _, l, r = min((1000 * a * n // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found[lang].append((-score, -a, " ".join(p).encode(), l, r, n))
    out = set()
    for lang, some in found.items():
        for rank, (score, a, phrase, l, r, n) in enumerate(sorted(some)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return out


def as_set(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def made(seed, n, words="a b c d e é ÉA b'c"):
    rng = np.random.default_rng(seed)
    some = words.split() + [".", "\t", "! ", "\r\n"]
    return " ".join(rng.choice(some, n))


@pytest.mark.parametrize("shard_phrases", [500_000, 90])
def test_collocations(spark, shard_phrases):
    """Small shards: every pair of shards is searched for longer phrases, and the result stays whole."""
    rows = [(lang, made(i, 150)) for i, lang in enumerate(["en"] * 6 + ["de"] * 3 + [None, "und"])]
    rows += [("en", None), ("en", ""), (None, " \t "), ("xx", "one word")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows, 3, 4, 60)
    assert len(want) > 100
    assert as_set(collocations(docs, 3, 4, 60, shard_phrases)) == want


def test_counts_of_every_level(spark):
    rows = [("en", made(i, 200, "x y z")) for i in range(4)]
    totals, counts = phrase_counts(spark.createDataFrame(rows, SCHEMA), 5, 3)
    want_totals, want = plain_counts(rows, 5, 3)
    assert {r.lang: r.n for r in totals.collect()} == want_totals
    got = {(r.lang, tuple(r.phrase.split(" "))): r.f for r in counts.collect()}
    assert got == want


def test_overlaps_ties_and_contained_phrases(spark):
    rows = [("en", "a a a a a a. x y z. X Y Z. x y z"), ("en", "a a a a a a. x y z. X Y Z. x y z")]
    got = as_set(collocations(spark.createDataFrame(rows, SCHEMA), 5, 2))
    assert got == plain(rows, 5, 2)
    assert not any(p == "x y" for _, _, p, *_ in got) and any(p == "x y z" for _, _, p, *_ in got)


def test_columns_that_clash(spark):
    rows = [("en", "p q p q", 1, "r", 2, "f")] * 3
    docs = spark.createDataFrame(rows, "lang string, text string, n int, phrase string, f int, rank string")
    assert as_set(collocations(docs, 5, 2)) == plain([r[:2] for r in rows], 5, 2)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert collocations(docs).collect() == []
    assert collocations(spark.createDataFrame([("en", "too few words")], SCHEMA)).collect() == []


def test_products_past_64_bits(spark):
    from millrace.llm.collocations import score_phrases

    a, n = 3_000_000_000_000, 9_000_000_000_000_000
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    counts = [("en", "p", 1, a + 1), ("en", "q", 1, a + 3), ("en", "p q", 2, a)]
    row = score_phrases(totals, spark.createDataFrame(counts, "lang string, phrase string, words int, f long")).first()
    assert row.score == 1000 * a * n // ((a + 1) * (a + 3))


def test_very_long_text_is_split_at_pieces(monkeypatch):
    from millrace.llm import collocations as module

    monkeypatch.setattr(module, "_CHUNK", 50)
    text = ("one two, three " * 100).encode()
    assert [w for part in split_words([text, b"", b"Z"]) for w in part] == (
        [b"one", b"two", b"\xff", b"three"] * 100 + [b"\xff", b"\xff", b"z"]
    )
    assert len(list(split_words([text]))) > 10


def test_trie_finds_every_phrase():
    rng = np.random.default_rng(5)
    for depth in (1, 2, 4):
        phrases = np.unique(rng.integers(1, 40, (3000, depth)), axis=0)
        phrases = phrases[rng.random(len(phrases)) < 0.7]
        text = rng.integers(0, 41, 20_000)
        rows = {tuple(p): i for i, p in enumerate(phrases)}
        want = [(i, rows[tuple(text[i : i + depth])]) for i in range(len(text) - depth + 1) if tuple(text[i : i + depth]) in rows]
        at, row = Trie(phrases).matches(text)
        assert list(zip(at.tolist(), row.tolist())) == want


def test_passes_grow_with_the_shards(spark, monkeypatch):
    """One pass for each shard of a level, and none for pairs of shards."""
    passes, made_pass = [], collocations_of._pass_of_shard
    monkeypatch.setattr(collocations_of, "_pass_of_shard", lambda shared, find_next: passes.append(len(shared.value[0].phrases)) or made_pass(shared, find_next))
    rows = [(lang, made(i, 150)) for i, lang in enumerate(["en"] * 6 + ["de"] * 3)]
    _, counts = phrase_counts(spark.createDataFrame(rows, SCHEMA).repartition(3), 2, 4, 12)
    want = plain_counts(rows, 2, 4)[1]
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in counts.collect()} == want
    by_level = [sum(len(p) == k for _, p in want) for k in (1, 2)]
    assert sum(passes) == sum(by_level) and len(passes) <= sum(-(-n // 12) for n in by_level)


def test_the_filter_holds_all_candidates_and_few_others():
    phrases = [("en", f"w{i} w{i * 7 % 1000}") for i in range(1000)]
    members = collocations_of._Members(len(phrases))
    members.add(phrases[:500])
    members.add(phrases[500:])

    def held(lang, some):
        words = [np.array([collocations_of._hash(p.split(" ")[k].encode()) for p in some], np.uint64) for k in (0, 1)]
        return members.holds(lang, iter(words), len(some))

    assert held("en", [p for _, p in phrases]).all()
    assert held("de", [p for _, p in phrases]).mean() < 0.1 and held("en", [f"w{i} w{i + 1}" for i in range(1, 999)]).mean() < 0.1


def test_large_tries_are_built_in_about_linear_time():
    numbers = np.random.default_rng(5)
    words = np.minimum(numbers.zipf(1.3, (1_000_000, 2)), 30_000)
    phrases = np.unique(words, axis=0)
    start = time.perf_counter()
    trie = Trie(phrases)
    assert time.perf_counter() - start < 20 and len(trie.base) < 20 * len(phrases)
    at, row = trie.matches(np.append(phrases, np.zeros((len(phrases), 1), np.int64), axis=1).ravel())
    assert (at == 3 * np.arange(len(phrases))).all() and (row == np.arange(len(phrases))).all()
