"""Near words and forms against all pairs of a plain Python vocabulary."""

import collections
import re
import zlib

import numpy as np
import pytest

from millrace.llm.spelling_variants import Index, group_variants, near_words, roots, variants, vocabulary

SCHEMA = "doc_id long, text string"


def one_error(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return len(long_) - len(short) == 1 and any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def plain_words(rows):
    found = collections.Counter()
    lower = {i: i + 32 for i in range(65, 91)}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def plain(counts):
    by_part = collections.defaultdict(set)
    for w in counts:
        for part in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by_part[part].add(w)
    near = {w: set() for w in counts}
    for some in by_part.values():
        for a in some:
            near[a] |= {b for b in some if one_error(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts.get(form[w]))
    return out


def as_dict(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("shard_chars", [1_000_000, 200])
def test_whole_documents(spark, shard_chars):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = plain(plain_words([tuple(r) for r in docs.collect()]))
    assert as_dict(group_variants(docs, shard_chars)) == want
    assert any(form for form, *_ in want.values())


def test_index_finds_all_one_error_words():
    rng = np.random.default_rng(1)
    words = sorted({"".join(rng.choice(list("abé"), rng.integers(1, 9))) for _ in range(700)})
    index = Index(words)
    exact = [len(w) - len(w) // 2 for w in words]
    asked, found = near_words(index, words, exact)
    pairs = list(zip(asked.tolist(), found.tolist()))
    assert len(set(pairs)) == len(pairs)
    want = set()
    for i, w in enumerate(words):
        keep = w[len(w) // 2 :]
        want |= {(i, j) for j, o in enumerate(words) if o.endswith(keep) and one_error(w, o)}
    assert set(pairs) == want


def test_unknown_letters_find_nothing():
    index = Index(["abcde", "abcdf"])
    asked, found = near_words(index, ["zzzzz", "abcdé"], [3, 3])
    assert len(asked) == len(found) == 0


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [
        (1, "color colour Colour COLOUR colour colour colour color color", "x", 7),
        (1, "colon colon colon colon colon colon", "x", 7),
        (1, "colon colon colon colon colon colon", "x", 7),
        (None, "naïve naïve naïve naive naive naive naive naive naive", None, None),
        (2, None, None, None),
        (3, "", None, None),
        (4, "über × ÷ 12345 --- _ a", None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    assert as_dict(group_variants(docs)) == plain(plain_words([r[:2] for r in rows]))


def test_very_long_words(spark):
    long_ = "ab" * 3000
    rows = [(i, f"{long_} {long_}c {long_[:2999]}x{long_[3000:]}") for i in range(3)] + [(9, f"{long_}c {long_}c {long_}c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert as_dict(group_variants(docs)) == plain(plain_words(rows))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert group_variants(docs).collect() == []
    assert vocabulary(docs).collect() == []


def test_hot_half_in_blocks(spark):
    """All words share their first half, so their key is cut into many blocks."""
    rng = np.random.default_rng(2)
    counts = {"prefixes" + "".join(rng.choice(list("abc"), 5)): int(n) for n in rng.integers(3, 99, 400)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n_near, r.form, r.form_n) for r in variants(words, 300).collect()}
    assert got == {w: (near, form, form_n) for w, (form, _, _, near, form_n) in plain(counts).items()}


def test_roots_follow_forms_to_the_last(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(9)] + [("x", "w3"), ("w9", None)]
    found = {r.word: r.root for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert found == {w: "w9" for w, form in chain if form}
