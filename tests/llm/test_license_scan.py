"""License scan against plain Python over whole word lists."""

import collections
import re

import numpy as np
import pytest

from millrace.llm.license_scan import BASE, TEMPLATES, postings, scan_licenses

LOWER = {i: i + 32 for i in range(65, 91)}
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def plain(texts, templates=TEMPLATES, index_words=4, looked_up=8, least_share=0.6):
    docs = [words_of(t) for t in texts]
    df = collections.Counter(w for d in docs for w in set(d))
    chosen_of = [sorted(set(p.split()), key=lambda w: (df[w], w))[:index_words] for _, p, _ in templates]
    ranked = sorted({w for some in chosen_of for w in some}, key=lambda w: (df[w], w))
    out = []
    for d in docs:
        places = sorted(i for phrase, _ in BASE for i in range(len(d)) if d[i : i + len(phrase.split())] == phrase.split())
        base = {label for phrase, label in BASE if any(d[i : i + len(phrase.split())] == phrase.split() for i in range(len(d)))}
        looked = [w for w in ranked if w in d][:looked_up]
        shares = {}
        for t, (label, passage, keys) in enumerate(templates):
            p = passage.split()
            for start in range(-len(p), len(d)):
                hits = {
                    w for q, w in enumerate(p)
                    if w in chosen_of[t] and w in looked and 0 <= start + q < len(d) and d[start + q] == w
                }
                share = len(hits) / len(chosen_of[t])
                if start < 0 or share < least_share:
                    continue
                at = [next(i for i in range(len(p)) if p[i : i + len(k.split())] == k.split()) for k in keys]
                if all(d[start + a : start + a + len(k.split())] == k.split() for a, k in zip(at, keys)):
                    shares[start, start + len(p), label] = max(share, shares.get((start, start + len(p), label), 0))
        score = 1.0 if places else max(shares.values(), default=0.0)
        labels = base | {label for _, _, label in shares}
        out.append((len(d), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, set(shares)))
    return out


def check(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, "x", 3, "y") for i, t in enumerate(texts)], "doc_id long, text string, words string, n_base int, label string")
    got = {}
    for r in scan_licenses(docs.repartition(3), **options).collect():
        found = {(n.start, n.end, n.label) for n in r.notices}
        got[r.doc_id] = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, found)
    assert got == dict(enumerate(plain(texts, **options)))
    return got


def test_awkward_texts(spark):
    long_ = "word " * 30_000 + MIT + " word" * 30_000 + " cc by cc by"
    got = check(
        spark,
        [
            None, "", " \n..", "CC BY", "cc-by cc  BY; cc\nby", "All Rights Reserved. all rights. reserved", MIT, MIT + ". " + MIT,
            "Released under the MIT License.", "released under the license mit", "mit license", "Straße cc by é GENERAL PUBLIC LICENSE",
            "Licensed under CC BY-NC 4.0.", "gnu general public licence", long_, MIT.replace("software", "thing"), "the of and to in",
        ],
    )
    assert got[6][5] == "mit" and got[14][5] == "cc-by,mit" and got[15][5] == "" and got[12][5] == "cc-by,cc-by-nc"


@pytest.mark.parametrize("seed", [1, 2])
def test_mixed_words(spark, seed):
    """Words of all passages in random order, with whole and broken passages between them."""
    rng = np.random.default_rng(seed)
    words = sorted({w for _, p, _ in TEMPLATES for w in p.split()})
    texts = []
    for _ in range(40):
        parts = [" ".join(rng.choice(words, rng.integers(0, 30)))]
        for t in rng.integers(0, len(TEMPLATES), rng.integers(0, 3)):
            p = TEMPLATES[t][1].split()
            if rng.random() < 0.5:
                p[rng.integers(len(p))] = rng.choice(words)
            parts += [" ".join(p), " ".join(rng.choice(words, rng.integers(0, 9)))]
        texts.append(" ".join(parts))
    check(spark, texts)
    check(spark, texts, index_words=3, looked_up=4, least_share=0.5) if seed == 1 else None


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, MIT), (None, MIT), (7, MIT)], "doc_id long, text string")
    rows = [(r.doc_id, r.labels) for r in scan_licenses(docs).collect()]
    assert collections.Counter(rows) == {(None, "mit"): 2, (7, "mit"): 1}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert scan_licenses(docs).collect() == []
    assert len({t for _, _, t, _ in postings(docs)}) == len(TEMPLATES)


def test_no_shuffle_and_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = scan_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
