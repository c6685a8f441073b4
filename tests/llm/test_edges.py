"""Awkward rows that the operators' own tests leave out: nulls, repeats, very long texts, empty tables, clashing columns."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import decontaminate, language_id, near_copies, quality, url_filter
from millrace.llm.queries import SENTENCEPIECE, URL_RULES

ENGLISH = "the of and to in that is was for on with as at by from this have not are were which one had all would".split()
GERMAN = "der die und das ist nicht mit auf ein eine von zu den dem im sich auch als an werden aus er hat dass".split()


def prose(seed, n, words=ENGLISH):
    return " ".join(np.random.default_rng(seed).choice(words, n))


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, prose(i, 40, GERMAN if i % 2 else ENGLISH), "de" if i % 2 else "en", i % 2) for i in range(120)]
    rows += [(None, prose(900, 40), None, None), (901, prose(901, 30_000, GERMAN), "de", 1), (901, prose(901, 30_000, GERMAN), "de", 0)]
    rows += [(902, "x" * 200_000, None, None), (903, None, "en", 0), (904, "", None, 1), (3, prose(3, 40, GERMAN), "de", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality long").withColumn("score", F.lit("x"))


def test_languages_of_awkward_rows(spark, labelled):
    found = language_id.predict_languages(labelled, SENTENCEPIECE)
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r.doc_id, []).append((r.lang_pred, r.held_out))
    assert sum(map(len, by_id.values())) == labelled.count()
    assert by_id[None] == [("en", False)] and {x[0] for x in by_id[901]} == {"de"} and len(by_id[3]) == 2
    assert by_id[903][0][0] == by_id[904][0][0] == "und" and by_id[902][0][0] in ("de", "en")
    assert language_id.predict_languages(labelled.where("false"), SENTENCEPIECE).count() == 0
    # Without a learned language nothing is identified, and a filter on languages keeps nothing.
    unknown = labelled.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.keep_identified(unknown, SENTENCEPIECE).count() == 0
    kept = language_id.keep_identified(labelled, SENTENCEPIECE)
    assert kept.columns == labelled.columns and kept.count() == labelled.count() - 2


def test_words_without_spaces_teach(spark):
    rows = [(i, "".join(np.random.default_rng(i).choice(list("abcd" if i % 2 else "wxyz"), 400)), "p" if i % 2 else "q") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.predict_languages(docs, SENTENCEPIECE).where("held_out").collect()
    assert found and all(r.lang_pred == ("p" if r.doc_id % 2 else "q") for r in found)


def test_quality_of_awkward_rows(spark, labelled):
    docs, labels = labelled.drop("quality"), labelled.select("doc_id", "quality")
    rows = quality.score_quality(docs, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in labelled.collect())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    empty = {r.score for r in rows if r.doc_id in (903, 904)}
    assert len(empty) == 1  # null and empty score the constant
    # Rows with both labels teach both; repeated labels teach once.
    again = quality.score_quality(docs, labels.unionByName(labels)).collect()
    assert sorted((str(r.doc_id), r.score) for r in again) == sorted((str(r.doc_id), r.score) for r in rows)
    assert quality.score_quality(docs.where("false"), labels).count() == 0


def test_repeated_and_very_long_urls(spark):
    long_ = "http://a.b.net/" + "p/" * 50_000
    rows = [(1, long_), (1, long_), (2, None), (None, "HTTP://X.Example.NET/en/?q"), (3, "no host"), (4, "://"), (5, "://net/?#")]
    pages = spark.createDataFrame([(p, u, "r") for p, u in rows], "page_id long, url string, rule string")
    found = url_filter.judge_urls(pages, spark.createDataFrame(URL_RULES, "rule string, action string")).collect()
    got = Counter((r.page_id, r.host, r.rule, r.verdict) for r in found)
    assert got[1, "a.b.net", "net/", "block"] == 2 and got[None, "x.example.net", "example.net/en/", "allow"] == 1
    assert got[2, "", None, "allow"] == got[3, "", None, "allow"] == got[4, "", None, "allow"] == 1 and got[5, "net", "net/", "block"] == 1


def plain_leak(doc, item, least):
    """Most words in a row that correspond: equal words, numbers one to one, with enough ordinary words."""
    best, need = 0, min(least, len(item))
    for offset in range(-len(item), len(doc)):
        for i in range(len(item)):
            for first in range(i + 1):
                words = [(item[k], doc[offset + k]) for k in range(first, i + 1) if 0 <= offset + k < len(doc)]
                if len(words) < need or len(words) != i + 1 - first:
                    continue
                forth, back, fine, literal = {}, {}, True, 0
                for a, b in words:
                    if a.isdigit() != b.isdigit():
                        fine = False
                    elif a.isdigit():
                        fine = fine and forth.setdefault(a, b) == b and back.setdefault(b, a) == a
                    else:
                        fine, literal = fine and a == b, literal + 1
                    if not fine:
                        break
                if fine and literal >= decontaminate.LITERAL:
                    best = max(best, len(words))
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_against_all_alignments(spark, seed):
    rng = np.random.default_rng(seed)
    vocabulary = "stone river cloud window garden letter button forest".split() + ["7", "8", "12"]
    items = [[str(x) for x in rng.choice(vocabulary, n)] for n in (15, 18, 22, 13, 9)]
    docs = []
    for k in range(24):
        item = items[int(rng.integers(len(items)))]
        low = int(rng.integers(0, 4))
        part = item[low : low + int(rng.integers(11, 22))]
        values = {"7": str(rng.integers(20, 23)), "8": str(rng.integers(22, 25)), "12": str(rng.integers(30, 32))}
        part = [values.get(w, w) if k % 3 else w for w in part]
        if k % 4 == 0 and len(part) > 6:
            part[5] = "changed"
        around = [str(x) for x in rng.choice(vocabulary, 12)]
        docs.append(around[:6] + part + around[6:])
    frame = spark.createDataFrame([(i, " ".join(d), "t") for i, d in enumerate(docs)], "doc_id long, text string, item string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.words) for r in decontaminate.leaks_by_document(frame, bench).collect()}
    usable = [x for x in items if len(x) >= decontaminate.WINDOW]
    want = {i: max(plain_leak(d, x, decontaminate.LEAST) for x in usable) for i, d in enumerate(docs)}
    assert got == {i: (n > 0, n) for i, n in want.items()} and 2 < sum(n > 0 for n in want.values()) < 24


def test_leaks_of_repeated_rows_and_null_ids(spark):
    item = prose(5, 20)
    rows = [(None, item), (None, item), (1, "well " + item), (1, "well " + item), (2, None), (3, prose(6, 20))]
    docs = spark.createDataFrame([(*r, "row") for r in rows], "doc_id long, text string, row string")
    bench = spark.createDataFrame([(1, item), (1, item), (2, None)], "item_id long, text string")
    found = Counter((r.doc_id, r.contaminated) for r in decontaminate.leaks_by_document(docs, bench).collect())
    assert found == {(None, True): 2, (1, True): 2, (2, False): 1, (3, False): 1}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()) == [2, 3]
    assert decontaminate.drop_leaks(docs.where("false"), bench).count() == 0


def test_near_copies_with_a_very_long_text(spark):
    words = [str(x) for x in np.random.default_rng(8).integers(0, 10**6, 60_000)]
    other = words[:30_000] + ["new"] + words[30_000:]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:20_000])), (4, prose(1, 50)), (None, prose(1, 50))]
    docs = spark.createDataFrame([(d, t, "m", 1) for d, t in rows], "doc_id long, text string, mark string, n int")
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, None}


def test_stages_on_awkward_rows(spark, tmp_path):
    """Each stage's decision, in order: unidentified, exact copy, near copy, leak; clean rows and all columns stay."""
    leak = prose(77, 30, [f"w{i}" for i in range(200)])
    copy = prose(50, 60)
    near = copy.split()
    near[30] = "changed"
    rows = [(i, prose(i, 60, GERMAN if i % 2 else ENGLISH), "de" if i % 2 else "en", "s") for i in range(40)]
    rows += [(100, None, "en", "s"), (101, "12 34", None, None), (102, copy, "en", "s"), (103, copy, "en", "s"), (None, prose(51, 60), "en", None)]
    rows += [(104, " ".join(near), "en", "s"), (105, prose(52, 40) + " " + leak, "en", "s"), (106, prose(53, 9000), "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    docs = docs.withColumn("mark", F.lit(1))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    gone, now = [], docs
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if number < 4:
            assert now.columns == docs.columns
        gone.append(sorted({r.doc_id for r in before.select("doc_id").collect()} - {r.doc_id for r in now.select("doc_id").collect()}))
    assert gone == [[100, 101], [102], [104], [105], []]
    assert now.count() == 40 + 3 and now.where("not parity").count() == 0
    empty = str(tmp_path / "empty")
    docs.where("false").write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
