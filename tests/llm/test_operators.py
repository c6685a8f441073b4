"""The training-text operators against plain Python on small tables with awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import decontaminate, exact_dedup, language_id, near_copies, pii, quality, secrets, sentencepiece_codec, simhash, substring_dedup, url_filter
from millrace.llm.components import connected
from millrace.llm.queries import SENTENCEPIECE, URL_RULES

WORDS = "the of and to in that is was for on with as at by from this have not are were which one had all would there their what".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


LONG = prose(1, 4000) + " " + "x" * 50_000 + " " + "1 " * 3000 + "!" * 2000
TEXTS = [
    (1, prose(2, 60)), (2, prose(2, 60)), (3, ""), (4, None), (5, "  \n\t "), (6, LONG), (7, prose(3, 30) + " " + prose(2, 60)),
    (8, "Mail a@b.c_d@e.f or 10.0.0.255, 10.0.0.256, +1 (988) 555-2485, 4111 1111 1111 1111 é x@y.z.é"), (9, "token = abc\npassword: 'abcdefabcdef0123'"),
    (10, "AKIA" + "Z" * 14 + " AKIAX 0123456789abcdef 0123456789abcde"), (None, prose(2, 60)), (1, prose(2, 60)), (11, prose(2, 59) + " end"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "h", 1, "r") for d, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, row long, words string").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def pairs(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("bits,capacity", [(64, 500_000), (3, 1)])
def test_exact_groups(docs, nothing, bits, capacity):
    groups = {}
    for d, t in TEXTS:
        groups.setdefault(t or "", []).append(d)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    got = exact_dedup.exact_groups(docs, capacity, 6, bits)
    assert pairs(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_dedup.exact_groups(nothing, capacity, 6, bits).count() == 0
    left = exact_dedup.drop_copies(docs, capacity=capacity, max_depth=6, key_bits=bits)
    assert left.columns == docs.columns and 1 not in {r.doc_id for r in left.collect()}


def test_directory_doubles_until_buckets_fit():
    slots = dict(exact_dedup.directory({0: 5, 1: 5, 2: 1, 7: 1}, 5, 3))
    assert slots[0] != slots[1] and slots[4] == slots[7] and len(slots) == 8
    assert len(set(dict(exact_dedup.directory({0: 50}, 5, 3)).values())) == 4  # the full slot overflows at the last depth


def urls():
    hosts = ["a.example.net", "example.net", "Example.NET", "xnet", "m.example.com", "b.org", "org", "c.io", ""]
    return [f"{s}://{h}{p}" for s in ("http",) for h in hosts for p in ("", "/", "/en/1?x", "/de/1#y", "/fr/", "/enx")] + [None, "nothing", "", "a://b://c"]


def test_url_verdicts(spark):
    rows = list(enumerate(urls()))
    pages = spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, rule string")
    rules = spark.createDataFrame([*URL_RULES, URL_RULES[0], (None, "block")], "rule string, action string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, rules).collect()}
    for i, u in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(r), r, v) for r, v in URL_RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u
    assert url_filter.judge_urls(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.where("false")).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).selectExpr("cast(id as string) as key", "id % 9 = 0 as listed")
    levels = url_filter.build_cascade(universe)
    assert len(levels) > 2
    assert universe.where(url_filter.contains(universe.key, levels) != universe.listed).count() == 0
    with pytest.raises(ValueError):
        url_filter.build_cascade(universe, 100)


def personal(text):
    digits = lambda m: re.sub("[^0-9]", "", m)

    def luhn(x):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(x))) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) < 256 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text) if ok(m[0])]


def test_personal_data(docs, nothing):
    want = Counter((d, hashlib.sha256(",".join(personal(t or "")).encode()).hexdigest()) for d, t in TEXTS)
    got = pii.find_personal_data(docs)
    assert pairs(got, "doc_id", "base_sha256") == want
    assert "email:5:10" in next(r.spans for r in got.collect() if r.doc_id == 8)
    assert pii.find_personal_data(nothing).count() == 0


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    rows = [(i, f"the customer card {n} was used") for i, n in enumerate(["4111111111111111", "5500005555555559", "340000000000009", "30000000000004", "6011000000000004"] * 2)]
    rows += [(100, "the customer card 99-8877 was used"), (101, "in the year 2024 there was")]
    found = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), confidence=0.8).collect()}
    assert found[100].spans == "card:18:25" and found[100].n_card == 0 and found[100].n_learned == 1
    assert found[101].spans == ""


def test_secrets(docs, nothing):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = {r.doc_id: r for r in secrets.find_secrets(docs, None).collect()}
    for d, t in TEXTS:
        t = t or ""
        base = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t) if len(m[2]) >= 12]
        base += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        base += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert got[d].spans == ",".join(x[2] for x in sorted(base))
    assert secrets.find_secrets(nothing, None).count() == 0 and secrets.fit(nothing) is None


def test_network_tells_keys_from_words():
    rng = np.random.default_rng(0)
    keys = ["".join(rng.choice(list("abcdefABCDEF0123456789"), 24)) for _ in range(400)]
    words = ["".join(rng.choice(WORDS, 6)) for _ in range(400)]
    codes = secrets.encode([(f"see {x} there", 4, 4 + len(x)) for x in keys + words])
    labels = np.array([1] * 400 + [0] * 400)
    train = np.arange(800) % 2 == 0
    network = secrets.Network()
    network.fit(codes[train], labels[train])
    network.calibrate(network.logits(codes[~train]), labels[~train], 0.95)
    said = network.probability(network.logits(codes[~train])) >= network.threshold
    assert (said == labels[~train]).mean() > 0.95 and said[labels[~train] == 1].mean() >= 0.94


def test_candidates_are_read_whole_and_recall_is_kept(spark):
    """A kind that was never labelled is found by its look; a difference after 40 characters counts; nulls and repeats hold."""
    rng = np.random.default_rng(1)
    key = lambda n, letters: "".join(rng.choice(list(letters), n))
    plain = lambda: " ".join("".join(rng.choice(WORDS, 5)) for _ in range(3))
    rows = [(i, f"{plain()} {key(24, '0123456789abcdef')} {plain()} token: {key(20, 'ABCDEFGHJKLMNPQRSTUVWXYZ0123456789')}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    network = secrets.fit(docs)
    hidden = [(1000 + i, f"{plain()} {key(30, 'ABCDEF0123456789')} {plain()}") for i in range(60)]
    hidden += [(2000 + i, plain()) for i in range(60)] + [(3000, None), (3000, None), (3001, "")]
    hidden += [(4000, "".join(rng.choice(WORDS, 30))[:60]), (4001, "".join(rng.choice(WORDS, 30))[:48] + key(40, "ABCDEF0123456789"))]
    found = secrets.find_secrets(spark.createDataFrame(hidden, "doc_id long, text string"), network).collect()
    got = {r.doc_id: r.n_learned for r in found}
    assert len(found) == len(hidden) and got[3000] == got[3001] == 0
    assert np.mean([got[1000 + i] > 0 for i in range(60)]) >= 0.9 and np.mean([got[2000 + i] == 0 for i in range(60)]) >= 0.9
    assert got[4000] == 0 and got[4001] == 1


def test_simhash_links(docs, nothing):
    def mark(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
        parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    marks = [(d, mark(t)) for d, t in TEXTS]
    reach = [{j for j in range(len(marks)) if (marks[i][1] ^ marks[j][1]).bit_count() <= 2} for i in range(len(marks))]
    for _ in marks:
        reach = [set().union(*(reach[j] for j in r)) for r in reach]
    want = Counter((d, f"{m:016x}", min((marks[j][0] for j in reach[i] if marks[j][0] is not None), default=None)) for i, (d, m) in enumerate(marks))
    assert pairs(simhash.near_groups(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_groups(nothing).count() == 0


def test_fingerprints_in_reach_share_a_home():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    near = simhash.Anchors(2)
    row, anchor, home = near.of(a)
    other = set(zip(*(x.tolist() for x in near.of(b)[:2]), strict=True))
    homes = list(zip(row[home].tolist(), anchor[home].tolist(), strict=True))
    assert len(homes) == 300 and all(x in other for x in homes)


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 100), (None, 5)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_near_copies_go(spark):
    text = prose(9, 300).split()
    copy = [*text[:100], "changed", *text[101:]]
    rows = [(1, " ".join(text), "v"), (2, " ".join(copy), "v"), (3, prose(10, 300), "v"), (4, None, "v"), (5, "", "v"), (None, " ".join(text), "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, views string")
    assert sorted(r.doc_id or 0 for r in near_copies.drop_near_copies(docs).collect()) == [0, 1, 3, 4]
    assert near_copies.drop_near_copies(docs.where("false")).count() == 0


def edited(words, seed, places):
    """A text with ``places`` words replaced, far apart."""
    rng = np.random.default_rng(seed)
    out = list(words)
    for at in rng.choice(np.arange(5, len(out) - 5, 6), places, replace=False):
        out[at] = f"w{seed}x{at}"
    return out


def exact_similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("length,places", [(100, 2), (400, 8)])
def test_copies_of_an_original_with_a_large_id_go(spark, length, places):
    original = prose(20, length).split()
    rows = [(i, " ".join(edited(original, i, places))) for i in range(40)] + [(100, " ".join(original)), (101, prose(21, length))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r.node for r in connected(near_copies.near_links(docs)).where("node <> component").collect()}
    alike = {i for i, t in rows[:40] if exact_similarity(t.split(), original) >= 0.8}
    assert len(alike) == 40 and gone == set(range(1, 40)) | {100}


def test_near_links_join_what_all_pairs_join(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    texts = [prose(30 + i, 100).split() for i in range(3)]
    for i in range(60):  # a random tree: copies of copies, most of them below 0.8 to most others
        texts.append(edited(texts[int(np.random.default_rng(i).integers(len(texts)))], 50 + i, 1 + i % 4))
    order = np.random.default_rng(1).permutation(len(texts)).tolist()
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in zip(order, texts, strict=True)], "doc_id long, text string")
    want = [(a, b) for a, s in zip(order, texts, strict=True) for b, t in zip(order, texts, strict=True) if a < b and exact_similarity(s, t) >= 0.8]
    want = {(r.node, r.component) for r in connected(spark.createDataFrame(want, "a long, b long")).collect()}
    assert {(r.node, r.component) for r in connected(near_copies.near_links(docs)).collect()} == want


def test_texts_of_one_fingerprint_stay_unless_alike(spark):
    texts = [" ".join(["here is the same line once again"] * 200 + [f"w{k}x{i}" for i in range(300)]) for k in range(2)]
    texts.append(texts[1].replace("w1x150", "other"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in simhash.near_groups(docs).collect()} == {0}  # one component, though 0 is unlike both others
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == [0, 1]


def test_passages(docs, nothing):
    firsts = {}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for d, t in TEXTS:
        w = split(t)
        for i in range(len(w) - 12):
            firsts[tuple(w[i : i + 13])] = min(firsts.get(tuple(w[i : i + 13]), 1 << 62), 1 << 62 if d is None else d)
    want = Counter()
    for d, t in TEXTS:
        w, gone = split(t), set()
        for i in range(len(w) - 12):
            if firsts[tuple(w[i : i + 13])] < ((1 << 63) - 1 if d is None else d):
                gone |= set(range(i, i + 13))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[d, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()] += 1
    assert pairs(substring_dedup.passage_digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert substring_dedup.passage_digests(nothing).count() == 0


ITEMS = [
    (1, "A farmer has 12 goats and 12 sheep in the green field near Oldtown and sells 5 kg of cheese every morning."),
    (2, "too short"), (3, None), (4, "It is well known that the quick brown fox jumps over the lazy dog each single day of the year."),
]


def test_leaks(spark):
    docs = [
        (1, "Intro words. " + ITEMS[0][1] + " More words follow."),
        (2, ITEMS[0][1].replace("12", "40").replace("Oldtown", "Newport").replace("5 kg", "7 lb")),
        (3, ITEMS[0][1].replace("12 sheep", "13 sheep")),  # one value of the item meets two, but 18 words in a row correspond
        (4, "It is well known that the quick brown fox sleeps."),
        (5, None), (6, ""), (7, LONG), (8, ITEMS[3][1].upper()),
    ]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.item_id) for r in decontaminate.leaks_by_document(frame, bench).collect()}
    assert got == {1: (True, 1), 2: (True, 1), 3: (True, 1), 4: (False, None), 5: (False, None), 6: (False, None), 7: (False, None), 8: (True, 4)}
    assert [r.doc_id for r in decontaminate.drop_leaks(frame, bench).orderBy("doc_id").collect()] == [4, 5, 6, 7]
    assert decontaminate.leaks_by_document(frame.where("false"), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.leaks_by_document(frame, bench.where("false")).collect())


def test_runs_correspond_by_themselves(spark):
    items = [ITEMS[0], (5, "pears and plums 7 grow on old trees 7 miles from town")]
    docs = [
        (0, ITEMS[0][1].replace("12 sheep", "13 sheep")),  # 18 words that correspond, after the value that meets two
        (1, items[1][1].replace("7 miles", "8 miles")),  # no run without the value that meets two
        (2, items[1][1].replace("7", "9")),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.words) for r in decontaminate.leaks_by_document(frame, bench).collect()}
    assert got == {0: (1, 18), 1: (None, 0), 2: (5, 12)}


def test_words_outside_the_run_do_not_count(spark):
    """A run of one word and twelve numbers is no leak, though other words of the item stand elsewhere; a later run is."""
    numbers = " ".join(str(n) for n in range(20, 32))
    item = f"costs {numbers} then the buyers took home all they had paid for in the end of that long day"
    other = " ".join(str(n) for n in range(50, 62))
    docs = [
        (0, f"costs {other} x the buyers y home all z they w had"),
        (1, f"costs {other} x the buyers took home all they had paid for in the end of that long day"),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.words) for r in decontaminate.leaks_by_document(frame, bench).collect()}
    assert got[0] == (False, 0) and got[1][0] and got[1][1] >= 13


def test_sample_leaves_out_only_texts_that_are_too_long(spark):
    from millrace.llm.common import bounded_sample

    rows = [(i, "x" * (5000 if i == 7 else 40)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, "a") for i in range(20)], "doc_id long, label string")
    assert len(bounded_sample(docs, marks, "label", 50, 4000)) == 19
    assert len(bounded_sample(docs, marks, "label", 5, 4000)) == 5
    assert sum(len(t) for t, _ in bounded_sample(docs, marks, "label", 50, 400)) <= 400
    many = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    assert len(bounded_sample(many, many.select("doc_id", F.lit("b").alias("label")), "label", 100, 4000)) == 100


def test_items_with_eight_numbers_in_a_row(spark):
    item = "values 1 2 3 4 5 6 7 8 9 come out here"
    frame = spark.createDataFrame([(n, "we " * n + item + " again") for n in range(7)], "doc_id long, text string")
    bench = spark.createDataFrame([(6, item)], "item_id long, text string")
    assert {(r.item_id, r.words) for r in decontaminate.leaks_by_document(frame, bench).collect()} == {(6, 13)}


def test_codec_round_trip_and_parity(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE)
    ids = sentencepiece_codec.encode(docs, SENTENCEPIECE).collect()
    want = Counter((d, tuple(model.encode(t or ""))) for d, t in TEXTS)
    assert Counter((r.doc_id, tuple(r.input_ids)) for r in ids) == want
    trip = sentencepiece_codec.round_trip(docs, SENTENCEPIECE).collect()
    assert all(r.lossless and r.parity for r in trip) and len(trip) == len(TEXTS)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, SENTENCEPIECE), SENTENCEPIECE).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((d, t or "") for d, t in TEXTS)


def test_forward_sums_all_segmentations():
    lattice = language_id.Lattice(["a", "b", "ab", "ba", "aba"])
    p = np.array([[0.2], [0.1], [0.3], [0.15], [0.25], [1e-3]])

    def total(word):
        if not word:
            return 1.0
        known = {"a": 0.2, "b": 0.1, "ab": 0.3, "ba": 0.15, "aba": 0.25}
        return sum(known.get(word[:n], 1e-3 if n == 1 else 0) * total(word[n:]) for n in range(1, len(word) + 1))

    words = ["abab", "a", "xaba", "abababababab"]
    assert np.allclose(lattice.log_forward(words, p)[:, 0], [np.log(total(w)) for w in words])


def test_languages_and_quality_on_held_out_rows(spark):
    other = "der die und das ist nicht mit auf ein eine von zu den dem im".split()
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(WORDS if i % 2 else other, 40)), "en" if i % 2 else "de", i % 2) for i in range(200)]
    rows += [(1000, None, "en", 1), (1001, "", "de", 0), (1002, "12 34", None, None), (1000, None, "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    found = language_id.predict_languages(docs, SENTENCEPIECE).collect()
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    assert len(found) == len(rows) and all(r.held_out == held[r.doc_id] for r in found)
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in found if r.doc_id < 1000)
    assert {(r.lang_pred, r.score) for r in found if r.doc_id >= 1000} == {("und", 0.0)}
    assert {r.lang_pred for r in language_id.predict_languages(docs.drop("lang").selectExpr("*", "cast(null as string) lang"), SENTENCEPIECE).collect()} == {"und"}
    assert language_id.keep_identified(docs, SENTENCEPIECE).count() == 200
    labels = docs.selectExpr("doc_id", "score as quality")
    scored = quality.score_quality(docs, labels).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert np.mean([r.predicted == r.doc_id % 2 for r in scored if r.doc_id < 200 and r.held_out]) > 0.95
    assert quality.score_quality(docs, labels.where("false")).count() == len(rows)


def test_pipeline_runs_its_stages(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "lang", "source", "input_ids", "parity"]
    rows = out.collect()
    assert rows and all(r.parity for r in rows) and len({r.doc_id for r in rows}) == len(rows)


def unigram_model(squeeze=True):
    """A small unigram model with byte fallback, put together by hand. Space handling as in models made by default."""
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.trainer_spec.model_type, spec.trainer_spec.byte_fallback = 1, True
    spec.normalizer_spec.name = "identity"
    spec.normalizer_spec.remove_extra_whitespaces = squeeze
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [(p, -1.0 - 0.37 * i, 1) for i, p in enumerate("▁ ▁the ▁th e ▁of a at ▁that t h n an ▁an d ▁and i in ing s o f".split())]
    for piece, score, kind in pieces:
        spec.pieces.add(piece=piece, score=score, type=kind)
    return spec.SerializeToString()


@pytest.mark.parametrize("squeeze", [True, False])
def test_unigram_models_are_rebuilt(spark, tmp_path, squeeze):
    import sentencepiece

    path = tmp_path / "unigram.model"
    path.write_bytes(unigram_model(squeeze))
    model = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["the that and", "  of  the   thing ", "", "   ", "that\ttin\nx", "é zz the", "a" * 300, None, "thatand andthe ofthe"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (list(r.input_ids), r.parity) for r in sentencepiece_codec.encode(rows, str(path)).collect()}
    assert got == {i: (model.encode(t or ""), True) for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(sentencepiece_codec.encode(rows, str(path)), str(path)).collect()}
    assert back == {i: model.decode(model.encode(t or "")) for i, t in enumerate(texts)}


def test_codec_on_empty_tables_and_null_ids(spark, docs, nothing):
    assert sentencepiece_codec.encode(nothing, SENTENCEPIECE).count() == 0
    assert sentencepiece_codec.round_trip(nothing, SENTENCEPIECE).count() == 0
    ids = spark.createDataFrame([(1, None), (2, [])], "doc_id long, input_ids array<int>")
    assert {r.doc_id: r.text for r in sentencepiece_codec.decode(ids, SENTENCEPIECE).collect()} == {1: None, 2: ""}
    assert sentencepiece_codec.decode(ids.where("false"), SENTENCEPIECE).count() == 0


def test_the_directory_doubles_and_rows_are_found_in_their_bucket(spark):
    texts = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 1000).alias("text"))
    index, slots = exact_dedup.build_index(texts, capacity=50, max_depth=8)
    found = {r.slot: r.bucket for r in slots.collect()}
    assert len(found) == 256 and len(set(found.values())) > 20
    rows = index.collect()
    assert len(rows) == 1000 and all(found[(r.key % (1 << 64)) >> 56] == r.bucket for r in rows)
    sizes = Counter(r.bucket for r in rows)
    assert max(sizes.values()) <= 50
    groups = exact_dedup.exact_groups(texts, capacity=50, max_depth=8)
    assert groups.where("kept").count() == 1000 and groups.where("group_size <> 3 or keep_id % 1000 <> doc_id % 1000").count() == 0


def test_dropped_tables_are_those_between_the_marks(spark):
    from millrace.llm.common import drop_tables, tables_made, written

    start = tables_made()
    first, second = (written(spark.range(5), f"mark-{i}") for i in range(2))
    drop_tables(spark, start, tables_made() - 1)
    assert second.count() == 5
    with pytest.raises(Exception):
        first.count()


@pytest.mark.parametrize("block", [100_000, 40])
def test_hot_anchor_is_cut_into_blocks(spark, block):
    """Fingerprints around one centre, most of them near the same anchors: cells of blocks find the same components."""
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 1 << 62))
    prints = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (400, 2))}
    prints |= {int(x) for x in rng.integers(0, 1 << 62, 50)}
    frame = spark.createDataFrame([(x,) for x in sorted(prints)], "fingerprint long")
    if block == 40:
        assert simhash.hot_anchors(frame, block=block).max() > 3
    found = [(r.a, r.b) for r in simhash.links(frame, block=block).collect()]
    assert all(bin(a ^ b).count("1") <= 2 for a, b in found)

    def components(edges):
        root = {x: x for x in prints}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[max(top(a), top(b))] = min(top(a), top(b))
        return {x: top(x) for x in prints}

    every = [(a, b) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= 2]
    assert components(found) == components(every)
