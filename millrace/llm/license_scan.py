"""License notices found through an index of rare words and their positions in license passages.

Every passage of ``TEMPLATES`` is a row of words. Its index words are those of its words that the fewest documents hold.
A document looks up the rarest index words it has, with all their positions; a posting (passage, position in it) turns
each into the place where the passage would start. Places named by several index words of a passage are candidates; the
passage counts once its mandatory key phrases stand where it puts them.

Only column functions are used, and a document is judged within its row: after the index is built, nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, whole_text

# Phrases whose every occurrence is reported, and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Label, passage, mandatory key phrases. The wording is that of the public license texts and usual notices.
TEMPLATES = [
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("free of charge", "this software")),
    ("mit", "the software is provided as is without warranty of any kind express or implied", ("without warranty of any kind",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("apache-2.0", "you may not use this file except in compliance with the license", ("in compliance with the license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", ("general public license", "free software foundation")),
    ("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used", ("copyright holder",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("public-domain", "this work has been released into the public domain", ("public domain",)),
]

INDEX_WORDS = 4  # index words of a passage: its rarest ones
LOOKED_UP = 8  # index words that a document looks up: its rarest ones
LEAST_SHARE = 0.6  # of a passage's index words that must stand at one relative position

_PLACES, _VOTES = "array<int>", "array<struct<t:int,start:int,word:string>>"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Maximal runs of a-z, 0-9 and characters beyond ASCII, A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(text), _NOT_WORD), lambda w: w != "")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each worked out once for a row however often it is used."""
    made = F.struct(*(c.alias(name) for name, c in columns.items()))
    return df.select("*", F.inline(F.array(made)))


def _starts(phrase: str) -> Column:
    """All places at which the words of ``phrase`` stand in a row, from 0."""
    parts = phrase.split(" ")
    places = F.sequence(F.lit(0), F.size("_words") - len(parts))
    here = lambda i: reduce(lambda a, b: a & b, (F.get("_words", i + k) == w for k, w in enumerate(parts)))
    return F.when(F.col("_spaced").contains(f" {phrase} "), F.filter(places, here)).otherwise(F.array().cast(_PLACES))


def _template_rows(templates) -> list[tuple[int, str, str, int]]:
    return [(t, label, w, q) for t, (label, passage, _) in enumerate(templates) for q, w in enumerate(passage.split(" "))]


def postings(docs: DataFrame, templates=TEMPLATES, index_words: int = INDEX_WORDS) -> list[tuple[str, int, int, int]]:
    """(word, documents that hold it, passage, position) of every index word. A passage's words are ranked by the
    number of documents that hold them, fewest first, then by the word. The size depends on ``templates`` alone."""
    spark = docs.sparkSession
    known = sorted({w for _, _, w, _ in _template_rows(templates)})
    held = docs.select(F.explode(F.array_intersect(words_of(whole_text()), F.lit(known))).alias("word"))
    counted = held.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rows = spark.createDataFrame(_template_rows(templates), "t int, label string, word string, q int")
    rows = rows.join(F.broadcast(counted), "word", "left").select("t", "word", "q", F.coalesce("df", F.lit(0)).alias("df"))
    rarest = Window.partitionBy("t").orderBy("df", "word")
    ranked = rows.withColumn("_rank", F.dense_rank().over(rarest)).where(F.col("_rank") <= index_words)
    return [tuple(r) for r in ranked.select("word", "df", "t", "q").orderBy("df", "word", "t", "q").collect()]


def _votes(index: list[tuple[str, int, int, int]]) -> Column:
    """(passage, start, word) for every posting of every place of a chosen word, in order and each once."""
    places = F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    places = F.filter(places, lambda h: F.array_contains("_chosen", h["w"]))
    entries = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(t).alias("t"), F.lit(q).alias("q")) for w, _, t, q in index))
    each = F.transform(
        places,
        lambda h: F.transform(
            F.filter(entries, lambda e: e["w"] == h["w"]),
            lambda e: F.struct(e["t"].alias("t"), (h["i"] - e["q"]).alias("start"), h["w"].alias("word")),
        ),
    )
    return F.array_sort(F.array_distinct(F.flatten(each)))


def _facts(index: list[tuple[str, int, int, int]], templates) -> Column:
    """By passage: label, length, number of index words, and the key phrases with their places in it."""
    needed = [len({w for w, _, t, _ in index if t == number}) for number in range(len(templates))]
    rows = []
    for (label, passage, some), n in zip(templates, needed):
        phrases = []
        for phrase in some:
            before = f" {passage} ".index(f" {phrase} ")
            at = len(passage[:before].split())
            phrases.append(F.struct(F.lit(at).alias("at"), F.lit(phrase.split(" ")).alias("words")))
        size = len(passage.split(" "))
        rows.append(F.struct(F.lit(label).alias("label"), F.lit(size).alias("size"), F.lit(n).alias("n"), F.array(*phrases).alias("keys")))
    return F.array(*rows)


def _notices(facts: Column, most: int, least_share: float) -> Column:
    """Accepted passages. Equal (passage, start) are neighbours among the votes, at most ``most`` of them."""
    same = lambda a, b: (a["t"] == b["t"]) & (a["start"] == b["start"])

    def judged(vote: Column, i: Column) -> Column:
        first = (i == 0) | ~same(F.get("_votes", i - 1), vote)
        hits = sum((F.coalesce(same(F.get("_votes", i + k), vote), F.lit(False)).cast("int") for k in range(1, most)), F.lit(1))
        fact = F.get(facts, vote["t"])
        return F.struct(
            vote["start"].alias("start"),
            (vote["start"] + fact["size"]).alias("end"),
            fact["label"].alias("label"),
            F.when(first, hits / fact["n"]).otherwise(0.0).alias("share"),
            fact["keys"].alias("keys"),
        )

    def stands(notice: Column) -> Column:
        def phrase(key: Column) -> Column:
            return F.slice("_words", notice["start"] + key["at"] + 1, F.size(key["words"])) == key["words"]

        return (notice["share"] >= least_share) & (notice["start"] >= 0) & F.forall(notice["keys"], phrase)

    found = F.filter(F.transform("_votes", judged), stands)
    return F.transform(found, lambda x: F.struct(*(x[c].alias(c) for c in ("start", "end", "label", "share"))))


def scan_licenses(
    docs: DataFrame,
    templates=TEMPLATES,
    index_words: int = INDEX_WORDS,
    looked_up: int = LOOKED_UP,
    least_share: float = LEAST_SHARE,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The ``keep`` columns, n_words, n_base, first_word, last_word, base_labels, labels, score and notices of each row.

    ``notices`` lists the accepted passages: start and end (words, end exclusive), label, and share, the part of the
    passage's index words found at that place. ``score`` is the largest share, 1.0 where a base phrase stands, 0.0
    without either. A null text counts as empty and has no words; repeated rows each get their row, and an empty table
    gives none. Long texts are read whole. Other columns of ``docs`` play no part.
    """
    index = postings(docs, templates, index_words)
    # Listed from the rarest on, so the first ones that a document has are its rarest.
    rare = F.array(*(F.lit(w) for w in dict.fromkeys(w for w, *_ in index))).cast("array<string>")
    found = _once(docs.select(*keep, whole_text().alias("_text")), _words=words_of(F.col("_text"))).drop("_text")
    spaced = F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))
    found = _once(found, _spaced=spaced, _chosen=F.slice(F.array_intersect(rare, "_words"), 1, looked_up))
    votes = F.when(F.size("_chosen") > 0, _votes(index)).otherwise(F.array().cast(_VOTES))
    base = F.array(*(_starts(phrase) for phrase, _ in BASE))
    found = _once(found, _base=base, _votes=votes)
    labels = F.transform(
        F.filter(F.arrays_zip(F.col("_base").alias("at"), F.lit([label for _, label in BASE]).alias("label")), lambda x: F.size(x["at"]) > 0),
        lambda x: x["label"],
    )
    found = _once(
        found, _places=F.flatten("_base"), _labels=labels, notices=_notices(_facts(index, templates), index_words, least_share)
    )
    own = F.transform("notices", lambda x: x["label"])
    shares = F.transform("notices", lambda x: x["share"])
    joined = lambda some: F.array_join(F.array_sort(F.array_distinct(some)), ",")
    return found.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"),
        F.array_max("_places").cast("long").alias("last_word"),
        joined("_labels").alias("base_labels"),
        joined(F.concat("_labels", own)).alias("labels"),
        F.when(F.size("_places") > 0, 1.0).otherwise(F.coalesce(F.array_max(shares), F.lit(0.0))).alias("score"),
        "notices",
    )
