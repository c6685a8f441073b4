"""Personal data: fixed patterns first, then contexts learned from what they found.

Base spans come from four patterns and their checks. They are the seeds: the words beside them are lexical patterns. All
identifier-like words of the corpus are candidates; candidates and patterns form a graph. In each round a pattern's
confidence is the mean score of the distinct candidates it meets, and a candidate's score is the noisy-or of the patterns
it meets; seeds keep score 1. Patterns that stay above ``CONFIDENCE`` with enough distinct candidates mark the unknown
candidates beside them as identifiers of the same kind.

Offsets count code points. They add up the lengths of what a pattern splits a text into. The patterns below equal those
of the task: possessive repeats only where nothing can be given back, look-behinds only where a match inside a run would
also have started at the run's start. So long runs cost linear time and no stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import whole_text, written

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
CONFIDENCE = 0.9
SUPPORT = 5  # distinct candidates that a pattern meets, at least

_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[ -]?[0-9])++"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_CANDIDATE = r"[0-9@]\S*+"  # of a word, from its first digit or @


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


# Checks of a match, by kind.
_CHECKS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "email": (_EMAIL, lambda m: F.lit(True)),
    "ip": (_IP, lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
    "card": (_CARD, lambda m: F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m))),
    "phone": (_PHONE, lambda m: F.length(_digits(m)).between(9, 15)),
}


def _spans(text: Column, number: int) -> Column:
    """Checked matches of one kind, as (no, s, e), in order."""
    pattern, check = _CHECKS[KINDS[number]]
    kind = "array<struct<no:int,s:int,e:int>>"
    parts = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(p.alias("p"), m.alias("m"))
    )

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        found = F.array(F.struct(F.lit(number).alias("no"), start.alias("s"), end.alias("e")))
        return F.struct(
            end.alias("at"), F.when(x["m"].isNotNull() & check(x["m"]), F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out")
        )

    first = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    return F.aggregate(parts, first, add, lambda acc: acc["out"])


def _candidates(text: Column, base: Column) -> Column:
    """Identifier-like words: four digits at least, or an @. (s, e, word, left, right, no: kind of a base span that it touches)."""
    kind = "array<struct<s:int,e:int,word:string,left:string,right:string,no:int>>"
    pieces = F.split(text, _CANDIDATE, -1)
    found = F.regexp_extract_all(text, F.lit(_CANDIDATE), F.lit(0))
    edge = 60  # characters beside a candidate that are searched for the neighbouring word

    def start_of_word(piece: Column) -> Column:
        """What the piece holds of the word that the match goes on with."""
        return F.substring_index(F.translate(piece, "\t\n\x0b\f\r", " " * 5), " ", -1)

    def up_to_word(piece: Column, match: Column) -> Column:
        """The piece without the start of a word that ``match`` goes on with; a candidate is no context of another."""
        return F.when(match.isNull(), piece).otherwise(piece.substr(F.lit(1), F.length(piece) - F.length(start_of_word(piece))))

    def before(piece: Column, size: Column) -> Column:
        """The word before the first ``size`` characters end."""
        near = piece.substr(F.greatest(size - (edge - 1), F.lit(1)), F.least(size, F.lit(edge)))
        return F.lower(F.regexp_extract(near, r"(\S+)\s*$", 1))

    def after(piece: Column) -> Column:
        return F.lower(F.regexp_extract(F.substring(piece, 1, edge), r"^\s*(\S+)", 1))

    # Bound to a name first: inside the inner function they would be computed again for every candidate.
    parts = F.get(
        F.transform(
            F.array(F.struct(pieces.alias("p"), found.alias("m"))),
            lambda z: F.transform(
                F.sequence(F.lit(0), F.size(z["m"])),
                lambda i: F.struct(
                    F.get(z["p"], i).alias("p"),
                    F.get(z["m"], i).alias("m"),
                    up_to_word(F.get(z["p"], i + 1), F.get(z["m"], i + 1)).alias("q"),
                    start_of_word(F.get(z["p"], i)).alias("w"),
                ),
            ),
        ),
        F.lit(0),
    )

    def add(acc: Column, x: Column) -> Column:
        size = F.length(x["p"]) - F.length(x["w"])
        start = acc["at"] + size
        end = acc["at"] + F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))
        touched = F.filter(base, lambda b: (b["s"] < end) & (b["e"] > start))
        item = F.struct(
            start.alias("s"),
            end.alias("e"),
            F.lower(F.concat(x["w"], x["m"])).alias("word"),
            before(x["p"], size).alias("left"),
            after(x["q"]).alias("right"),
            F.get(touched, 0)["no"].alias("no"),
        )
        likely = x["m"].isNotNull() & (x["m"].contains("@") | (F.length(_digits(x["m"])) >= 4))
        return F.struct(end.alias("at"), F.when(likely, F.concat(acc["out"], F.array(item))).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    return F.aggregate(parts, first, add, lambda acc: acc["out"])


def scan(docs: DataFrame) -> DataFrame:
    """row (hash of doc_id and text), doc_id, base spans and candidates of every row of ``docs``; one pass over the texts."""
    text = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", whole_text().alias("text"))
    based = text.withColumn("base", F.concat(*[_spans(F.col("text"), i) for i in range(len(KINDS))]))
    return based.select("row", "doc_id", "base", _candidates(F.col("text"), F.col("base")).alias("candidates"))


def learn_patterns(candidates: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """pattern, no (kind) and score of the patterns to trust. ``candidates``: word, pattern, no (null: unknown)."""
    edges = written(candidates.groupBy("pattern", "word").agg(F.max("no").alias("no")), "pii-edges")
    met = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= support)
    met = written(met, "pii-patterns")
    seeds = written(edges.where("no is not null").groupBy("word", "no").agg(F.lit(1.0).alias("score")), "pii-seeds")
    scores, trusted = seeds, None
    for _ in range(rounds):
        sums = edges.select("pattern", "word").join(scores, "word").groupBy("pattern", "no").agg(F.sum("score").alias("total"))
        trusted = sums.join(met, "pattern").select("pattern", "no", F.least(F.lit(1.0), F.col("total") / F.col("met")).alias("score"))
        trusted = written(trusted.where(F.col("score") >= confidence / 2), "pii-trusted")
        # The logarithm of the noisy-or's complement adds up; a full score is held just below one.
        doubt = F.sum(F.log(1 - F.least(F.col("score"), F.lit(0.999))))
        reached = edges.where("no is null").select("pattern", "word").join(trusted, "pattern").groupBy("word", "no")
        scores = written(seeds.unionByName(reached.agg((1 - F.exp(doubt)).alias("score"))), "pii-scores")
    return trusted.where(F.col("score") >= confidence)


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_learned.

    A null text counts as empty and has no spans. Spans read ``kind:start:end``, ordered by kind as listed, then start;
    learned spans never touch base ones. A word beside two trusted patterns takes the kind with the higher score, then the
    first kind. Repeated rows get the same spans; an empty table gives an empty result. Texts are searched whole, however
    long; as context of a candidate counts a word that lies within 60 characters of it, or as much of it as does.
    """
    scanned = written(scan(docs), "pii-scan")
    each = scanned.select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    sides = F.array(F.concat(F.lit("L "), F.col("left")), F.concat(F.lit("R "), F.col("right")))
    beside = each.select("row", "s", "e", "word", "no", F.explode(F.filter(sides, lambda x: F.length(x) > 2)).alias("pattern"))
    trusted = written(learn_patterns(beside.select("word", "pattern", "no"), rounds, confidence, support), "pii-learned")
    reached = beside.where("no is null").select("row", "s", "e", "pattern").join(trusted, "pattern")
    best = reached.groupBy("row", "s", "e").agg(F.max(F.struct("score", (-F.col("no")).alias("no"))).alias("b"))
    new = best.groupBy("row").agg(F.collect_set(F.struct((-F.col("b.no")).alias("no"), "s", "e")).alias("learned"))
    out = scanned.select("row", "doc_id", "base").join(written(new, "pii-new"), "row", "left")
    learned = F.coalesce("learned", F.array().cast("array<struct<no:int,s:int,e:int>>"))
    names = F.array(*map(F.lit, KINDS))

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["no"]), x["s"], x["e"])), ",")

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["no"] == kind)).cast("bigint")

    counts = [number(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return out.select(
        "doc_id",
        *counts,
        F.sha2(text(F.col("base")), 256).alias("base_sha256"),
        text(F.array_sort(F.concat("base", learned))).alias("spans"),
        F.size(learned).cast("bigint").alias("n_learned"),
    )
