"""Benchmark decontamination on templates.

Numbers, names and units become typed placeholders, so a question with other values keeps its template. Windows of
template words are hashed; the benchmark's windows are joined to the documents' by hash. A document and an item that share
a window are laid side by side at its offset. They match if enough template words in a row are equal and the values in the
placeholders of that run correspond one to one: the same value of the item always meets the same value in the document.
What the rest of the item meets in the document plays no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import whole_text, written

WINDOW = 8  # words of a window
LEAST = 13  # equal words in a row that make a match; shorter items must be covered whole
LITERAL = 4  # words of a match that are no placeholders, at least
BROADCAST_ROWS = 1_000_000  # benchmark windows (about 40 MB) that are sent to every executor; more are joined by shuffle

# Units that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi miles meters metres mg g kg lb lbs oz tons ml l liters litres s sec seconds min minutes h hours "
    "days weeks months years mph kmh hz khz mhz w kw kwh v a j n c f percent dollars cents euros pounds usd eur gbp kb mb gb tb"
)


def raw_words(text: Column) -> Column:
    """Words joined by one space. A capital that starts a sentence is marked with ^; numbers and hyphenated words stay whole."""
    out = F.translate(text, "^", " ")
    out = F.regexp_replace(out, r"(?<=[0-9])[.,:/](?=[0-9])|(?<=\p{L})['’-](?=\p{L})", "_")
    out = F.regexp_replace(out, r"(^|[.!?\n])([^\p{L}\p{N}.!?\n]{0,4}+)(\p{Lu})", r"$1$2^$3")
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}_^]++", " "))


def template_of(words: Column) -> Column:
    """``raw_words`` with placeholders, in lower case; as many words as before."""
    out = F.regexp_replace(words, r"(?<![^ ])[0-9][^ ]*+", "<num>")
    out = F.regexp_replace(out, rf"(?<=<num> )(?i:{UNITS.replace(' ', '|')})(?![^ ])", "<unit>")
    out = F.regexp_replace(out, r"(?<![^ ])\p{Lu}[\p{Ll}_][^ ]*+", "<name>")
    return F.lower(F.translate(out, "^", ""))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _windows(words: Column, window: int, step: int) -> Column:
    """(at, hash) of every ``step``-th window; at counts from 0."""
    empty = F.array().cast("array<struct<at:int,hash:bigint>>")
    return F.when(
        F.size(words) >= window,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - (window - 1), F.lit(step)),
            lambda i: F.struct((i - 1).alias("at"), F.xxhash64(F.slice(words, i, window)).alias("hash")),
        ),
    ).otherwise(empty)


def _is_slot(word: Column) -> Column:
    return word.isin("<num>", "<unit>", "<name>")


def _looked_up(words: Column, window: int, step: int) -> Column:
    """(at, hash) of every ``step``-th window, and where that is all placeholders, of all windows that can stand in for it."""
    empty = F.array().cast("array<struct<at:int,hash:bigint>>")
    last = F.size(words) - (window - 1)
    near = lambda i: F.sequence(F.greatest(F.lit(1), i - (step - 1)), F.least(last, i + (step - 1)))
    places = F.transform(
        F.sequence(F.lit(1), last, F.lit(step)), lambda i: F.when(F.forall(F.slice(words, i, window), _is_slot), near(i)).otherwise(F.array(i))
    )
    hashed = F.transform(
        F.array_distinct(F.flatten(places)),
        lambda i: F.struct((i - 1).alias("at"), F.xxhash64(F.slice(words, i, window)).alias("hash")),
    )
    return F.when(F.size(words) >= window, hashed).otherwise(empty)


def _longest_run(pairs: Column, need: Column, corresponding: bool) -> Column:
    """Most ``pairs`` in a row that are the same, ``need`` or more with ``LITERAL`` words that are no placeholders; or 0.

    With ``corresponding``, the values within the run also correspond one to one.
    """
    same = lambda x: F.coalesce(x["same"], F.lit(False))

    def after_conflict(x: Column, slots: Column) -> Column:
        """The place after the last earlier slot that maps one of x's values to another one."""
        differs = lambda y: (y["kind"] == x["kind"]) & ((y["mine"] == x["mine"]) != (y["theirs"] == x["theirs"]))
        return F.aggregate(
            slots, F.lit(0), lambda acc, y: F.when((y["at"] < x["at"]) & differs(y), F.greatest(acc, y["at"] + 1)).otherwise(acc)
        )

    def longest(slots: Column) -> Column:
        def first(acc: Column, x: Column) -> Column:
            moved = acc["first"]
            if corresponding:
                moved = F.when(_is_slot(x["kind"]), F.greatest(moved, after_conflict(x, slots))).otherwise(moved)
            return F.when(same(x), moved).otherwise(x["at"] + 1)

        def literal(f: Column, size: Column) -> Column:
            return F.size(F.filter(F.slice(pairs, f + 1, size), lambda y: ~_is_slot(y["kind"])))

        def most(acc: Column, f: Column, size: Column) -> Column:
            longer = (size >= need) & (size > acc["most"])
            return F.when(F.when(longer, literal(f, size)).otherwise(0) >= LITERAL, size).otherwise(acc["most"])

        return F.aggregate(
            pairs,
            F.struct(F.lit(0).alias("first"), F.lit(0).alias("most")),
            lambda acc, x: _let(first(acc, x), lambda f: F.struct(f.alias("first"), most(acc, f, x["at"] + 1 - f).alias("most"))),
            lambda acc: acc["most"],
        )

    return _let(F.filter(pairs, lambda x: same(x) & _is_slot(x["kind"])), longest)


def _hits(docs: DataFrame, items: DataFrame, window: int, least: int) -> DataFrame:
    """row, item and offset of every document and item that share a window there.

    A match covers ``least`` words in a row, so it holds ``least - window + 1`` windows in a row; documents therefore
    only need every so manyth window, while items have all of theirs. Shorter items shorten that step. Windows of
    placeholders alone are not joined; a document looks up all windows around one of its own.
    """
    shortest = items.where(F.size("template") >= window).agg(F.min(F.size("template"))).first()[0]
    step = min(least, shortest or least) - window + 1
    of_item = items.select("item", "template", F.explode(_windows(F.col("template"), window, 1)).alias("w"))
    literal = F.exists(F.slice("template", F.col("w.at") + 1, window), lambda x: ~_is_slot(x))
    of_item = written(of_item.where(literal).select("item", F.col("w.at").alias("at"), F.col("w.hash").alias("hash")), "leaks-windows")
    found = _let(F.split(template_of(raw_words(whole_text())), " "), lambda t: _looked_up(t, window, step))
    of_doc = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.explode(found).alias("w")).select("row", "w.at", "w.hash")
    side = F.broadcast(of_item) if of_item.count() <= BROADCAST_ROWS else of_item
    met = of_doc.withColumnRenamed("at", "place").join(side, "hash")
    return met.select("row", "item", (F.col("place") - F.col("at")).alias("offset")).distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """Matches: row (hash of doc_id and text), item_id, words (longest run in common) and whether its values correspond.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. Null texts count as empty. A match is a run of ``least``
    equal template words, or all of a shorter item, that has ``LITERAL`` words that are no placeholders. Items with fewer than
    ``window`` words match nothing, and neither do ``window`` placeholders in a row. Of runs that are long enough, one
    whose values correspond goes first. Repeated rows of either table give the same matches once.
    """
    items = benchmark.select(F.col("item_id").alias("item"), raw_words(whole_text()).alias("words")).distinct()
    items = items.select("item", F.split("words", " ").alias("mine"), F.split(template_of(F.col("words")), " ").alias("template"))
    items = written(items, "leaks-items")
    hits = written(_hits(docs, items, window, least), "leaks-hits")
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row"), whole_text().alias("text"))
    met = texts.join(hits.select("row").distinct(), "row", "left_semi").select("row", raw_words(F.col("text")).alias("words")).distinct()
    met = written(met.select("row", F.split("words", " ").alias("theirs"), F.split(template_of(F.col("words")), " ").alias("other")), "leaks-met")
    both = met.join(hits, "row").join(items, "item")
    pairs = F.transform(
        "template",
        lambda kind, i: F.struct(
            i.alias("at"),
            kind.alias("kind"),
            (kind == F.get("other", i + F.col("offset"))).alias("same"),
            F.get("mine", i).alias("mine"),
            F.get("theirs", i + F.col("offset")).alias("theirs"),
        ),
    )
    both = written(both.select("row", "item", F.size("template").alias("size"), pairs.alias("pairs")), "leaks-pairs")
    need = F.least(F.lit(least), F.col("size"))
    both = both.select(
        "row",
        F.col("item").alias("item_id"),
        _longest_run(F.col("pairs"), need, False).alias("run"),
        _longest_run(F.col("pairs"), need, True).alias("whole"),
    )
    both = both.where("run > 0").withColumn("consistent", F.col("whole") > 0)
    words = F.when(F.col("consistent"), F.col("whole")).otherwise(F.col("run"))
    return both.select("row", "item_id", words.alias("words"), "consistent").distinct()


def leaks_by_document(docs: DataFrame, benchmark: DataFrame, **sizes: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, n_items, item_id (the smallest), words (most covered by a match).

    A null text is clean, and so is every text if ``benchmark`` is empty. Rows are told apart by doc_id and text, so repeated
    rows and null ids get the result of their text. An empty table gives an empty result.
    """
    found = find_leaks(docs, benchmark, **sizes).where("consistent").groupBy("row")
    found = written(
        found.agg(F.countDistinct("item_id").alias("n_items"), F.min("item_id").alias("item_id"), F.max("words").alias("words")), "leaks"
    )
    out = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row")).join(found, "row", "left")
    return out.select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "item_id",
        F.coalesce("words", F.lit(0)).alias("words"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **sizes: int) -> DataFrame:
    """``docs``, all its columns, without the rows that hold a passage of ``benchmark``.

    Null and empty texts stay, whatever their id; repeated rows go together; an empty table stays empty.
    """
    gone = written(find_leaks(docs.select("doc_id", "text"), benchmark, **sizes).where("consistent").select("row").distinct(), "leaks-gone")
    return docs.withColumn("_millrace_row", F.xxhash64("doc_id", "text")).join(
        gone.withColumnRenamed("row", "_millrace_row"), "_millrace_row", "left_anti"
    ).select(*docs.columns)
