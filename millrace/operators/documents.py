"""Documents: text, statistics, routing, chunks, retrieval results, answers, questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import compact_whitespace, empty_safe_words
from millrace.functions.scalar import WHITESPACE
from millrace.operators.dedup import keep_first

# Suffixes read as plain text.
PLAIN_SUFFIXES = (".txt", ".md", ".csv", ".json", ".yml", ".yaml", ".log")
HTML_SUFFIXES = (".html", ".htm")

# Chunk length and overlap in words.
CHUNK_WORDS, CHUNK_OVERLAP = 512, 50

# Words that send a question to the tables instead of the documents.
TABLE_WORDS = ("oee", "batch", "machine", "production", "yield", "quality", "capa", "inventory", "shift", "plant")

# Excerpt lengths, context separator, confidence when none is stated.
EXCERPT, EXCERPT_KEY = 280, 180
CONTEXT_SEPARATOR = "\n\n---\n\n"
DEFAULT_CONFIDENCE = 0.5


def utf8_text(content: Column) -> Column:
    """Bytes as UTF-8 text, unreadable sequences left out."""
    raw = content.cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(F.make_valid_utf8(raw), F.lit("�"), F.lit("")))


def html_text(html: Column) -> Column:
    """Readable text of a page: no scripts, styles, comments or tags, basic entities resolved."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return compact_whitespace(text)


def _ends_with(name: Column, suffixes: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for suffix in suffixes:
        hit = hit | name.endswith(suffix)
    return hit


def extract_text(files: DataFrame) -> DataFrame:
    """Text of files (``path``, ``content``) by suffix: ``filename, source_key, extracted_text, extraction_method``.

    Files of other kinds, and files without text, come back with method ``failed`` and
    no text; ``extract_with`` takes a parser for those kinds.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    plain, page = _ends_with(name, PLAIN_SUFFIXES), _ends_with(name, HTML_SUFFIXES)
    body = utf8_text(F.col("content"))
    text = F.when(plain, body).when(page, html_text(body))
    method = F.when(plain, "plain_text").when(page, "html")
    found = files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("path").alias("source_key"),
        text.alias("_text"),
        method.alias("_method"),
    )
    has_text = F.coalesce(compact_whitespace(F.col("_text")) != "", F.lit(False))
    return found.select(
        "filename",
        "source_key",
        F.when(has_text, F.col("_text")).alias("extracted_text"),
        F.when(has_text, F.col("_method")).otherwise("failed").alias("extraction_method"),
    )


def extract_with(files: DataFrame, parser: Callable[[str, bytes], str], method: str) -> DataFrame:
    """The same for kinds that need a parser; an error in one file leaves the others alone."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    text = parser(path, bytes(content))
                except Exception:  # noqa: BLE001  (the document goes to the failed ones)
                    text = None
                texts.append(text if text and text.strip() else None)
            yield pd.DataFrame(
                {
                    "filename": [p.rsplit("/", 1)[-1] for p in batch["path"]],
                    "source_key": batch["path"],
                    "extracted_text": texts,
                    "extraction_method": [method if t else "failed" for t in texts],
                }
            )

    schema = "filename string, source_key string, extracted_text string, extraction_method string"
    return files.select("path", "content").mapInPandas(parse, schema)


def document_stats(df: DataFrame, text: str = "extracted_text") -> DataFrame:
    """Characters and words of each document."""
    return df.withColumns({"char_count": F.length(text), "word_count": F.size(empty_safe_words(F.col(text)))})


def document_routing(extracted: DataFrame, processed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents to store, documents to set aside) among those not processed before."""
    fresh = extracted.join(processed.select("source_key").distinct(), "source_key", "left_anti")
    return fresh.where(F.col("extraction_method") != "failed"), fresh.where(F.col("extraction_method") == "failed")


def chunk_documents(df: DataFrame, text: str, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Overlapping word windows: one row per chunk with its index, page number and the chunk count.

    Windows start every ``size - overlap`` words while a word is left, so the last one may
    lie wholly inside its predecessor's overlap. Whole texts are cut; empty ones give no row.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the chunk size")
    step = size - overlap
    worded = df.withColumn("_words", empty_safe_words(F.col(text)))
    starts = F.when(F.size("_words") > 0, F.sequence(F.lit(0), F.size("_words") - 1, F.lit(step))).otherwise(
        F.array().cast("array<int>")
    )
    pieces = F.transform(starts, lambda start: F.array_join(F.slice("_words", start + 1, size), " "))
    # The outer form on purpose: for the plain one the planner derives a "not empty" filter, pushes
    # it to the scan, and so splits every text again, once per piece.
    total = F.floor((F.size("_words") - 1) / step).cast("int") + 1
    # The count is taken from the words, so the list of pieces need not travel with every piece.
    return (
        worded.select(*df.columns, total.alias("total_chunks"), pieces.alias("_pieces"))
        .select(*df.columns, "total_chunks", F.posexplode_outer("_pieces").alias("chunk_index", "chunk_text"))
        .where(F.col("chunk_index").isNotNull())
        .withColumn("page_number", F.col("chunk_index") + 1)
    )


def excerpt(text: Column, limit: int = EXCERPT) -> Column:
    """Text on one line, cut at ``limit`` characters with an ellipsis."""
    compact = compact_whitespace(text)
    return F.when(F.length(compact) <= limit, compact).otherwise(
        F.concat(F.rtrim(F.substring(compact, 1, limit)), F.lit("..."))
    )


def retrieval_sources(hits: DataFrame) -> DataFrame:
    """Sources of each query's hits without repeats; a source keeps the number of its first hit.

    ``hits``: query_id, rank, source, chunk_index, text, extraction_method.
    """
    keyed = hits.withColumns(
        {"source": F.coalesce("source", F.lit("Unknown")), "_key": excerpt(F.col("text"), EXCERPT_KEY)}
    )
    first = keep_first(keyed, ["query_id", "source", "chunk_index", "_key"], [F.col("rank").asc()])
    return first.select(
        "query_id", F.col("rank").alias("ref"), "source", excerpt(F.col("text")).alias("excerpt"), "chunk_index", "extraction_method"
    )


def context_assembly(hits: DataFrame) -> DataFrame:
    """Per query: texts of the hits in rank order as one context, and the sorted distinct sources.

    The k of the retrieval bounds the lists; every hit handed in is used.
    """
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return (
        hits.groupBy("query_id")
        .agg(
            F.array_join(F.transform(ordered, lambda hit: hit["text"]), CONTEXT_SEPARATOR).alias("context"),
            F.array_join(F.array_sort(F.collect_set(F.coalesce("source", F.lit("Unknown")))), ", ").alias("sources"),
        )
    )


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WHITESPACE}|{WHITESPACE}$", "")


def parse_answers(df: DataFrame, response: str = "response") -> DataFrame:
    """Answer text and confidence out of ``ANSWER: .. CONFIDENCE: .. SOURCES: ..`` responses.

    A response without the ANSWER mark is the answer itself. The confidence is clamped to
    0..1 and rounded; one that is missing or not a number counts as one half.
    """
    whole = F.col(response)
    part = F.split_part(whole, F.lit("ANSWER:"), F.lit(2))
    has_answer = F.contains(whole, F.lit("ANSWER:"))
    has_confidence = has_answer & F.contains(part, F.lit("CONFIDENCE:"))
    said = _strip(F.split_part(F.split_part(part, F.lit("CONFIDENCE:"), F.lit(2)), F.lit("SOURCES:"), F.lit(1)))
    number = F.when(said.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), said.try_cast("double"))
    answer = (
        F.when(has_confidence, _strip(F.split_part(part, F.lit("CONFIDENCE:"), F.lit(1))))
        .when(has_answer, _strip(part))
        .otherwise(whole)
    )
    confidence = F.when(has_confidence, F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    # greatest/least skip NULL, so an unreadable number is replaced before they could turn it into a bound.
    confidence = F.when(number.isNull(), F.lit(DEFAULT_CONFIDENCE)).otherwise(confidence)
    return df.withColumns({"answer": answer, "confidence": F.round(F.coalesce(confidence, F.lit(DEFAULT_CONFIDENCE)), 2)})


def route_questions(df: DataFrame, question: str = "question") -> DataFrame:
    """Send questions that mention a table word to ``sql``, all others to ``documents``."""
    mentions = F.lower(question).rlike("|".join(TABLE_WORDS))
    return df.withColumn("route", F.when(mentions, "sql").otherwise("documents"))

