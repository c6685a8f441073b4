"""Documents, vectors, answers and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import documents, tables
from millrace.operators.vectors import recall, vector_topk, vector_topk_lsh
from millrace.session import scratch
from testbed import inputs
from testbed.catalogue import add
from testbed.columns import present, shown
from testbed.oracle import statement

# White space beyond ASCII, for the checking engine's expression syntax.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def compact(expr: str) -> str:
    return f"trim(regexp_replace(coalesce({expr}, ''), '{SPACE}', ' ', 'g'))"


def strip(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '^{SPACE}', ''), '{SPACE}$', '')"


def files(spark, sf):
    """Pages and documents as a listing of binary files; some are of kinds that need a parser."""
    pages = inputs.table(spark, sf, "pages").select(
        F.concat(F.lit("/docs/pages/"), "page_id", F.lit(".HTML")).alias("path"), F.col("html").cast("binary").alias("content")
    )
    kind = F.when(F.col("doc_id") % 10 == 1, ".pdf").when(F.col("doc_id") % 10 == 2, ".md").otherwise(".txt")
    docs = inputs.table(spark, sf, "documents").select(
        F.concat(F.lit("/docs/texts/"), "doc_id", kind).alias("path"), F.col("text").cast("binary").alias("content")
    )
    return inputs.spread(pages.unionByName(docs))


def _html_sql(column: str) -> str:
    text = f"regexp_replace({column}, '(?is)<(script|style)\\b.*?</(script|style)\\s*>', ' ', 'g')"
    text = f"regexp_replace({text}, '(?s)<!--.*?-->', ' ', 'g')"
    text = f"regexp_replace({text}, '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return compact(text)


EXTRACTED = f"""(select concat(page_id, '.HTML') as filename, concat('/docs/pages/', page_id, '.HTML') as source_key,
        nullif({_html_sql('html')}, '') as extracted_text, case when {_html_sql('html')} = '' then 'failed' else 'html' end as extraction_method
    from pages
    union all
    select concat(doc_id, kind), concat('/docs/texts/', doc_id, kind), case when kind <> '.pdf' and {compact('text')} <> '' then text end,
        case when kind <> '.pdf' and {compact('text')} <> '' then 'plain_text' else 'failed' end
    from (select *, case doc_id % 10 when 1 then '.pdf' when 2 then '.md' else '.txt' end as kind from documents))"""


def extract(spark, sf):
    return documents.extract_text(files(spark, sf))


def routing(spark, sf):
    """New documents to store and to set aside, after a third was processed before."""
    found = extract(spark, sf)
    processed = (
        inputs.table(spark, sf, "documents")
        .where("doc_id % 3 = 0 and doc_id % 10 not in (1, 2)")
        .select(F.concat(F.lit("/docs/texts/"), "doc_id", F.lit(".txt")).alias("source_key"))
    )
    store, aside = documents.document_routing(found, processed)
    keep = ("source_key", "extraction_method")
    return store.select(F.lit("store").alias("route"), *keep).unionByName(aside.select(F.lit("aside").alias("route"), *keep))


ROUTED = f"""select case when extraction_method = 'failed' then 'aside' else 'store' end as route, source_key, extraction_method from {EXTRACTED}
    where source_key not in (select concat('/docs/texts/', doc_id, '.txt') from documents where doc_id % 3 = 0 and doc_id % 10 not in (1, 2))"""

WORDS = f"(select doc_id, string_split({compact('text')}, ' ') as w from documents where {compact('text')} <> '')"


def chunks(spark, sf):
    cut = documents.chunk_documents(inputs.spread(inputs.table(spark, sf, "documents").select("doc_id", "text")), "text")
    return cut.select("doc_id", "chunk_index", "total_chunks", "page_number", "chunk_text")


CHUNKS = f"""select doc_id, i::int as chunk_index, ((len(w) - 1) // 462 + 1)::int as total_chunks, (i + 1)::int as page_number,
    array_to_string(w[i * 462 + 1 : i * 462 + 512], ' ') as chunk_text
    from (select doc_id, w, unnest(range(0, (len(w) - 1) // 462 + 1)) as i from {WORDS})"""


def rebuild(spark, sf):
    """Chunks rebuilt twice in place: no repeats."""
    path = tables.table_path(scratch(spark, "lake"), "silver", "chunks")
    for _ in range(2):
        tables.write_layer_table(chunks(spark, sf), path)
    return spark.read.parquet(path).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.max("chunk_index").alias("last_index"), F.sum(F.length("chunk_text")).alias("chars")
    )


REBUILT = (
    f"select doc_id, count(*) as chunks, max(chunk_index) as last_index, sum(length(chunk_text))::bigint as chars from ({CHUNKS}) group by 1"
)


def topk(spark, sf, **options):
    """Every vector as a query against all vectors."""
    vectors = inputs.table(spark, sf, "embeddings")
    return vector_topk(vectors, vectors, **options)


# Near-uniform vectors: few bits, several probes.
LSH = {"tables": 8, "bits": 8, "probes": 24}


def topk_lsh(spark, sf):
    """The same through buckets of random projections."""
    vectors = inputs.table(spark, sf, "embeddings")
    return vector_topk_lsh(vectors, vectors, **LSH)


def lsh_recall(spark, sf):
    """What the buckets find of the exact hits."""
    return recall(topk_lsh(spark, sf), topk(spark, sf))


def _topk_sql(k: int, where: str = "true", measure: str = "list_cosine_similarity") -> str:
    return f"""(select q.vec_id as query_id, row_number() over (partition by q.vec_id order by
            round({measure}(q.embedding::double[], c.embedding::double[]), 12) desc, c.vec_id) as rank,
            c.vec_id as hit_id, {measure}(q.embedding::double[], c.embedding::double[]) as score
        from embeddings q join embeddings c on {where} qualify rank <= {k})"""


def hits(spark, sf):
    """Retrieved texts; every hit is delivered a second time behind the others."""
    found = topk(spark, sf)
    docs = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("hit_id"), "source", "text")
    joined = docs.join(found, "hit_id").select(
        "query_id", "rank", "source", (F.col("hit_id") % 2).alias("chunk_index"), "text", F.lit("plain_text").alias("extraction_method")
    )
    return joined.unionByName(joined.withColumn("rank", F.col("rank") + 4))


HITS = f"""(select h.query_id, h.rank + extra as rank, d.source, h.hit_id % 2 as chunk_index, d.text, 'plain_text' as extraction_method
    from {_topk_sql(4)} h join documents d on d.doc_id = h.hit_id, (values (0), (4)) v(extra))"""


def _excerpt_sql(limit: int) -> str:
    return f"case when length({compact('text')}) <= {limit} then {compact('text')} else concat(rtrim(substr({compact('text')}, 1, {limit})), '...') end"


SOURCES = f"""(select query_id, rank as ref, source, {_excerpt_sql(280)} as excerpt, chunk_index, extraction_method from {HITS}
    qualify row_number() over (partition by query_id, source, chunk_index, {_excerpt_sql(180)} order by rank) = 1)"""

CONTEXT = f"""select query_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as context,
    array_to_string(list_sort(list_distinct(list(source))), ', ') as sources from {HITS} where rank <= 10 group by 1"""

_PART = "split_part(response, 'ANSWER:', 2)"
_SAID = strip(f"split_part(split_part({_PART}, 'CONFIDENCE:', 2), 'SOURCES:', 1)")
PARSED = f"""(select conv_id, turn,
    case when not contains(response, 'ANSWER:') then response
         when contains({_PART}, 'CONFIDENCE:') then {strip(f"split_part({_PART}, 'CONFIDENCE:', 1)")}
         else {strip(_PART)} end as answer,
    case when contains(response, 'ANSWER:') and try_cast({_SAID} as double) is not null
         then greatest(0, least(1, try_cast({_SAID} as double))) else 0.5 end as confidence from answers)"""


def register() -> None:
    spec = "filename source_key extracted_text extraction_method"
    add("extract_text", extract, shown(EXTRACTED, spec))
    add(
        "document_stats",
        lambda s, sf: documents.document_stats(inputs.spread(inputs.table(s, sf, "documents")), "text").select("doc_id", "char_count", "word_count"),
        f"select doc_id, length(text) as char_count, case when {compact('text')} = '' then 0 else len(string_split({compact('text')}, ' ')) end "
        "as word_count from documents",
    )
    add("document_routing", routing, ROUTED)
    add("chunk_documents", chunks, CHUNKS)
    add("rebuild_chunks", rebuild, REBUILT)
    ranked = "query_id rank:n hit_id score:6"
    add("vector_topk", lambda s, sf: present(topk(s, sf), ranked), shown(_topk_sql(4), ranked))
    add(
        "vector_topk_filtered",
        lambda s, sf: present(topk(s, sf, k=3, where="label = 3"), ranked),
        shown(_topk_sql(3, "c.label = 3"), ranked),
    )
    add(
        "vector_topk_blocks",
        lambda s, sf: present(topk(s, sf, k=10, metric="dot", cell_values=8000), ranked),
        shown(_topk_sql(10, measure="list_inner_product"), ranked),
    )
    add("vector_topk_lsh", lambda s, sf: present(topk_lsh(s, sf), ranked))
    add("vector_lsh_recall", lsh_recall)
    sources = "query_id ref:n source excerpt chunk_index:n extraction_method"
    add("retrieval_sources", lambda s, sf: present(documents.retrieval_sources(hits(s, sf)), sources), shown(SOURCES, sources))
    add("context_assembly", lambda s, sf: documents.context_assembly(hits(s, sf)), CONTEXT)
    add(
        "parse_answers",
        lambda s, sf: present(documents.parse_answers(inputs.spark_input(s, sf, "answers")), "conv_id turn answer confidence:2"),
        shown(PARSED, "conv_id turn answer confidence:2"),
    )
    add(
        "route_questions",
        lambda s, sf: documents.route_questions(inputs.spark_input(s, sf, "questions")).select("conv_id", "turn", "route"),
        statement(
            "select conv_id, turn, case when regexp_matches(lower(question), 'oee|batch|machine|production|yield|quality|capa|inventory|shift|plant') "
            "then 'sql' else 'documents' end as route from questions"
        ),
    )
