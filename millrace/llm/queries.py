"""The operators applied to their whole tables, and the statements that check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import secrets
from millrace.llm.collocations import collocations
from millrace.llm.decontaminate import leaks_by_document
from millrace.llm.exact_dedup import exact_groups
from millrace.llm.language_id import predict_languages
from millrace.llm.license_scan import BASE, INDEX_WORDS, LEAST_SHARE, LOOKED_UP, TEMPLATES, scan_licenses
from millrace.llm.pii import find_personal_data
from millrace.llm.quality import score_quality
from millrace.llm.sentencepiece_codec import round_trip
from millrace.llm.simhash import near_groups
from millrace.llm.spelling_variants import group_variants
from millrace.llm.substring_dedup import passage_digests
from millrace.llm.url_filter import judge_urls

SENTENCEPIECE = "/opt/tokenizers/piece_bpe_32k.model"

# The rules of the task.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)
WINDOW same AS (PARTITION BY body)
"""


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), SENTENCEPIECE)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "rule string, action string"))


OP4_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule, h, p, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
ranked AS (
  SELECT page_id, host, path, rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS rank
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE rank = 1
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(_table(spark, sf_dir, "documents"), SENTENCEPIECE)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.find_secrets(docs, secrets.fit(docs))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks_by_document(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_digests(_table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS phrase
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM words WHERE len(w) >= 13)),
firsts AS (SELECT phrase, min(doc_id) AS least FROM windows GROUP BY phrase),
gone AS (
  SELECT doc_id, list(p) AS starts FROM windows JOIN firsts USING (phrase) WHERE least < doc_id GROUP BY doc_id),
positions AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM (SELECT doc_id, unnest(starts) AS s FROM gone)),
kept AS (
  SELECT each.doc_id, list(each.word ORDER BY each.p) AS k
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words) AS each
  ANTI JOIN positions ON each.doc_id = positions.doc_id AND each.p = positions.p
  GROUP BY each.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(len(k), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(_table(spark, sf_dir, "documents"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).drop("notices")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


def _passages() -> dict[str, str]:
    """The license passages as rows of SQL values."""
    split = [(t, label, passage.split(), some) for t, (label, passage, some) in enumerate(TEMPLATES)]
    return {
        "labels": _values((t, label) for t, label, _, _ in split),
        "words": _values((t, w, q) for t, _, words, _ in split for q, w in enumerate(words)),
        "keys": _values(
            (t, min(i for i in range(len(words)) if words[i : i + len(k.split())] == k.split()), len(k.split()), k)
            for t, _, words, some in split
            for k in some
        ),
        "base": _values((phrase.split()[0], len(phrase.split()), phrase, label) for phrase, label in BASE),
    }


OP12_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS id, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
places AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM words),
labels(t, label) AS (VALUES %(labels)s),
passages(t, word, q) AS (VALUES %(words)s),
keys(t, place, size, phrase) AS (VALUES %(keys)s),
base(word, size, phrase, label) AS (VALUES %(base)s),
held AS (SELECT word, count(DISTINCT id) AS df FROM places SEMI JOIN passages USING (word) GROUP BY word),
ranked AS (
  SELECT t, word, q, coalesce(df, 0) AS df, dense_rank() OVER (PARTITION BY t ORDER BY coalesce(df, 0), word) AS rank
  FROM passages LEFT JOIN held USING (word)),
postings AS (SELECT * FROM ranked WHERE rank <= %(index_words)s),
chosen AS (
  SELECT id, word FROM (SELECT DISTINCT id, word, df FROM places JOIN (SELECT DISTINCT word, df FROM postings) USING (word))
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY df, word) <= %(looked_up)s),
votes AS (
  SELECT DISTINCT id, t, i - q AS start, word FROM places JOIN chosen USING (id, word) JOIN postings USING (word)),
found AS (SELECT id, t, start, count(*) AS hits FROM votes WHERE start >= 0 GROUP BY id, t, start),
shares AS (
  SELECT id, t, start, hits / n AS share
  FROM found JOIN (SELECT t, count(DISTINCT word) AS n FROM postings GROUP BY t) USING (t)),
notices AS (
  SELECT id, t, start, share FROM shares JOIN keys USING (t) JOIN words USING (id) WHERE share >= %(least)s
  GROUP BY id, t, start, share HAVING bool_and(array_to_string(w[start + place + 1:start + place + size], ' ') = phrase)),
own AS (SELECT id, list(label) AS l, max(share) AS score FROM notices JOIN labels USING (t) GROUP BY id),
fixed AS (
  SELECT id, i, label FROM places JOIN base USING (word) JOIN words USING (id)
  WHERE array_to_string(w[i + 1:i + size], ' ') = phrase),
known AS (
  SELECT id, count(*) AS n, min(i) AS first_word, max(i) AS last_word, list(label) AS l FROM fixed GROUP BY id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, array_to_string(list_sort(list_distinct(coalesce(known.l, []))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(known.l, []), coalesce(own.l, [])))), ',') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score
FROM words LEFT JOIN known USING (id) LEFT JOIN own USING (id)
""" % (_passages() | {"index_words": INDEX_WORDS, "looked_up": LOOKED_UP, "least": LEAST_SHARE})


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
lengths AS (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS k FROM words),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lengths WHERE len(w) >= k),
counts AS (
  SELECT lang, k, w[i:i + k - 1] AS p, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.p, c.k, c.f AS a, x.f AS l, y.f AS r, n, unnest_k AS cut,
         (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS unnest_k FROM counts WHERE k > 1) AS c
  JOIN counts AS x ON x.lang = c.lang AND x.p = c.p[1:unnest_k]
  JOIN counts AS y ON y.lang = c.lang AND y.p = c.p[unnest_k + 1:]
  JOIN totals AS t ON t.lang = c.lang),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, p[j:j + m - 1] AS p, max(f) AS f
  FROM (SELECT lang, p, f, k, m, unnest(range(1, k - m + 2)) AS j
        FROM (SELECT *, unnest(range(2, k)) AS m FROM counts WHERE k > 2))
  GROUP BY ALL),
left_over AS (
  SELECT lowest.* FROM lowest LEFT JOIN longer ON longer.lang = lowest.lang AND longer.p = lowest.p
  WHERE longer.f IS NULL OR longer.f < a),
ranked AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank
  FROM left_over)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_url_filter": op4_url_filter,
    "op5_language_id": op5_language_id,
    "op6_secrets": op6_secrets,
    "op7_decontamination": op7_decontamination,
    "op8_simhash": op8_simhash,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality": op10_quality,
    "op11_spelling": op11_spelling,
    "op12_licenses": op12_licenses,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {
    "op2_exact_dedup": OP2_SQL,
    "op4_url_filter": OP4_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op12_licenses": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
