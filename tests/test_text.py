import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import documents, vectors
from millrace.operators.vectors import _grid, recall, vector_topk, vector_topk_lsh


def expected_chunks(text, size=512, overlap=50):
    words = text.split()
    starts = range(0, len(words), size - overlap)
    return [" ".join(words[s : s + size]) for s in starts]


@pytest.mark.parametrize("count", [0, 1, 461, 462, 463, 511, 512, 513, 924, 925, 3000])
def test_chunks(spark, count):
    text = "  " + " \n".join(f"w{i}" for i in range(count)) + "\t"
    got = documents.chunk_documents(spark.createDataFrame([(1, text)], "id int, text string"), "text").orderBy("chunk_index").collect()
    want = expected_chunks(text)
    assert [r["chunk_text"] for r in got] == want
    assert [(r["chunk_index"], r["page_number"], r["total_chunks"]) for r in got] == [(i, i + 1, len(want)) for i in range(len(want))]


def test_chunks_of_missing_text_and_odd_sizes(spark):
    df = spark.createDataFrame([(1, None), (2, "   "), (3, "a b c d e")], "id int, text string")
    got = documents.chunk_documents(df, "text", size=3, overlap=1).orderBy("chunk_index").collect()
    assert [r["chunk_text"] for r in got] == ["a b c", "c d e", "e"]
    with pytest.raises(ValueError):
        documents.chunk_documents(df, "text", size=3, overlap=3)


def test_texts_are_split_once(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "id int, text string").write.parquet(str(tmp_path / "t"))
    df = documents.chunk_documents(spark.read.parquet(str(tmp_path / "t")), "text")
    assert df._jdf.queryExecution().executedPlan().toString().count("split(") == 1


def test_extract_text(spark):
    rows = [
        ("/d/a.TXT", "héllo".encode()),
        ("/d/b.txt", b"ok \xff\xfe bytes"),
        ("/d/c.html", b"<html><style>p{}</style><p>A &amp; B&lt;c&gt;</p><!-- no --><script>x<1</script></html>"),
        ("/d/d.md", b"  \n"),
        ("/d/e.pdf", b"%PDF"),
    ]
    got = {r["filename"]: (r["extracted_text"], r["extraction_method"]) for r in documents.extract_text(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {
        "a.TXT": ("héllo", "plain_text"),
        "b.txt": ("ok  bytes", "plain_text"),
        "c.html": ("A & B<c>", "html"),
        "d.md": (None, "failed"),
        "e.pdf": (None, "failed"),
    }


def test_parser_errors_stay_in_their_document(spark):
    def parser(path, content):
        if path.endswith("bad"):
            raise ValueError(path)
        return content.decode().upper()

    rows = [("/d/1.ok", b"x"), ("/d/2.bad", b"y"), ("/d/3.ok", b" ")]
    got = documents.extract_with(spark.createDataFrame(rows, "path string, content binary"), parser, "upper").orderBy("filename").collect()
    assert [(r["extracted_text"], r["extraction_method"]) for r in got] == [("X", "upper"), (None, "failed"), (None, "failed")]


def test_stats(spark):
    df = spark.createDataFrame([("a  b",), ("",), (None,)], "extracted_text string")
    assert [(r["char_count"], r["word_count"]) for r in documents.document_stats(df).collect()] == [(4, 2), (0, 0), (None, 0)]


@pytest.mark.parametrize(
    "response, answer, confidence",
    [
        ("ANSWER: yes\nCONFIDENCE: 0.9\nSOURCES: a", "yes", 0.9),
        ("ANSWER: yes CONFIDENCE: 0.9", "yes", 0.9),
        ("ANSWER: yes", "yes", 0.5),
        ("just text", "just text", 0.5),
        ("just text CONFIDENCE: 0.9", "just text CONFIDENCE: 0.9", 0.5),
        ("ANSWER: a CONFIDENCE: high SOURCES: b", "a", 0.5),
        ("ANSWER: a CONFIDENCE: 7", "a", 1.0),
        ("ANSWER: a CONFIDENCE: -3", "a", 0.0),
        ("ANSWER: a CONFIDENCE: 0.456", "a", 0.46),
        ("ANSWER: a ANSWER: b CONFIDENCE: 0.1", "a", 0.5),
        ("ANSWER:", "", 0.5),
    ],
)
def test_answers(spark, response, answer, confidence):
    row = documents.parse_answers(spark.createDataFrame([(response,)], "response string")).first()
    assert (row["answer"], row["confidence"]) == (answer, confidence)


def test_questions(spark):
    texts = ["What is the OEE?", "Summarise the manual", "mechanics", "shiftless", None]
    got = documents.route_questions(spark.createDataFrame([(t,) for t in texts], "question string")).collect()
    assert [r["route"] for r in got] == ["sql", "documents", "documents", "sql", "documents"]


def test_sources_and_context(spark):
    long = "word " * 100
    rows = [
        (1, 1, "b.txt", 0, long, "m"),
        (1, 2, "a.txt", 0, "x", "m"),
        (1, 3, "b.txt", 0, long + "other tail beyond the compared part", "m"),
        (1, 4, None, None, "y", "m"),
        (2, 1, "c.txt", 1, "z", "m"),
    ]
    hits = spark.createDataFrame(rows, "query_id int, rank int, source string, chunk_index int, text string, extraction_method string")
    sources = documents.retrieval_sources(hits).orderBy("query_id", "ref").collect()
    assert [(r["query_id"], r["ref"], r["source"]) for r in sources] == [(1, 1, "b.txt"), (1, 2, "a.txt"), (1, 4, "Unknown"), (2, 1, "c.txt")]
    assert sources[0]["excerpt"] == long[:280].rstrip() + "..."
    context = {r["query_id"]: r for r in documents.context_assembly(hits).collect()}
    assert context[1]["sources"] == "Unknown, a.txt, b.txt"
    assert context[1]["context"].split(documents.CONTEXT_SEPARATOR)[1] == "x" and context[2]["context"] == "z"


def brute_topk(queries, corpus, k, metric):
    def score(a, b):
        value = float(np.dot(a, b))
        if metric == "cosine":
            norm = float(np.linalg.norm(a) * np.linalg.norm(b))
            value = value / norm if norm else 0.0
        return round(value, 9)

    found = {}
    for q, v in queries:
        ranked = sorted(((-score(v, w), c) for c, w in corpus))[:k]
        found[q] = [c for _, c in ranked]
    return found


@pytest.mark.parametrize("metric", ["cosine", "dot"])
@pytest.mark.parametrize("cell_values", [1 << 20, 30, 9])
def test_topk_equals_brute_force(spark, metric, cell_values):
    rng = random.Random(5)
    # Few distinct small integers give many exact ties; some vectors are zero.
    vector = lambda: [float(rng.randint(-1, 1)) for _ in range(3)]
    corpus, queries = [(i, vector()) for i in range(200)], [(1000 + i, vector()) for i in range(25)]
    schema = "vec_id bigint, embedding array<float>"
    got = vector_topk(spark.createDataFrame(queries, schema), spark.createDataFrame(corpus, schema).repartition(5), 4, metric=metric, cell_values=cell_values)
    ranked = {}
    for row in got.orderBy("query_id", "rank").collect():
        ranked.setdefault(row["query_id"], []).append(row["hit_id"])
    assert ranked == brute_topk(queries, corpus, 4, metric)


def test_topk_with_filter_and_small_corpus(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 2), (3, None, 1)], schema)
    got = vector_topk(df.where("vec_id = 2"), df, 4, where=F.col("label") == 1).collect()
    assert [(r["query_id"], r["rank"], r["hit_id"]) for r in got] == [(2, 1, 1)]
    assert vector_topk(df.where("vec_id > 9"), df, 4).count() == 0
    with pytest.raises(ValueError):
        vector_topk(df, df, 11)


def test_vectors_of_other_sizes_and_with_gaps_match_nothing(spark):
    schema = "vec_id bigint, embedding array<float>"
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [1.0, None]), (4, []), (5, None), (6, [0.0, 0.0])], schema)
    for found in (vector_topk(df.where("vec_id = 1"), df, 4), vector_topk_lsh(df.where("vec_id = 1"), df, 4, bits=1, probes=2)):
        assert [(r["hit_id"], r["score"]) for r in found.orderBy("rank").collect()] == [(1, 1.0), (6, 0.0)]
    assert vector_topk_lsh(df.where("vec_id = 5"), df, 4).count() == 0


def test_queries_and_corpus_stay_off_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id bigint, embedding array<float>")
    collect = DataFrame.collect

    def one_row(self):
        rows = collect(self)
        assert len(rows) <= 1
        return rows

    monkeypatch.setattr(DataFrame, "collect", one_row)
    for search in (vector_topk, vector_topk_lsh):
        assert "FlatMapCoGroupsInArrow" in search(df, df, 1)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("cell_values", [1 << 20, 200])
def test_lsh_finds_most_neighbours(spark, cell_values):
    """Clustered vectors, a third of them equal: hot buckets are cut into blocks and nothing is lost by that."""
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in centres[i % 20]] if i % 3 else centres[0]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    queries = df.where("vec_id % 10 = 0")
    exact = vector_topk(queries, df, 4)
    found = vector_topk_lsh(queries, df, 4, tables=6, bits=8, probes=12, cell_values=cell_values)
    best = recall(found, exact).first()
    assert best["exact_hits"] == 160 and best["recall"] >= 0.9
    # Whatever is found has its exact score.
    both = found.withColumnRenamed("score", "s").join(vector_topk(queries, df, 10), ["query_id", "hit_id"])
    assert both.where("abs(s - score) > 1e-9").count() == 0


def test_recall_without_hits(spark):
    none = spark.createDataFrame([], "query_id bigint, hit_id bigint")
    assert tuple(recall(none, none).first()) == (0, 0, None)


def test_topk_has_no_product_of_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    plan = vector_topk(df, df, 1)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and plan.count("WindowGroupLimit") == 2


def test_small_products_do_not_multiply_the_rows_that_move(spark):
    across, down = _grid(720_000, 720_000, 64, 8000, 12)
    assert across <= 25 and down <= 25
    assert _grid(2000, 2000, 64, 8000, 12) == (1, 12)
    assert _grid(0, 0, 0, 8000, 4) == (1, 4)


def test_few_scores_of_a_product_are_looked_at_again(monkeypatch):
    """Each score costs one comparison; rounding and sorting are for those that may be among the best."""
    numbers = np.random.default_rng(3)
    values = numbers.integers(-3, 4, size=(900, 4)).astype(float)  # many ties
    values[::50] = 0.0
    table = pa.table({"id": pa.array(numbers.permutation(900)), "v": pa.array(list(values), pa.list_(pa.float64()))})
    ids = table.column("id").to_numpy()
    rounded, real = [], np.round
    monkeypatch.setattr(vectors.np, "round", lambda x, *rest: rounded.append(x.size) or real(x, *rest))
    for metric, cell_values in (("dot", 400), ("cosine", 400), ("dot", 1 << 20)):
        rounded.clear()
        got = vectors._cell(3, metric, 4, cell_values)(table, table)
        assert sum(rounded) < 900 * 900 / 4
        unit = vectors._unit_rows(values) if metric == "cosine" else values
        scores = real(unit @ unit.T, 12)
        want = {(q, h, -s) for i, q in enumerate(ids) for s, h in sorted(zip(-scores[i], ids))[:3]}
        assert {tuple(r.values()) for r in got.to_pylist()} == want
