"""Functions of SQL that make rows of texts, on literal cases and against the column functions."""

import pytest
from pyspark.errors import AnalysisException

from vellum.functions import tables
from vellum.operators import text as T

DOCS = [(1, "en", "a" * 30 + "\n" + "b" * 30 + "\n" + "c" * 30), (2, "de", None), (3, "fr", ""), (4, None, "One. Two; three, four. " * 20), (5, "en", "x" * 500)]
REVIEW = "# 建议\n1. not this\n# 质询问题\n1. first\nmore of it\n2. second\n\nbetween\n3. third\n# End\n4. none"


@pytest.fixture
def docs(spark):
    tables.register(spark)
    rows = spark.createDataFrame(DOCS, "doc_id long, lang string, text string")
    rows.createOrReplaceTempView("some_docs")
    return rows


def test_paragraphs_go_whole(spark, docs):
    got = spark.sql("SELECT c.* FROM some_docs d, LATERAL chunk_text(d.text, 64, 31) c WHERE d.doc_id = 1 ORDER BY chunk").collect()
    assert [(r.chunk, r.start, r.stop, r.chunk_text) for r in got] == [(0, 0, 61, "a" * 30 + "\n" + "b" * 30), (1, 31, 92, "b" * 30 + "\n" + "c" * 30)]


def test_long_paragraphs_are_cut_at_sentences(spark, docs):
    got = spark.sql("SELECT c.* FROM some_docs d, LATERAL chunk_text(d.text, 100, 10) c WHERE d.doc_id = 4 ORDER BY chunk").collect()
    # A sentence's end is worth more than reach; the next chunk begins ten characters before it.
    assert all(r.chunk_text.rstrip().endswith(".") for r in got) and [b.start for b in got[1:]] == [a.stop - 10 for a in got[:-1]]
    hard = spark.sql("SELECT c.start, c.stop FROM some_docs d, LATERAL chunk_text(d.text, 200, 50) c WHERE d.doc_id = 5 ORDER BY chunk").collect()
    assert [tuple(r) for r in hard] == [(0, 200), (150, 350), (300, 500)]


def test_lateral_and_table_are_as_chunks(spark, docs):
    want = sorted(map(tuple, T.chunks(docs, 64, 31).collect()))
    lateral = spark.sql("SELECT d.doc_id, c.* FROM some_docs d, LATERAL chunk_text(d.text, 64, 31) c")
    assert sorted(map(tuple, lateral.collect())) == want and {r[0] for r in want} == {1, 4, 5}
    whole = spark.sql("SELECT * FROM chunk_table(TABLE(some_docs), 'text', 64, 31)")
    assert whole.columns == ["doc_id", "lang", "chunk", "start", "stop", "chunk_text"]
    assert sorted(tuple(r[c] for c in ("doc_id", "chunk", "start", "stop", "chunk_text")) for r in whole.collect()) == want
    assert {(r.doc_id, r.lang) for r in whole.collect()} == {(1, "en"), (4, None), (5, "en")}
    parts = spark.sql("SELECT * FROM chunk_table(TABLE(some_docs) PARTITION BY (lang) ORDER BY (doc_id), 'text', 64, 31)")
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    assert spark.sql("SELECT * FROM chunk_table(TABLE(SELECT * FROM some_docs WHERE false), 'text')").count() == 0


def test_faults_are_told_before_a_run(spark, docs):
    for call in ("TABLE(some_docs), 'none'", "TABLE(SELECT doc_id AS chunk, text FROM some_docs), 'text'", "'no table', 'text'"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM chunk_table({call})")


def test_numbered_remarks(spark, docs):
    spark.createDataFrame([(1, REVIEW), (2, None), (3, "no items")], "doc_id long, text string").createOrReplaceTempView("some_reviews")
    got = spark.sql("SELECT r.doc_id, n.* FROM some_reviews r, LATERAL numbered_remarks(r.text, 4) n ORDER BY doc_id, pos").collect()
    assert [tuple(r) for r in got] == [(1, 0, "first more of it"), (1, 1, "second"), (1, 2, "third")]
