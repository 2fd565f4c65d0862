"""The parse deals its lines out once and sorts them once; captions take the lines after them as before; checks don't move contents."""

import re

from pyspark.sql import functions as F

from vellum.operators import citations, dictionary, parse


def _lines(spark, rows):
    schema = "doc_id long, line_no long, page_num int, content string, size double, x0 double, y0 double, x1 double, y1 double"
    return spark.createDataFrame([(d, n, p, c, 10.0, x, 10.0 * n, x + 100.0, 10.0 * n + 9) for d, n, p, c, x in rows], schema)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_exchange_and_one_sort(spark):
    plan = _plan(parse.parse(_lines(spark, [(1, 1, 1, "A line of text", 5.0)])))
    assert len(re.findall(r"Exchange ", plan)) == 1 and len(re.findall(r"\bSort ", plan)) == 1


def test_lines_after_captions(spark):
    rows = [(1, 1, 1, "Figure 1 First shown", 5.0), (1, 2, 1, "goes on here", 3.0), (1, 3, 1, "and on here", 200.0), (1, 4, 1, "but not here", 5.0)]
    rows += [(1, 5, 1, "Figure 2 Second shown", 5.0), (1, 6, 1, "Figure 3 Third shown", 5.0), (1, 7, 1, "x" * 91, 5.0), (1, 8, 1, "not after a long line", 5.0)]
    rows += [(1, 9, 1, "Figure 4 Last of its page", 5.0), (1, 10, 2, "of the next page", 5.0)]
    for long in (parse.LONG, 5):
        got = {r.seq // 100: r for r in parse.parse(_lines(spark, rows), long).where("seq % 100 = 99").collect()}
        assert sorted(got) == [1, 4, 5, 6, 7, 8, 9, 10]
        assert got[1].content == "Figure 1 First shown goes on here and on here" and (got[1].x0, got[1].x1, got[1].y1) == (3.0, 300.0, 39.0)
        assert [got[n].content for n in (5, 6, 9)] == ["Figure 2 Second shown", "Figure 3 Third shown", "Figure 4 Last of its page"]


def test_references_are_found_without_windows(spark):
    rows = [(1, 1, 1, "Plain text", "main"), (1, 2, 2, "[1] Someone", "reference"), (1, 3, 3, "1. An item of some length in a list", "main"), (2, 1, 1, "1. An item of some length, before", "main"), (2, 2, 4, "2. An item of some length in a list", "main"), (2, 3, 4, "3. short", "main")]
    e = spark.createDataFrame(rows, "doc_id long, seq long, page_num int, content string, region string")
    refs = citations.reference_rows(e)
    assert "Window" not in _plan(refs)
    # Of a document that has a reference, items of lists aren't; of another those of its last pages are.
    assert sorted((r.doc_id, r.seq) for r in refs.collect()) == [(1, 2), (2, 2)]


def test_texts_without_a_form_stay_with_spark(spark):
    texts = spark.createDataFrame([(1, "a DEEP-Learning x"), (2, "nothing"), (3, "maſk here"), (4, "深度学习"), (5, "two  words"), (6, None)], "doc_id long, content string")
    forms = [(0, "deep-learning", False), (1, "mask", False), (2, "深度", False), (3, "two words", True)]
    kept = texts.where(dictionary.may_have(F.col("content"), forms))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    got = dictionary.find_forms(texts, spark.createDataFrame(forms, "entry int, form string, loose boolean"))
    assert sorted((r.doc_id, r.entry) for r in got.collect()) == [(1, 0), (3, 1), (4, 2), (5, 3)]
