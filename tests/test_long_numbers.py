"""Lines that begin with numbers beyond those of machines are headings with that number."""

import __spark_entry__ as entry
from tests.test_predicates import ask
from vellum.functions import predicates as B

CARD = "4373275973027849 Beta gamma"


def test_numbers_of_headings_are_whole(spark, monkeypatch):
    assert ask(spark, B.heading_parts, [CARD, "2.99999999999 x1"]) == [[4373275973027849], [2, 99999999999]]
    docs = spark.createDataFrame([(1, CARD), (2, "12 3+4"), (3, "01.2 Title")], "doc_id long, text string")
    monkeypatch.setattr(entry.engine, "lines", lambda *_: docs.selectExpr("doc_id", "1L as line_no", "text as content"))
    got = {r.doc_id: r.number for r in entry.engine.QUERIES["headings"](spark, "").collect()}
    assert got == {1: "4373275973027849", 2: "12", 3: "01.2"}
