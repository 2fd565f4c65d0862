"""Checks that read what they need: no parse for pages, no contents in windows, no places of letters without a form."""

import random
import re

from pyspark.sql import functions as F

from vellum.operators import citations, dictionary, parse, structure
from vellum.plans import queries
from vellum.schemas import ELEMENT
from vellum.sources import documents as D


def made(spark, texts):
    return spark.createDataFrame([(1, k, "text", t, 0.0, 0.0, 1.0, 1.0, 1, "main") for k, t in enumerate(texts)], ELEMENT)


def test_document_pages_needs_no_parse(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(1, "a\n" * 20 + "Figure 1 x\ny z w"), (2, " \n　\n"), (3, None), (4, "\n" * 9 + "b")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    held = D.placed_lines(docs)
    assert set(map(tuple, parse.pages_held(held).distinct().collect())) == set(map(tuple, parse.parse(held).select("doc_id", "page_num").distinct().collect()))

    def none(*_):
        raise AssertionError("parsed")

    monkeypatch.setattr(queries, "elements", none)
    assert {r.doc_id: r.pages for r in queries.document_pages(spark, str(tmp_path)).where("doc_id in (1, 4)").collect()} == {1: "1-3", 4: "1-2"}


def test_offsets_move_lengths_only(spark):
    rows = parse.with_offsets(made(spark, ["a", "", "bcd"])).select("doc_id", "start", "stop", "page_num")
    assert sorted(map(tuple, rows.collect())) == [(1, 0, 1, 1), (1, 2, 5, 1)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Project \[[^\n]*(?<!\()content#", plan), plan


def test_places_of_letters_only_where_a_form_is(monkeypatch):
    forms = [(0, "deep learning", True), (1, "TensorFlw", True), (2, "ß-Net", False)]
    found = dictionary._automaton("lean", forms)
    assert dictionary.hits_in("x  DEEP \n learning, É tensorflw", found) == [(0, 3, 18), (1, 22, 31)]
    monkeypatch.setattr(dictionary, "_drawn_together", lambda t: 1 / 0)
    assert dictionary.hits_in("a  text with \t no form é", found) == []
    rng = random.Random(3)
    for text in ("".join(chr(rng.choice((rng.randrange(32, 0x600), rng.randrange(0x1E00, 0x2200), 0x1F600))) for _ in range(300)) for _ in range(200)):
        up = "".join(u if len(u := c.upper()) == 1 else c for c in text)
        assert dictionary.fold(text) == ("".join(x if len(x := c.lower()) == 1 else c for c in up))


def test_mentions_and_positions_are_found_in_any_case(spark):
    e = made(spark, ["see FIGURE 3 and 表 4", "no number", "as in EQ. 5 and 式（6） (7-8)", "so. [1] and, [2]", "so. 1"])
    assert sorted(r.seq for r in structure.labels_missing(e).collect()) == [0, 0]
    assert {r.number for r in structure.formula_mentions(e).collect()} == {"5", "6", "7.8"}
    assert [r.evidence for r in citations.positions(e, {}).orderBy("seq").collect()] == ["so. [1] and, [2]"]
    assert e.where(F.col("content").isNull()).count() == 0
