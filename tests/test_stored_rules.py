"""Rules as data, versions of them in one run, and drawings in an audit."""

import json

from pyspark.sql import functions as F

from vellum.config import RULES, stored_rules
from vellum.plans import audit
from vellum.sources import documents as D

TEXT = "\n".join(["1 Intro", "We use TensorFlw [1] here", "see Figure 2 and (Smith, 2001)", "Figure 1 a caption", "deep-learning as said [3]", "References", "[1] Someone, a long title. 2001"])


def test_stored_sections(spark):
    rows = [("score_weights", "critical: 1.5\nwarning: 0\n"), ("typo_check", '{"critical_keywords": ["Spark"]}'), ("citation_check", "[not a section"), ("llm_scan", "just text"), ("own", "- 1\n- 2"), ("none", None), (None, "a: 1"), ("empty", "")]
    got = stored_rules(spark.createDataFrame(rows, "rule_id string, content string"))
    assert got["score_weights"] == {"critical": 1.5, "warning": 0} and got["typo_check"] == {"critical_keywords": ["Spark"]} and got["own"] == [1, 2]
    assert got["citation_check"] == RULES["citation_check"] and got["llm_scan"] == RULES["llm_scan"] and set(got) == {*RULES, "own"}
    assert stored_rules(spark.createDataFrame([], "rule_id string, content string")) == RULES


def test_versions_are_as_runs_apart(spark):
    docs = spark.createDataFrame([(k, TEXT) for k in range(6)] + [(9, None)], "doc_id long, text string")
    chosen = spark.createDataFrame([(0, 1), (1, 2), (2, 1), (3, None), (4, 7), (9, 2)], "doc_id long, version int")
    sections = {1: {"score_weights": {"critical": 40.0, "warning": 0.5, "info": 0.5}}, 2: {"typo_check": {"critical_keywords": []}, "citation_check": {**RULES["citation_check"], "enforce_style": False}}}
    stored = spark.createDataFrame([(v, k, json.dumps(x)) for v, s in sections.items() for k, x in s.items()], "version int, rule_id string, content string")
    lines = D.placed_lines(docs)
    got = {r.doc_id: r for r in audit.audit_versions(lines, chosen, stored).collect()}
    for version, ids in ((1, [0, 2]), (2, [1]), (None, [3, 5]), (7, [4])):
        apart = {r.doc_id: r for r in audit.audit(lines.where(F.col("doc_id").isin(ids)), RULES | sections.get(version, {})).collect()}
        for d in ids:
            assert got[d].version == version and {k: v for k, v in got[d].asDict().items() if k != "version"} == apart[d].asDict()
    assert got[0].score < got[3].score and got[1].n_critical < got[3].n_critical


def test_drawings_are_images_of_an_audit(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    lines = D.placed_lines(docs)
    cap = lines.where("content = 'Figure 1 a caption'").first()
    rects = spark.createDataFrame([(1, cap.page_num, 600.0, 800.0, cap.x0, cap.y0 - 150.0, cap.x0 + 200.0, cap.y0 - 20.0)], "doc_id long, page_num int, width double, height double, x0 double, y0 double, x1 double, y1 double")
    assert audit.elements_of(lines, rects).where("type = 'image'").count() == 1 and audit.elements_of(lines).where("type = 'image'").count() == 0
    # A figure's caption below its drawing is in place; one above it is reported.
    plain = audit.audit(lines).first()
    assert audit.audit(lines, rects=rects).first().n_issues == plain.n_issues
    below = rects.withColumn("y0", F.lit(cap.y1 + 20.0)).withColumn("y1", F.lit(cap.y1 + 150.0))
    assert audit.elements_of(lines, below).where("type = 'image'").count() <= 1
