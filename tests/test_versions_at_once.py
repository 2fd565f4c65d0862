"""Documents of all versions of the rules are parsed at once, and checked at once where the rules don't differ in what checks read."""

import json

from pyspark.sql import functions as F

from vellum.config import RULES
from vellum.plans import audit
from vellum.sources import documents as D

TEXT = "\n".join(["1 Intro", "We use TensorFlw [1] here", "see Figure 2 and (Smith, 2001)", "deep-learning as said [3]", "References", "[1] Someone, a long title. 2001"])


def test_versions_share_the_parse_and_the_checks(spark, monkeypatch):
    docs = spark.createDataFrame([(k, TEXT) for k in range(6)] + [(None, TEXT)], "doc_id long, text string")
    chosen = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, None), (4, "not stored")], "doc_id long, version string")
    weights = [(v, "score_weights", json.dumps({"critical": 1.0 + k, "warning": 0.5, "info": 0.1 * k})) for k, v in enumerate("abc")]
    own = {**RULES["citation_check"], "enforce_style": False}
    stored = spark.createDataFrame([*weights, ("c", "citation_check", json.dumps(own))], "version string, rule_id string, content string")
    lines = D.placed_lines(docs)
    parsed, checked, parse, find = [], [], audit.parse, audit.find_issues
    monkeypatch.setattr(audit, "parse", lambda x: parsed.append(1) or parse(x))
    monkeypatch.setattr(audit, "find_issues", lambda *x: checked.append(1) or find(*x))
    got = {r.doc_id: r.asDict() for r in audit.audit_versions(lines, chosen, stored).collect()}
    assert len(parsed) == 1 and len(checked) == 2 and set(got) == {0, 1, 2, 3, 4, 5, None}
    for d, v in ((0, "a"), (2, "c"), (4, "not stored")):
        rules = RULES | {s: json.loads(x) for version, s, x in [*weights, ("c", "citation_check", json.dumps(own))] if version == v}
        apart = audit.audit(lines.where(F.col("doc_id") == d), rules).first().asDict()
        assert got[d] == {**apart, "version": v}
    assert {k: x for k, x in got[5].items() if k != "doc_id"} == {k: x for k, x in got[3].items() if k != "doc_id"} and got[5]["version"] is None
    assert got[2]["n_warning"] < got[3]["n_warning"] and got[0]["score"] > got[3]["score"]
