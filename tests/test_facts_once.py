"""Facts of a text are worked out once for a commentary."""

from vellum.operators import text


def test_facts_are_worked_out_once(spark):
    docs = spark.createDataFrame([(1, "One  fact。 \t Another　one\n" + "x" * 40), (2, " \n "), (3, None)], "doc_id long, text string")
    issues = spark.createDataFrame([(1, "Label_Missing")], "doc_id long, issue_type string")
    experts = text.embed(spark.createDataFrame([(1, "m", "one fact", True)], "comment_id long, metric_id string, text string, active boolean"))
    out = text.commentary(docs, issues, experts)
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.doc_id, r.comment) for r in out.collect()] == [(1, "发现以下问题：\n- Label_Missing: 1")]
    got = docs.select("doc_id", text.facts(docs.text).alias("f")).orderBy("doc_id").collect()
    assert [r.f for r in got] == ["- One fact\n- Another one\n- " + "x" * 30, "", None]
