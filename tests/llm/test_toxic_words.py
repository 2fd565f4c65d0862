"""Frequent toxic words that clean rows hold too come before rare ones that none holds."""

from tests.llm.util import table
from vellum.llm import toxicity


def test_frequent_words_are_not_cut_off(spark):
    docs = [(k, f"plain words here rare{k % 20}" + (" vile" if k % 2 else "")) for k in range(200)]
    docs += [(1000 + k, "plain words here" + (" vile" if k < 3 else "")) for k in range(600)]
    labels = spark.createDataFrame([(d, int(d < 1000)) for d, _ in docs], "doc_id long, toxic int")
    got = {r.id: r.severity for r in toxicity.severity(table(spark, [*docs, (5000, "vile"), (5001, "plain")]), labels).collect()}
    assert got[5000] > got[5001] + 0.1
