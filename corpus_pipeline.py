"""The corpus pipeline: documents through quality rules, deduplication, secret removal, mixing and tokenization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import stages
from vellum.llm.common import discard, scope, stage, table

STAGES = [
    ("quality_rules", stages.keep_good),
    ("simhash_near_dedup", stages.keep_one),
    ("secret_scan", stages.redact_secrets),
    ("mixing", stages.mix_sources),
    ("bpe", stages.tokenize),
]

#: No stage but the mixing can be told in SQL; tests hold the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of what the stages keep. What a stage needs by itself is deleted once its documents are written, and these once
    the next stage's are."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        with scope():
            after = stage(f(spark, docs, sf_dir), name, lasting=True)
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
