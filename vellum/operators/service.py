"""Requests and answers of an audit service as rows: checks of their fields, compact issues, and whole answers."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import patterns as P
from vellum.functions import predicates as B

UUID4 = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"

#: Parts of an answer.
KEYS = ("request_id", "info", "result", "usage")


def request_faults(requests: DataFrame) -> DataFrame:
    """``requests`` (request_id, paper_id, paper_title, chunk_id[, temperature, max_tokens]) with ``faults``, the fields that aren't valid."""
    have = requests.columns
    temperature = F.coalesce("temperature", F.lit(0.1)) if "temperature" in have else F.lit(0.1)
    tokens = F.coalesce("max_tokens", F.lit(500)) if "max_tokens" in have else F.lit(500)
    tests = {
        "request_id": F.col("request_id").isNull(),
        "paper_id": ~B.has(F.coalesce("paper_id", F.lit("")), UUID4),
        "paper_title": F.coalesce("paper_title", F.lit("")) == "",
        "chunk_id": F.coalesce("chunk_id", F.lit("")) == "",
        "temperature": ~temperature.between(0.0, 1.0),
        "max_tokens": tokens <= 0,
    }
    return requests.withColumn("faults", F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in tests.items()]), lambda x: x.isNotNull()))


def result_faults(results: DataFrame) -> DataFrame:
    """``results`` (score, tags: array<string>, tokens, latency_ms) with ``faults``, the fields that aren't valid."""
    tests = {
        "score": ~F.coalesce(F.col("score").between(0, 100), F.lit(False)),
        "tags": F.exists("tags", lambda t: ~t.isin(*P.TAGS)),
        "tokens": F.col("tokens") < 0,
        "latency_ms": F.col("latency_ms") < 0,
    }
    return results.withColumn("faults", F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in tests.items()]), lambda x: x.isNotNull()))


def compact_issues(issues: DataFrame) -> DataFrame:
    """(doc_id, seq, issue): an issue as a JSON object of its keys that aren't empty; a page is a number where it can be read as one."""
    text = lambda c: F.when(F.col(c) != "", F.concat(F.lit(f'"{c}":'), F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)))
    number = F.trim("page").try_cast("int")
    quoted = F.to_json(F.array("page")).substr(F.lit(2), F.length(F.to_json(F.array("page"))) - 2)
    page = F.when(F.col("page") != "", F.concat(F.lit('"page_num":'), F.coalesce(number.cast("string"), quoted)))
    box = F.when(F.col("x0").isNotNull(), F.concat(F.lit('"bbox":'), F.to_json(F.array("x0", "y0", "x1", "y1"))))
    keys = [text(c) for c in ("issue_type", "severity", "message", "suggestion", "evidence") if c in issues.columns]
    return issues.select("doc_id", "seq", F.concat(F.lit("{"), F.array_join(F.filter(F.array(*keys, page, box), lambda x: x.isNotNull()), ","), F.lit("}")).alias("issue"))


def answers(results: DataFrame, texts: DataFrame, commentary: DataFrame | None = None, name: str = "vellum", version: str = "1.0.0", keys: tuple[str, str, str, str] = KEYS) -> DataFrame:
    """(doc_id, answer): the whole answer to an audit request as JSON.

    ``results`` as ``audit.results`` gives them, ``texts`` (doc_id, text) for the estimate of tokens, and a commentary
    (doc_id, comment, suggestion) in place of the standard one. ``keys`` name the answer's four parts: the request, who
    answers, the result, and what it took.
    """
    rows = results.join(texts.select("doc_id", B.token_estimate(F.col("text")).alias("tokens")), "doc_id", "left")
    n = F.col("n_issues")
    # The standard commentary.
    comment = F.when(n > 0, F.concat(F.lit("发现 "), n.cast("string"), F.lit(" 个格式问题。"))).otherwise("格式审计完成。")
    suggestion = F.when(n > 0, "建议根据详细报告进行修改。").otherwise("请检查文中标记的格式问题。")
    if commentary is not None:
        rows = rows.join(commentary.select("doc_id", F.col("comment").alias("_c"), F.col("suggestion").alias("_s")), "doc_id", "left")
        comment, suggestion = F.coalesce("_c", comment), F.coalesce("_s", suggestion)
    tags = F.when(F.col("tags") != "", F.split("tags", ",")).otherwise(F.array().cast("array<string>"))
    said: list[Any] = [
        F.col("doc_id").cast("string").alias(keys[0]),
        F.struct(F.lit(name).alias("name"), F.lit(version).alias("version")).alias(keys[1]),
        F.struct("score", "audit_level", comment.alias("comment"), suggestion.alias("suggestion"), tags.alias("tags")).alias(keys[2]),
        F.struct(F.coalesce("tokens", F.lit(0)).alias("tokens"), F.lit(0).alias("latency_ms")).alias(keys[3]),
    ]
    return rows.select("doc_id", F.to_json(F.struct(*said)).alias("answer"))
