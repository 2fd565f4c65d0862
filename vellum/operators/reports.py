"""Reports of audited documents as lines of Markdown files: the score, and the details of what was deducted."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import predicates as B
from vellum.operators.issues import level

# The text of the score report. Fields are file, time, score, level, issues, critical, warnings, remarks,
# the three weights, the sum of deductions in words and in figures, deducted points and score.
SCORE_REPORT = """# 论文格式审计评分报告

**文件名**: %s

**审计时间**: %s

## 审计结果
- **总分**: %s/100
- **评级**: %s
- **问题总数**: %s

## 问题统计
- **Critical (严重)**: %s
- **Warning (警告)**: %s
- **Info (提示)**: %s

## 评分说明
本系统采用非线性扣分机制，避免单一类问题导致分数过低：
- **Critical**: 权重 %s (线性扣分)
- **Warning**: 权重 %s (平方根非线性扣分)
- **Info**: 权重 %s (平方根非线性扣分)

**总扣分计算**: `%s` ≈ `%.2f`
**最终得分**: `100 - %s` = `%s`"""

# Weights of the score report where the rules have none, and which issues are about layout.
SCORING = {"critical_weight": 5.0, "warning_weight": 2.0, "info_weight": 0.5}
LAYOUT_TYPES = ("Label_Missing", "Formula_Missing", "Formula_Ref_Missing", "Formula_Misaligned", "Hierarchy_Fault", "Citation_Visual_Fault")

# Headings and labels of the details.
DETAILS = "# 论文格式审计扣分细则"
SECTIONS = ("## 1. 视觉布局分析 (CV Layout Analysis)", "## 2. 语义内容分析 (LLM Semantic Analysis)")
NOTHING, NO_LAYOUT, NO_MEANING = "恭喜！未发现明显的格式问题。", "未发现布局问题。", "未发现语义问题。"
#: Characters of evidence that stand in their line; longer evidence is a block.
INLINE = 120


def _said(at: str | None) -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss") if at is None else F.lit(at)


def _file(docs: DataFrame) -> Column:
    """The file's name: what follows the last slash of ``file`` if there is such a column, else the document's id."""
    return F.coalesce(F.regexp_extract("file", r"[^/\\]*$", 0), F.col("doc_id").cast("string")) if "file" in docs.columns else F.col("doc_id").cast("string")


def score_report(scores: DataFrame, rules: dict[str, Any] | None = None, at: str | None = None) -> DataFrame:
    """(doc_id, line_no, line): how each document's score comes about. ``scores`` are results of an audit, maybe with ``file``.

    The weights shown are those of the rules' section ``scoring``. ``at`` is the time of the audit, now if None.
    """
    own = (rules or {}).get("scoring", {})
    own = own if isinstance(own, dict) else {}
    weights = [float(own.get(k) or d) for k, d in SCORING.items()]
    counts = [F.col(c) for c in ("n_critical", "n_warning", "n_info")]
    loss = weights[0] * counts[0] + weights[1] * F.sqrt(counts[1]) + weights[2] * F.sqrt(counts[2])
    shown = [f"{w:g}" for w in weights]
    sum_ = F.format_string(f"{shown[0]} * %d + {shown[1]} * sqrt(%d) + {shown[2]} * sqrt(%d)", *counts)
    fields = [_file(scores), _said(at), "score", F.upper(level(F.col("score"), "Pass")), counts[0] + counts[1] + counts[2], *counts, *map(F.lit, shown), sum_, loss, F.bround(loss, 0).cast("long"), "score"]
    text = F.format_string(SCORE_REPORT, *fields)
    return scores.select("doc_id", F.posexplode(F.split(text, "\n")).alias("n", "line")).select("doc_id", (F.col("n") + 1).cast("long").alias("line_no"), "line")


def _details(issues: DataFrame) -> DataFrame:
    """(doc_id, part, at, issue_type, nth, n, line): the lines of each issue, after a heading before the first of its type."""
    # Evidence is drawn together before the windows, and so once.
    said = B.strip(F.regexp_replace(F.coalesce("evidence", F.lit("")), r"\s+", " "))
    own = issues.withColumn("evidence", said).withColumn("part", F.when(F.col("issue_type").isin(*LAYOUT_TYPES), 1).otherwise(2)).withColumn("issue_type", F.coalesce("issue_type", F.lit("Other")))
    kind = Window.partitionBy("doc_id", "part", "issue_type")
    own = own.withColumn("at", F.min("seq").over(kind)).withColumn("nth", F.row_number().over(kind.orderBy("seq"))).withColumn("many", F.count("*").over(kind))
    evidence = F.col("evidence")
    label = lambda name, value: F.concat(F.lit(f"- **{name}**: "), value)
    block = F.array(F.lit("- **证据**:"), F.lit(""), F.lit("```"), evidence, F.lit("```"))
    advice = F.coalesce("suggestion", F.lit("")) if "suggestion" in issues.columns else F.lit("")
    some = lambda when, value: F.when(when, F.array(value)).otherwise(F.array().cast("array<string>"))
    lines = F.concat(
        some(F.col("nth") == 1, F.concat(F.lit("### "), "issue_type", F.lit(" ("), F.col("many").cast("string"), F.lit(" 个问题)"))),
        F.array(F.concat(F.lit("#### "), F.col("nth").cast("string"), F.lit(". [Page "), F.coalesce("page", F.lit("?")), F.lit("] "), F.coalesce("message", F.lit("无描述"))), label("严重程度", F.coalesce("severity", F.lit("Info")))),
        some(F.col("x0").isNotNull(), label("BBox", B.format_box(F.array("x0", "y0", "x1", "y1")))),
        F.when(evidence == "", F.array().cast("array<string>")).when(F.length(evidence) <= INLINE, F.array(label("证据", F.concat(F.lit("`"), evidence, F.lit("`"))))).otherwise(block),
        some(advice != "", label("修改建议", advice)),
        F.array(F.lit("")),
    )
    return own.select("doc_id", "part", "at", "issue_type", "nth", F.posexplode(lines).alias("n", "line"))


def deduction_report(issues: DataFrame, docs: DataFrame, at: str | None = None) -> DataFrame:
    """(doc_id, line_no, line): every document's issues in detail: those of layout, then those of meaning, each by type in order.

    ``docs`` have a row a document, maybe with ``file``; issues may have a ``suggestion``. Issues of documents that aren't
    among ``docs`` are left out, and a document without issues has a line that says so.
    """
    body = _details(issues.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    layout = F.coalesce(F.col("issue_type").isin(*LAYOUT_TYPES), F.lit(False))
    found = issues.groupBy("doc_id").agg(F.max(layout).alias("layout"), F.max(~layout).alias("meaning"))
    head = lambda part, n, *lines: [(part, n + k, x) for k, x in enumerate(lines)]
    none = F.col("layout").isNull()
    top = head(0, 0, F.lit(DETAILS), F.lit(""), F.concat(F.lit("**文件名**: "), _file(docs)), F.concat(F.lit("**生成时间**: "), _said(at)), F.lit(""))
    top += head(0, 5, F.when(none, F.lit(NOTHING)))
    top += head(1, -3, F.when(~none, F.lit(SECTIONS[0])), *[F.when(~F.col("layout"), F.lit(x)) for x in (NO_LAYOUT, "")])
    # A section's lines come before its issues, and the end of the first after them.
    top += head(2, -4, *[F.when(~none, F.lit(x)) for x in ("", SECTIONS[1])], *[F.when(~F.col("meaning"), F.lit(x)) for x in (NO_MEANING, "")])
    rows = F.array(*[F.struct(F.lit(part).alias("part"), F.lit(n).alias("n"), line.alias("line")) for part, n, line in top])
    frame = docs.dropDuplicates(["doc_id"]).join(found, "doc_id", "left").select("doc_id", F.explode(F.filter(rows, lambda x: x.line.isNotNull())).alias("x"))
    frame = frame.select("doc_id", "x.part", F.lit(-1).cast("long").alias("at"), F.lit("").alias("issue_type"), F.lit(0).alias("nth"), "x.n", "x.line")
    order = Window.partitionBy("doc_id").orderBy("part", "at", "issue_type", "nth", "n")
    return frame.unionByName(body).select("doc_id", F.row_number().over(order).cast("long").alias("line_no"), "line")
