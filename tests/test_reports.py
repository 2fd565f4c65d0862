"""Reports of the score and of deductions against literal texts, and payloads from opening to results."""

import base64
import random

from pyspark.sql import functions as F

from vellum.config import RULES
from vellum.functions import predicates as B
from vellum.operators import reports
from vellum.operators.parse import document_pages, page_stats, parse, select_pages
from vellum.plans import audit, ingest
from vellum.schemas import ISSUE
from vellum.sources import documents as D

SCORES = "doc_id long, n_critical long, n_warning long, n_info long, score int, file string"
AT = "2024-05-01 12:30:00"


def texts(df, doc_id=1):
    return [r.line for r in df.where(F.col("doc_id") == doc_id).orderBy("line_no").collect()]


def test_score_report(spark):
    scores = spark.createDataFrame([(1, 1, 4, 9, 89, "a/b/paper.pdf"), (2, 0, 0, 0, 100, None)], SCORES)
    got = texts(reports.score_report(scores, at=AT))
    assert got == """# 论文格式审计评分报告

**文件名**: paper.pdf

**审计时间**: 2024-05-01 12:30:00

## 审计结果
- **总分**: 89/100
- **评级**: PASS
- **问题总数**: 14

## 问题统计
- **Critical (严重)**: 1
- **Warning (警告)**: 4
- **Info (提示)**: 9

## 评分说明
本系统采用非线性扣分机制，避免单一类问题导致分数过低：
- **Critical**: 权重 5 (线性扣分)
- **Warning**: 权重 2 (平方根非线性扣分)
- **Info**: 权重 0.5 (平方根非线性扣分)

**总扣分计算**: `5 * 1 + 2 * sqrt(4) + 0.5 * sqrt(9)` ≈ `10.50`
**最终得分**: `100 - 10` = `89`""".split("\n")
    own = texts(reports.score_report(scores, {"scoring": {"critical_weight": 7.25, "info_weight": 0}}, AT))
    assert "- **Critical**: 权重 7.25 (线性扣分)" in own and "- **Info**: 权重 0.5 (平方根非线性扣分)" in own
    assert "**文件名**: 2" in texts(reports.score_report(scores, at=AT), 2)
    assert reports.score_report(scores.where("false")).count() == 0


def test_deduction_report(spark):
    box = (1.0, 2.0, 3.0, 4.25)
    rows = [
        (1, 9, "Punctuation_Mixed", "Info", "2", None, None, None, None, "x  y\n", "marks", "use others"),
        (1, 3, "Label_Missing", "Warning", "1", *box, "Figure 2", "none such", None),
        (1, 5, "Hierarchy_Fault", None, None, None, None, None, None, None, None, ""),
        (1, 7, "Label_Missing", "Info", "4", None, None, None, None, "e" * 121, "again", None),
        (2, 1, "Own_Type", "Critical", "1", None, None, None, None, "", "m", None),
        (8, 1, "Label_Missing", "Info", "1", None, None, None, None, "", "of no document", None),
    ]
    found = spark.createDataFrame(rows, ISSUE + ", suggestion string")
    docs = spark.createDataFrame([(1, "p/one.pdf"), (2, "two.pdf"), (3, "three.pdf")], "doc_id long, file string")
    got = reports.deduction_report(found, docs, AT)
    top = lambda name: ["# 论文格式审计扣分细则", "", f"**文件名**: {name}", "**生成时间**: 2024-05-01 12:30:00", ""]
    layout, meaning = "## 1. 视觉布局分析 (CV Layout Analysis)", "## 2. 语义内容分析 (LLM Semantic Analysis)"
    assert texts(got, 3) == [*top("three.pdf"), "恭喜！未发现明显的格式问题。"]
    assert texts(got, 2) == [*top("two.pdf"), layout, "未发现布局问题。", "", "", meaning, "### Own_Type (1 个问题)", "#### 1. [Page 1] m", "- **严重程度**: Critical", ""]
    assert texts(got, 1) == [
        *top("one.pdf"), layout,
        "### Label_Missing (2 个问题)", "#### 1. [Page 1] none such", "- **严重程度**: Warning", "- **BBox**: [1.0, 2.0, 3.0, 4.2]", "- **证据**: `Figure 2`", "",
        "#### 2. [Page 4] again", "- **严重程度**: Info", "- **证据**:", "", "```", "e" * 121, "```", "",
        "### Hierarchy_Fault (1 个问题)", "#### 1. [Page ?] 无描述", "- **严重程度**: Info", "",
        "", meaning,
        "### Punctuation_Mixed (1 个问题)", "#### 1. [Page 2] marks", "- **严重程度**: Info", "- **证据**: `x y`", "- **修改建议**: use others", "",
    ]
    assert {r.doc_id for r in got.collect()} == {1, 2, 3}
    assert texts(reports.deduction_report(found.where("doc_id = 2"), docs, AT), 1) == [*top("one.pdf"), "恭喜！未发现明显的格式问题。"]
    only = texts(reports.deduction_report(found.where("doc_id = 1 and seq < 9"), docs, AT))
    assert only[-2:] == [meaning, "未发现语义问题。"] or only[-3:] == [meaning, "未发现语义问题。", ""]


TEXT = "\n".join([f"line {k} with TensorFlw and [7] here" for k in range(20)])


def _payloads(spark):
    pdf = lambda s: base64.b64encode(s.encode()).decode()
    rows = [(1, pdf("%PDF-1.7\n" + TEXT), None), (2, pdf("%PDF-1.7\n" + TEXT), [2, -1]), (3, pdf("%PDF-1.7 /Encrypt 5 0 R\n" + TEXT), [1]), (4, pdf(TEXT), None), (5, None, [3]), (6, "no base64!", []), (7, pdf("%PDF-1.7\n" + TEXT), [9])]
    return spark.createDataFrame(rows, "doc_id long, payload string, pages array<int>")


def _lines(payloads):
    return D.placed_lines(payloads.select("doc_id", F.regexp_replace(F.decode(F.unbase64("payload"), "UTF-8"), "^[^\n]*\n", "").alias("text")))


def test_ingest(spark):
    got = ingest.ingest(_payloads(spark), _lines)
    assert sorted(map(tuple, got.errors.select("doc_id", "error_type").collect())) == [(3, "encrypted_pdf"), (4, "invalid_pdf"), (5, "invalid_pdf"), (6, "invalid_pdf")]
    assert {r.doc_id: tuple(r)[1:] for r in got.report.collect()} == {1: (False, 3, 0, 0), 2: (False, 1, 0, 0), 3: (True, 0, 0, 0), 4: (False, 0, 0, 0), 5: (False, 0, 0, 0), 6: (False, 0, 0, 0), 7: (False, 0, 0, 0)}
    good = _payloads(spark).where("doc_id in (1, 2, 7)")
    want = parse(select_pages(_lines(good), good.select("doc_id", "pages")))
    assert sorted(map(tuple, got.elements.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and want.count()
    assert {r.page_num for r in got.elements.where("doc_id = 2").collect()} == {2}
    length = sum(len(x) for x in TEXT.split("\n")) + sum(len(x) for x in TEXT.split("\n")[8:16])
    assert got.counts == {"payloads": 7, "invalid_pdf": 3, "encrypted_pdf": 1, "lines": 28, "characters": length}
    none = ingest.ingest(_payloads(spark).where("false"), _lines)
    assert none.counts == {"payloads": 0, "invalid_pdf": 0, "encrypted_pdf": 0, "lines": 0, "characters": 0} and none.report.count() == 0


def test_audit_of_payloads(spark):
    got = {r.doc_id: r for r in ingest.audit_payloads(_payloads(spark), _lines, RULES).collect()}
    assert set(got) == set(range(1, 8)) and got[1].n_issues > got[2].n_issues > 0
    assert [got[k].error for k in range(1, 8)] == [None, None, "encrypted_pdf", "invalid_pdf", "invalid_pdf", "invalid_pdf", None]
    assert all(got[k].score == 100 and got[k].n_issues == 0 for k in (3, 4, 5, 6, 7))
    # The same texts audited without payloads.
    plain = audit.audit(_lines(_payloads(spark).where("doc_id = 1"))).first()
    assert all(got[1][c] == plain[c] for c in plain.asDict())
    stored = spark.createDataFrame([("typo_check", '{"critical_keywords": []}')], "rule_id string, content string")
    without = {r.doc_id: r for r in ingest.audit_payloads(_payloads(spark), _lines, RULES, stored=stored).collect()}
    assert got[1].n_critical > without[1].n_critical == 0


def test_pages_of_documents_without_elements(spark):
    elements = spark.createDataFrame([(1, 4), (1, 6), (2, 0)], "doc_id long, page_num int")
    rows = [(1, [9], 3, [8]), (2, [9], 3, [8]), (3, [0, 5, 2], 3, [8]), (4, [-1], 3, [8]), (5, None, 1, None), (6, None, 0, [7, -3, 9]), (7, None, None, [4]), (8, None, None, None), (9, [], -2, [0])]
    docs = spark.createDataFrame(rows, "doc_id long, selected array<int>, page_count int, page_list array<int>")
    assert {r.doc_id: r.pages for r in document_pages(docs, elements).collect()} == {1: "4-6", 2: "N/A", 3: "2-5", 4: "1-3", 5: "1", 6: "7-9", 7: "4", 8: "N/A", 9: "N/A"}
    assert document_pages(docs.select("doc_id"), elements).where("doc_id = 3").first().pages == "N/A"


def test_page_size_without_boxes(spark):
    lines = spark.createDataFrame([(1, 1, "a", None, None), (1, 2, "b", 10.0, 20.0)], "doc_id long, page_num int, content string, x1 double, y1 double")
    assert {r.page_num: (r.max_x, r.max_y) for r in page_stats(lines).collect()} == {1: (595.0, 842.0), 2: (10.0, 20.0)}


def test_tenths_are_rounded_by_exact_values(spark):
    rng = random.Random(5)
    xs = [0.05, 0.15, 0.25, 0.35, 0.45, 0.75, 0.95, 1.05, 100.15, 4.25, 4.75, 2.5, -0.04, -0.05, -4.25, 0.0, 0.999, 99.95, 1e6 + 0.25, *[rng.randrange(200_000) / 100 for _ in range(2000)], *[rng.uniform(-900, 900) for _ in range(500)]]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", B.tenths(F.col("x")).alias("t")).collect()
    assert all(r.t == f"{r.x:.1f}" for r in got) and len(got) == len(xs)
