import pytest
from pyspark.sql import functions as F

from vellum.functions import predicates as B


def ask(spark, expression, values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", expression(F.col("v")).alias("x")).orderBy("k").collect()]


CASES = [
    (B.is_reference_title, {"参考文献": True, " References ： ": True, "reference": False, "References list": False, "": False}),
    (B.is_caption, {"Fig 3": False, "Fig. 3 x": True, "图 2.2": True, "Table 4-1 y": True, "table 9": True, "Figure 1 ...... 12": False, "表格": False}),
    (B.is_heading, {"2023年5月": False, "1.2 方法": True, "第三章 结论": True, "1 Introduction": True, "1. a": False, "3 ms": False, "2 then": False, "1.1 What，x": False, "Intro": False}),
    (B.is_formula, {"E = mc^2 (1)": True, "x_i = y": True, "the a = b": False, "Width = 100": False, "(3)": False, "def f = 1": False, "a == b": False, "∑ x": True, "my_var = 3": False, "plain words": False, "α + β。": False, "http://x = 1": False}),
    (B.is_display_formula, {"E = mc^2 (1)": True, "x := 3": False, "a = b + c": True, "T=0.2": False, "x ≤ 3": False, "其中 x = y": False, "": False, "a{b": False}),
    (B.is_toc_heading, {"1 Intro ..... 3": True, "1 Intro": False, "a __ 3": False, "x …… 4": True}),
    (B.is_caption_continuation, {"and more of it": True, "end。": False, "1.2 方法": False, "abc": False, "第 3 页": False}),
]


@pytest.mark.parametrize("predicate,cases", CASES, ids=[p.__name__ for p, _ in CASES])
def test_predicates(spark, predicate, cases):
    assert dict(zip(cases, ask(spark, predicate, list(cases)))) == cases


def test_citations(spark):
    code = "for i in range(3): a[i] = 1; see [1] and [2]"
    assert ask(spark, B.layout_citations, [code, "Bad refs [0] [1000] ok [12, 13]", "This is based on (Smith, 2020) and (O'Neil et al., 2019a)."]) == [[], ["[12, 13]"], ["(Smith, 2020)", "(O'Neil et al., 2019a)"]]
    assert ask(spark, B.numeric_citations, ["shown[3]", "如图[4]", "a [1-3]", "b [0]", "c [12,13] [5]", "[1][2]"]) == [[], [], [], [], ["12,13", "5"], ["1"]]


def test_numbers(spark):
    assert ask(spark, B.cn_number, ["二十一", "十", "一百零五", "12", "两千", "零", "x", ""]) == [21, 10, 105, 12, 2000, None, None, None]
    assert ask(spark, B.heading_parts, ["2.1.3 Title", "第十二章 x", "1. ", "3 42", "Title"]) == [[2, 1, 3], [12], None, None, None]
    assert ask(spark, B.page_list, ["1,3-5", "5-3", "", "a,2", "0,7"]) == [[1, 3, 4, 5], [3, 4, 5], [], [2], [7]]
    assert ask(spark, B.normal_page, ["-1", "12", "p. 3-4", "?", None]) == [0, 12, 3, 0, 0]
    assert ask(spark, B.label_number, ["2 . 3", "2–1"]) == ["2-3", "2-1"]
    assert ask(spark, B.formula_number, ["2 – 3", "2.1", "4"]) == ["2.3", "2.1", "4"]
    assert ask(spark, B.clamp_weight, ["2", "-1", "0.5", "x"]) == [1.0, 0.0, 0.5, None]
    assert ask(spark, B.normal_bbox, [[1.0, 2.0], None, [1.0, 2.0, 3.0, 4.0, 5.0]], "array<double>") == [[1, 2, 0, 0], [0, 0, 0, 0], [1, 2, 3, 4]]


def test_levels_and_types(spark):
    assert ask(spark, B.normal_level, ["fatal", "WARN", "", None, "odd"]) == ["Critical", "Warning", "Info", "Info", "Odd"]
    assert ask(spark, B.rule_id, ["Label_Missing", "X", ""]) == ["FMT-003", "FMT-AUTO-X", "FMT-AUTO-Other"]
    assert ask(spark, B.guess_issue_type, ["有错别字", "实验结果是否可信", "标题编号不连续", "图3缺标题", "参考文献格式混乱", "引用[3]未找到", "公式看不清", "标点混用", "行距不对", "好", ""]) == ["Typo_Error", "Experiment_Result_Question", "Hierarchy_Fault", "Label_Missing", "Citation_Style_Inconsistent", "Citation_Reference_Missing", "Formula_Readability", "Punctuation_Mixed", "Formatting_Issue", "Other", "Other"]
    assert ask(spark, B.guess_severity, ["严重", "格式错误", "ok", ""]) == ["Critical", "Warning", "Info", None]


def test_pdf(spark):
    import base64

    assert ask(spark, B.is_pdf_base64, [base64.b64encode(b"%PDF-1.4 x").decode(), base64.b64encode(b"text").decode(), "not a pdf"]) == [True, False, False]


def test_terms_are_quoted(spark):
    found = lambda text, term: spark.range(1).select(B.term_found(F.lit(text), term)).first()[0]
    assert found(r"a x\Ey b", r"x\Ey") and not found("a xEy b", r"x\Ey") and not found("xy", r"x\Ey")
    assert found("see C.N net", "c.n") and not found("see CxN net", "c.n") and not found("cats", "cat") and found("一图", "图") and not found("x", "")
