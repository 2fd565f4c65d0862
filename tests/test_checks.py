import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.config import RULES, load_rules
from vellum.functions import patterns as P
from vellum.functions import predicates as B
from vellum.operators import charts, citations, issues, service, store, structure, terms, text
from vellum.operators import parse as parse_ops
from vellum.operators.parse import parse
from vellum.operators.spans import match_spans
from vellum.plans import audit
from vellum.schemas import ELEMENT, ISSUE, schema_report
from vellum.sources import documents as D


def make(spark, rows):
    """Elements (type, content[, region[, page[, box]]]) of document 1, in order."""
    full = []
    for k, (kind, content, *more) in enumerate(rows):
        region, page, box = [*more, *("main", 1, (72.0, 100.0 + 20 * k, 300.0, 112.0 + 20 * k))[len(more) :]]
        full.append((1, k, kind, content, *map(float, box), page, region))
    return spark.createDataFrame(full, ELEMENT)


def cited(spark, refs, cites):
    rows = [("text", f"[{n}] A. Author, Title", "reference") for n in refs] + [("citation", c, "citation") for c in cites]
    return [r.message.rpartition(": ")[2] for r in citations.layout_faults(make(spark, rows)).collect()]


def test_layout_citations(spark):
    assert cited(spark, [1, 2], ["[1]", "[3]"]) == ["3"]
    assert cited(spark, [1], ["[2019]"]) == []
    assert cited(spark, [1], ["[500]", "[1000]"]) == []
    assert cited(spark, range(1, 6), ["[20]"]) == []
    assert cited(spark, [1, 2], ["[1-4]", "(Smith, 2020)"]) == ["3, 4"]
    assert cited(spark, [], ["[7]"]) == ["7"]


SAMPLE = """1. Introduction
We use TensorFlw framework for implementation.
The Pydantc library is used for validation.
However, deep-learning models are complex.
这是一个测试句子.
Reference one [1].
Reference two .[2]
Another method is proposed by (Wang, 2023).
如图1所示，结果显著。
图1 测试图表
E = mc^2 (1)
References
[1] A. Smith, 'Paper Title', 2020."""


def test_audit_of_a_page(spark):
    lines = spark.createDataFrame([(1, k + 1, 1, x, 10.0, 72.0, 100.0 + 20 * k, 300.0, 112.0 + 20 * k) for k, x in enumerate(SAMPLE.split("\n"))], "doc_id long, line_no long, page_num int, content string, size double, x0 double, y0 double, x1 double, y1 double")
    elements = parse(lines)
    kinds = {(r.type, r.region) for r in elements.collect()}
    assert {("title", "chart"), ("title", "reference"), ("formula", "formula"), ("text", "reference"), ("citation", "citation")} <= kinds
    rules = RULES | {"terminology_check": {"forbidden_variants": {"deep learning": ["deep-learning"]}}}
    found = audit.find_issues(elements, rules)
    types = {r.issue_type for r in found.collect()}
    assert {"Critical_Keyword_Typo", "Terminology_Forbidden", "Citation_Style_Inconsistent", "Citation_Style_Mismatch", "Citation_Position_Inconsistent", "Punctuation_Mixed", "Citation_Reference_Missing"} <= types
    assert "Label_Missing" not in types
    row = audit.results(found, lines, rules).first()
    assert row.score < 100 and "Citation_Inconsistency" in row.tags
    report = store.report(found, audit.results(found, lines, rules)).orderBy("line_no").collect()
    assert report[0].line == "# Audit report" and any(r.line.startswith("## Critical_Keyword_Typo") for r in report)


def test_labels_and_headings(spark):
    e = make(spark, [("title", "图 2.1 结构", "chart"), ("text", "见 图2-1 和 Figure 3, 代表4"), ("title", "1 Start", "title"), ("title", "1.1.1 Deep", "title"), ("title", "3 Later", "title"), ("title", "1 Start", "title"), ("title", "1.1.1.1.1 Too deep", "title"), ("text", "tail", "main", 1, (72, 980, 300, 1000))])
    assert [r.evidence for r in structure.labels_missing(e).collect()] == ["见 图2-1 和 Figure 3, 代表4"]
    messages = sorted(r.message for r in structure.headings(e, RULES).collect())
    assert any("层级过深" in m for m in messages) and any("序号重复: 1 " in m for m in messages) and any("层级跳跃" in m for m in messages) and any("期望: 2" in m for m in messages)


def test_formulas(spark):
    e = make(spark, [("formula", "a = b + c", "formula", 1, (100, 300, 200, 312)), ("text", "(4)", "main", 1, (480, 300, 500, 312)), ("formula", "q = r + s", "formula", 2, (100, 300, 200, 312)), ("text", "by Eq. (4)"), ("text", "x", "main", 1, (72, 700, 510, 800)), ("text", "x", "main", 2, (72, 700, 510, 800))])
    rows = {r.content: r.number for r in structure.formula_rows(e, RULES).collect()}
    assert rows == {"a = b + c": "4", "q = r + s": None}
    assert [r.issue_type for r in structure.formulas(e, RULES).collect()] == ["Formula_Missing"]


def test_images(spark):
    page = ("text", "words here", "main", 1, (72, 700, 560, 800))
    below = [("image", "", "chart", 1, (100, 200, 400, 400)), ("title", "Figure 1 x", "chart", 1, (100, 410, 400, 425)), page]
    assert charts.images_without_caption(make(spark, below), RULES).count() == 0
    bare = [("image", "", "chart", 1, (100, 200, 400, 400)), ("title", "Figure 1 x", "chart", 2, (100, 410, 400, 425)), page]
    assert [r.message for r in charts.images_without_caption(make(spark, bare), RULES).collect()] == ["检测到图片但未找到图标题"]
    above = [("image", "", "chart", 1, (100, 200, 400, 400)), ("title", "Figure 1 x", "chart", 1, (100, 180, 400, 195)), page]
    assert [r.message for r in charts.images_without_caption(make(spark, above), RULES).collect()] == ["图标题应位于图下方 (规则要求: bottom)"]
    import numpy as np

    assert charts.merge_regions(np.array([[10.0, 10, 60, 60], [58, 10, 120, 60], [300, 300, 301, 301]]), 400, 400) == [[10, 10, 120, 60]]


def marks(spark, texts, **how):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [[(x.message, x.evidence) for x in r.m] for r in df.select("k", terms.wrong_marks(F.col("t"), **how).alias("m")).orderBy("k").collect()]


def test_terms(spark):
    found = marks(spark, ["这是一个测试句子.", "中文,文字", "证明. 由上", "http://a 中文,", "文字a,b", "设值, x = 3 文字", "版本.2 的文字", "这里，a ! 好的?是", "（见 Large words，here）and more of it"])
    assert [[m for m, _ in x] for x in found] == [["中文文本使用了英文标点(.)"], ["中文文本使用了英文标点"], [], [], [], [], [], ["中文文本使用了英文标点"], []]
    assert found[1][0][1] == "中文,文字"
    long = "前面有许多许多的文字放在这里为了让上下文被截断,后面也有许多许多的文字放在这里为了让上下文被截断"
    assert marks(spark, [long]) == [[("中文文本使用了英文标点", "…" + long[4:42] + "…")]]
    assert marks(spark, ["Large Model，works here well"], compat=False)[0] and not marks(spark, ["Large Model，works here well"])[0]
    like = lambda t, compat=True: spark.range(1).select(terms.math_like(F.lit(t), compat)).first()[0]
    assert like("a≤b") and not like("ABC") and like("abc") and not like("abc", False) and like("p 等价 q")


@pytest.mark.parametrize("counts,score", [((0, 0, 0), 100), ((1, 4, 9), 90), ((3, 2, 0), 82), ((20, 0, 0), 0)])
def test_score(spark, counts, score):
    df = spark.createDataFrame([(1, *counts)], "doc_id long, n_critical long, n_warning long, n_info long")
    assert issues.score(df, {"critical": 5, "warning": 2, "info": 0.3}).first().score == score


def test_dedupe_keeps_the_first(spark):
    rows = [(1, k, "A", "Info", "1", 1.04, 2.0, 3.0, 4.0, "e", m) for k, m in ((5, "m"), (3, "m"), (4, "n"))]
    out = issues.dedupe(spark.createDataFrame(rows, ISSUE))
    assert sorted(r.seq for r in out.collect()) == [3, 4] and issues.dedupe(out).count() == 2


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,;。\n", max_size=400), st.integers(20, 80), st.integers(0, 15))
def test_chunks_cover_the_text(content, size, overlap):
    ranges = text.chunk_ranges(content, size, overlap)
    covered = set()
    for (a, b), (c, d) in zip(ranges, ranges[1:]):
        assert c > a or d > b
    for a, b in ranges:
        assert b - a <= size + 100
        covered |= set(range(a, b))
    assert all(content[k] == "\n" for k in range(len(content)) if k not in covered)


def test_stores(spark):
    target = spark.createDataFrame([(1, "a", "x"), (None, "b", "y")], "k int, v string, w string")
    changes = spark.createDataFrame([(None, "c"), (3, "d")], "k int, v string")
    merged = {(r.k, r.v) for r in store.upsert(target, changes, ["k"]).collect()}
    assert merged == {(1, "a"), (None, "c"), (3, "d")}
    assert {(r.k, r.v) for r in store.coalescing_upsert(target, spark.createDataFrame([(1, ""), (None, "z")], "k int, v string"), ["k"]).collect()} == {(1, "a"), (None, "z")}
    assert schema_report(target, "k int, v long") == [("v", "bigint", "string"), ("w", "", "string")]
    assert load_rules("typo_check: {critical_keywords: [A]}")["typo_check"] == {"critical_keywords": ["A"]} and load_rules("{bad: [") == RULES


def test_sources(spark, tmp_path):
    (tmp_path / "gt.json").write_text('{"items": [{"issue_type": "A", "page_num": "3"}]}')
    assert D.ground_truth(spark, str(tmp_path / "gt.json")).first().issue_type == "A"
    (tmp_path / "m.json").write_text('[{"id": "a", "path": "p"}, {"id": "a", "path": "q"}, {"id": "", "path": "r"}]')
    assert [(r.id, r.path) for r in D.manifest(spark, str(tmp_path / "m.json")).collect()] == [("a", "p")]
    (tmp_path / "x.bin").write_bytes(b"%PDF-1.4")
    assert D.files(spark, str(tmp_path), "*.bin").first().is_pdf
    spans = '{"pdf_info": [{"page_idx": 0, "para_blocks": [{"lines": [{"spans": [{"content": "a", "bbox": [1,2,3,4]}, {"content": "b", "bbox": [0,3,5,6]}]}]}]}]}'
    rows = D.span_rows(spark.createDataFrame([(1, spans)], "doc_id long, json string")).collect()
    assert sorted((r.content, tuple(r.bbox)) for r in rows) == [("a", (1, 2, 3, 4)), ("ab", (0, 2, 5, 6)), ("b", (0, 3, 5, 6))]


def test_remarks(spark):
    assert text.numbered_remarks("intro\n# 质询问题\n1. first\nmore\n2） second\n# End\n3. no") == ["first more", "second"]
    assert text.numbered_remarks("# 主要贡献与建议\n1. x\n# 质询问题\n1. real\n\nbetween\n2、 next\n" + "y" * 201 + "\nend\n<table>\n3. no") == ["real", "next end"]
    assert text.numbered_remarks("# 主要问题与修改意见\n5. a\n123. b\n6. c\n7. d\n8. e\n9. f") == ["a 123. b", "c", "d", "e"]
    assert text.numbered_remarks("1. a\n# x\n2. b") == ["a"] and text.numbered_remarks("") == []


def test_model_answers(spark):
    def said(kind, evidence, message="m"):
        return {"issue_type": kind, "severity": "Warning", "evidence": evidence, "message": message}

    answers = [
        "Sure ```json\n" + json.dumps({"issues": [said("Citation_Placeholder", "[3]"), said("Nope", "x")], "summary": "s"}) + "\n```",
        "no json",
        json.dumps([said("Citation_Placeholder", "see [1] in the text, page TODO"), said("Citation_Placeholder", "x", "孤立的 [2, 3]"), said("Citation_Placeholder", " [1-3, 5] ")]),
        "```json\n" + json.dumps({"issues": [], "summary": "fine"}) + "\n```",
    ]
    df = spark.createDataFrame(list(enumerate(answers)), "doc_id long, answer string")
    got = sorted((r.doc_id, r.pos, r.issue_type, r.severity, r.message) for r in text.model_issues(df).collect())
    note = " (疑似排版或解析造成的孤立行，非内容缺失)"
    assert got == [(0, 0, "Citation_Layout_Check", "Info", "m" + note), (2, 0, "Citation_Placeholder", "Warning", "m"), (2, 1, "Citation_Layout_Check", "Info", "孤立的 [2, 3]" + note), (2, 2, "Citation_Layout_Check", "Info", "m" + note)]
    assert {r.doc_id: r.feedback for r in text.model_summary(df).collect()} == {0: "s", 1: "no json", 2: answers[2], 3: "fine"}


def test_spans(spark):
    remarks = spark.createDataFrame([(1, 0, "The method is unclear"), (1, 1, "Quite another thing"), (1, 2, "Abcdefgh and a lot more words"), (2, 0, "alone")], "doc_id long, pos long, text string")
    spans = spark.createDataFrame([(1, 1, "Here: the method is unclear, really"), (1, 2, "The method is unclear."), (1, 3, "The methods is unclear"), (1, 4, "abcdefgh and a lot")], "doc_id long, span_id long, content string")
    got = {(r.doc_id, r.pos): (r.span_id, r.ratio) for r in match_spans(remarks, spans).collect()}
    assert got == {(1, 0): (1, 1.0), (1, 2): (4, 15 / 24)}


def test_pages(spark):
    e = make(spark, [("text", "abcd", "main", 1), ("text", "", "main", 1), ("text", "efg", "main", 3), ("title", "hi", "title", 5)])
    offsets = parse_ops.with_offsets(e)
    places = spark.createDataFrame([(1, 0, 2), (1, 3, 6), (1, 4, 5), (1, 0, 99)], "doc_id long, start long, stop long")
    assert {(r.start, r.stop): r.pages for r in parse_ops.pages_at(offsets, places).collect()} == {(0, 2): "1", (3, 6): "1-3", (4, 5): "?", (0, 99): "1-5"}
    docs = spark.createDataFrame([(1, None, 9), (2, [4, -1, 2], None), (3, [0], 1), (4, None, 7), (5, None, None)], "doc_id long, selected array<int>, page_count int")
    assert {r.doc_id: r.pages for r in parse_ops.document_pages(docs, e).collect()} == {1: "1-5", 2: "2-4", 3: "1", 4: "1-7", 5: "N/A"}
    issue = spark.createDataFrame([(1, 1, "A", "Info", "?", None, None, None, None, "e", "m"), (1, 2, "A", "Info", "2", None, None, None, None, "e", "m")], ISSUE)
    assert sorted(r.page for r in parse_ops.place_issues(issue, parse_ops.document_pages(docs, e)).collect()) == ["1-5", "2"]


def greedy(caps, regions):
    """Captions in order take the nearest region that is left."""
    used = []
    for x0, y0, x1, y1, kind in caps:
        best = None
        for r in regions:
            lap = min(x1, r[2]) - max(x0, r[0])
            if r in used or lap <= 0 or lap < 0.2 * min(max(1, x1 - x0), max(1, r[2] - r[0])) or kind == "f" and r[1] > y1 + 6 or kind == "t" and r[3] < y0 - 6:
                continue
            dy = y0 - r[3] if r[3] <= y0 else r[1] - y1 if r[1] >= y1 else 0
            score = dy * 1000 + abs((x0 + x1) / 2 - (r[0] + r[2]) / 2)
            best = min(best or (score, r), (score, r))
        if best:
            used.append(best[1])
    return used or [max(regions, key=lambda r: (r[2] - r[0]) * (r[3] - r[1]))]


def test_captions_take_regions(spark):
    import random

    draw = random.Random(5)
    caps, regions, want = [], [], {}
    for page in range(60):
        at = lambda w, h: (x := draw.randint(0, 400), y := draw.randint(0, 600), x + draw.randint(20, w), y + draw.randint(10, h))
        c = [(*map(float, at(200, 12)), draw.choice("ft")) for _ in range(draw.randint(1, 4))]
        r = [tuple(map(float, at(250, 200))) for _ in range(draw.randint(1, 4))]
        want[page] = sorted(greedy(c, r))
        caps += [(1, page, k, "Figure 1" if x[4] == "f" else "Table 1", *x[:4]) for k, x in enumerate(c)]
        regions += [(1, page, *x) for x in r]
    box = "x0 double, y0 double, x1 double, y1 double"
    rows = charts.captioned_regions(spark.createDataFrame(caps, f"doc_id long, page_num int, line_no long, content string, {box}"), spark.createDataFrame(regions, f"doc_id long, page_num int, {box}"), spark.createDataFrame([(1, 99, 0.0, 0.0, 1.0, 1.0)], f"doc_id long, page_num int, {box}")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.page_num, []).append((r.x0, r.y0, r.x1, r.y1))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_merged_regions_equal_any_order():
    import random

    import numpy as np

    draw = random.Random(6)
    for _ in range(30):
        rects = np.array([(x, y, x + draw.randint(20, 80), y + draw.randint(20, 80)) for x, y in ((draw.randint(0, 900), draw.randint(0, 900)) for _ in range(draw.randint(1, 40)))], float)
        boxes = [tuple(r) for r in rects if (r[2] - r[0]) * (r[3] - r[1]) >= 0.0008 * 1e6]
        changed = True
        while changed:
            changed = False
            for a in boxes:
                for b in boxes:
                    if a is not b and a[0] <= b[2] + 4 and b[0] <= a[2] + 4 and a[1] <= b[3] + 4 and b[1] <= a[3] + 4:
                        boxes = [x for x in boxes if x is not a and x is not b] + [(min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))]
                        changed = True
                        break
                if changed:
                    break
        want = sorted(list(b) for b in boxes if 0.02 <= (b[2] - b[0]) * (b[3] - b[1]) / 1e6 <= 0.9)
        assert sorted(charts.merge_regions(rects, 1000, 1000)) == want


def test_service(spark):
    ok = ("r1", "123e4567-e89b-42d3-a456-426614174000", "t", "c", 0.1, 500)
    df = spark.createDataFrame([ok, ("r2", "x", "", None, 1.5, 0)], "request_id string, paper_id string, paper_title string, chunk_id string, temperature double, max_tokens int")
    assert {r.request_id: r.faults for r in service.request_faults(df).collect()} == {"r1": [], "r2": ["paper_id", "paper_title", "chunk_id", "temperature", "max_tokens"]}
    issue = spark.createDataFrame([(1, 1, 'A"', "", "x", 1.0, 2.0, 3.0, 4.0, None, "m"), (1, 2, "B", "Info", "3", None, None, None, None, "e", "")], ISSUE)
    assert [json.loads(r.issue) for r in service.compact_issues(issue).orderBy("seq").collect()] == [{"issue_type": 'A"', "message": "m", "page_num": "x", "bbox": [1, 2, 3, 4]}, {"issue_type": "B", "severity": "Info", "evidence": "e", "page_num": 3}]
    urls = ["postgresql+asyncpg://u:p@Host:5432/db?x=1", "http://a.b/c", "", None, "nothing"]
    got = [r[0] for r in spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, u string").orderBy("k").select(B.mask_url(F.col("u"))).collect()]
    assert got == ["postgresql://***@host:5432/db", "http://***@a.b/c", "Hidden", "Hidden", "Hidden"]


def test_whole_answers(spark):
    docs = spark.createDataFrame([(1, SAMPLE + "\nAn LLM, e.g. this one"), (2, "Nothing here"), (3, "")], "doc_id long, text string")
    experts = text.embed(spark.createDataFrame([(1, "m", "Use figures", True), (2, "m", "", True), (3, "m", "Other", False)], "comment_id long, metric_id string, text string, active boolean"))
    got = {r.doc_id: json.loads(r.answer) for r in audit.answer(docs, D.placed_lines(docs), experts, RULES, text.mock_answer).collect()}
    assert got[1]["result"]["comment"].startswith("发现以下问题") and "Abbreviation_Definition: 1" in got[1]["result"]["comment"] and got[1]["result"]["suggestion"].endswith("参考建议：Use figures")
    assert got[2]["result"]["score"] == 100 and got[2]["result"]["comment"] == "已完成格式审计。" and got[3]["result"]["comment"] == "格式审计完成。"
    assert got[1]["usage"]["tokens"] == (len(SAMPLE) + 22) // 4 and set(got[1]["result"]["tags"]) <= set(P.TAGS)


def test_model_scan_says_pages(spark):
    lines = [f"line {k} " + "word " * 60 + ("e.g. that" if k in (2, 100) else "") for k in range(110)]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    e = parse(D.placed_lines(docs))
    found = audit.model_scan(e, text.mock_answer, RULES).collect()
    assert len(found) == 2 and [r.page for r in sorted(found, key=lambda r: r.seq)][0].startswith("1-") and all(r.message for r in found)
    assert audit.model_scan(e, text.mock_answer, {"llm_scan": {"enabled": False}}).count() == 0


def test_files(spark, tmp_path):
    folder = tmp_path / "p1" / "reviews" / "r1" / "hybrid_auto"
    folder.mkdir(parents=True)
    (folder / "a.md").write_text("no")
    (folder / "r1.md").write_text("# 质询问题\n1. yes")
    (folder / "x_middle.json").write_text("{}")
    rows = D.review_folders(spark, str(tmp_path)).collect()
    assert [(r.sample_id, r.text, r.layout) for r in rows] == [("papers-mineru10-p1-r1", "# 质询问题\n1. yes", "{}")]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.pdf").write_bytes(b"abc")
    good = hashlib.sha256(b"abc").hexdigest()
    listed = spark.createDataFrame([("1", "f/a.pdf", good.upper()), ("2", "f/b.pdf", good), ("3", "f/a.pdf", "0"), ("4", "f/a.pdf", None)], "id string, path string, sha256 string")
    assert {r.id: r.status for r in D.verify(D.files(spark, str(tmp_path / "f")), listed).collect()} == {"1": "ok", "2": "missing", "3": "wrong", "4": "unchecked"}


def test_upserts_with_other_keys(spark):
    target = spark.createDataFrame([(1, "m", "a", 0.5), (2, "m", "b", 0.5)], "comment_id long, metric_id string, text string, weight double")
    changes = spark.createDataFrame([(2, "", " new ", "7", 1), (None, "m", "a", "", 1), (None, "m", "c", None, 1), (None, "m", "c", "0.25", 2), (None, "", "x", None, 1), (3, "k", "", None, 1)], "comment_id long, metric_id string, text string, weight string, nth int")
    done = store.upsert_experts(target, changes, text.embed)
    assert sorted((r.metric_id, r.text, r.weight) for r in done.collect()) == [("m", "a", 0.5), ("m", "c", 0.25), ("m", "new", 1.0)]
    again = store.upsert_experts(done, changes, text.embed)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, done.collect()))
