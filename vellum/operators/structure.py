"""Checks of labels, formulas and headings, by joins and windows over elements."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import patterns as P
from vellum.functions import predicates as B
from vellum.operators.issues import issue, union
from vellum.operators.marks import mark


def _mentions(c: Column) -> Column:
    """Numbers of the figures and tables that a text mentions: those with one separator at most and none left hanging."""
    edge = f"(?i)(?<![一-鿿A-Za-z0-9])(?:图|表|(?:Figure|Fig\\.?|Table)(?![A-Za-z])){P.S}*({P.NUMBER})({P.DASH}?)"
    # The pattern goes back and forth at every letter; few texts have a word that it can't do without.
    low = F.lower(c)
    some = F.contains(c, F.lit("图")) | F.contains(c, F.lit("表")) | F.contains(low, F.lit("fig")) | F.contains(low, F.lit("table"))
    c = F.when(some, c)
    numbers, hanging = (F.regexp_extract_all(c, F.lit(edge), F.lit(k)) for k in (1, 2))
    pairs = F.filter(F.arrays_zip(numbers.alias("n"), hanging.alias("d")), lambda x: (x.d == "") & (F.regexp_count(x.n, F.lit(P.DASH)) < 2))
    return F.transform(pairs, lambda x: B.label_number(x.n))


def caption_rows(elements: DataFrame) -> DataFrame:
    return elements.where((F.col("type") == "chart") | ((F.col("type") == "title") & mark(elements, "caption")))


def labels_missing(elements: DataFrame, rules: dict[str, Any] | None = None) -> DataFrame:
    """Mentions of figures and tables that no caption of the document has."""
    known = caption_rows(elements).select("doc_id", B.label_number(F.regexp_extract("content", P.CAPTION_NUMBER, 1)).alias("n")).where("n <> ''").distinct()
    rows = elements.where("type = 'text' and region <> 'reference'").select("*", F.explode(_mentions(F.col("content"))).alias("n"))
    return rows.join(known, ["doc_id", "n"], "left_anti").select(*issue("Label_Missing", "Info", "正文引用的图表编号未在图表标题中找到"))


def formula_rows(elements: DataFrame, rules: dict[str, Any], compat: bool = True) -> DataFrame:
    """Displayed formulas with their number, at their end or beside them on the page, and the box that has it."""
    side = rules.get("formula_check", {}).get("numbering", "right")
    page = elements.groupBy("doc_id", "page_num").agg(F.max("x1").alias("max_x"), F.max("y1").alias("max_y"))
    formulas = elements.where("type = 'formula'").where(B.is_display_formula(F.col("content")))
    formulas = formulas.withColumn("own", F.when(B.has(F.col("content"), P.FORMULA_END), B.formula_number(F.regexp_extract("content", P.FORMULA_END, 1))))
    formulas = formulas.join(page, ["doc_id", "page_num"])
    alone = elements.where("type in ('text', 'title', 'formula')").where(B.has(F.col("content"), P.FORMULA_ONLY))
    alone = alone.select("doc_id", "page_num", F.col("seq").alias("e_seq"), *[F.col(b).alias(f"e_{b}") for b in ("x0", "y0", "x1", "y1")], B.formula_number(F.regexp_extract("content", P.FORMULA_ONLY, 1)).alias("n"))
    off = F.abs((F.col("e_y0") + F.col("e_y1") - F.col("y0") - F.col("y1")) / 2)
    fits = (off <= F.greatest(F.lit(3.5), F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")) * 0.8)) & (F.col("e_x1") - F.col("e_x0") <= 120)
    if side == "right":
        fits = fits & (F.col("e_x0") >= F.col("x1") - 4) & (F.col("e_y0") > F.col("max_y") * 0.08) & (F.col("e_y1") < F.col("max_y") * 0.96) & (F.col("e_x1") >= F.col("max_x") * 0.85)
    elif side == "left":
        fits = fits & (F.col("e_x1") <= F.col("x0") + 4)
    near = formulas.where("own is null").join(alone, ["doc_id", "page_num"])
    rank = F.struct((off * 1000 + F.abs(F.col("e_x0") - F.col("x1"))).alias("score"), "e_seq")
    best = near.groupBy("doc_id", "seq").agg(F.min(F.when(fits, F.struct(rank.alias("rank"), "n", "e_x0", "e_x1"))).alias("best"), F.max(F.struct("e_seq", "n")).alias("last"))
    out = formulas.join(best, ["doc_id", "seq"], "left")
    beside = F.coalesce(F.col("best.n"), F.col("last.n")) if compat else F.col("best.n")
    number = F.coalesce("own", beside)
    return out.select(*elements.columns, "max_x", F.when(number != "", number).alias("number"), F.coalesce("best.e_x0", "x0").alias("n_x0"), F.coalesce("best.e_x1", "x1").alias("n_x1"))


def formula_mentions(elements: DataFrame) -> DataFrame:
    """(doc_id, number): numbers of formulas that texts mention."""
    c = F.col("content")
    # Each pattern is looked for only in texts with a sign that it can't do without.
    signs = (F.contains(c, F.lit("式")), F.contains(F.lower(c), F.lit("eq")), F.contains(c, F.lit("(")) | F.contains(c, F.lit("（")))
    *found, parens = (F.when(has, F.regexp_extract_all(c, F.lit(p), F.lit(1))).otherwise(F.array().cast("array<string>")) for has, p in zip(signs, (*P.FORMULA_MENTIONS, P.FORMULA_PAREN)))
    parens = F.filter(parens, lambda n: B.has(n, P.DASH))
    rows = elements.where("type = 'text'").select("doc_id", F.explode(F.concat(*found, parens)).alias("raw"))
    return rows.select("doc_id", B.formula_number(F.col("raw")).alias("number")).distinct()


def formulas(elements: DataFrame, rules: dict[str, Any], compat: bool = True) -> DataFrame:
    """Formulas without a number, whose number is not mentioned, or is not at the side it should be."""
    r = rules.get("formula_check", {})
    rows = formula_rows(elements, rules, compat)
    numbered = rows.where("number is not null")
    parts = []
    if r.get("require_numbering", False):
        parts.append(rows.where("number is null").select(*issue("Formula_Missing", r.get("missing_severity", "Warning"), "公式未检测到编号")))
    if r.get("check_reference", False):
        known = formula_mentions(elements).withColumn("said", F.lit(True))
        both = numbered.join(known, ["doc_id", "number"], "left").withColumn("unsaid", F.col("said").isNull())
        doc = Window.partitionBy("doc_id")
        both = both.withColumn("n", F.sum(F.col("unsaid").cast("int")).over(doc)).withColumn("share", F.col("n") / F.count("*").over(doc))
        least, ratio = int(r.get("min_unreferenced_count", 0) or 0), float(r.get("unreferenced_ratio_threshold", 0.0) or 0.0)
        parts.append(both.where("unsaid").where((F.col("n") >= least) & (F.col("share") >= ratio)).select(*issue("Formula_Ref_Missing", "Info", "公式编号未在正文引用中出现")))
    if r.get("numbering", "right") == "right":
        parts.append(numbered.where("n_x1 < max_x * 0.6").select(*issue("Formula_Misaligned", "Warning", "公式编号疑似未右对齐")))
    elif r.get("numbering") == "left":
        parts.append(numbered.where("n_x0 > max_x * 0.15").select(*issue("Formula_Misaligned", "Warning", "公式编号疑似未左对齐")))
    return union(parts)


def _in_body(elements: DataFrame) -> DataFrame:
    """Elements outside the bands at the top and bottom of their page."""
    low = F.max("y1").over(Window.partitionBy("doc_id", "page_num"))
    return elements.withColumn("low", low).where("y0 > low * 0.08 and y1 < low * 0.95").drop("low")


def heading_rows(elements: DataFrame) -> DataFrame:
    """Numbered headings in reading order with their numbers; running chapter titles are left out."""
    c = F.col("content")
    titles = elements.where("type = 'title' and region = 'title'")
    compact = B.squeeze(c)
    times = F.count("*").over(Window.partitionBy("doc_id", compact))
    running = (times >= 3) & B.has(compact, P.RUNNING_CHAPTER)
    titles = titles.withColumn("running", running)
    low = elements.groupBy("doc_id", "page_num").agg(F.max("y1").alias("low"))
    rows = titles.join(low, ["doc_id", "page_num"]).where("not running and y0 > low * 0.08 and y1 < low * 0.95")
    rows = rows.withColumn("parts", mark(elements, "parts")).where("parts is not null")
    return rows.withColumn("key", F.array_join(F.col("parts").cast("array<string>"), ".")).drop("running", "low")


def headings(elements: DataFrame, rules: dict[str, Any]) -> DataFrame:
    """Headings too deep, with a number that was there before, that skip a level, or leave a number out."""
    r = rules.get("heading_check", {})
    depth, severity = int(r.get("max_depth", 4)), r.get("continuity_severity", "Info")
    rows = heading_rows(elements)
    parts = [rows.where(F.size("parts") > depth).select(*issue("Hierarchy_Fault", "Warning", f"标题层级过深 (最大允许: {depth})"))]
    place = ["page_num", "y0", "x0", "seq"]
    same = Window.partitionBy("doc_id", "key").orderBy(*place)
    again = rows.withColumn("nth", F.row_number().over(same)).withColumn("first_page", F.first("page_num").over(same)).where("nth > 1")
    message = F.concat(F.lit("标题序号重复: "), F.col("key"), F.lit(" (首次出现: 第"), F.col("first_page").cast("string"), F.lit("页)"))
    parts.append(again.select(*issue("Hierarchy_Fault", severity, message)))
    if not r.get("continuity_check", False):
        return union(parts)
    order = Window.partitionBy("doc_id").orderBy(*place)
    before = F.lag(F.struct("page_num", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), "parts")).over(order)
    jumps = rows.withColumn("before", before).where("before.page_num = page_num")
    jumps = jumps.where(F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("before.cx")) < float(r.get("column_threshold", 200.0)))
    jumps = jumps.where((F.size("parts") > F.size("before.parts") + 1) & (F.slice("parts", 1, F.size("before.parts")) == F.col("before.parts")))
    parts.append(jumps.select(*issue("Hierarchy_Fault", severity, "标题层级跳跃")))
    rows = rows.withColumn("child", F.element_at("parts", -1)).withColumn("parent", F.array_join(F.slice("parts", 1, F.size("parts") - 1).cast("array<string>"), "."))
    earlier = Window.partitionBy("doc_id", "parent").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("expected", F.coalesce(F.max("child").over(earlier), F.lit(0)) + 1).where("child > expected")
    rows = rows.withColumn("wanted", F.concat_ws(".", F.when(F.col("parent") != "", F.col("parent")), F.col("expected").cast("string")))
    seen = _in_body(elements).withColumn("parts", mark(elements, "parts")).where("parts is not null")
    seen = seen.groupBy("doc_id", F.array_join(F.col("parts").cast("array<string>"), ".").alias("wanted")).agg(F.min(F.struct("page_num", "y0", "x0")).alias("at"))
    gaps = rows.join(seen, ["doc_id", "wanted"], "left").where(F.col("at").isNull() | ~(F.col("at") < F.struct("page_num", "y0", "x0")))
    message = F.concat(F.lit("标题序号不连续 (期望: "), F.col("wanted"), F.lit(")"))
    parts.append(gaps.select(*issue("Hierarchy_Fault", severity, message)))
    return union(parts)
