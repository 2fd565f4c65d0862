"""Checks of citations against references."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import patterns as P
from vellum.functions import predicates as B
from vellum.operators.issues import issue
from vellum.operators.marks import mark

NO_INTS = "array<int>"


def _is_year(n: Column) -> Column:
    return n.between(1800, 2100)


def layout_reference_numbers(elements: DataFrame) -> DataFrame:
    """For each document with references: their numbers from 1 to 300, and the largest, or how many references there are."""
    # The number's own stretch of the text is cut out once.
    said = F.regexp_extract("content", P.LAYOUT_REFERENCE_NUMBER, 0)
    number = B.let(said, lambda s: F.concat(*[F.regexp_extract(s, P.LAYOUT_REFERENCE_NUMBER, k) for k in range(1, 7)])).try_cast("int")
    rows = elements.where("region = 'reference'").select("doc_id", number.alias("n"))
    found = rows.groupBy("doc_id").agg(F.collect_set(F.when(F.col("n").between(1, 300), F.col("n"))).alias("known"), F.count("*").cast("int").alias("n_refs"))
    return found.select("doc_id", "known", F.coalesce(F.array_max("known"), F.col("n_refs")).alias("top"))


def cited_numbers(content: Column) -> Column:
    """Numbers of a citation: ranges of at most 51 are spelled out, years and 0 left out."""
    parts = F.flatten(F.transform(F.regexp_extract_all(content, F.lit(P.LAYOUT_GROUP), F.lit(1)), lambda g: F.split(B.strip(g), P.LAYOUT_SPLIT)))

    def numbers(p):
        a, b = (F.regexp_extract(p, f"^([0-9]+){P.S}*[-–]{P.S}*([0-9]+)$", k).try_cast("int") for k in (1, 2))
        run = F.when((a > 0) & (a <= b) & (b - a <= 50), F.sequence(a, b))
        one = F.when(B.has(p, "^[0-9]+$"), F.array(F.coalesce(p.try_cast("int"), F.lit(2**31 - 1))))
        return F.coalesce(run, one, F.array().cast(NO_INTS))

    return F.filter(F.flatten(F.transform(parts, numbers)), lambda n: (n > 0) & ~_is_year(n))


def layout_faults(elements: DataFrame, rules: dict[str, Any] | None = None) -> DataFrame:
    """Citations with numbers that no reference of the document has."""
    cites = elements.where("type = 'citation'").where(~(B.has(F.col("content"), P.LAYOUT_AUTHOR_YEAR) & B.has(F.col("content"), "[A-Za-z]")))
    # As a row of an array the numbers are worked out once, not again by each condition.
    used = F.filter(F.array(cited_numbers(F.col("content"))), lambda nums: (F.size(nums) > 0) & ~F.exists(nums, lambda n: n >= 150))
    cites = cites.select("*", F.explode(used).alias("nums"))
    both = cites.join(layout_reference_numbers(elements), "doc_id", "left")
    known = F.coalesce("known", F.array().cast(NO_INTS))
    near = F.filter("nums", lambda n: F.col("top").isNull() | (n <= F.col("top") + 10))
    missing = F.array_sort(F.array_except(F.array_distinct(near), known))
    rows = both.withColumn("missing", missing).where("size(missing) > 0")
    message = F.concat(F.lit("引用标注在参考文献区未找到对应条目: "), F.array_join(F.col("missing").cast("array<string>"), ", "))
    return rows.select(*issue("Citation_Visual_Fault", "Warning", message))


def reference_rows(elements: DataFrame, tail: float = 0.25) -> DataFrame:
    """Elements that are references; in documents without any, numbered items from the reference title or the last pages on.

    Contents aren't moved, but for the numbered items.
    """
    own = elements.select("*", mark(elements, "likely").alias("_likely"), mark(elements, "titled").alias("_titled"), mark(elements, "item").alias("_item"))
    titled = F.min(F.when(F.col("_titled"), F.struct("seq", "page_num")))
    start = F.coalesce(titled.page_num, F.greatest(F.bround(F.max("page_num") * (1.0 - tail), 0).cast("int"), F.lit(1)))
    none = own.groupBy(F.col("doc_id").alias("_doc")).agg(F.max("_likely").alias("_any"), start.alias("_from")).where("not _any")
    late = own.where("_item and not _likely").join(none, F.col("doc_id").eqNullSafe(F.col("_doc"))).where("page_num >= _from")
    return own.where("_likely").select(*elements.columns).unionByName(late.select(*elements.columns))


def _per_document(elements: DataFrame, tail: float) -> DataFrame:
    refs = reference_rows(elements, tail)
    numbers = F.array_distinct(F.flatten(F.collect_list(F.transform(B.reference_numbers(F.col("content")), lambda n: F.coalesce(n.try_cast("int"), F.lit(0))))))
    found = refs.groupBy("doc_id").agg(numbers.alias("known"), F.count("*").cast("int").alias("n_refs"))
    return found.select("doc_id", "known", "n_refs", F.coalesce(F.when(F.array_max("known") > 0, F.array_max("known")), F.col("n_refs")).alias("top"))


def pages_text(pages: Column) -> Column:
    """Sorted distinct pages, joined with commas."""
    return F.array_join(F.array_sort(pages).cast("array<string>"), ", ")


def styles(elements: DataFrame, rules: dict[str, Any]) -> DataFrame:
    """Documents that mix numbers and author-year citations, or use the style that isn't the configured one."""
    r = rules.get("citation_check", {})
    rows = elements.select("doc_id", "seq", "page_num", F.size(mark(elements, "numeric")).alias("n"), F.size(mark(elements, "authors")).alias("a"))
    found = rows.groupBy("doc_id").agg(
        F.lit(0).cast("long").alias("seq"), F.sum("n").alias("numeric"), F.sum("a").alias("author"),
        F.collect_set(F.when(F.col("n") > 0, F.col("page_num"))).alias("n_pages"), F.collect_set(F.when(F.col("a") > 0, F.col("page_num"))).alias("a_pages"),
    )
    parts = []
    if not r.get("allow_mixed_styles", False):
        both = found.where("numeric > 0 and author > 0")
        parts.append(both.select(*issue("Citation_Style_Inconsistent", r.get("style_inconsistent_severity", "Warning"), "正文引用风格不一致", F.lit("numeric + author-year"), pages_text(F.array_union("n_pages", "a_pages")), box=False)))
    style = (r.get("style", "IEEE") or "").strip().lower()
    severity = r.get("style_mismatch_severity", "Warning")
    if r.get("enforce_style", True) and style in ("ieee", "numeric"):
        parts.append(found.where("author > 0").select(*issue("Citation_Style_Mismatch", severity, "引用风格与配置不一致，建议使用数字编号引用", F.lit("author-year"), pages_text(F.col("a_pages")), box=False)))
    if r.get("enforce_style", True) and style in ("apa", "mla", "author-year"):
        parts.append(found.where("numeric > 0").select(*issue("Citation_Style_Mismatch", severity, "引用风格与配置不一致，建议使用作者-年份引用", F.lit("numeric"), pages_text(F.col("n_pages")), box=False)))
    out = parts[0] if parts else found.where("false").select(*issue("", "", "", F.lit(""), F.lit(""), box=False))
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def list_missing(elements: DataFrame, rules: dict[str, Any], compat: bool = True) -> DataFrame:
    """Documents with citations but without references. Not compat: nor with a reference title or numbered items at the end."""
    tail = float(rules.get("citation_check", {}).get("reference_detect_tail_ratio", 0.25) or 0.25)
    cited = elements.where((F.size(mark(elements, "numeric")) > 0) | (F.size(mark(elements, "authors")) > 0)).select("doc_id").distinct()
    out = cited.join(reference_rows(elements, tail).select("doc_id").distinct(), "doc_id", "left_anti")
    if not compat:
        last = Window.partitionBy("doc_id")
        section = elements.withColumn("from", F.greatest(F.bround(F.max("page_num").over(last) * (1.0 - tail), 0), F.lit(1)))
        section = section.where(B.is_reference_title(F.col("content")) | (F.col("region") == "reference") | ((F.col("page_num") >= F.col("from")) & B.has(F.col("content"), P.REFERENCE_ITEM)))
        out = out.join(section.select("doc_id").distinct(), "doc_id", "left_anti")
    return out.withColumn("seq", F.lit(0).cast("long")).select(*issue("Reference_List_Missing", "Warning", "正文存在引用标注，但未检测到参考文献列表", F.lit(""), F.lit("?"), box=False))


def numbers_missing(elements: DataFrame, rules: dict[str, Any]) -> DataFrame:
    """Cited numbers that no reference has, one issue a number."""
    tail = float(rules.get("citation_check", {}).get("reference_detect_tail_ratio", 0.25) or 0.25)
    docs = _per_document(elements, tail).select("doc_id", "known", "top")
    cites = elements.select("doc_id", "seq", "page_num", F.explode(mark(elements, "numeric")).alias("inner")).where("inner is not null")
    nums = F.filter(F.transform(F.split(B.squeeze(F.col("inner")), ","), lambda n: n.try_cast("int")), lambda n: n != 0)
    cites = cites.withColumn("nums", nums).where(~F.exists("nums", lambda n: n >= 150))
    rows = cites.join(docs, "doc_id").select("doc_id", "seq", "page_num", "known", "top", F.explode("nums").alias("n")).where("n <= top + 10 and not array_contains(known, n)")
    return rows.select(*issue("Citation_Reference_Missing", "Info", "引用标注未在参考文献中找到对应编号", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]")), box=False))


def authors_missing(elements: DataFrame, rules: dict[str, Any]) -> DataFrame:
    """Author-year citations of which no reference has both the author and the year."""
    tail = float(rules.get("citation_check", {}).get("reference_detect_tail_ratio", 0.25) or 0.25)
    refs = reference_rows(elements, tail).select("doc_id", F.lower("content").alias("text"))
    cites = elements.select("doc_id", "seq", "page_num", F.explode(F.regexp_extract_all("content", F.lit(P.AUTHOR_YEAR_ANY), F.lit(1))).alias("inner"))
    cites = cites.select("*", F.regexp_extract("inner", "[0-9]{4}[a-z]?", 0).alias("year"), F.lower(F.regexp_extract("inner", r"(?<![\p{L}\p{N}_])[A-Za-z][A-Za-z'\-]+(?![\p{L}\p{N}_])", 0)).alias("author")).where("author <> ''")
    some = elements.where(F.size(mark(elements, "authors")) > 0).select("doc_id").distinct()
    asked = cites.join(refs.select("doc_id").distinct(), "doc_id", "left_semi").join(some, "doc_id", "left_semi").withColumn("digits", F.substring("year", 1, 4))
    # References are found by the years in them, any four digits in a row; the author is looked for in these only.
    posted = refs.select("doc_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?=([0-9]{4}))"), F.lit(1)))).alias("digits"))
    named = F.contains(posted["text"], asked["year"]) & F.contains(posted["text"], asked["author"])
    rows = asked.join(posted, (asked["doc_id"] == posted["doc_id"]) & (asked["digits"] == posted["digits"]) & named, "left_anti")
    return rows.select(*issue("Citation_Reference_Missing", "Info", "作者-年份引用未在参考文献中找到对应条目", F.concat(F.lit("("), F.col("inner"), F.lit(")")), box=False))


def positions(elements: DataFrame, rules: dict[str, Any]) -> DataFrame:
    """Citations that come after a punctuation mark."""
    if not rules.get("punctuation_check", {}).get("check_citation_position", True):
        elements = elements.where("false")
    rows = elements.where(~mark(elements, "likely"))
    # What comes before a mark is tried at every letter, so only texts that have such a place are gone through.
    rows = rows.where(F.contains("content", F.lit("[")) & B.has(F.col("content"), P.POSITION))
    rows = rows.select("doc_id", "seq", "page_num", F.explode(F.regexp_extract_all("content", F.lit(f"(?s).{{0,18}}{P.POSITION}"), F.lit(0))).alias("hit"))
    return rows.select(*issue("Citation_Position_Inconsistent", "Info", "引用标注位置错误 (应置于标点符号之前)", F.col("hit"), box=False))
