"""Issue rows: making, deduplicating, counting, scoring and labelling them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import predicates as B
from vellum.schemas import ISSUE_COLUMNS

BOX = ("x0", "y0", "x1", "y1")


def issue(kind: str, severity: str | Column, message: str | Column, evidence: Column | None = None, page: Column | None = None, box: bool = True) -> list[Column]:
    """Columns of an issue about the element in hand."""
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [
        F.col("doc_id"), F.col("seq"), F.lit(kind).alias("issue_type"), text(severity).alias("severity"),
        (F.col("page_num").cast("string") if page is None else page).alias("page"),
        *[(F.col(b) if box else F.lit(None).cast("double")).alias(b) for b in BOX],
        (F.col("content") if evidence is None else evidence).alias("evidence"), text(message).alias("message"),
    ]


def union(parts: list[DataFrame]) -> DataFrame:
    """All issues, those of earlier parts before those of later ones."""
    steps = [p.select(*[F.col(c) if c != "seq" else (F.col("seq") + F.lit(k * 10**12)).alias("seq") for c in ISSUE_COLUMNS]) for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, steps)


def dedupe(issues: DataFrame) -> DataFrame:
    """The first of issues that agree in document, type, severity, page, message, evidence and box to a tenth."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    page = F.coalesce(F.when(F.col("page") != "", F.col("page")), F.lit("?"))
    box = F.when(F.col("x0").isNotNull(), F.concat_ws(",", *[B.tenths(F.col(b)) for b in BOX]))
    key = Window.partitionBy("doc_id", blank("issue_type"), blank("severity"), page, blank("message"), blank("evidence"), box).orderBy("seq")
    return issues.withColumn("_n", F.row_number().over(key)).where("_n = 1").drop("_n")


def severity_counts(issues: DataFrame) -> DataFrame:
    s = F.col("severity")
    is_c, is_w = s == "Critical", s == "Warning"
    n = lambda x: F.coalesce(F.sum(F.when(x, 1)), F.lit(0)).cast("long")
    return issues.groupBy("doc_id").agg(n(is_c).alias("n_critical"), n(is_w).alias("n_warning"), n(F.coalesce(~(is_c | is_w), F.lit(True))).alias("n_info"))


WEIGHTS = {"critical": 5.0, "warning": 2.0, "info": 0.5}


def weights(given: dict | None = None) -> dict[str, float | Column]:
    """The weights of a score: those given, which may be columns, else the standard ones."""
    own = {k: (given or {}).get(k) for k in WEIGHTS}
    return {k: x if isinstance(x, Column) else float(x or WEIGHTS[k]) for k, x in own.items()}


def score(counts: DataFrame, given: dict | None = None) -> DataFrame:
    """Score from 0 to 100 and level: many warnings and remarks weigh by the root of their number."""
    w = weights(given)
    loss = F.col("n_critical") * w["critical"] + F.sqrt("n_warning") * w["warning"] + F.sqrt("n_info") * w["info"]
    points = F.greatest(F.least(F.lit(100) - F.bround(loss, 0), F.lit(100)), F.lit(0)).cast("int")
    return counts.withColumn("score", points).withColumn("audit_level", level(F.col("score")))


def level(points: Column, passed: str = "Info") -> Column:
    return F.when(points < 60, "Critical").when(points < 80, "Warning").otherwise(passed)


def tags(issues: DataFrame) -> DataFrame:
    """(doc_id, tags): sorted labels of what is wrong, joined with commas."""
    t = F.lower("issue_type")
    tag = (
        F.when(t.contains("citation") | t.contains("reference"), "Citation_Inconsistency")
        .when(F.col("issue_type") == "Label_Missing", "Label_Missing")
        .when(F.col("issue_type") == "Hierarchy_Fault", "Hierarchy_Fault")
        .when(t.contains("punctuation"), "Punctuation_Error")
    )
    return issues.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(tag)), ",").alias("tags"))


def counts_by_type(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue_type")


def top_per_type(issues: DataFrame, k: int = 3) -> DataFrame:
    order = Window.partitionBy("doc_id", "issue_type").orderBy("seq")
    return issues.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def number_text(c: Column) -> Column:
    """A double as it is written in a list: whole numbers end in .0."""
    return F.when(c == F.floor(c), F.concat(c.cast("decimal(30,0)").cast("string"), F.lit(".0"))).otherwise(c.cast("string"))


def anchors(issues: DataFrame) -> DataFrame:
    """Adds anchor_id, a digest of type, page and box."""
    box = F.concat(F.lit("["), F.concat_ws(", ", *[number_text(F.col(b)) for b in BOX]), F.lit("]"))
    return issues.withColumn("anchor_id", F.md5(F.concat_ws("-", "issue_type", "page", box).cast("binary")))


def result_rows(issues: DataFrame) -> DataFrame:
    """One result row an issue, numbered in order within its document."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    page = B.normal_page(F.col("page"))
    return issues.select(
        "doc_id", F.format_string("item-%03d", n).alias("result_id"), B.point(F.col("issue_type")).alias("point"), B.rule_id(F.col("issue_type")).alias("rule_id"),
        B.level_score(F.col("severity")).alias("score"), B.normal_level(F.col("severity")).alias("level"), F.col("message").alias("description"),
        F.col("evidence").alias("evidence_quote"), F.concat(F.lit("p"), page.cast("string")).alias("section"), F.coalesce(F.col("y0").cast("int"), F.lit(0)).alias("line_start"),
    )


def payload(issues: DataFrame) -> DataFrame:
    """(doc_id, payload): a document's issues as one JSON text for a front end."""
    row = F.struct("issue_type", "severity", "page", F.array(*BOX).alias("bbox"), "evidence", "message", "anchor_id", F.array(*BOX).alias("highlight"))
    return anchors(issues).groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("seq", row.alias("row")))), lambda x: x.row)).alias("payload"))
