"""Stored tables: upserts, latest rows, rule overlays, fallbacks, reports and evaluation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import predicates as B
from vellum.operators.issues import level
from vellum.storage import stage


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _beside(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Full join on keys (null equals null); columns of ``changes`` get a prefix, and _new says whether there is a row of it."""
    named = changes.select(*[F.col(c).alias(f"_c_{c}") for c in changes.columns], F.lit(True).alias("_new"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    return target.join(named, on, "full")


def upsert(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the rows of ``changes`` in place of those with the same keys (null equals null), restricted to target's columns.

    Columns that ``changes`` lacks keep their values. ``changes`` has one row a key.
    """
    pick = lambda c: F.when(F.col("_new"), F.col(f"_c_{c}")).otherwise(F.col(c)).alias(c) if c in changes.columns else F.col(c)
    return _beside(target, changes, keys).select(*[pick(c) for c in target.columns])


def coalescing_upsert(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Like ``upsert``, but only values that aren't null or empty replace others."""
    filled = lambda c: F.when(F.col(f"_c_{c}").cast("string") != "", F.col(f"_c_{c}"))
    return _beside(target, changes, keys).select(*[F.coalesce(filled(c), F.col(c)).alias(c) if c in changes.columns else F.col(c) for c in target.columns])


def seed(target: DataFrame, seeds: DataFrame, key: str, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """The table after seeding, and counts (inserted, updated, skipped)."""
    both = seeds.join(target.select(key).withColumn("_there", F.lit(1)), key, "left")
    there = F.coalesce(F.sum("_there"), F.lit(0)).cast("long")
    fresh = F.count("*") - there
    counts = both.agg(fresh.alias("inserted"), (there if overwrite else F.lit(0).cast("long")).alias("updated"), (F.lit(0).cast("long") if overwrite else there).alias("skipped"))
    new = seeds if overwrite else seeds.join(target.select(key), key, "left_anti")
    return upsert(target, new, [key]), counts


def overlay_rules(base: DataFrame, over: DataFrame) -> DataFrame:
    """(rule_id, content, source): a stored section replaces the whole configured one."""
    both = base.select("rule_id", F.col("content").alias("a")).join(over.select("rule_id", F.col("content").alias("b")), "rule_id", "full")
    return both.select("rule_id", F.coalesce("b", "a").alias("content"), F.when(F.col("b").isNotNull(), "db").otherwise("yaml").alias("source"))


def resolve_content(requests: DataFrame, sections: DataFrame, reviews: DataFrame) -> DataFrame:
    """(paper_id, chunk_id, content): the first text that is not empty, by section number, name, name without spaces, review.

    By number a section's own text comes before its other content, by name after it.
    """
    r = requests.select("paper_id", "chunk_id", F.regexp_extract("chunk_id", "[0-9]+", 0).try_cast("long").alias("number"))
    s = sections.select(F.col("paper_id").alias("p"), "section_id", "section_name", "content", "section_content")
    squeezed = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    # Each way to name a section is an equi-join of its own, so a request never meets all sections of its paper.
    joins = [
        (F.col("number") == F.col("section_id"), [(0, "section_content"), (1, "content")]),
        (F.col("section_name") == F.col("chunk_id"), [(2, "content"), (4, "section_content")]),
        (squeezed("section_name") == squeezed("chunk_id"), [(3, "content"), (5, "section_content")]),
    ]
    parts = []
    for on, ways in joins:
        tries = F.array(*[F.when(F.col(c) != "", F.struct(F.lit(k).alias("way"), F.col("section_id").alias("at"), F.col(c).alias("text"))) for k, c in ways])
        parts.append(r.join(s, (F.col("paper_id") == F.col("p")) & on).select("paper_id", "chunk_id", F.explode(F.filter(tries, lambda x: x.isNotNull())).alias("x")))
    v = reviews.where("review_content <> ''").select(F.col("paper_id").alias("p"), "review_id", F.col("section_id").alias("s_id"), "review_content")
    for on in (F.col("number") == F.col("review_id"), F.col("number") == F.col("s_id")):
        parts.append(r.join(v, (F.col("paper_id") == F.col("p")) & on).select("paper_id", "chunk_id", F.struct(F.lit(6).alias("way"), F.col("review_id").alias("at"), F.col("review_content").alias("text")).alias("x")))
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("paper_id", "chunk_id").agg(F.min("x").alias("x")).select("paper_id", "chunk_id", F.col("x.text").alias("content"))


def search(rows: DataFrame, words: str, columns: list[str], id_col: str, most: int = 50) -> DataFrame:
    """Rows with ``words`` in one of the columns, without case, the highest ids first, 200 at most."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.col(c).ilike(f"%{words}%")
    return rows.where(hit).orderBy(F.desc(id_col)).limit(max(1, min(most, 200)))


def key_columns(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Issues reduced to what makes two of them the same in an evaluation, with the columns ``keep``."""
    said = F.trim(F.coalesce("page", F.lit("")))
    page = F.when(said != "", F.coalesce(said.try_cast("int").cast("string"), F.col("page")))
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    box = F.when(F.size("bbox") == 4, F.array_join(F.transform("bbox", B.tenths), ","))
    return rows.select(*(keep or []), text("issue_type").alias("issue_type"), text("severity").alias("severity"), page.alias("page"), F.lower(text("evidence")).alias("evidence"), F.lower(text("message")).alias("message"), box.alias("box")).distinct()


def evaluate(predicted: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of predicted issues, which are right if a true one has the same key; by paper, say."""
    by = by or []
    return precision_recall(key_columns(predicted, by), key_columns(truth, by), by)


def upsert_experts(target: DataFrame, changes: DataFrame, embed: Callable[[DataFrame, str], DataFrame] | None = None, source: str = "admin") -> DataFrame:
    """Expert rows after ``changes`` (comment_id, metric_id, text, ...), which have a text and a comment_id or metric_id.

    A change means the row of its comment_id, else the first one of its metric and text; without either it is new. Empty
    values change nothing, weights are kept within 0 and 1, and ``embed`` (a table and its column of texts) gives the
    embedding of metric and text. The last change of a row wins, by ``nth`` if there is one.
    """
    given = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    ok = (given("text") != "") & ((given("metric_id") != "") | F.col("comment_id").isNotNull())
    rows = changes.where(ok).select(*[given(c).alias(c) if t == "string" else F.col(c) for c, t in changes.dtypes])
    if embed:
        rows = embed(rows.withColumn("_said", F.concat("metric_id", F.lit("\n"), "text")), "_said").drop("_said")
    old = target.select(F.col("comment_id").alias("_id"), F.col("metric_id").alias("_metric"), F.col("text").alias("_text"))
    by_text = old.groupBy("_metric", "_text").agg(F.min("_id").alias("_by_text"))
    rows = rows.join(old.select(F.col("_id").alias("_by_id")), F.col("comment_id") == F.col("_by_id"), "left")
    rows = rows.join(by_text, (F.col("metric_id") == F.col("_metric")) & (F.col("text") == F.col("_text")) & (F.col("metric_id") != ""), "left")
    rows = rows.withColumn("_at", F.coalesce("_by_id", "_by_text"))
    # A new row's number is its own or comes from its metric and text, the same however often it is run.
    rows = rows.withColumn("_key", F.coalesce(F.col("_at").cast("string"), F.col("comment_id").cast("string"), F.concat(F.lit("new:"), F.md5(F.concat_ws("\n", "metric_id", "text").cast("binary")))))
    rows = latest(rows, ["_key"], [F.desc("nth") if "nth" in changes.columns else F.lit(1)])
    weight = B.clamp_weight(F.col("weight").cast("string")) if "weight" in changes.columns else None
    new = {c: F.col(c) for c in changes.columns if c in target.columns}
    if weight is not None:
        new["weight"] = weight
    if embed and "embedding" in target.columns:
        new["embedding"] = F.col("embedding")
    kinds = dict(target.dtypes)
    blank = lambda c: F.when(new[c] != "", new[c]) if kinds[c] == "string" else new[c]
    fresh = {"rule_title": F.coalesce(*(x for x in (F.when(given("metric_id") != "", F.col("metric_id")), F.lit("UNKNOWN")))), "indicator_name": F.coalesce(F.when(given("metric_id") != "", F.col("metric_id")), F.lit("UNKNOWN")), "rule_text": F.col("text"), "operator": F.lit("N/A"), "source": F.lit(source), "active": F.lit(True), "is_hard_rule": F.lit(False), "evidence_pattern": F.lit("")}
    top = F.coalesce(F.col("_at"), F.col("comment_id"), F.pmod(F.xxhash64("_key"), F.lit(2**53)) + 2**32)
    ready = rows.select(top.cast(kinds["comment_id"]).alias("comment_id"), F.col("_at").isNull().alias("_fresh"), *[F.coalesce(*([blank(c)] if c in new else []), F.when(F.col("_at").isNull(), fresh.get(c, F.lit(None)))).cast(kinds[c]).alias(c) for c in target.columns if c != "comment_id"])
    named = ready.select(*[F.col(c).alias(f"_n_{c}") for c in ready.columns])
    both = target.join(named, F.col("comment_id") == F.col("_n_comment_id"), "full")
    return both.select(F.coalesce("comment_id", "_n_comment_id").alias("comment_id"), *[F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) for c in target.columns if c != "comment_id"]).select(*target.columns)


# What tells labelled issues apart, besides their type, as far as a change names it.
TRUTH_KEYS = ("sample_id", "paper_id", "chunk_id", "evidence", "message")


def upsert_truth(target: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled issues after ``changes``, and counts (inserted, updated, skipped).

    A change means the first row (issue_id) that has its type and all those of ``TRUTH_KEYS`` that it names; of a row it
    sets severity, page_num, bbox and source, as far as it names them. Changes without a type are skipped. Where several
    changes mean one row, the last (``nth``) wins; equal new ones are one row.
    """
    text = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    keys = ["issue_type", *TRUTH_KEYS]
    named = changes.select(*[text(c).alias(c) if t == "string" else F.col(c) for c, t in changes.dtypes])
    rows = named.where(F.col("issue_type").isNotNull()).withColumn("_row", F.xxhash64("nth", *keys))
    # Which keys are named decides which join finds the row: each set of names is one equi-join.
    names = F.concat(*[F.when(F.col(c).isNotNull(), "1").otherwise("0") for c in TRUTH_KEYS])
    shapes = sorted(r[0] for r in rows.select(names.alias("s")).distinct().collect())
    met = []
    for shape in shapes:
        on = ["issue_type", *[c for c, x in zip(TRUTH_KEYS, shape) if x == "1"]]
        first = target.groupBy(*on).agg(F.min("issue_id").alias("_at"))
        met.append(rows.where(names == shape).join(first, on, "left").select(*rows.columns, "_at"))
    if not met:
        return target, changes.agg(F.lit(0).cast("long").alias("inserted"), F.lit(0).cast("long").alias("updated"), F.count("*").alias("skipped"))
    rows = stage(reduce(DataFrame.unionByName, met), "truth")
    again = latest(rows.where("_at is not null"), ["_at"], [F.desc("nth")])
    sets = [c for c in ("severity", "page_num", "bbox", "source") if c in target.columns and c in changes.columns]
    old = target.join(again.select(F.col("_at").alias("_id"), *[F.col(c).alias(f"_n_{c}") for c in sets]), F.col("issue_id") == F.col("_id"), "left")
    old = old.select(*[F.coalesce(f"_n_{c}", c).alias(c) if c in sets else F.col(c) for c in target.columns])
    fresh = latest(rows.where("_at is null"), keys, [F.desc("nth")])
    kinds = dict(target.dtypes)
    number = F.pmod(F.xxhash64(*keys), F.lit(2**53)) + 2**32
    added = fresh.select(*[number.cast(kinds[c]).alias(c) if c == "issue_id" else (F.col(c) if c in fresh.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in target.columns])
    found = rows.agg(F.count_distinct(F.when(F.col("_at").isNull(), F.xxhash64(*keys))).alias("inserted"), F.count("_at").alias("updated"))
    counts = found.join(changes.agg(F.count(F.when(F.trim(F.coalesce("issue_type", F.lit(""))) == "", 1)).alias("skipped")))
    return old.unionByName(added), counts


def reembed(rows: DataFrame, embed: Callable[[DataFrame, str], DataFrame], most: int = 200, require_text: bool = True) -> DataFrame:
    """The first ``most`` (1 to 2000) rows (comment_id, metric_id, text, embedding) without an embedding, with one of metric and text."""
    todo = rows.where("embedding is null")
    if require_text:
        todo = todo.where("trim(text) <> ''")
    todo = todo.orderBy("comment_id").limit(max(1, min(2000, most))).drop("embedding")
    said = F.concat(F.trim(F.coalesce("metric_id", F.lit(""))), F.lit("\n"), F.trim(F.coalesce("text", F.lit(""))))
    return embed(todo.withColumn("_said", said), "_said").drop("_said")


def precision_recall(predicted: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of distinct rows in both, only predicted and only true, with precision, recall and F1 (0 where undefined)."""
    by = by or []
    columns = predicted.columns
    rows = predicted.distinct().withColumn("_p", F.lit(1)).withColumn("_t", F.lit(0)).unionByName(truth.distinct().withColumn("_p", F.lit(0)).withColumn("_t", F.lit(1)))
    rows = rows.groupBy(*columns).agg(F.max("_p").alias("_p"), F.max("_t").alias("_t"))
    n = lambda x: F.coalesce(F.sum(F.when(x, 1)), F.lit(0)).cast("long")
    p, t = F.col("_p") == 1, F.col("_t") == 1
    out = rows.groupBy(*by).agg(n(p & t).alias("tp"), n(p & ~t).alias("fp"), n(~p & t).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def report(issues: DataFrame, scores: DataFrame) -> DataFrame:
    """(doc_id, line): a report in Markdown, a text file's line a row, for ``write.text``."""
    head = scores.select("doc_id", F.posexplode(F.array(F.lit("# Audit report"), F.concat(F.lit("Score: "), F.col("score").cast("string")), F.concat(F.lit("Level: "), F.upper(level(F.col("score"), "Pass"))))).alias("n", "line")).select("doc_id", F.lit("").alias("t"), F.col("n").cast("long").alias("n"), "line")
    by_type = issues.groupBy("doc_id", "issue_type").agg(F.count("*").alias("n")).select("doc_id", F.col("issue_type").alias("t"), F.lit(-1).cast("long").alias("n"), F.concat(F.lit("## "), "issue_type", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    rows = issues.select("doc_id", F.col("issue_type").alias("t"), F.col("seq").alias("n"), F.concat(F.lit("- ["), "severity", F.lit("] p"), "page", F.lit(": "), F.coalesce("message", F.lit(""))).alias("line"))
    order = Window.partitionBy("doc_id").orderBy("t", "n", "line")
    return head.unionByName(by_type).unionByName(rows).select("doc_id", F.row_number().over(order).cast("long").alias("line_no"), "line")


def json_reports(issues: DataFrame, scores: DataFrame) -> DataFrame:
    """(doc_id, report): score and issues as one JSON text, for ``write.text``."""
    row = F.struct("issue_type", "severity", F.col("page").alias("page_num"), F.when(F.col("x0").isNotNull(), F.array("x0", "y0", "x1", "y1")).alias("bbox"), "evidence", "message")
    rows = issues.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", row.alias("row")))), lambda x: x.row).alias("issues"))
    both = scores.select("doc_id", "score").join(rows, "doc_id", "left")
    kind = dict(rows.dtypes)["issues"]
    return both.select("doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("file"), "score", F.coalesce("issues", F.array().cast(kind)).alias("issues"))).alias("report"))
