"""From lines to typed, placed elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import patterns as P
from vellum.functions import predicates as B

KEEP = ["doc_id", "seq", "type", "content", "x0", "y0", "x1", "y1", "page_num", "region"]


#: Lines from which on a document is long, and elements of a block of running sums.
LONG, BLOCK = 100_000, 20_000


def _dealt(lines: DataFrame, long: int | None) -> tuple[DataFrame, list[str]]:
    """Lines dealt out, and by which columns: documents whole, but by ``part`` if some are long, which are dealt out by their pages.

    ``title_at`` is a long document's first reference title. Long documents are found by a count; as each has ``long`` lines, they
    are few. A column with one value isn't among those columns: Spark takes it out of windows, which then ask for shuffles anew.
    """
    none = F.lit(None).cast("long").alias("title_at")
    sizes = lines.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") >= long).select("doc_id").collect() if long else []
    if not sizes:
        return lines.select("*", none).repartition("doc_id"), ["doc_id"]
    few = lines.sparkSession.createDataFrame(sizes, lines.select("doc_id").schema)
    titles = lines.join(F.broadcast(few), "doc_id").where(B.is_reference_title(B.strip(F.col("content")))).groupBy("doc_id").agg(F.min("line_no").alias("title_at"))
    # A long document without such a title has none before its end.
    few = few.join(titles, "doc_id", "left").select("doc_id", F.coalesce("title_at", F.lit((1 << 63) - 1)).alias("title_at"))
    own = lines.join(F.broadcast(few), "doc_id", "left").withColumn("part", F.when(F.col("title_at").isNull(), 0).otherwise(F.coalesce("page_num", F.lit(-1))))
    return own.repartition("doc_id", "part"), ["doc_id", "part"]


def parse(lines: DataFrame, long: int | None = LONG) -> DataFrame:
    """Elements of lines (doc_id, line_no, page_num, content, size, x0, y0, x1, y1), which are in reading order by line_no.

    From a reference title on, lines are references. A caption takes up to two lines after it on its page. Other lines
    give their citations and then a formula, a title or text. Documents of ``long`` lines and more are many tasks' work, a
    page being one's.
    """
    # Lines are dealt out and sorted once, for all windows; what a line is by itself is worked out once, before them.
    own, whole = _dealt(lines, long)
    own = own.withColumn("content", B.strip(F.col("content"))).where("content <> ''")
    c = F.col("content")
    own = own.select("*", B.is_reference_title(c).alias("is_title"), B.caption_like(c).alias("is_caption"), B.heading_like(c).alias("heading"), B.formula_like(c).alias("formula"))
    own = own.withColumn("goes_on", B.goes_on(c, F.col("is_title") | F.col("is_caption") | F.col("heading") | F.col("formula")))
    own = own.withColumn("starts", F.col("is_caption") & ~F.col("is_title"))
    box = ("x0", "y0", "x1", "y1")
    page = Window.partitionBy(*whole, "page_num").orderBy("line_no")
    earlier = lambda c, n: F.coalesce(F.lag(c, n).over(page), F.lit(False))
    # Of the two lines after a caption the first goes on with it if it can, and the second if the first does.
    later = lambda n: F.lead(F.when(F.col("goes_on"), F.struct("content", *box)), n).over(page)
    own = own.select("*", earlier("starts", 1).alias("after"), (earlier("starts", 2) & earlier("goes_on", 1)).alias("after_two"), later(1).alias("next"), later(2).alias("next_two"))
    own = own.withColumn("next_two", F.when(F.col("next").isNotNull(), F.col("next_two")))
    # These windows find their rows in order.
    body = F.coalesce(F.median(F.when(F.col("size") > 0, F.col("size"))).over(Window.partitionBy(*whole, "page_num")), F.lit(10.0))
    title_at = F.coalesce("title_at", F.min(F.when(F.col("is_title"), F.col("line_no"))).over(Window.partitionBy(*whole)))
    own = own.withColumn("body", body).withColumn("refs", F.coalesce(F.col("line_no") >= title_at, F.lit(False)))
    own = own.where(~(F.col("goes_on") & (F.col("after") | F.col("after_two"))))
    edge = lambda n, f: f(F.col(n), F.col(f"next.{n}"), F.col(f"next_two.{n}"))
    own = own.select("*", F.concat_ws(" ", "content", "next.content", "next_two.content").alias("caption_text"), *[edge(n, F.least if n in ("x0", "y0") else F.greatest).alias(f"c{n}") for n in box])
    large = (F.col("heading") & (F.col("size") >= F.col("body") * 1.15)) | (F.col("size") >= F.col("body") * 1.3)
    own = own.withColumn("kind", F.when(F.col("formula"), "formula").when(large, "title").otherwise("main"))
    in_refs = F.col("refs")
    kind_type = F.when(F.col("is_title") | F.col("starts"), "title").when(in_refs, "text").when(F.col("kind") == "formula", "formula").when(F.col("kind") == "title", "title").otherwise("text")
    region = F.when(F.col("is_title"), "reference").when(F.col("starts"), "chart").when(in_refs, "reference").when(F.col("kind").isin("formula", "title"), F.col("kind")).otherwise("main")
    place = lambda n: F.when(F.col("starts"), F.col(f"c{n}")).otherwise(F.col(n)).alias(n)
    element = F.struct((F.col("line_no") * 100 + 99).alias("seq"), kind_type.alias("type"), F.when(F.col("starts"), F.col("caption_text")).otherwise(c).alias("content"), *[place(n) for n in box], region.alias("region"))

    def cite(x, pos):
        return F.struct((F.col("line_no") * 100 + F.least(pos, F.lit(98))).alias("seq"), F.lit("citation").alias("type"), x.alias("content"), *[F.col(n).alias(n) for n in box], F.lit("citation").alias("region"))

    cites = F.when(F.col("is_title") | F.col("starts"), F.array().cast("array<string>")).otherwise(B.layout_citations(c))
    rows = own.select("doc_id", "page_num", F.explode(F.concat(F.array(element), F.transform(cites, cite))).alias("e"))
    return rows.select("doc_id", "e.seq", "e.type", "e.content", *[f"e.{n}" for n in box], "page_num", "e.region")


def with_offsets(elements: DataFrame, block: int = BLOCK) -> DataFrame:
    """Where each element's text begins and ends in the document's joined text.

    Lengths are summed in two steps, so a long document isn't one task's work: over blocks of ``block`` line numbers, and
    then inside each from the sum of those before it.
    """
    # Windows move lengths; contents go along only for callers that read them.
    own = elements.where("content <> ''").withColumn("_block", F.floor(F.col("seq") / (100 * block))).withColumn("_len", F.length("content"))
    sums = own.groupBy("doc_id", "_block").agg(F.sum(F.col("_len") + 1).alias("_n"))
    earlier = Window.partitionBy("doc_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("doc_id").alias("_d"), F.col("_block").alias("_k"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    before = Window.partitionBy("doc_id", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_base") + F.coalesce(F.sum(F.col("_len") + 1).over(before), F.lit(0))
    placed = own.join(sums, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_block") == F.col("_k"))).withColumn("start", start.cast("long"))
    return placed.withColumn("stop", (F.col("start") + F.col("_len")).cast("long")).drop("_block", "_base", "_d", "_k", "_len")


#: Characters of a bin are 2 to the power BIN, and each level's bins hold 2 to the power STEP of those below; there are LEVELS.
BIN, STEP, LEVELS = 8, 4, 7


def pages_at(offsets: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (doc_id, start, stop) with the pages that a stretch of the document's text is on, as "3" or "3-5".

    ``offsets`` are elements with their offsets. A stretch between two elements is on no page, which is "?".

    Stretches and elements meet in bins of the text, so no document is gone through for each of its stretches: the bins at
    the two ends of a stretch give their elements, and what lies between is made up of whole bins, of the largest that fit,
    whose first and last pages are known.
    """
    own = offsets.where("start < stop").select("doc_id", F.col("start").alias("_a"), F.col("stop").alias("_b"), "page_num")
    own = own.select("*", F.explode(F.sequence(F.shiftright("_a", BIN), F.shiftright(F.col("_b") - 1, BIN))).alias("bin"))
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("bin", STEP * k).alias("bin")) for k in range(LEVELS)])
    whole = own.select("doc_id", "page_num", F.explode(levels).alias("x")).groupBy("doc_id", "x.level", "x.bin").agg(F.min("page_num").alias("low"), F.max("page_num").alias("high"))
    keys = places.select("doc_id", "start", "stop").distinct().withColumn("_s", F.greatest("start", F.lit(0)).cast("long")).withColumn("_e", F.col("stop").cast("long")).where("_s < _e")
    ends = keys.select("*", F.explode(F.array_distinct(F.array(F.shiftright("_s", BIN), F.shiftright(F.col("_e") - 1, BIN)))).alias("bin"))
    ends = ends.join(own, ["doc_id", "bin"]).where(F.greatest("_s", "_a") < F.least("_e", "_b")).select("doc_id", "start", "stop", F.col("page_num").alias("low"), F.col("page_num").alias("high"))
    between = keys.select("*", F.explode(F.filter(F.array(*[_bins(k) for k in range(LEVELS)]), lambda x: F.size(x.bins) > 0)).alias("x"))
    between = between.select("doc_id", "start", "stop", "x.level", F.explode("x.bins").alias("bin"))
    inside = between.join(whole, ["doc_id", "level", "bin"]).select("doc_id", "start", "stop", "low", "high")
    found = ends.unionByName(inside).groupBy("doc_id", "start", "stop").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    low, high = F.col("low").cast("string"), F.col("high").cast("string")
    page = F.when(F.col("low") == F.col("high"), low).otherwise(F.concat(low, F.lit("-"), high))
    known = places.where("doc_id is not null and start is not null and stop is not null")
    return known.join(found.select("doc_id", "start", "stop", page.alias("pages")), ["doc_id", "start", "stop"], "left").withColumn("pages", F.coalesce("pages", F.lit("?")))


def _bins(level: int) -> Column:
    """The bins of a level that make up a stretch from _s to _e together with those of other levels."""
    first = lambda k: -F.shiftright(-F.col("_s"), BIN + STEP * k)
    last = lambda k: F.shiftright("_e", BIN + STEP * k)
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    if level + 1 == LEVELS:
        bins = run(first(level), last(level))
    else:
        # Where bins of the level above lie inside, only those before and after them are left.
        up, down = F.shiftleft(first(level + 1), STEP), F.shiftleft(last(level + 1), STEP)
        above = first(level + 1) < last(level + 1)
        bins = F.when(above, F.concat(run(first(level), up), run(down, last(level)))).otherwise(run(first(level), last(level)))
    return F.struct(F.lit(level).alias("level"), bins.alias("bins"))


def pages_held(lines: DataFrame) -> DataFrame:
    """(doc_id, page_num) of the elements of lines, which needs no parse: a line that isn't blank is an element, or part of one on its page."""
    return lines.where(B.strip(F.col("content")) != "").select("doc_id", "page_num")


def document_pages(docs: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, pages): the range of pages of each of ``docs`` (doc_id, and if known selected: array<int>, page_count: int, page_list: array<int>).

    By its elements, else by the pages selected, else by the number of pages, else by the pages listed; N/A where nothing tells.
    """
    have = dict(docs.dtypes)
    positive = lambda c: F.filter(c, lambda p: p > 0) if c in have else F.array().cast("array<int>")
    chosen, listed = positive("selected"), positive("page_list")
    count = F.col("page_count") if "page_count" in have else F.lit(None).cast("int")
    own = elements.groupBy("doc_id").agg(F.min("page_num").alias("low"), F.max("page_num").alias("high"))
    rows = docs.select("doc_id", chosen.alias("chosen"), count.alias("count"), listed.alias("listed")).join(own, "doc_id", "left")
    span = lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("-"), b.cast("string")))
    by_elements = F.when(F.col("low") > 0, span(F.col("low"), F.col("high"))).otherwise("N/A")
    among = lambda c: span(F.array_min(c), F.array_max(c))
    said = F.when(F.col("low").isNotNull(), by_elements).when(F.size("chosen") > 0, among("chosen")).when(F.col("count") > 0, span(F.lit(1), F.col("count"))).when(F.size("listed") > 0, among("listed"))
    return rows.select("doc_id", F.coalesce(said, F.lit("N/A")).alias("pages"))


def place_issues(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """Issues without a page get their document's range (doc_id, pages)."""
    known = F.when(~F.trim(F.coalesce("page", F.lit(""))).isin("", "?"), F.col("page"))
    return issues.join(pages, "doc_id", "left").withColumn("page", F.coalesce(known, "pages", F.lit("N/A"))).drop("pages")


def select_pages(lines: DataFrame, selection: DataFrame) -> DataFrame:
    """Lines of the pages that ``selection`` (doc_id, pages: array<int>) names; all of a document that it names none of."""
    wanted = selection.select("doc_id", F.filter("pages", lambda p: p > 0).alias("_wanted"))
    rows = lines.join(wanted, "doc_id", "left")
    return rows.where(F.coalesce(F.size("_wanted"), F.lit(0)).isin(-1, 0) | F.array_contains("_wanted", F.col("page_num"))).drop("_wanted")


def parse_report(lines: DataFrame) -> DataFrame:
    """(doc_id, pages, scanned_pages, multi_column_pages): a page has several columns if its lines have (col), else none has."""
    stats = page_stats(lines).select("doc_id", "page_num", "scanned")
    if "col" in lines.columns:
        stats = stats.join(lines.groupBy("doc_id", "page_num").agg((F.max("col") > 0).alias("several")), ["doc_id", "page_num"])
    else:
        stats = stats.withColumn("several", F.lit(False))
    n = lambda c: F.count(F.when(F.col(c), 1))
    return stats.groupBy("doc_id").agg(F.count("*").alias("pages"), n("scanned").alias("scanned_pages"), n("several").alias("multi_column_pages"))


# Fixed value: width and height of a page whose lines have no boxes.
PAGE_SIZE = (595.0, 842.0)


def page_stats(lines: DataFrame) -> DataFrame:
    """For each page: lines, characters, whether it counts as scanned, and its extents, which are those of a sheet if it has no boxes."""
    text = F.regexp_replace(F.array_join(F.collect_list(F.regexp_replace("content", f"^{P.S}+|{P.S}+$", "")), ""), f"^{P.S}+|{P.S}+$", "")
    return lines.groupBy("doc_id", "page_num").agg(F.count("*").alias("n_lines"), F.length(text).cast("long").alias("n_chars"), (F.length(text) < 10).alias("scanned"), *[F.coalesce(F.max(c), F.lit(d)).alias(n) for c, n, d in zip(("x1", "y1"), ("max_x", "max_y"), PAGE_SIZE)])


def document_text(elements: DataFrame) -> DataFrame:
    """(doc_id, text): contents of the elements in order, a line each."""
    rows = elements.where("content <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("xs"))
    return rows.select("doc_id", F.array_join(F.transform("xs", lambda x: x.content), "\n").alias("text"))
