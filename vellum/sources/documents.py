"""Lines, blocks and spans from documents of several shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.schemas import BLOCK

LINES_PER_PAGE = 8


def text_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, page_num, line): lines of plain texts, eight a page."""
    at = F.posexplode(F.split("text", "\n")).alias("pos", "line")
    return docs.select("doc_id", at).select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), (F.floor(F.col("pos") / LINES_PER_PAGE) + 1).cast("int").alias("page_num"), "line")


def placed_lines(docs: DataFrame) -> DataFrame:
    """Lines of plain texts as the parser takes them: all of one size, one below the other, eight a page."""
    slot = F.expr("(line_no - 1) % 8")
    return text_lines(docs).select(
        "doc_id", "line_no", "page_num", F.col("line").alias("content"), F.lit(10.0).alias("size"),
        F.lit(72.0).alias("x0"), (80 + slot * 80).cast("double").alias("y0"), (72 + F.least(F.length("line") * 5, F.lit(450))).cast("double").alias("x1"), (92 + slot * 80).cast("double").alias("y1"),
    )


def _two(lines: DataFrame, mark: Column, body: Column) -> DataFrame:
    """Lines of which some have a line of their own put before them (``mark``, null for none): numbered by twos, in order."""
    both = F.when(mark.isNotNull(), F.array(mark, body)).otherwise(F.array(body))
    return lines.select("*", F.posexplode(both).alias("n", "content")).withColumn("slot", F.expr("(line_no - 1) % 8")).withColumn("line_no", F.col("line_no") * 2 + F.col("n"))


def decorated_lines(docs: DataFrame) -> DataFrame:
    """Whole lines of ``docs`` with citations, references and faults put after them by a fixed rule, and with headings,
    captions, formulas and reference titles in lines of their own before them; with boxes."""
    lines = text_lines(docs).withColumn("h", F.expr("cast((doc_id * 31 + line_no * 17) % 13 as int)"))
    number = lambda base, what, n: F.expr(f"cast({base} + {what} % {n} as string)")
    line, h = F.col("line"), F.col("h")
    own = F.col("line_no").cast("string")
    mark = (
        F.when(h == 0, F.concat(number(1, "line_no", 4), F.lit("."), number(1, "doc_id", 5), F.lit(" Part "), own))
        .when(h == 1, F.concat(F.lit("Figure "), number(1, "line_no", 6), F.lit(" What part "), own, F.lit(" shows")))
        .when(h == 5, F.concat(F.lit("x_"), own, F.lit(" = y^2 ("), number(1, "line_no", 7), F.lit(")")))
        .when((h == 10) & F.expr("line_no % 3 = 0"), "References")
    )
    body = (
        F.when(h == 2, F.concat(line, F.lit(" ["), number(1, "doc_id", 9), F.lit(", "), number(1, "line_no", 12), F.lit("]")))
        .when(h == 3, F.concat(line, F.lit(" (Smith, "), number(1990, "doc_id", 30), F.lit(")")))
        .when(h == 4, F.concat(F.lit("["), number(1, "line_no", 10), F.lit("] "), line, F.lit(" vol. 3")))
        .when(h == 6, F.concat(line, F.lit(" see Figure "), number(1, "line_no", 9)))
        .when(h == 7, F.concat(line, F.lit(" TensorFlw and deep-learning")))
        .when(h == 8, F.concat(line, F.lit(" as noted.["), number(1, "doc_id", 5), F.lit("]")))
        .when(h == 9, F.concat(line, F.lit(" from Eq. ("), number(1, "line_no", 9), F.lit(")")))
        .otherwise(line)
    )
    y = 80 + F.col("slot") * 80 + F.col("n") * 20
    return _two(lines, mark, body).select(
        "doc_id", "line_no", "page_num", "h", "content",
        F.when((h == 0) & (F.col("n") == 0), 14.0).otherwise(10.0).alias("size"),
        (72 + h % 3 * 10).cast("double").alias("x0"), y.cast("double").alias("y0"),
        (272 + h % 3 * 10 + h * 20).cast("double").alias("x1"), (y + 12).cast("double").alias("y1"),
    )


def heading_lines(docs: DataFrame) -> DataFrame:
    """Whole lines of ``docs``, with a heading before every third by a fixed rule; headings come again, skip levels and go too deep."""
    lines = text_lines(docs)
    top, sub = F.expr("cast(1 + floor(line_no / 15) % 3 as string)"), F.expr("cast(1 + doc_id % 2 as string)")
    k = F.col("line_no") % 15
    mark = F.when(k == 0, F.concat(top, F.lit(" Alpha"))).when(k.isin(3, 9), F.concat(top, F.lit("."), sub, F.lit(" Beta"))).when(k == 6, F.concat(top, F.lit("."), sub, F.lit(".2.1 Gamma"))).when(k == 12, F.concat(top, F.lit(".1.1.1.1 Delta")))
    y = 80 + F.col("slot") * 80 + F.col("n") * 20
    rows = _two(lines.withColumn("headed", k % 3 == 0), mark, F.col("line"))
    return rows.select(
        "doc_id", "line_no", "page_num", "content", F.when(F.col("headed") & (F.col("n") == 0), 14.0).otherwise(10.0).alias("size"),
        F.lit(72.0).alias("x0"), y.cast("double").alias("y0"), F.lit(272.0).alias("x1"), (y + 12).cast("double").alias("y1"),
    )


def block_lines(pages: DataFrame) -> DataFrame:
    """Lines of pages (doc_id, page_num, width, blocks as JSON): text, largest size, box, and the column they are in.

    Reading order is page, column, top and left of the block, place of the line. A page has two columns if blocks
    start on both sides of its middle.
    """
    blocks = pages.select("doc_id", "page_num", "width", F.posexplode(F.from_json("blocks", BLOCK)).alias("block_no", "block"))
    right = F.when(F.col("block.bbox")[0] >= F.col("width") * 0.5, 1).otherwise(0)
    from pyspark.sql import Window

    page = Window.partitionBy("doc_id", "page_num")
    blocks = blocks.withColumn("side", right)
    both = (F.min("side").over(page) == 0) & (F.max("side").over(page) == 1)
    blocks = blocks.withColumn("col", F.when(both, F.col("side")).otherwise(0))
    lines = blocks.select("doc_id", "page_num", "col", "block_no", "block.type", F.col("block.bbox").alias("block_bbox"), F.posexplode_outer("block.lines").alias("line_no", "line"))
    text = F.regexp_replace(F.array_join(F.transform("line.spans", lambda s: s.text), ""), r"^\s+|\s+$", "")
    size = F.coalesce(F.array_max(F.transform("line.spans", lambda s: s.size)), F.lit(0.0))
    return lines.select("doc_id", "page_num", "col", "block_no", "line_no", "type", "block_bbox", F.col("line.bbox").alias("bbox"), text.alias("content"), size.alias("size"))


def span_rows(files: DataFrame) -> DataFrame:
    """Spans of review layouts (doc_id, json), and for lines of several spans the line as a whole."""
    kind = "struct<pdf_info: array<struct<page_idx: int, para_blocks: array<struct<lines: array<struct<spans: array<struct<content: string, bbox: array<double>>>>>, blocks: array<struct<lines: array<struct<spans: array<struct<content: string, bbox: array<double>>>>>>>>>>>>"
    pages = files.select("doc_id", F.explode(F.from_json("json", kind).pdf_info).alias("p"))
    blocks = pages.select("doc_id", (F.col("p.page_idx") + 1).alias("page_num"), F.explode("p.para_blocks").alias("b"))
    lines = F.when(F.size("b.blocks") > 0, F.flatten(F.transform("b.blocks", lambda x: x.lines))).otherwise(F.col("b.lines"))
    rows = blocks.select("doc_id", "page_num", F.explode(lines).alias("l")).withColumn("spans", F.filter("l.spans", lambda s: F.length(F.trim(s.content)) > 0))
    spans = rows.select("doc_id", "page_num", F.explode("spans").alias("s")).select("doc_id", "page_num", F.trim("s.content").alias("content"), F.col("s.bbox").alias("bbox"))
    edge = lambda i, f: f(F.transform("spans", lambda s: s.bbox[i]))
    box = F.array(edge(0, F.array_min), edge(1, F.array_min), edge(2, F.array_max), edge(3, F.array_max))
    whole = rows.where(F.size("spans") > 1).select("doc_id", "page_num", F.array_join(F.transform("spans", lambda s: F.trim(s.content)), "").alias("content"), box.alias("bbox"))
    return spans.unionByName(whole)


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Labelled issues of a JSON file, which holds a list or an object with ``items``."""
    item = "struct<sample_id: string, paper_id: string, chunk_id: string, issue_type: string, severity: string, message: string, evidence: string, page_num: string, bbox: array<double>>"
    raw = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json("value", f"struct<items: array<{item}>>").items, F.from_json("value", f"array<{item}>"))
    return raw.select(F.explode(listed).alias("x")).select("x.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Samples (id, kind, path, url, sha256) of a JSON list; rows without id or path are left out, the first of an id counts."""
    kind = "array<struct<id: string, kind: string, path: string, url: string, sha256: string>>"
    from pyspark.sql import Window

    raw = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json("value", f"struct<samples: {kind}>").samples, F.from_json("value", kind))
    rows = raw.select(F.posexplode(listed).alias("pos", "x")).select("pos", "x.*").where("id <> '' and path <> ''")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where("n = 1").drop("n", "pos")


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content, sha256, is_pdf) of the files under a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    pdf = F.instr(F.decode(F.substring("content", 1, 1024), "ISO-8859-1"), "%PDF") > 0
    return raw.select("path", "content", F.sha2("content", 256).alias("sha256"), pdf.alias("is_pdf"))




def open_payloads(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``payloads`` with ``error``: null for a PDF, else why it can't be read: invalid_pdf or encrypted_pdf.

    A payload is the file's bytes, or a text that is base64 of them. A PDF has its mark within the first 1,024 bytes; one
    that names an encryption dictionary is encrypted.
    """
    raw = F.col(column) if dict(payloads.dtypes)[column] == "binary" else F.try_to_binary(F.col(column), F.lit("base64"))
    text = F.decode(raw, "ISO-8859-1")
    pdf = F.coalesce(F.instr(F.substring(text, 1, 1024), "%PDF") > 0, F.lit(False))
    return payloads.withColumn("error", F.when(~pdf, "invalid_pdf").when(F.regexp_like(text, F.lit(r"/Encrypt[\s/<0-9]")), "encrypted_pdf"))


def verify(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, path, status): whether a manifest's files are there and have its digest: ok, missing, wrong or unchecked.

    ``files`` have (path, sha256); a manifest's path is the end of a file's path.
    """
    name = lambda c: F.regexp_extract(c, "[^/]+$", 0)
    own = files.select(F.col("path").alias("at"), "sha256", name(F.col("path")).alias("name"))
    want = manifest.select("id", "path", F.lower(F.trim(F.coalesce("sha256", F.lit("")))).alias("wanted"), name(F.col("path")).alias("name"))
    met = want.join(own, "name", "left").where(F.col("at").isNull() | F.endswith(F.concat(F.lit("/"), "at"), F.concat(F.lit("/"), F.regexp_replace("path", r"^(?:\./|/)+", ""))))
    status = F.when(F.count("sha256") == 0, "missing").when(F.max("wanted") == "", "unchecked").when(F.max((F.lower("sha256") == F.col("wanted")).cast("int")) == 1, "ok").otherwise("wrong")
    seen = met.groupBy("id", "path").agg(status.alias("status"))
    return manifest.select("id", "path").join(seen, ["id", "path"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def review_folders(spark: SparkSession, root: str) -> DataFrame:
    """(sample_id, paper, review, source, text, layout): reviews in folders paper/reviews/review/hybrid_auto under ``root``.

    text is the review's Markdown, layout its ``_middle.json`` (null if there is none); files that have the review's name
    come first, then the first by name.
    """
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"))
    part = lambda k: F.regexp_extract("path", r"([^/]+)/reviews/([^/]+)/hybrid_auto/([^/]+)$", k)
    raw = raw.select("value", "path", part(1).alias("paper"), part(2).alias("review"), part(3).alias("file")).where("paper <> ''")

    def best(end: str, column: str) -> DataFrame:
        own = raw.where(F.endswith("file", F.lit(end)))
        rank = F.struct((F.col("file") != F.concat("review", F.lit(end))).alias("other"), "file", "path", "value")
        return own.groupBy("paper", "review").agg(F.min(rank).alias(column))

    # Fixed value: the name of the collection in ids.
    rows = best(".md", "m").join(best("_middle.json", "j"), ["paper", "review"], "left")
    return rows.select(F.concat_ws("-", F.lit("papers-mineru10"), "paper", "review").alias("sample_id"), "paper", "review", F.col("m.path").alias("source"), F.col("m.value").alias("text"), F.col("j.value").alias("layout"))
