"""Long documents, which are dealt out by pages and blocks, against the same documents as one window each."""

import random

from pyspark.sql import functions as F

from vellum.operators import parse

LINES = "doc_id long, line_no long, page_num int, content string, size double, x0 double, y0 double, x1 double, y1 double"
KINDS = ["参考文献", "References", "Figure 3 some caption", "图 2 标题", "goes on here", "2.1 A heading", "x_1 = y^2 (3)", "as said [3] and (Lee, 2001)", "", "   ", "[1] Lee, a title. 2001", "plain text."]


def made(spark, lengths, weights=None):
    rng = random.Random(sum(lengths))
    rows = []
    for d, n in enumerate(lengths):
        # Titles are rare, so the mode begins somewhere within a document.
        kinds = rng.choices(KINDS, weights=weights or [0.15, 0.15, 2, 1, 3, 1, 1, 1, 1, 1, 1, 2], k=n)
        rows += [(d if d else None, k, None if d == 1 else 1 + k // rng.choice([7, 8]), c, rng.choice([10.0, 10.0, 12.0, 0.0, None]), 1.0 * k, 2.0 * k, 3.0 * k, 4.0) for k, c in enumerate(kinds)]
    return spark.createDataFrame(rows, LINES)


def test_by_pages_is_as_by_documents(spark):
    lines = made(spark, [40, 60, 300, 25, 500, 3, 1])
    # Pages of a document whose number changes back and forth are one page each.
    want = sorted(map(repr, parse.parse(lines, None).collect()))
    for long in (1, 30, 200, 100_000):
        assert sorted(map(repr, parse.parse(lines, long).collect())) == want
    titles = parse.parse(lines, 1).where("region = 'reference'").groupBy("doc_id").count().count()
    assert titles >= 2 and len(want) > 800


def test_offsets_by_blocks(spark):
    elements = parse.parse(made(spark, [40, 60, 300, 25])).where("doc_id is not null")
    got = {(r.doc_id, r.seq): (r.start, r.stop) for r in parse.with_offsets(elements, 7).collect()}
    text = {}
    for r in sorted(elements.collect(), key=lambda r: (r.doc_id, r.seq)):
        before = text.get(r.doc_id, "")
        text[r.doc_id] = before + r.content + "\n"
        assert got.pop((r.doc_id, r.seq)) == (len(before), len(before) + len(r.content))
    assert not got
    assert {r.doc_id: r.text for r in parse.document_text(elements).collect()} == {d: t[:-1] for d, t in text.items()}


def test_one_document_of_half_a_million_lines(spark):
    n, parts = 500_000, 16
    c = F.when(F.col("id") == 300_000, "References").when(F.col("id") % 50 == 7, F.concat(F.lit("Figure "), F.col("id").cast("string"))).otherwise(F.concat(F.lit("line "), F.col("id").cast("string")))
    lines = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("line_no"), (F.col("id") / 40).cast("int").alias("page_num"), c.alias("content"), F.lit(10.0).alias("size"), *[F.lit(1.0).alias(b) for b in ("x0", "y0", "x1", "y1")])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = parse.parse(lines).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count("*").alias("n"), F.min(F.when(F.col("region") == "reference", F.col("seq"))).alias("first")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # All tasks have about as much to do, and the mode begins at the title.
    assert len(rows) == parts and max(r.n for r in rows) < 1.2 * sum(r.n for r in rows) / parts
    assert min(r.first for r in rows) == 300_000 * 100 + 99
