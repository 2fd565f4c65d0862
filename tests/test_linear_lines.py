"""What a line is takes time in proportion to its length, and stays what it was."""

import time

from pyspark.sql import functions as F

from vellum.functions import patterns as P
from vellum.functions import predicates as B


def test_white_space_inside_a_line_is_gone_through_once(spark):
    rows = spark.range(4).select(F.concat(F.lit(" 　a"), F.repeat(F.lit(" "), 300_000), F.lit("b  ")).alias("c"))
    began = time.monotonic()
    assert rows.select(F.length(B.strip(F.col("c"))).alias("n")).distinct().collect()[0].n == 300_002
    assert time.monotonic() - began < 20


def test_ends_titles_and_citations_are_as_before(spark):
    c = F.col("c")
    old_title = F.regexp_replace(B.squeeze(c), "[：:]+$", "").isin(*P.REFERENCE_TITLES)
    groups = F.regexp_extract_all(c, F.lit(P.CITATION_GROUP), F.lit(0))
    said = ["", " ", "References", " R e f e r e n c e s ： :\n", "参 考　文献", "Referencesx", "Reference:s", ":References", "x [1, 2] (A. Bee, 1999)", "if x [3]", "[0]", "[12] y[3]", "(no", None]
    said += [f"{chr(k)}References{chr(k)}" for k in (0x1C, 0x85, 0xA0, 0x180E, 0x1680, 0x2000, 0x200A, 0x200B, 0x2028, 0x205F, 0xFEFF)]
    rows = spark.createDataFrame([(x,) for x in said], "c string")
    for r in rows.select(c, B.strip(c).alias("s"), F.regexp_replace(c, f"^{P.S}+|{P.S}+$", "").alias("s0"), B.is_reference_title(c).alias("t"), old_title.alias("t0"), B.layout_citations(c).alias("l"), F.regexp_extract_all(c, F.lit(P.CITATION_AUTHOR), F.lit(0)).alias("a"), groups.alias("g")).collect():
        assert r.s == r.s0 and r.t == r.t0, repr(r.c)
    found = {r.c: r.l for r in rows.select(c, B.layout_citations(c).alias("l")).collect()}
    assert found["x [1, 2] (A. Bee, 1999)"] == ["[1, 2]", "(A. Bee, 1999)"]
    assert found["if x [3]"] == found["[0]"] == found["[12] y[3]"] == found["(no"] == [] and found[None] is None
