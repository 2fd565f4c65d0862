"""Places, citations and marks that must not be gone through one by one: against plain versions, and crowded."""

import random
import re
import time

from pyspark.sql import functions as F

from vellum.config import RULES
from vellum.operators import citations, parse, terms

ELEMENTS = "doc_id long, seq long, type string, content string, x0 double, y0 double, x1 double, y1 double, page_num int, region string"


def made(spark, rows):
    """Elements of (doc_id, content, page[, region])."""
    return spark.createDataFrame([(d, k, "text", c, 0.0, 0.0, 1.0, 1.0, p, *(r or ["main"])) for k, (d, c, p, *r) in enumerate(rows)], ELEMENTS)


def test_pages_of_stretches(spark):
    rng = random.Random(6)
    rows = [(d, "x" * rng.choice([0, 1, 3, 40, 300, 5000]), rng.randint(1, 9) + k // 10) for d in range(3) for k in range(120)] + [(7, "y" * 300_000, 4), (7, "z", 2)]
    offsets = parse.with_offsets(made(spark, rows))
    held = {}
    for r in offsets.collect():
        held.setdefault(r.doc_id, []).append((r.start, r.stop, r.page_num))
    places = []
    for d in (0, 1, 2, 7, 8):
        end = max((b for _, b, _ in held.get(d, [])), default=50)
        for _ in range(120):
            a = rng.randint(-5, end + 3)
            places.append((d, a, a + rng.choice([-1, 0, 1, 2, 255, 256, 257, 4096, 4097, 70_000, end])))
        places += [(d, 0, end), (d, 256, 512), (d, 0, 1 << 20), (d, -3, 0)]
    got = {(r.doc_id, r.start, r.stop): r.pages for r in parse.pages_at(offsets, spark.createDataFrame(places, "doc_id long, start long, stop long")).collect()}
    for d, a, b in places:
        on = [p for s, e, p in held.get(d, []) if max(a, s) < min(b, e)]
        want = "?" if not on else str(min(on)) if min(on) == max(on) else f"{min(on)}-{max(on)}"
        assert got[d, a, b] == want, (d, a, b)


def test_pages_of_one_long_document(spark):
    """200,000 elements and 20,000 stretches of one document meet in bins."""
    offsets = spark.range(200_000).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 50).alias("start"), (F.col("id") * 50 + 49).alias("stop"), (F.col("id") / 40).cast("int").alias("page_num"))
    places = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 500).alias("start"), (F.col("id") * 500 + 30_000).alias("stop"))
    began = time.time()
    got = {r.start: r.pages for r in parse.pages_at(offsets, places).collect()}
    assert time.time() - began < 60
    last = 199_999 // 40
    assert len(got) == 20_000 and got[0] == "0-14" and all(v == f"{s // 2000}-{min((s + 29_999) // 2000, last)}" or s // 2000 == last for s, v in got.items())
    plan = parse.pages_at(offsets, places)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_authors_against_all_references(spark):
    rng = random.Random(2)
    names = ["smith", "lee", "o'neil", "van", "Jones", "li"]
    rows = []
    for d in range(12):
        if d % 4:
            rows += [(d, f"[{k + 1}] {rng.choice(names)}, some title {rng.randint(1, 99)}. {rng.choice([2001, 12002, '2003a', '19x9', 2004])}", 5, "reference") for k in range(rng.randint(1, 8))]
        rows += [(d, f"as said ({rng.choice(names).title()}, {rng.choice([2001, 2002, '2003', '2003a', '2003b', 2004, 1200])}) and (Oliver et al., {rng.choice([2001, 1999])}) and (2001)", 1) for _ in range(6)]
    e = made(spark, rows)
    refs = {}
    for r in citations.reference_rows(e, 0.25).collect():
        refs.setdefault(r.doc_id, []).append(r.content.lower())
    want = []
    for k, (d, c, *_) in enumerate(rows):
        for inner in re.findall(r"\(([^()]*[0-9]{4}[a-z]?[^()]*)\)", c):
            author = re.search(r"(?<!\w)[A-Za-z][A-Za-z'\-]+(?!\w)", inner)
            year = re.search("[0-9]{4}[a-z]?", inner)[0]
            if author and d in refs and not any(year in t and author[0].lower() in t for t in refs[d]):
                want.append((d, k, f"({inner})"))
    found = citations.authors_missing(e, RULES)
    assert sorted((r.doc_id, r.seq, r.evidence) for r in found.collect()) == sorted(want) and len(want) > 20
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_marks_take_linear_time(spark):
    text = "中文字符串, " * 10 + "中文字,文" * 20_000
    began = time.time()
    assert len(terms.marks_in(text, True, False, True)) == 20_010
    nested = "Some （words here，and " * 20_000
    assert len(terms.marks_in(nested, False, True, True)) == 20_000 and terms.marks_in(nested + "）", False, True, True)[-1:] != []
    assert time.time() - began < 5
    rows = spark.createDataFrame([(text,)], "t string")
    assert rows.select(F.size(terms.wrong_marks(F.col("t")))).first()[0] == 20_010


def test_marks_literally():
    said = lambda t, c=True, la=False, proof=True: [x["message"][-5:] for x in terms.marks_in(t, c, la, proof)]
    assert said("设值, x = 3 文字") == [] and said("设值, x y 文字") == ["了英文标点"]
    assert said("证明. 由上 文字. 好") == ["标点(.)"] and len(said("证明. 由上 文字. 好", proof=False)) == 2
    assert said("a文, b") == [] and said("a\n文, b") == [] and said("a\n\n文, b") == ["了英文标点"]
    latin = lambda t: len(terms.marks_in(t, False, True, True))
    assert latin("one （see this，here） and two，three words") == 1 and latin("lone，word") == 0 and latin("中ab，word goes") == 0
    assert latin("open （ never，closed and more") == 1 and latin("（a bc，d（ef，g） hij，k l") == 2
