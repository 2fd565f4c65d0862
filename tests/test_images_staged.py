"""The steps of the check of images read what is left of the images, instead of working it out again."""

from vellum.config import RULES
from vellum.operators import charts


def test_images_that_are_left_are_staged(spark):
    rows = [
        (1, 1, "title", "Figure 1 x", 100.0, 350.0, 300.0, 362.0, 1, "chart"), (1, 2, "image", "", 90.0, 200.0, 290.0, 340.0, 1, "chart"),
        (1, 3, "image", "", 90.0, 300.0, 290.0, 440.0, 2, "chart"), (1, 4, "text", "some text below", 90.0, 445.0, 290.0, 457.0, 2, "main"),
        (1, 5, "text", "last", 0.0, 780.0, 600.0, 800.0, 1, "main"), (1, 6, "text", "last", 0.0, 780.0, 600.0, 800.0, 2, "main"),
    ]
    e = spark.createDataFrame(rows, "doc_id long, seq long, type string, content string, x0 double, y0 double, x1 double, y1 double, page_num int, region string")
    found = charts.images_without_caption(e, RULES)
    assert [(r.seq % 10**12, r.page, r.evidence) for r in found.collect()] == [(3, "2", "some text below")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") < 10
