"""Pages go to Python many at a time, and have the regions that each has alone."""

import numpy as np
from pyspark.sql import functions as F

from vellum.operators import charts


def test_regions_of_many_pages(spark):
    draw = np.random.default_rng(3)
    pages = {(d, p): np.round(draw.uniform(0, 500, (k, 4)), 1) for k, (d, p) in enumerate((d, p) for d in range(6) for p in range(1, 8))}
    for b in pages.values():
        b[:, 2:] = b[:, :2] + 60
    rows = [(d, p, 600.0, 800.0, *map(float, b)) for (d, p), bs in pages.items() for b in bs]
    rects = spark.createDataFrame(rows, "doc_id long, page_num int, width double, height double, x0 double, y0 double, x1 double, y1 double").orderBy(F.rand(1))
    found = charts.drawing_regions(rects)
    want = sorted((d, p, *b) for (d, p), bs in pages.items() for b in charts.merge_regions(bs, 600.0, 800.0))
    assert want and sorted(map(tuple, found.collect())) == want
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    assert charts.drawing_regions(rects.where("false")).count() == 0
