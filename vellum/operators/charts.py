"""Checks of images and their captions by place, and drawing regions."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import patterns as P
from vellum.functions import predicates as B
from vellum.operators.issues import issue, union
from vellum.operators.structure import caption_rows
from vellum.storage import stage

_TEXTS = "type in ('text', 'title', 'chart') and region <> 'reference'"


def _pages(elements: DataFrame) -> DataFrame:
    crowd = F.sum(F.when(F.col("type").isin("text", "title", "citation", "chart", "formula") & (F.col("region") != "reference"), 1).otherwise(0))
    return elements.groupBy("doc_id", "page_num").agg(F.max("x1").alias("max_x"), F.max("y1").alias("max_y"), crowd.alias("crowd"), F.max((F.col("type") == "scanned_content").cast("int")).alias("scanned"))


def _as(df: DataFrame, prefix: str, *more: str) -> DataFrame:
    return df.select("doc_id", "page_num", *[F.col(c).alias(f"{prefix}_{c}") for c in ("seq", "content", "x0", "y0", "x1", "y1", *more)])


def _overlap(a: str, b: str) -> Column:
    return F.least(F.col(f"{a}_x1"), F.col(f"{b}_x1")) - F.greatest(F.col(f"{a}_x0"), F.col(f"{b}_x0"))


def _narrower(a: str, b: str) -> Column:
    return F.least(F.greatest(F.lit(1.0), F.col(f"{a}_x1") - F.col(f"{a}_x0")), F.greatest(F.lit(1.0), F.col(f"{b}_x1") - F.col(f"{b}_x0")))


def misplaced_captions(elements: DataFrame, rules: dict[str, Any]) -> DataFrame:
    """Figure captions that stand above the lower edge of the images they belong to (or below the upper one)."""
    side = rules.get("figure_table_check", {}).get("caption_requirement", "bottom")
    caps = _as(caption_rows(elements).where(B.has(F.col("content"), P.FIGURE_CAPTION)), "c")
    images = _as(elements.where("type = 'image'"), "i")
    gap = F.col("c_y0") - F.col("i_y1") if side == "bottom" else F.col("i_y0") - F.col("c_y1")
    near = caps.join(images, ["doc_id", "page_num"]).join(_pages(elements), ["doc_id", "page_num"]).where((gap <= F.col("max_y") * 0.33) & (gap >= -6.0))
    rows = near.groupBy("doc_id", "page_num", "c_seq", "c_content", "c_x0", "c_y0", "c_x1", "c_y1", "max_x").agg(F.min("i_x0").alias("gx0"), F.min("i_y0").alias("gy0"), F.max("i_x1").alias("gx1"), F.max("i_y1").alias("gy1"))
    mid = (F.col("c_x0") + F.col("c_x1")) / 2
    rows = rows.where(mid.between(F.col("gx0") - F.col("max_x") * 0.02, F.col("gx1") + F.col("max_x") * 0.02))
    rows = rows.where(F.col("c_y0") < F.col("gy1") - 5.0) if side == "bottom" else rows.where(F.col("c_y1") > F.col("gy0") + 5.0)
    rows = rows.select("doc_id", "page_num", *[F.col(f"c_{c}").alias(c) for c in ("seq", "content", "x0", "y0", "x1", "y1")])
    word = "下" if side == "bottom" else "上"
    return rows.select(*issue("Label_Missing", "Info", f"图标题应位于图{word}方 (规则要求: {side})"))


def image_rows(elements: DataFrame, rules: dict[str, Any]) -> DataFrame:
    """Images that ought to have a caption: neither too small nor the whole page, no banner, running text, header or footer.

    Only images of documents with a caption, and of pages that are not scanned, are looked at.
    """
    least = float(rules.get("figure_table_check", {}).get("min_figure_area_ratio", 0.03))
    images = elements.where("type = 'image'").join(_pages(elements), ["doc_id", "page_num"]).where("scanned = 0")
    images = images.join(caption_rows(elements).select("doc_id").distinct(), "doc_id", "left_semi")
    w, h = F.greatest(F.col("x1") - F.col("x0"), F.lit(0.0)), F.greatest(F.col("y1") - F.col("y0"), F.lit(0.0))
    images = images.withColumn("share", w * h / F.greatest(F.col("max_x") * F.col("max_y"), F.lit(1.0)))
    text = B.strip(F.coalesce("content", F.lit("")))
    part = B.has(text, r"(?i)^(?:\(?[a-z]\)?|[a-z]\.)\s") | ((F.length(text) < 10) & B.has(text, r"(?i)^(?:\(?[a-z]\)?|[a-z]\.)$"))
    prose = (F.length(text) > 50) & ~B.has(text, r"(?i)^(?:图|表|Figure|Table|Fig\.?)\s*[0-9]")
    banner = (w > F.col("max_x") * 0.8) & (h < F.col("max_y") * 0.05)
    edge = (F.col("y1") <= F.col("max_y") * 0.12) | (F.col("y0") >= F.col("max_y") * 0.88)
    full = (F.col("share") >= 0.6) & (F.col("x0") <= F.col("max_x") * 0.05) & (F.col("x1") >= F.col("max_x") * 0.95) & (F.col("y0") <= F.col("max_y") * 0.10) & (F.col("y1") >= F.col("max_y") * 0.90) & (F.col("crowd") >= 15)
    return images.where(F.col("share").between(least, 0.8) & ~banner & ~part & ~prose & ~edge & ~full)


def images_without_caption(elements: DataFrame, rules: dict[str, Any]) -> DataFrame:
    """Images that no caption covers or is next to, and captions next to an image on the wrong side of it."""
    r = rules.get("figure_table_check", {})
    # The images that are left after each step are staged, for every later step asks for them more than once.
    images = stage(image_rows(elements, rules), "images")
    page = ["doc_id", "page_num"]
    i = _as(images, "i", "max_x", "max_y")
    caps = caption_rows(elements)
    figures = _as(caps.where(B.has(F.col("content"), P.FIGURE_CAPTION)), "c")
    # A figure caption covers all images of its page that end shortly above it, if it is within their width.
    all_images = _as(elements.where("type = 'image'").join(_pages(elements), page), "i", "max_x", "max_y")
    gap = F.col("c_y0") - F.col("i_y1")
    group = Window.partitionBy(*page, "c_seq")
    above = figures.join(all_images, page).where((gap <= F.col("i_max_y") * 0.30) & (gap >= -6.0)).withColumn("gx0", F.min("i_x0").over(group)).withColumn("gx1", F.max("i_x1").over(group))
    mid = (F.col("c_x0") + F.col("c_x1")) / 2
    covered = above.where(mid.between(F.col("gx0") - F.col("i_max_x") * 0.03, F.col("gx1") + F.col("i_max_x") * 0.03))
    tenth = [F.bround(f"i_{b}", 1).alias(b) for b in ("x0", "y0", "x1", "y1")]
    covered = covered.select(*page, *tenth).distinct()
    left = stage(i.select("*", *tenth).join(covered, [*page, "x0", "y0", "x1", "y1"], "left_anti").drop("x0", "y0", "x1", "y1"), "uncovered")
    texts = _as(elements.where(_TEXTS).where(F.length(B.strip(F.col("content"))) > 0), "t", "type")
    near_to = lambda some: some.join(texts, page).withColumn("lap", _overlap("t", "i")).withColumn("least", _narrower("t", "i")).withColumn("below", F.col("t_y0") - F.col("i_y1")).withColumn("above", F.col("i_y0") - F.col("t_y1")).where("lap > 0")
    near = near_to(left)
    reach = F.col("i_max_y") * 0.18
    subs = near.where(B.has(F.col("t_content"), f"(?i)^{P.S}*(?:图|Figure|Fig\\.?){P.S}*[（(]?{P.S}*[A-Za-z]{P.S}*[)）]") & (F.col("lap") >= F.col("least") * 0.05) & (F.col("below").between(F.lit(-6.0), reach) | F.col("above").between(F.lit(-6.0), reach)))
    left = stage(left.join(subs.select("doc_id", "i_seq").distinct(), ["doc_id", "i_seq"], "left_anti"), "whole")
    near = near_to(left)
    # The nearest caption among the texts right above or below.
    under, over = F.col("below").between(F.lit(0.0), reach), F.col("above").between(F.lit(0.0), reach)
    next_to = near.where(F.col("t_type").isin("text", "title") & B.is_caption(F.col("t_content")) & (F.col("lap") >= F.col("least") * 0.15) & (under | over))
    distance = F.when(under, F.col("below")).otherwise(F.col("above"))
    at = F.struct(distance.alias("d"), "t_seq", F.when(under, "bottom").otherwise("top").alias("side"), *[f"t_{c}" for c in ("content", "x0", "y0", "x1", "y1")])
    best = stage(next_to.groupBy("doc_id", "page_num", "i_seq").agg(F.min(at).alias("b")), "best")
    table = B.has(F.col("b.t_content"), P.TABLE_CAPTION)
    want = F.when(table, r.get("table_caption_requirement", "top")).otherwise(r.get("caption_requirement", "bottom"))
    noun = F.when(table, "表").otherwise("图")
    wrong = best.withColumn("want", want).withColumn("noun", noun).where(F.col("want").isin("top", "bottom") & (F.col("want") != F.col("b.side")))
    message = F.concat("noun", F.lit("标题应位于"), "noun", F.when(F.col("want") == "bottom", "下").otherwise("上"), F.lit("方 (规则要求: "), "want", F.lit(")"))
    wrong = wrong.select("doc_id", "page_num", F.col("b.t_seq").alias("seq"), F.col("b.t_content").alias("content"), *[F.col(f"b.t_{b}").alias(b) for b in ("x0", "y0", "x1", "y1")], message.alias("m"))
    left = left.join(best.select("doc_id", "i_seq"), ["doc_id", "i_seq"], "left_anti")
    # Any caption of the page in the band of the image will do.
    pool = _as(caps.where(B.has(F.col("content"), P.FIGURE_CAPTION) | B.has(F.col("content"), P.TABLE_CAPTION)), "c")
    band = left.join(pool, page).withColumn("lap", _overlap("c", "i")).withColumn("least", _narrower("c", "i"))
    inside = mid.between(F.col("i_x0") - F.col("i_max_x") * 0.03, F.col("i_x1") + F.col("i_max_x") * 0.03)
    # Captions beside the image are let through by their middle, and then held to the overlap like all others.
    band = band.where(((F.col("lap") > 0) | inside) & (F.col("lap") >= F.col("least") * 0.2) & (F.abs(F.col("c_y0") - F.col("i_y0")) <= F.col("i_max_y") * 0.25))
    left = stage(left.join(band.select("doc_id", "i_seq").distinct(), ["doc_id", "i_seq"], "left_anti"), "bare")
    near = near_to(left).where((F.col("lap") >= F.col("least") * 0.15) & ~B.is_reference_title(F.col("t_content")) & ~B.has(F.col("t_content"), P.TOC_DOTS))
    flat = B.strip(F.regexp_replace("t_content", f"{P.S}+", " "))
    short = F.when(F.length(flat) > 120, F.concat(F.substring(flat, 1, 119), F.lit("…"))).otherwise(flat)

    def nearest(d: str):
        close = F.when(F.col(d).between(F.lit(-3.0), reach), F.struct(F.col(d).alias("d"), "t_seq", short.alias("s")))
        return F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(close)), 1, 2), lambda x: x.s), " | ")

    said = near.groupBy("doc_id", "i_seq").agg(nearest("below").alias("under"), nearest("above").alias("over"))
    evidence = F.coalesce(F.when(F.col("under") != "", F.col("under")), F.col("over"), F.lit(""))
    bare = left.join(said, ["doc_id", "i_seq"], "left").select("doc_id", "page_num", evidence.alias("content"), *[F.col(f"i_{c}").alias(c) for c in ("seq", "x0", "y0", "x1", "y1")])
    return union([wrong.select(*issue("Label_Missing", "Info", F.col("m"))), bare.select(*issue("Label_Missing", "Info", "检测到图片但未找到图标题"))])


def _touching(boxes: np.ndarray, margin: float) -> np.ndarray:
    """For each box, sorted by its left edge, the first box of the group that touches it, over any number of boxes."""
    n = len(boxes)
    root = np.arange(n)

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    reach = np.searchsorted(boxes[:, 0], boxes[:, 2] + margin, "right")
    for k in range(n):
        some = boxes[k + 1 : reach[k]]
        near = np.flatnonzero((some[:, 1] <= boxes[k, 3] + margin) & (some[:, 3] >= boxes[k, 1] - margin))
        for j in near.tolist():
            a, b = find(k), find(k + 1 + j)
            root[max(a, b)] = min(a, b)
    return np.array([find(k) for k in range(n)], np.int64)


def merge_regions(rects: np.ndarray, width: float, height: float, least: float = 0.02, most: float = 0.9, margin: float = 4.0) -> list[list[float]]:
    """Boxes of drawings: rectangles that touch within ``margin`` become one; specks, pages and slender ones are dropped.

    Sweeps from left to right until nothing touches any more; each sweep leaves one box a group.
    """
    area = (rects[:, 2] - rects[:, 0]) * (rects[:, 3] - rects[:, 1]) if len(rects) else np.zeros(0)
    boxes = rects[area >= 0.0008 * width * height] if len(rects) else rects
    while len(boxes) > 1:
        boxes = boxes[np.lexsort(boxes.T[::-1])]
        group = _touching(boxes, margin)
        first = np.unique(group, return_inverse=True)[1]
        if first.max() == len(boxes) - 1:
            break
        whole = np.empty((first.max() + 1, 4))
        whole[:, :2], whole[:, 2:] = np.inf, -np.inf
        np.minimum.at(whole[:, :2], first, boxes[:, :2])
        np.maximum.at(whole[:, 2:], first, boxes[:, 2:])
        boxes = whole
    out = []
    for x0, y0, x1, y1 in boxes.tolist():
        w, h = x1 - x0, y1 - y0
        share, aspect = w * h / (width * height), min(w, h) / max(w, h, 1e-9)
        slender = aspect < 0.06 and (w > 0.8 * width or h > 0.8 * height)
        if least <= share <= most and not slender:
            out.append([x0, y0, x1, y1])
    return out


def drawing_regions(rects: DataFrame) -> DataFrame:
    """Regions of each page from rectangles (doc_id, page_num, width, height, x0, y0, x1, y1).

    Pages go to Python many at a time, for a page has few rectangles.
    """
    pages = rects.groupBy("doc_id", "page_num").agg(F.first("width").alias("w"), F.first("height").alias("h"), F.flatten(F.collect_list(F.array("x0", "y0", "x1", "y1"))).alias("boxes"))

    def run(boxes: pd.Series, ws: pd.Series, hs: pd.Series) -> pd.Series:
        return pd.Series([merge_regions(np.asarray(b, float).reshape(-1, 4), w, h) for b, w, h in zip(boxes, ws, hs)])

    merged = F.pandas_udf(run, "array<array<double>>")
    found = pages.select(F.col("doc_id").cast("long"), F.col("page_num").cast("int"), F.explode(merged("boxes", F.col("w").cast("double"), F.col("h").cast("double"))).alias("b"))
    return found.select("doc_id", "page_num", *[F.col("b")[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])


def captioned_regions(captions: DataFrame, regions: DataFrame, images: DataFrame) -> DataFrame:
    """Images (doc_id, page_num, x0, y0, x1, y1) that drawing regions make up for on pages with captions but without images.

    ``captions``: (doc_id, page_num, line_no, content, x0, y0, x1, y1), ``regions`` and ``images`` with the same place.
    In their order, captions take the nearest region that no other has: one that overlaps a fifth of the narrower's
    width, and isn't below a figure's caption or above a table's. Where no caption takes any, the largest region counts.
    """
    page, box = ["doc_id", "page_num"], ["x0", "y0", "x1", "y1"]
    figure, table = B.has(F.col("content"), f"(?i)^{P.S}*(?:图|Figure|Fig\\.?)"), B.has(F.col("content"), f"(?i)^{P.S}*(?:表|Table)")
    caps = captions.join(images.select(*page).distinct(), page, "left_anti").groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("line_no", *box, figure.alias("figure"), table.alias("table")))).alias("caps"))
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    # The largest first, the uppermost of equals, so that the first of all is the largest.
    own = regions.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct((-size).alias("size"), "y0", "x0", "x1", "y1"))).alias("regions"))
    rows = caps.join(own, page)

    def step(taken: Column, c: Column) -> Column:
        def reach(r: Column) -> Column:
            lap = F.least(c.x1, r.x1) - F.greatest(c.x0, r.x0)
            narrow = F.least(F.greatest(F.lit(1.0), c.x1 - c.x0), F.greatest(F.lit(1.0), r.x1 - r.x0))
            return (lap > 0) & (lap >= narrow * 0.2) & ~(c.figure & (r.y0 > c.y1 + 6.0)) & ~(c.table & (r.y1 < c.y0 - 6.0))

        def score(r: Column) -> Column:
            away = F.when(r.y1 <= c.y0, c.y0 - r.y1).when(r.y0 >= c.y1, r.y0 - c.y1).otherwise(F.lit(0.0))
            return away * 1000.0 + F.abs((c.x0 + c.x1) / 2.0 - (r.x0 + r.x1) / 2.0)

        free = F.filter("regions", lambda r: reach(r) & ~F.array_contains(taken, r))
        best = F.array_min(F.transform(free, lambda r: F.struct(score(r).alias("score"), r.alias("r"))))
        return F.when(F.size(free) > 0, F.concat(taken, F.array(best.r))).otherwise(taken)

    kind = "array<struct<size: double, y0: double, x0: double, x1: double, y1: double>>"
    taken = F.aggregate("caps", F.array().cast(kind), step)
    rows = rows.withColumn("taken", taken).withColumn("taken", F.when(F.size("taken") > 0, F.col("taken")).otherwise(F.slice("regions", 1, 1)))
    return rows.select(*page, F.explode("taken").alias("r")).select(*page, *[F.col(f"r.{b}").alias(b) for b in box])


def drawn_images(elements: DataFrame, rects: DataFrame) -> DataFrame:
    """``elements`` with an image for each drawing of pages that have captions but no images; rects as in ``drawing_regions``."""
    caps = caption_rows(elements).select("doc_id", "page_num", F.col("seq").alias("line_no"), "content", "x0", "y0", "x1", "y1")
    found = captioned_regions(caps, drawing_regions(rects), elements.where("type = 'image'"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "page_num").orderBy("y0", "x0", "x1", "y1"))
    # Images come after all other elements.
    last = elements.groupBy("doc_id", "page_num").agg(F.max("seq").alias("last"))
    rows = found.withColumn("nth", nth).join(last, ["doc_id", "page_num"])
    images = rows.select("doc_id", (F.col("last") * 1000 + F.col("nth")).alias("seq"), F.lit("image").alias("type"), F.lit("").alias("content"), "x0", "y0", "x1", "y1", "page_num", F.lit("chart").alias("region"))
    return elements.unionByName(images)
