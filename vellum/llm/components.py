"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import discard, stage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Nodes of ``edges`` (u, v: long) with the smallest node they reach: (node, root).

    Each round rewires edges towards the local minimum; the edge set ends as one star a component.
    Every step is a minimum by key and a join, so a hub's edges are split like any skewed join.
    Loops and edges with a null are dropped; no edges give no rows.
    """
    e = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    e = stage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _state(e)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = small.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        after = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small")
        discard(e)
        discard(large)
        e, before, seen = after, seen, _state(after)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
