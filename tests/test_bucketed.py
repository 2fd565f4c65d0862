"""Upserts by buckets against upserts of the whole table, with batches that come again."""

import os

import pytest
from pyspark.sql import functions as F

from vellum.operators import store
from vellum.operators.bucketed import Bucketed

ROWS = "k long, g string, v string, n long"


def rows_of(df):
    return sorted(map(repr, df.select("k", "g", "v", "n").collect()))


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    target = spark.range(20_000).select(F.col("id").alias("k"), F.lit("g").alias("g"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"), F.lit(1).cast("long").alias("n"))
    kept = Bucketed(path, ["k", "g"], 200)
    kept.create(target)
    with pytest.raises(Exception):
        kept.create(target)
    before = files(path)
    changes = spark.createDataFrame([(k, "g", "new") for k in range(0, 20_000, 1000)], "k long, g string, v string")
    counts = kept.upsert(changes, 5)
    after = files(path)
    assert counts["inserted"] == 0 and counts["updated"] == 20 and counts["skipped"] == 0 and counts["buckets"] <= 20
    same = {f for f in before if after.get(f) == before[f]}
    assert len({os.path.dirname(f) for f in before} - {os.path.dirname(f) for f in same}) == counts["buckets"]
    assert rows_of(kept.read(spark)) == rows_of(store.upsert(target, changes, ["k", "g"]))
    # Run again, the batch changes nothing; an earlier one doesn't undo it.
    assert kept.upsert(changes, 5)["skipped"] == 20
    assert kept.upsert(changes.withColumn("v", F.lit("late")), 4) == {"inserted": 0, "updated": 0, "skipped": 20, "buckets": counts["buckets"]}
    assert rows_of(kept.read(spark)) == rows_of(store.upsert(target, changes, ["k", "g"]))
    plan = spark.read.parquet(path).where(F.col("_bucket").isin([1, 2]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [_bucket" in plan


def test_null_keys_and_new_rows(spark, tmp_path):
    target = spark.createDataFrame([(1, "a", "x", 1), (None, "a", "y", 2), (3, None, "z", 3), (4, "b", "w", 4)], ROWS)
    changes = spark.createDataFrame([(1, "a", "", 10, 0), (None, "a", "Y", None, 0), (9, None, "new", 9, 0), (4, "c", "other", 5, 0)], ROWS + ", more int")
    for fill, whole in ((False, store.upsert), (True, store.coalescing_upsert)):
        kept = Bucketed(str(tmp_path / str(fill)), ["k", "g"], 3)
        kept.create(target)
        counts = kept.upsert(changes, 0, fill)
        assert (counts["inserted"], counts["updated"]) == (2, 2)
        assert rows_of(kept.read(spark)) == rows_of(whole(target, changes, ["k", "g"]))
        assert kept.upsert(changes.where("false"), 1) == {"inserted": 0, "updated": 0, "skipped": 0, "buckets": 0}
        assert kept.read(spark).dtypes == target.dtypes


def test_a_loss_in_the_middle(spark, tmp_path):
    """Where a run has replaced some buckets and not others, running it again does the rest."""
    target = spark.range(100).selectExpr("id k", "'g' g", "'old' v", "id n")
    kept, whole = Bucketed(str(tmp_path / "a"), ["k"], 8), Bucketed(str(tmp_path / "b"), ["k"], 8)
    for t in (kept, whole):
        t.create(target)
    changes = spark.range(50, 150).selectExpr("id k", "'g' g", "'new' v", "id + 1 n")
    some = changes.where("pmod(xxhash64(k), 8) < 3")
    first = kept.upsert(some, 7)
    again = kept.upsert(changes, 7)
    assert first["inserted"] + again["inserted"] == 50 and again["skipped"] == some.count()
    whole.upsert(changes, 7)
    assert rows_of(kept.read(spark)) == rows_of(whole.read(spark))
