"""The latest row of each key: a stream with late and repeated rows against the whole table, over a restart."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vellum.operators import store
from vellum.operators.bucketed import Bucketed
from vellum.streaming.latest import keep_latest, latest_rows

SCHEMA = "event_id long, user_id long, event_type string, ts timestamp, value double"


def made(spark, n, seed):
    rng = random.Random(seed)
    began = datetime(2024, 1, 1)
    rows = [(k, rng.randint(0, 12), rng.choice("abc"), began + timedelta(seconds=rng.randint(0, 1500)), float(k)) for k in range(seed * 1000, seed * 1000 + n)]
    return rows + rng.choices(rows, k=n // 5) + [(seed * 1000 + 990, 1, "a", None, 0.0)]


def test_stream_is_as_the_table(spark, tmp_path):
    source = str(tmp_path / "in")
    pieces = [made(spark, 120, k) for k in range(1, 5)]
    empty = spark.createDataFrame([], SCHEMA)
    kept = Bucketed(str(tmp_path / "kept"), ["user_id", "event_type"], 4, empty.schema)
    kept.create(empty)
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run = lambda: keep_latest(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), kept, str(tmp_path / "ck")).awaitTermination()
    put(pieces[0])
    put(pieces[1])
    run()
    # The stream goes on from its checkpoint: state and table are those it left.
    put(pieces[2])
    put(pieces[3][:60] + pieces[0][:30])
    run()
    run()
    rows = [r for p in (*pieces[:3], pieces[3][:60]) for r in p if r[3] is not None]
    table = spark.createDataFrame(sorted(set(rows)), SCHEMA)
    want = store.latest(table, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    got = kept.read(spark)
    assert got.count() == got.select("user_id", "event_type").distinct().count() > 30
    assert sorted(map(tuple, got.select(table.columns).collect())) == sorted(map(tuple, want.collect()))


def test_late_and_repeated_rows_are_told(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []
    for number, rows in enumerate([[(1, 1, "a", at(5), 1.0), (2, 1, "a", at(3), 2.0), (3, 2, "a", at(1), 3.0)], [(1, 1, "a", at(5), 1.0), (4, 1, "a", at(4), 4.0), (5, 2, "a", at(9), 5.0)], [(6, 1, "a", at(5), 6.0)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = latest_rows(spark.readStream.schema(SCHEMA).parquet(source), ["user_id", "event_type"], ttl_ms=3_600_000)
        each = lambda df, n: seen.extend((number, r.event_id, r.status) for r in df.collect())  # noqa: B023, E731
        stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", out).trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == [(0, 1, "new"), (0, 2, "late"), (0, 3, "new"), (1, 1, "late"), (1, 4, "late"), (1, 5, "updated"), (2, 6, "updated")]
