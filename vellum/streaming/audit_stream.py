"""Audits of documents as they arrive: the batch plan on each micro-batch, the latest result of a document wins."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.operators.store import latest
from vellum.plans.audit import Check, audit
from vellum.sources.documents import placed_lines
from vellum.storage import scope


def start(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, rules: dict[str, Any] | Callable[[], dict[str, Any]] | None = None, checks: list[Check] | None = None, lines: Callable[[DataFrame], DataFrame] = placed_lines) -> StreamingQuery:
    """Audits the Parquet files that come into ``source`` and appends results, with their batch, to ``sink``.

    ``lines`` makes placed lines of a batch's documents. Rules that are a function are asked for by every batch, so a stored
    table of them (``config.stored_rules``) is read anew. What a batch stages is deleted once its results are written.
    """

    def each(batch: DataFrame, number: int) -> None:
        with scope():
            done = audit(lines(batch), rules() if callable(rules) else rules, checks).withColumn("batch", F.lit(number).cast("long"))
            # A batch that is run again writes the same folder again.
            done.write.mode("overwrite").parquet(f"{sink}/batch_no={number:012d}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, sink: str) -> DataFrame:
    """The latest result of each document."""
    return latest(spark.read.parquet(f"{sink}/batch_no=*"), ["doc_id"], [F.desc("batch")]).drop("batch")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type in windows of event time, on a stream or a table; a stream drops what comes later than ``late``."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
