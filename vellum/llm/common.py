"""Shared plumbing of the corpus operators: tables, staged results, text slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vellum.batches import SLICE_BYTES, text_slices
from vellum.storage import discard, scope, shared_root, spread, stage

__all__ = ["SLICE_BYTES", "discard", "scope", "shared_root", "spread", "stage", "table", "text_slices", "utf8_slices"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def utf8_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES):
    """Like ``text_slices``, with each piece's texts as one byte array and row offsets (null: empty)."""
    for piece in text_slices(batches, column, limit):
        texts = piece.column(piece.schema.get_field_index(column))
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        yield piece, raw, offsets - offsets[0]
