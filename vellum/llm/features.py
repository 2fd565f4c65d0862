"""Hashed n-gram indicators of texts, and their counts by class."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import text_slices

CACHE = 300_000
_CLASS = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b > 127 else ord("0") if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))
_word_codes: dict[bytes, int] = {}
_plain_codes: dict[bytes, int] = {}


def _code(word: bytes) -> int:
    """Hash of the lower-case word, and above it that of its shape: letters, digits and signs with runs collapsed."""
    return zlib.crc32(word.lower()) << 16 | zlib.crc32(_RUN.sub(rb"\1", word.translate(_CLASS))) >> 16


def _codes(words: list[bytes], cache: dict[bytes, int], code: Callable[[bytes], int]) -> np.ndarray:
    if len(cache) > CACHE:
        cache.clear()
    for w in set(words):
        if w not in cache:
            cache[w] = code(w)
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def _spread(x: np.ndarray, salt: int, bits: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.uint32)


def shape_ngrams(text: str, bits: int = 16) -> np.ndarray:
    """Distinct features: words, and shapes of one to three neighbouring words, which tell a repeated word."""
    codes = _codes(text.encode().split(), _word_codes, _code)
    if not len(codes):
        return np.zeros(0, np.uint32)
    same = np.zeros(len(codes), np.uint64)
    same[1:] = codes[1:] == codes[:-1]
    s = (codes & np.uint64(0xFFFF)) * np.uint64(2) + same
    pairs = s[:-1] << np.uint64(20) | s[1:]
    return np.unique(np.concatenate([_spread(codes >> np.uint64(16), 1, bits), _spread(s, 2, bits), _spread(pairs, 3, bits), _spread(pairs[:-1] << np.uint64(20) | s[2:], 4, bits)]))


def words_of(text: str, bits: int = 20) -> np.ndarray:
    """Distinct words, without case and signs."""
    return np.unique(_spread(_codes(text.encode().translate(_PLAIN).split(), _plain_codes, zlib.crc32), 1, bits))


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian numbers of as few whole bytes as ``bits`` need."""
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : -(-bits // 8)].tobytes()


def unpack(f: bytes, bits: int) -> np.ndarray:
    width = -(-bits // 8)
    out = np.zeros((len(f) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(f, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u4")


def indicators(docs: DataFrame, of: Callable[[str, int], np.ndarray], bits: int, id_col: str, text_col: str) -> DataFrame:
    """(id, f): the distinct features of each text, packed in order; null: none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, "t"):
            rows = [pack(of(t or "", bits), bits) for t in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(rows, pa.binary())], names=["id", "f"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, f binary")


def class_counts(rows: DataFrame, bits: int) -> DataFrame:
    """(feature, n0, n1): in how many rows (f, y) of class 0 and 1 each feature is; feature -1 counts the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, (1 << bits) + 1), np.int64)
        for batch in batches:
            ys = batch.column(1).to_pylist()
            for f, y in zip(batch.column(0).to_pylist(), ys):
                total[y, unpack(f, bits)] += 1
                total[y, -1] += 1
        kept = np.flatnonzero(total.any(axis=0))
        for at in range(0, len(kept), 50_000):
            some = kept[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.where(some == 1 << bits, -1, some)), pa.array(total[0, some]), pa.array(total[1, some])], names=["feature", "n0", "n1"])

    return rows.select("f", F.col("y").cast("int").alias("y")).mapInArrow(run, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def bounded_sample(rows: DataFrame, most: int, n: int, keys: tuple[str, ...] = ("id", "f")) -> DataFrame:
    """At most ``most`` of the ``n`` rows, those with the lowest hash of their keys."""
    order = F.xxhash64(F.lit("sample"), *keys)
    share = min(1.0, 1.2 * most / max(n, 1) + 0.001)
    return rows.where(order < int((2 * share - 1) * (2**63 - 1))).orderBy(order, *keys).limit(most) if n > most else rows
