"""Functions that make rows of a text, for SQL: by lateral join, or over a whole table whose other columns stay.

    SELECT d.doc_id, c.* FROM docs d, LATERAL chunk_text(d.text, 5000, 500) c
    SELECT * FROM chunk_table(TABLE(SELECT doc_id, lang, body FROM docs), 'body', 5000, 500)
    SELECT r.doc_id, n.* FROM reviews r, LATERAL numbered_remarks(r.text, 4) n

Rows leave a task one by one: no text's chunks are held together. A null text has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from vellum.operators.text import chunk_ranges, numbered_remarks

# Types are made without a session, for a table function's columns are worked out in a process that has none.
CHUNK = StructType([*(StructField(c, LongType()) for c in ("chunk", "start", "stop")), StructField("chunk_text", StringType())])


class _Chunks:
    def eval(self, text: str, size: int = 5000, overlap: int = 500) -> Iterator[tuple]:
        for k, (a, b) in enumerate(chunk_ranges(text or "", size, overlap)):
            yield k, a, b, text[a:b]


class _Remarks:
    def eval(self, text: str, most: int = 4) -> Iterator[tuple]:
        yield from enumerate(numbered_remarks(text or "", most))


class _ChunkTable:
    """All columns of a table but its texts, with the chunks of these."""

    def __init__(self) -> None:
        self._kept: list[str] | None = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("chunk_table takes a table first")
        names = [f.name for f in rows.dataType.fields]
        if column.value not in names:
            raise ValueError(f"no column {column.value} among {', '.join(names)}")
        twice = {f.name for f in CHUNK.fields} & set(names) - {column.value}
        if twice:
            raise ValueError(f"the table has columns of the result: {', '.join(sorted(twice))}")
        return AnalyzeResult(StructType([*(f for f in rows.dataType.fields if f.name != column.value), *CHUNK.fields]))

    def eval(self, row: Row, column: str, size: int = 5000, overlap: int = 500) -> Iterator[tuple]:
        if self._kept is None:
            self._kept = [c for c in row.__fields__ if c != column]
        text = row[column]
        for k, (a, b) in enumerate(chunk_ranges(text or "", size, overlap)):
            yield (*(row[c] for c in self._kept), k, a, b, text[a:b])


def register(spark: SparkSession) -> None:
    """Makes chunk_text, chunk_table and numbered_remarks known to the session's SQL."""
    spark.udtf.register("chunk_text", udtf(_Chunks, returnType=CHUNK))
    spark.udtf.register("chunk_table", udtf(_ChunkTable))
    spark.udtf.register("numbered_remarks", udtf(_Remarks, returnType="pos long, remark string"))
