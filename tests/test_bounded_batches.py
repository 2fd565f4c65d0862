"""What Python holds at once of a batch is bounded, whatever the batch has."""

import tracemalloc

import pandas as pd
import pyarrow as pa

from vellum.operators import text


def batches(texts):
    return iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "t"])])


def test_embeddings_are_arrays():
    texts = pd.Series([f"word {k}" for k in range(2000)])
    tracemalloc.start()
    out = text.embedded(texts)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 2000 * text.WIDTH * 8
    assert out[7].tolist() == text.hash_vector("word 7")


def test_rows_of_long_texts_come_in_slices():
    texts = ["1. a" + "x" * (1 << 20)] * 20 + [None, ""]
    out = list(text.made(batches(texts), lambda t: enumerate([t] if t else []), ["pos", "text"], [pa.int64(), pa.string()]))
    assert max(b.nbytes for b in out) < 6 << 20
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(20))


def test_chunks_and_remarks_are_as_before(spark):
    rows = spark.createDataFrame([(1, "a b\n" * 40), (2, None), (3, "1. x\nmore\n2. y\n")], "doc_id long, text string")
    got = sorted(map(tuple, text.chunks(rows, 50, 10).collect()))
    assert got == sorted((d, n, a, b, t[a:b]) for d, t in ((1, "a b\n" * 40), (3, "1. x\nmore\n2. y\n")) for n, (a, b) in enumerate(text.chunk_ranges(t, 50, 10)))
    assert sorted(map(tuple, text.numbered_rows(rows).collect())) == [(3, 0, "x more"), (3, 1, "y")]
