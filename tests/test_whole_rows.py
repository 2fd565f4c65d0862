"""Registered queries keep the rows that a filter once left out."""

import duckdb
import pyarrow.parquet as pq

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_bbox_of_every_vector(spark):
    got = {r.vec_id: (r.x0, r.y0, r.x1, r.y1) for r in entry.queries()["bbox_normalize"](spark, SF).collect()}
    given = pq.read_table(f"{SF}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pylist()
    boxes = {r["vec_id"]: [*r["embedding"][: r["vec_id"] % 6], 0, 0, 0, 0][:4] for r in given}
    assert got.keys() == boxes.keys() and any(not any(x) for x in got.values())
    assert all(abs(a - b) < 1e-6 for k in got for a, b in zip(got[k], boxes[k]))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    said = con.execute(entry.oracle_sql()["bbox_normalize"]).fetchall()
    assert {r[0] for r in said} <= got.keys() and all(abs(a - b) < 1e-6 for r in said for a, b in zip(got[r[0]], r[1:]))


def test_mock_scan_reads_the_turns(spark, monkeypatch):
    turns = [(1, "plain"), (1, "ask an LLM"), (5, "some, e.g. this"), (7, "Large Language Model (LLM)"), (11, None), (6, None), (9, "x")]
    monkeypatch.setattr(entry.engine, "table", lambda *_: spark.createDataFrame(turns, "conv_id long, text string"))
    got = sorted((r.doc_id, r.evidence) for r in entry.engine.QUERIES["mock_scan"](spark, SF).collect())
    assert got == [(1, "LLM"), (5, "e.g."), (6, "LLM"), (6, "e.g."), (9, "LLM")]
