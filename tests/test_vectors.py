"""Nearest neighbours against plain numpy, recall of the index, crowded cells and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import text
from vellum.operators import vectors as V
from vellum.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain(vectors, asked, k, keep=None):
    """(query, rank, id, distance) of all pairs, with distances in millionths and ties by id."""
    unit = {i: np.array(v, np.float64) / np.linalg.norm(v) for i, v in vectors.items()}
    out = set()
    for q in asked:
        near = sorted((round(1.0 - float(unit[q] @ v), 6) + 0.0, i) for i, v in unit.items() if keep is None or keep(i))
        out |= {(q, r + 1, i, d) for r, (d, i) in enumerate(near[:k])}
    return out


def loose(rows):
    """Distances to five places: sums in another order may differ in the sixth."""
    return {(q, r, round(d, 5)) for q, r, _, d in rows}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    # Half of all vectors lie around one centre, and some are the same.
    which = np.where(rng.random(1200) < 0.5, 0, rng.integers(0, 6, 1200))
    x = centres[which] + 0.4 * rng.normal(size=(1200, 16))
    x[100:110] = x[100]
    return spark.createDataFrame([(k, v.tolist(), int(w)) for k, (v, w) in enumerate(zip(x, which))], "vec_id long, embedding array<float>, kind int")


def test_exact_and_blocks(spark, rows, monkeypatch):
    held = {r.vec_id: r.embedding for r in rows.collect()}
    asked = [k for k in held if k % 50 == 0]
    want = plain(held, asked, 7)
    for index in (V.flat(rows), V.flat(rows, block=90), V.build(rows, 9, block=70)):
        assert loose(map(tuple, V.search(index, rows.where("vec_id % 50 = 0"), 7, None).collect())) == loose(want)
    monkeypatch.setattr(V, "ASKED", 5)
    assert loose(map(tuple, V.search(V.build(rows, 9, block=70), rows.where("vec_id % 50 = 0"), 7, None).collect())) == loose(want)
    # Equal vectors come by id.
    got = {r.rank: r.vec_id for r in V.search(V.flat(rows), rows.where("vec_id = 105"), 12, None).collect()}
    assert [got[k] for k in range(1, 11)] == list(range(100, 110))


def test_index_recall_and_filters(spark, rows):
    index = V.build(rows, 24, block=100)
    assert index.rows.count() == 1200 and max(index.blocks) >= 1 and len(index.means) == 24
    queries = rows.where("vec_id % 50 = 0")
    exact = V.search(index, queries, 10, None)
    probes = V.probes_for(index, rows, 10, 0.95)
    assert 1 <= probes < 24
    assert V.recall(V.search(index, queries, 10, probes), exact) >= 0.93
    assert V.recall(V.search(index, queries, 10, 24), exact) == 1.0
    held = {r.vec_id: (r.embedding, r.kind) for r in rows.collect()}
    want = plain({k: v for k, (v, _) in held.items()}, [k for k in held if k % 50 == 0], 5, lambda k: held[k][1] == 2)
    assert loose(map(tuple, V.search(index, queries, 5, None, keep=F.col("kind") == 2).collect())) == loose(want)


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, None]), (None, [0.0, 1.0]), (7, [float("nan"), 1.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0])], "vec_id long, embedding array<double>")
    index = V.build(rows, 2)
    assert index.rows.count() == 3
    got = sorted((r.query_id, r.rank, r.vec_id, r.distance) for r in V.search(index, rows.where("vec_id = 1"), 9, None).collect())
    assert got[:3] == [(1, 1, 1, 0.0), (1, 2, 8, 0.0), (1, 3, 8, 0.0)]
    assert V.search(index, rows.where("vec_id in (2, 3, 4)"), 3).collect() == []
    empty = rows.where("false")
    assert V.search(V.build(empty), rows, 3).collect() == [] and V.search(index, empty, 3, None).collect() == []


def test_tips_by_blocks(spark, monkeypatch):
    said = ["number every figure", "cite in order", "figure captions below", "write shorter sentences", "cite figure order"]
    experts = text.embed(spark.createDataFrame([(k, f"m{k}", said[k % 5] + f" {k}", True) for k in range(60)], "comment_id long, metric_id string, text string, active boolean"))
    docs = text.embed(spark.createDataFrame([(k, said[k % 5]) for k in range(8)], "doc_id long, text string")).select("doc_id", "embedding")
    few = sorted((r.doc_id, tuple(r.tips)) for r in text.expert_tips(docs, experts, 4).collect())
    monkeypatch.setattr(V, "BLOCK", 7)
    assert sorted((r.doc_id, tuple(r.tips)) for r in text.expert_tips(docs, experts, 4).collect()) == few and len(few) == 8


def test_queries(spark):
    import duckdb

    from vellum.plans.oracles import ORACLES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    for name in ("knn_exact", "knn_filtered"):
        got = QUERIES[name](spark, SF)
        want = con.execute(ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
    exact = QUERIES["knn_exact"](spark, SF)
    assert V.recall(QUERIES["knn_index"](spark, SF), exact) >= 0.95
