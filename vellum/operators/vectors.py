"""Nearest neighbours of many vectors at once, by cosine distance: an inverted-file index, and an exact way beside it.

The index has cells, the means of a bounded sample of vectors; each vector lies in the cell whose mean is nearest in direction.
A search probes the cells nearest to each query and ranks all that these hold by their exact distances. Vectors of a cell are
kept in blocks of a bounded number, so neither a crowded cell nor a popular one is one task's work; a block and the queries
that probe it meet in a task, as one product of matrices that leaves the ``k`` best of each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.storage import stage

#: Rows of the sample that cells are fitted to, vectors of a block, queries that meet it in one task, and those of one product.
SAMPLE, BLOCK, ASKED, AT_ONCE = 20_000, 8_000, 20_000, 512
ROUNDS = 15
FOUND = "query_id long, vec_id long, distance double"


@dataclass
class Index:
    """Vectors (vec_id, embedding, cell, block, *others) and the means of the cells, one a row."""

    rows: DataFrame
    means: np.ndarray
    #: Blocks of each cell.
    blocks: list[int]


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """An array column of ``width`` numbers a row as rows of length one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def usable(embedding: Column, width: int) -> Column:
    """Whether a vector has a direction: ``width`` numbers, none missing, not all zero."""
    return (F.size(embedding) == width) & ~F.exists(embedding, lambda v: v.isNull() | F.isnan(v)) & F.exists(embedding, lambda v: v != 0)


def fit_cells(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 42) -> np.ndarray:
    """Means of ``cells`` groups of directions, until none changes its group or for so many ``rounds``."""
    rng = np.random.default_rng(seed)
    means = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    whose = None
    for _ in range(rounds):
        nearest = np.concatenate([(sample[a : a + 4096] @ means.T).argmax(axis=1) for a in range(0, len(sample), 4096)])
        if whose is not None and (nearest == whose).all():
            break
        whose = nearest
        sums = np.zeros_like(means)
        np.add.at(sums, whose, sample)
        empty = np.bincount(whose, minlength=len(means)) == 0
        # A group without members starts anew at some row.
        sums[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        means = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return means


def build(rows: DataFrame, cells: int | None = None, sample: int = SAMPLE, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> Index:
    """An index of all ``rows`` that have a direction. Cells: by default the square root of how many there are, 4,096 at most.

    Cells are fitted to the ``sample`` rows of least hash of their id; every row is put into one. Rows without an id or a
    vector, or of another width than most, have no place in it; other columns go along, for filters.
    """
    widths = rows.where(F.size(vector_col) > 0).groupBy(F.size(vector_col).alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    width = widths[0]["w"] if widths else 1
    own = rows.where(usable(F.col(vector_col), width) & F.col(id_col).isNotNull()).withColumn(vector_col, F.col(vector_col).cast("array<double>"))
    own = own.withColumnRenamed(id_col, "vec_id").withColumnRenamed(vector_col, "embedding")
    total = own.count()
    some = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow().column(0)
    cells = cells or max(1, min(4096, int(np.sqrt(total))))
    means = fit_cells(matrix(some, width), cells) if total else np.zeros((1, width))
    place = _placed(own, means, 1).withColumn("cell", F.col("cells")[0]).drop("cells")
    place = stage(place, "placed")
    sizes = {r[0]: r[1] for r in place.groupBy("cell").count().collect()}
    blocks = [max(1, -(-sizes.get(c, 0) // block)) for c in range(len(means))]
    by = F.array(*[F.lit(b) for b in blocks])
    return Index(stage(place.withColumn("block", F.pmod(F.xxhash64("vec_id"), by[F.col("cell")]).cast("int")).repartition("cell", "block"), "index"), means, blocks)


def _placed(rows: DataFrame, means: np.ndarray, probes: int) -> DataFrame:
    """``rows`` with ``cells``, the ``probes`` cells nearest to each."""
    here = rows.sparkSession.sparkContext.broadcast(means)
    names, at = rows.columns, rows.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            close = -(matrix(batch.column(at), here.value.shape[1]) @ here.value.T)
            best = np.argsort(close, axis=1, kind="stable")[:, :probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.tolist(), pa.list_(pa.int32()))], names=[*names, "cells"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", cells array<int>")


def best_of(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the ``k`` nearest vectors of each query, distances in millionths, ties by id."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    whose, which, far = [], [], []
    for a in range(0, len(queries), AT_ONCE):
        d = np.round(1.0 - queries[a : a + AT_ONCE] @ vectors.T, 6)
        # Distances that look alike once rounded fall by id.
        best = np.argsort(d, axis=1, kind="stable")[:, :k] if d.shape[1] <= 4 * k else _least(d, k)
        n = best.shape[1]
        whose.append(np.repeat(np.arange(a, a + len(d)), n))
        which.append(ids[best].ravel())
        far.append(np.take_along_axis(d, best, 1).ravel())
    return np.concatenate(whose), np.concatenate(which), np.concatenate(far) + 0.0


def _least(d: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` least of each row, the first of equals."""
    edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(d), k), np.int64)
    for r, (row, most) in enumerate(zip(d, edge)):
        near = np.flatnonzero(row <= most)
        out[r] = near[np.argsort(row[near], kind="stable")[:k]]
    return out


def search(index: Index, queries: DataFrame, k: int = 10, probes: int | None = 8, keep: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, distance): the ``k`` vectors nearest to each query, from rank 1 on, distances rounded to six places.

    The ``probes`` cells nearest to a query are looked through, or with None all of them, which is exact. ``keep`` is a
    condition on the index's columns. Queries without an id or a direction find nothing; a query may find itself.
    """
    width = index.means.shape[1]
    asked = queries.where(usable(F.col(vector_col), width) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    by = F.array(*[F.lit(b) for b in index.blocks])
    if probes is None:
        asked = asked.withColumn("cells", F.sequence(F.lit(0), F.lit(len(index.blocks) - 1)))
    else:
        asked = stage(_placed(asked, index.means, max(1, probes)), "asked")
    asked = asked.select("query_id", "embedding", F.explode("cells").alias("cell"))
    # Queries that probe a popular cell are dealt out too, each part to a copy of the cell's blocks.
    many = {r[0]: r[1] for r in asked.groupBy("cell").count().collect()}
    parts = F.array(*[F.lit(max(1, -(-many.get(c, 0) // ASKED))) for c in range(len(index.blocks))])
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), parts[F.col("cell")]).cast("int"))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), by[F.col("cell")] - 1)).alias("block"))
    held = index.rows if keep is None else index.rows.where(keep)
    held = held.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "cell", "block")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        ids = left.column("query_id").to_numpy()
        whose, which, far = best_of(matrix(left.column("embedding"), width), matrix(right.column("embedding"), width), right.column("vec_id").to_numpy(), k)
        return pa.table({"query_id": ids[whose], "vec_id": which, "distance": far})

    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), parts[F.col("cell")] - 1)))
    key = ["cell", "block", "part"]
    found = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(meet, FOUND)
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    near = F.slice(F.array_sort(F.collect_list(F.struct("distance", "vec_id"))), 1, k)
    best = found.groupBy("query_id").agg(near.alias("near")).select("query_id", F.posexplode("near").alias("rank", "x"))
    return best.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.distance")


def flat(rows: DataFrame, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> Index:
    """An index of one cell, whose search is exact."""
    return build(rows, 1, 1, block, id_col, vector_col)


def against(queries: DataFrame, rows: DataFrame, k: int, width: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, distance) as of ``search``, exact, for queries (query_id, embedding) and rows of ``width`` numbers.

    Rows are counted: a block of them is broadcast and queries aren't shuffled; more are searched by blocks.
    """
    own = rows.where(usable(F.col(vector_col), width) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    if own.count() > BLOCK:
        return search(flat(own), queries, k, None, id_col="query_id")
    few = own.toArrow()
    here = rows.sparkSession.sparkContext.broadcast((few.column("vec_id").to_numpy(), matrix(few.column("embedding"), width)))
    asked = queries.where(usable(F.col("embedding"), width) & F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = here.value
        for batch in batches:
            if len(batch) and len(ids):
                whose, which, far = best_of(matrix(batch.column(1), width), vectors, ids, k)
                rank = np.concatenate([np.arange(1, n + 1) for n in np.bincount(whose, minlength=len(batch))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[whose]), pa.array(rank), pa.array(which), pa.array(far)], names=["query_id", "rank", "vec_id", "distance"])

    return asked.mapInArrow(run, "query_id long, rank int, vec_id long, distance double")


def probes_for(index: Index, queries: DataFrame, k: int = 10, least: float = 0.95, sample: int = 200, id_col: str = "vec_id", vector_col: str = "embedding") -> int:
    """How many cells must be probed for a recall of ``least`` at ``k``, as measured on the ``sample`` queries of least hash.

    For each of their true neighbours it is known how many cells are nearer to the query than the neighbour's own.
    """
    width = index.means.shape[1]
    some = queries.where(usable(F.col(vector_col), width) & F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    some = stage(some.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("embedding")), "tried")
    order = _placed(some, index.means, len(index.means)).select("query_id", "cells")
    true = search(index, some, k, None, id_col="query_id").join(order, "query_id").join(index.rows.select("vec_id", "cell"), "vec_id")
    need = true.select(F.array_position("cells", F.col("cell")).alias("n")).groupBy("n").count().orderBy("n").collect()
    total, seen = sum(r["count"] for r in need), 0
    for r in need:
        seen += r["count"]
        if seen >= least * total:
            return int(r["n"])
    return 1


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Which part of ``exact`` (query_id, vec_id) is in ``found``; 1 if there is nothing to find."""
    row = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").agg(F.sum("hit"), F.count("*")).first()
    return (row[0] or 0) / row[1] if row[1] else 1.0
