"""Quality classifier: support vectors on naive Bayes features.

An n-gram indicator is scaled by the log ratio of its share in the two classes, counted over all labelled
training rows. A linear model with hinge loss is fitted to the scaled rows by dual coordinate descent, on a
bounded sample of them, and its margins become probabilities by a logistic fit on the same sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import stage
from vellum.llm.features import bounded_sample, class_counts, indicators, shape_ngrams, unpack

BITS = 16
#: Most labelled rows that the linear model is fitted to.
SAMPLE = 8000


@dataclass
class NBSVM:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, rows: list[bytes]) -> np.ndarray:
        ids = [unpack(f, BITS) for f in rows]
        return np.array([self.weights[i].sum() / np.sqrt(max(1, len(i))) + self.bias for i in ids])

    def scores(self, rows: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(rows) + self.offset, -30, 30)))


def log_ratios(features: np.ndarray, n0: np.ndarray, n1: np.ndarray, bits: int, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(1 << bits, alpha), np.full(1 << bits, alpha)
    p[features], q[features] = n1 + alpha, n0 + alpha
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit_hinge(rows: list[bytes], ys: np.ndarray, ratio: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 42) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss; rarer classes cost more, by the root of their share."""
    random = np.random.default_rng(seed)
    ids = [unpack(f, BITS) for f in rows]
    xs = [ratio[i] / np.sqrt(max(1, len(i))) for i in ids]
    norm = np.array([x @ x + 1.0 for x in xs])
    sign = np.where(ys == 1, 1.0, -1.0)
    top = cost * np.sqrt(len(ys) / (2 * np.maximum(1, np.where(ys == 1, (ys == 1).sum(), (ys == 0).sum()))))
    a, w, bias = np.zeros(len(rows)), np.zeros(len(ratio)), 0.0
    for _ in range(epochs):
        moved = 0.0
        for k in random.permutation(len(rows)).tolist():
            grad = sign[k] * (w[ids[k]] @ xs[k] + bias) - 1
            new = min(max(a[k] - grad / norm[k], 0.0), top[k])
            step = (new - a[k]) * sign[k]
            if step:
                w[ids[k]] += step * xs[k]
                bias += step
                a[k] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w * ratio, bias


def fit_logistic(margins: np.ndarray, ys: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps on smoothed targets."""
    n1, n0 = (ys == 1).sum(), (ys == 0).sum()
    target = np.where(ys == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.c_[margins, np.ones(len(margins))], np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (target - p) - 1e-3 * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: (id, held_out, score), score the chance of label 1.

    Learns from rows of ``labels`` (id, 0 or 1; other and null labels are skipped, of repeated ids the larger
    label counts) whose id isn't held out: crc32 of the id as text, mod 5, is not 0. Of a document only the text
    enters its score; a null or empty text gets the score of no features. Without both classes every score is
    the share of label 1, or 0.5. A very long text is read whole. Null and repeated ids keep their rows (a null id is
    not held out); an empty table gives no rows; columns besides these are not looked at.
    """
    own = stage(indicators(docs, shape_ngrams, BITS, id_col, text_col), "indicators")
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    rows = stage(own.join(known.groupBy("id").agg(F.max("y").alias("y")).hint("merge"), "id"), "labelled")
    counted = class_counts(rows, BITS).toPandas()
    n = {c: int(counted.loc[counted.feature == -1, c].sum()) for c in ("n0", "n1")}
    out = own.withColumn("held_out", F.coalesce(held_out(F.col("id")), F.lit(False)))
    if not n["n0"] or not n["n1"]:
        share = n["n1"] / (n["n0"] + n["n1"]) if n["n0"] + n["n1"] else 0.5
        return out.select("id", "held_out", F.lit(float(share)).alias("score"))
    counted = counted[counted.feature >= 0]
    ratio = log_ratios(counted.feature.to_numpy(), counted.n0.to_numpy(), counted.n1.to_numpy(), BITS)
    some = sorted(bounded_sample(rows.select("id", "y", "f"), sample, n["n0"] + n["n1"]).collect(), key=lambda r: (r.id, r.y, r.f))
    fs, ys = [bytes(r.f) for r in some], np.array([r.y for r in some])
    weights, bias = fit_hinge(fs, ys, ratio)
    model = NBSVM(weights, bias, 1.0, 0.0)
    model.slope, model.offset = fit_logistic(model.margins(fs), ys)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.scores(batch.column(2).to_pylist()), pa.float64())], names=["id", "held_out", "score"])

    return out.select("id", "held_out", "f").mapInArrow(run, "id long, held_out boolean, score double")
