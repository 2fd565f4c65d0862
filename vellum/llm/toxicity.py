"""Toxicity by cumulative-link ordinal regression.

Severity grades are ordered; one weight for each word is shared by all thresholds between grades, so the log
odds of exceeding grade k are w.x - t_k. Labels only say whether a text is toxic: a toxic row's grade in
training is 1 to 3 by how many distinct words typical of toxic rows it holds. A word enters the model if the
counts over all labelled rows tell that it is typical: its likelihood ratio is over ``SURE`` and its odds are ``ODDS``
times those in clean rows. There are at most 2^``BITS`` words, which is a hash's range. The model is fitted to a bounded
sample of labelled rows, of which only the model's words leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import stage
from vellum.llm.features import bounded_sample, class_counts, indicators, unpack, words_of

BITS = 20
#: Least likelihood ratio (four standard errors, squared) and odds ratio of a typical word.
SURE, ODDS = 16.0, 8.0
#: Most labelled rows of each class that the model is fitted to.
SAMPLE = 6000
#: Distinct typical words from which a toxic row has grade 2 and 3.
GRADES = (4, 7)


@dataclass
class CumulativeLink:
    words: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def chances(self, rows: list[bytes]) -> np.ndarray:
        """Chance that each row exceeds grade 0, 1, ..."""
        sums = np.zeros(len(rows))
        for k, f in enumerate(rows):
            ids = unpack(f, BITS)
            at = np.minimum(np.searchsorted(self.words, ids), len(self.words) - 1)
            sums[k] = self.weights[at[self.words[at] == ids]].sum()
        return 1 / (1 + np.exp(-np.clip(sums[:, None] - self.cuts, -30, 30)))


def typical_words(counts: DataFrame) -> DataFrame:
    """(feature, odds) of the words that are typical of class 1, odds the log odds ratio, from (feature, n0, n1).

    The likelihood ratio holds for rare words too, of which a standard error tells little.
    """
    totals = counts.where("feature = -1").select(F.col("n0").alias("all0"), F.col("n1").alias("all1"))
    c = counts.where("feature >= 0").crossJoin(F.broadcast(totals))
    odds = F.ln(F.expr("(n1 + 0.5D) / (all1 - n1 + 0.5D)")) - F.ln(F.expr("(n0 + 0.5D) / (all0 - n0 + 0.5D)"))
    part = lambda n, both, of: F.expr(f"CASE WHEN {n} > 0 THEN ({n}) * ln(({n}) * CAST(all0 + all1 AS DOUBLE) / ({both}) / {of}) ELSE 0D END")
    ratio = 2 * (part("n1", "n0 + n1", "all1") + part("n0", "n0 + n1", "all0"))
    ratio = ratio + 2 * (part("all1 - n1", "all0 + all1 - n0 - n1", "all1") + part("all0 - n0", "all0 + all1 - n0 - n1", "all0"))
    return c.select("feature", odds.alias("odds"), ratio.alias("ratio")).where((F.col("ratio") > SURE) & (F.col("odds") > np.log(ODDS))).select("feature", "odds")


def of_model(rows: DataFrame, words: np.ndarray) -> DataFrame:
    """(id, y, f) with only the places of the model's words in f, as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for f in batch.column(2).to_pylist():
                ids = unpack(f, BITS)
                at = np.minimum(np.searchsorted(words, ids), len(words) - 1)
                out.append(at[words[at] == ids].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], names=["id", "y", "f"])

    return rows.select("id", "y", "f").mapInArrow(run, "id long, y int, f binary")


def fit(rows: list[np.ndarray], grades: np.ndarray, weight: np.ndarray, n_words: int, n_grades: int, start: np.ndarray, steps: int = 400, l2: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights of at least 0 and ordered cuts, by adaptive gradient steps on the mean log likelihood."""
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w = np.clip(start, 0, 6) / 3
    base, gaps = np.array([2.0]), np.ones(n_grades - 2)
    total = weight.sum()
    state = [np.zeros_like(x) for x in (w, base, gaps)] + [np.zeros_like(x) for x in (w, base, gaps)]
    for step in range(1, steps + 1):
        cuts = base[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        x = np.bincount(of, w[at], minlength=len(rows))
        above = 1 / (1 + np.exp(-np.clip(x[:, None] - cuts, -30, 30)))
        edges = np.c_[np.ones(len(x)), above, np.zeros(len(x))]
        each = np.arange(len(x))
        chance = np.maximum(edges[each, grades] - edges[each, grades + 1], 1e-12)
        slope = np.c_[np.zeros(len(x)), above * (1 - above), np.zeros(len(x))]
        scale = weight / (total * chance)
        gx = scale * (slope[each, grades] - slope[each, grades + 1])
        gw = np.bincount(at, gx[of], minlength=n_words) - l2 * w
        gc = np.array([-(scale * (slope[:, k + 1] * (grades == k + 1) - slope[:, k + 1] * (grades == k))).sum() for k in range(n_grades - 1)])
        grads = [gw, np.array([gc.sum()]), np.array([gc[k + 1 :].sum() * np.exp(gaps[k]) for k in range(n_grades - 2)])]
        for k, (value, g) in enumerate(zip((w, base, gaps), grads)):
            state[k] = 0.9 * state[k] + 0.1 * g
            state[k + 3] = 0.999 * state[k + 3] + 0.001 * g * g
            value += 0.05 * (state[k] / (1 - 0.9**step)) / (np.sqrt(state[k + 3] / (1 - 0.999**step)) + 1e-9)
        np.maximum(w, 0, out=w)
    return w, base[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def severity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: (id, chances, severity, grade).

    chances: that the text's grade exceeds 0, 1 and 2; severity: the expected grade; grade: the likeliest grade's
    place among cuts at one half. ``labels`` has (id, 0 or 1): other and null labels are skipped, of repeated ids
    the larger label counts. Without typical words, or without toxic rows, all chances are 0. A null or empty
    text has no words; a very long one is read whole. Null and repeated ids keep their rows; an empty table gives none.
    Columns besides these are not looked at.
    """
    own = stage(indicators(docs, words_of, BITS, id_col, text_col), "words")
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1))
    rows = stage(own.join(known.groupBy("id").agg(F.max("y").alias("y")).hint("merge"), "id"), "labelled")
    counts = stage(class_counts(rows, BITS), "counts")
    total = counts.where("feature = -1").first()
    n0, n1 = (total.n0, total.n1) if total else (0, 0)
    typical = sorted(typical_words(counts).collect()) if n0 and n1 else []
    words, odds = np.array([r.feature for r in typical], np.int64), np.array([r.odds for r in typical])
    if not len(words):
        return own.select("id", F.array(*[F.lit(0.0)] * 3).alias("chances"), F.lit(0.0).alias("severity"), F.lit(0).alias("grade"))
    short = of_model(rows, words)
    parts = [bounded_sample(short.where(F.col("y") == y), sample, n) for y, n in ((0, n0), (1, n1))]
    some = sorted(((r.y, r.id, bytes(r.f)) for r in parts[0].unionByName(parts[1]).collect()))
    xs = [np.frombuffer(f, "<i4").astype(np.int64) for _, _, f in some]
    grades = np.array([y * (1 + sum(len(x) >= g for g in GRADES)) for (y, _, _), x in zip(some, xs)])
    weight = np.where(grades > 0, n1 / max(1, (grades > 0).sum()), n0 / max(1, (grades == 0).sum()))
    weights, cuts = fit(xs, grades, weight, len(words), len(GRADES) + 2, odds)
    shared = docs.sparkSession.sparkContext.broadcast(CumulativeLink(words, weights, cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.chances(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(p.sum(axis=1)), pa.array((p >= 0.5).sum(axis=1).astype(np.int32))], names=["id", "chances", "severity", "grade"])

    return own.mapInArrow(run, "id long, chances array<double>, severity double, grade int")
