"""Quality rules by robust multivariate outliers.

Every text gets counts and, from them, a vector of transformed statistics. Each language and source has a
minimum-covariance-determinant estimate of location and scatter: concentration steps keep the share ``SHARE`` of its
rows that are nearest by Mahalanobis distance and estimate anew from these. They start from three estimates (spreads by
quartiles, the correlation of hyperbolic tangents, that of spatial signs); after ``TRIAL`` steps the start of least
determinant goes on until no determinant falls any more. A row too far from its group's estimate is rejected.

The estimates are regularised, as in the minimum regularised covariance determinant: mean and scatter of a group are
drawn towards its language's estimate, and a language's scatter towards one of units, by a weight that counts as
``PRIOR`` rows. So a group of any size has an estimate of its own, and one of many rows has hardly anything of others.
Statistics come in units of ``FLOORS``, and half a unit of variance stands for differences that never are unusual.

All steps are sums and histograms over all rows, which tasks make of the rows they read, so a group may have any size
and no rows are dealt by group. Estimates are a row for each group: the driver holds those of ``SMALL`` groups at a
time, and goes through more of them in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import stage, text_slices

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct", "n_distinct", "n_digits")
#: Units of the statistics: differences below them never count as unusual.
FLOORS = (0.06, 0.04, 0.05, 0.08, 0.03, 0.2, 0.25, 0.15)
#: Share of rows that an estimate is made of, steps from each start, steps at most, the fall of a determinant's logarithm
#: that ends them, and rows that the parent counts for.
SHARE, TRIAL, STEPS, FALL, PRIOR = 0.75, 2, 10, 1e-2, 32
#: Steps of a histogram in a unit and in a factor of e of a squared distance.
BINS, SCALE = 20, 50
#: Groups whose estimates (1.5 kB each) the driver holds at a time.
SMALL = 20_000
#: Chance of a rejection if a group's clean rows were normal, before the floors.
ALPHA = 1e-9
_SPACE, _SYMBOLS, _UPPER, _PUNCT, _DIGITS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91)), b".,;:!?", b"0123456789"


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words in 3-word windows that occur twice or more, and how many distinct words there are."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(words) < 4:
        return 0, len(known)
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    _, of, n = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(n[of] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum()), len(known)


def counts(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated, distinct = repeated_words(words)
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    return len(words), len(text) - without(_SPACE), without(_SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), without(_UPPER), without(_PUNCT), distinct, without(_DIGITS)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, lang, source) and the counts ``COUNTS``; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, "t"):
            rows = list(zip(*(counts(t or "") for t in piece.column(3).to_pylist())))
            yield pa.RecordBatch.from_arrays([*piece.columns[:3], *(pa.array(c, pa.int64()) for c in rows)], names=["id", "lang", "source", *COUNTS])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("t"))
    return own.mapInArrow(run, "id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def vector() -> list[Column]:
    """The transformed statistics, of about equal spread at any length."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        share("n_symbols", "word_chars"),
        share("n_upper", "word_chars"),
        share("n_punct", "n_words"),
        F.log(F.col("n_distinct") + 1) / F.log(F.col("n_words") + 2),
        share("n_repeat_words", "n_words"),
        share("n_dup_lines", "n_lines"),
        share("n_digits", "word_chars"),
    ]


def chi_square(p: float, d: int) -> float:
    """Wilson and Hilferty's approximation of the quantile."""
    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * (2 / (9 * d)) ** 0.5) ** 3


def _quantile(parts: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles of the whole number ``value`` in each group, from parts of its histogram (n): one row a group."""
    n = parts.groupBy(*by, value).agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*by).orderBy(value)
    n = n.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    return n.groupBy(*by).agg(*[F.min(F.when(F.col("upto") >= F.col("all") * s, F.col(value))).alias(k) for k, s in shares.items()])


def _counted(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of whole numbers, and how often each comes."""
    rows, n = np.unique(np.stack(keys, axis=1), axis=0, return_counts=True)
    return list(rows.T), n


def _summed(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their rows, and sums of their values."""
    order = np.argsort(key, kind="stable")
    keys, first, n = np.unique(key[order], return_index=True, return_counts=True)
    return keys, n, np.add.reduceat(values[order], first, axis=0) if len(key) else values[:0]


def _products(y: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(y.shape[1])
    return y[:, i] * y[:, j]


def _square(upper: np.ndarray, d: int) -> np.ndarray:
    out = np.zeros((*upper.shape[:-1], d, d))
    i, j = np.triu_indices(d)
    out[..., i, j] = upper
    out[..., j, i] = upper
    return out


def _far(y: np.ndarray, g: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Squared distances of rows from their group's estimate."""
    off = y - mean[g]
    return np.einsum("ni,nij,nj->n", off, inverse[g], off)


def _log(distance: np.ndarray) -> np.ndarray:
    """A squared distance as a whole number, in steps of its logarithm."""
    return np.round(np.log(distance + 1e-6) * SCALE).astype(np.int64)


def drawn(n: np.ndarray, sums: np.ndarray, mean0: np.ndarray | None, cov0: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and scatters from rows and sums, drawn towards others; a missing mean draws nothing."""
    n = np.maximum(n, 1e-9)[:, None]
    mean = sums[:, :d] / n
    cov = _square(sums[:, d:] / n, d) - mean[:, :, None] * mean[:, None, :]
    w = n / (n + PRIOR)
    if mean0 is not None:
        mean = w * mean + (1 - w) * mean0
    return mean, w[:, :, None] * cov + (1 - w)[:, :, None] * cov0


def _rows(batch: pa.RecordBatch, names: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Group and statistics of the rows (name, y) whose group is in ``names``."""
    g = pc.fill_null(pc.index_in(batch.column(0), value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    y = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return g[g >= 0], y[g >= 0]


def estimate(fit: DataFrame, names: list[str], d: int, mean0: np.ndarray | None = None, cov0: np.ndarray | None = None, scale0: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scatter, scale) of each of the groups ``names`` from the rows ``fit`` (name, y: array of d doubles).

    mean0, cov0 and scale0 are what they are drawn towards, units if nothing. scale brings the median distance to what it is under
    a normal law, for the nearest rows understate the scatter.
    """
    values = pa.array(names, pa.string())
    cov0 = np.broadcast_to(np.eye(d), (len(names), d, d)) if cov0 is None else cov0

    def over(make: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], columns: str) -> DataFrame:
        """What ``make`` makes of each batch's groups and statistics."""
        heads = [c.split()[0] for c in columns.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                g, y = _rows(batch, values, d)
                if len(g):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in make(g, y)], names=heads)

        return fit.mapInArrow(run, columns)

    def quartiles(g: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        parts = [_counted(g, np.full(len(g), j), np.round(y[:, j] * BINS).astype(np.int64)) for j in range(d)]
        return [*(np.concatenate([p[0][k] for p in parts]) for k in range(3)), np.concatenate([p[1] for p in parts])]

    mid, unit = np.zeros((len(names), d)), np.ones((len(names), d))
    for r in _quantile(over(quartiles, "g long, j long, x long, n long"), ["g", "j"], "x", {"a": 0.25, "b": 0.5, "c": 0.75}).collect():
        mid[r.g, r.j], unit[r.g, r.j] = r.b / BINS, max((r.c - r.a) / (BINS * 1.349), 1.0)

    size = d * (d + 1) // 2

    def summed(make: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and sums by group and start, of what ``make`` gives for a batch: keys and values."""

        def parts(g: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
            key, n, total = _summed(*make(g, y))
            return [key, n, *total.T.copy()]

        names_ = [f"s{k}" for k in range(width)]
        found = over(parts, "key long, n long, " + ", ".join(f"{c} double" for c in names_)).groupBy("key").agg(F.sum("n").alias("n"), F.array(*[F.sum(c) for c in names_]).alias("s"))
        n, total = np.zeros(len(names) * starts), np.zeros((len(names) * starts, width))
        for r in found.collect():
            n[r.key], total[r.key] = r.n, r.s
        return n, total

    def signs(g: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (y - mid[g]) / unit[g]
        return g, np.concatenate([_products(np.tanh(z)), _products(z / np.sqrt((z * z).sum(axis=1, keepdims=True) + 1e-9))], axis=1)

    _, total = summed(signs, 2 * size, 1)
    inverse = []
    for upper in (None, total[:, :size], total[:, size:]):
        like = np.broadcast_to(np.eye(d), (len(names), d, d))
        if upper is not None:
            cov = _square(upper, d) + 1e-9 * np.eye(d)
            root = np.sqrt(np.einsum("gii->gi", cov))
            # A tenth of the identity keeps a correlation regular.
            like = 0.9 * cov / (root[:, :, None] * root[:, None, :]) + 0.1 * np.eye(d)
        inverse.append(np.linalg.inv(like) / (unit[:, :, None] * unit[:, None, :]))
    # Estimates by group and start; from the first choice on there is one start.
    starts = 3
    mean, inverse = np.repeat(mid, starts, axis=0), np.stack(inverse, axis=1).reshape(-1, d, d)
    det = cov = None

    def logs(mean: np.ndarray, inverse: np.ndarray, starts: int) -> DataFrame:
        def parts(g: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
            found = [_counted(g * starts + k, _log(_far(y, g * starts + k, mean, inverse))) for k in range(starts)]
            return [*(np.concatenate([f[0][c] for f in found]) for c in range(2)), np.concatenate([f[1] for f in found])]

        return over(parts, "key long, far long, n long")

    for step in range(1, STEPS + 1):
        most = np.full(len(mean), -(2**62))
        for r in _quantile(logs(mean, inverse, starts), ["key"], "far", {"most": SHARE}).collect():
            most[r.key] = r.most

        def near(g: np.ndarray, y: np.ndarray, mean=mean, inverse=inverse, starts=starts, most=most) -> tuple[np.ndarray, np.ndarray]:
            keys, values = [], []
            for k in range(starts):
                key = g * starts + k
                kept = _log(_far(y, key, mean, inverse)) <= most[key]
                keys.append(key[kept])
                values.append(np.concatenate([y[kept], _products(y[kept])], axis=1))
            return np.concatenate(keys), np.concatenate(values)

        n, sums = summed(near, d + size, starts)
        again = lambda x: None if x is None else np.repeat(x, starts, axis=0)
        mean, cov = drawn(n, sums, again(mean0), again(cov0), d)
        cov = cov + 0.5 * np.eye(d)
        was, det = det, np.linalg.slogdet(cov)[1]
        if step == TRIAL:
            best = det.reshape(-1, starts).argmin(axis=1) + np.arange(len(names)) * starts
            mean, cov, det, n, starts = mean[best], cov[best], det[best], n[best], 1
        inverse = np.linalg.inv(cov)
        if step > TRIAL and (was - det).max(initial=0.0) < FALL:
            break
    scale = np.ones(len(names))
    for r in _quantile(logs(mean, inverse, 1), ["key"], "far", {"mid": 0.5}).collect():
        scale[r.key] = max(np.exp(r.mid / SCALE) / chi_square(0.5, d), 1.0)
    w = n / (n + PRIOR)
    return mean, cov, np.exp(w * np.log(scale) + (1 - w) * np.log(1.0 if scale0 is None else scale0))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", alpha: float = ALPHA) -> DataFrame:
    """One row per row of ``docs``: (id, lang, source), ``COUNTS``, base_failed, distance, kept.

    base_failed: fewer than 50 words, or over half the words in repeated 3-word windows. The other rows make up
    their language and source's estimate (null counts as a name of its own). distance: squared Mahalanobis distance,
    null where base_failed. kept: not base_failed and not beyond the cutoff. A null or empty text has no words and
    fails; a very long one is counted whole. Null and repeated ids keep their rows; ties in distance fall on the same
    side; an empty table gives no rows. Columns besides these four are not looked at.
    """
    own = statistics(docs, id_col, text_col, lang_col, source_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    d = len(FLOORS)
    y = F.array(*[x / F.lit(u) for x, u in zip(vector(), FLOORS)])
    columns = ["id", "lang", "source", *COUNTS, "base_failed"]
    own = stage(own.withColumn("base_failed", failed).select(*columns, F.to_json(F.struct("lang")).alias("tongue"), F.to_json(F.struct("lang", "source")).alias("g"), y.alias("y")), "statistics")
    fit = own.where("not base_failed")
    blocks = max(1, -(-fit.select("g").distinct().count() // SMALL))
    cutoff = chi_square(1 - alpha, d)
    done = [own.where("base_failed").select(*columns, F.lit(None).cast("double").alias("distance"))]
    for block in range(blocks):
        part = fit.where(F.pmod(F.xxhash64("g"), F.lit(blocks)) == block)
        # A language whose groups fall into several blocks is estimated from all its rows in each.
        pairs = sorted((r.g, r.tongue) for r in part.select("g", "tongue").distinct().collect())
        names, tongues = [g for g, _ in pairs], sorted({t for _, t in pairs})
        at = {t: k for k, t in enumerate(tongues)}
        mean0, cov0, scale0 = estimate(fit.select("tongue", "y"), tongues, d)
        own_language = [at[t] for _, t in pairs]
        mean, cov, scale = estimate(part.select("g", "y"), names, d, mean0[own_language], cov0[own_language], scale0[own_language])
        inverse, values = np.linalg.inv(cov) / scale[:, None, None], pa.array(names, pa.string())

        def score(batches: Iterator[pa.RecordBatch], mean=mean, inverse=inverse, values=values) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                g, rows = _rows(batch.select(["g", "y"]), values, d)
                far = _far(rows, g, mean, inverse) if len(g) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(far, pa.float64())], names=[*columns, "distance"])

        kinds = dict(own.dtypes)
        done.append(part.select(*columns, "g", "y").mapInArrow(score, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", distance double"))
    out = reduce(DataFrame.unionByName, done)
    kept = ~F.col("base_failed") & (F.col("distance") <= cutoff)
    return out.select(*columns, "distance", F.coalesce(kept, F.lit(False)).alias("kept"))
