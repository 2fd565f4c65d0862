"""Distances and verdicts of the quality rules against estimates made one group at a time, over lists of rows."""

import math
from collections import defaultdict

import numpy as np

from tests.llm.util import table
from vellum.llm import quality_rules as Q

SF = "/root/testdata/sf0.001"
D = len(Q.FLOORS)


def vector(r):
    share = lambda a, b: math.sqrt(a / max(b, 1))
    x = (
        math.log(max(r.word_chars, 1) / max(r.n_words, 1)), share(r.n_symbols, r.word_chars), share(r.n_upper, r.word_chars), share(r.n_punct, r.n_words),
        math.log(r.n_distinct + 1) / math.log(r.n_words + 2), share(r.n_repeat_words, r.n_words), share(r.n_dup_lines, r.n_lines), share(r.n_digits, r.word_chars),
    )
    return np.array(x) / np.array(Q.FLOORS)


def lowest(values, share):
    """The least value up to which a share of all are."""
    ordered = sorted(values)
    return next(v for k, v in enumerate(ordered) if sum(o <= v for o in ordered) >= share * len(ordered))


def steps_of(distances):
    return [round(math.log(x + 1e-6) * Q.SCALE) for x in distances]


def one_group(rows, mean0, cov0, steps):
    """Estimates after each step, by start, and the one that is chosen; the group stops when all groups do."""
    mid = np.array([lowest([round(y[j] * Q.BINS) for y in rows], 0.5) for j in range(D)]) / Q.BINS
    wide = np.array([lowest([round(y[j] * Q.BINS) for y in rows], 0.75) - lowest([round(y[j] * Q.BINS) for y in rows], 0.25) for j in range(D)])
    unit = np.maximum(wide / (Q.BINS * 1.349), 1.0)
    z = [(y - mid) / unit for y in rows]
    starts = []
    for f in (None, np.tanh, lambda v: v / np.sqrt(v @ v + 1e-9)):
        like = np.eye(D)
        if f is not None:
            cov = sum(np.outer(f(v), f(v)) for v in z) + 1e-9 * np.eye(D)
            root = np.sqrt(np.diag(cov))
            like = 0.9 * cov / np.outer(root, root) + 0.1 * np.eye(D)
        starts.append((mid, np.linalg.inv(like) / np.outer(unit, unit)))

    def concentrate(mean, inverse):
        far = steps_of([(y - mean) @ inverse @ (y - mean) for y in rows])
        near = np.array([y for y, f in zip(rows, far) if f <= lowest(far, Q.SHARE)])
        w = len(near) / (len(near) + Q.PRIOR)
        own = near.mean(axis=0)
        cov = w * ((near - own).T @ (near - own) / len(near)) + (1 - w) * cov0
        return (own if mean0 is None else w * own + (1 - w) * mean0), cov + 0.5 * np.eye(D), w

    tried = []
    for mean, inverse in starts:
        for _ in range(Q.TRIAL):
            mean, cov, w = concentrate(mean, inverse)
            inverse = np.linalg.inv(cov)
        tried.append((np.linalg.slogdet(cov)[1], mean, cov, w))
    history = [min(tried, key=lambda t: t[0])]
    for _ in range(steps - Q.TRIAL):
        mean, cov, w = concentrate(history[-1][1], np.linalg.inv(history[-1][2]))
        history.append((np.linalg.slogdet(cov)[1], mean, cov, w))
    return history


def estimates(groups, before):
    every = {g: one_group(rows, *before(g)[:2], Q.STEPS) for g, rows in groups.items()}
    last = Q.STEPS - Q.TRIAL
    for k in range(1, last + 1):
        if max(h[k - 1][0] - h[k][0] for h in every.values()) < Q.FALL:
            last = k
            break
    out = {}
    for g, rows in groups.items():
        _, mean, cov, w = every[g][last]
        inverse = np.linalg.inv(cov)
        middle = lowest(steps_of([(y - mean) @ inverse @ (y - mean) for y in rows]), 0.5)
        scale = max(math.exp(middle / Q.SCALE) / Q.chi_square(0.5, D), 1.0)
        out[g] = mean, cov, math.exp(w * math.log(scale) + (1 - w) * math.log(before(g)[2]))
    return out


def test_distances_equal_plain_estimates(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # Some groups of many rows, and one of a single row, whose names are null.
    docs = docs.selectExpr("doc_id", "text", "lang", "if(doc_id % 3 = 0, source, 's') as source").unionByName(docs.limit(1).selectExpr("doc_id + 100000 as doc_id", "concat(text, ' ', text) as text", "cast(null as string) as lang", "cast(null as string) as source"))
    rows = Q.judge(docs).collect()
    groups, tongues = defaultdict(list), defaultdict(list)
    for r in sorted(rows, key=lambda r: r.id):
        if not r.base_failed:
            groups[r.lang, r.source].append(vector(r))
            tongues[r.lang].append(vector(r))
    language = estimates(tongues, lambda g: (None, np.eye(D), 1.0))
    found = estimates(groups, lambda g: language[g[0]])
    assert len(rows) == docs.count() and len(groups) > 20
    for r in rows:
        if r.base_failed:
            assert r.distance is None and not r.kept
        else:
            mean, cov, scale = found[r.lang, r.source]
            off = vector(r) - mean
            want = off @ np.linalg.inv(cov) @ off / scale
            assert abs(want - r.distance) <= 1e-6 * max(1, want)
            assert r.kept == (want <= Q.chi_square(1 - Q.ALPHA, D))
    # Groups that the driver goes through in several blocks have the same estimates.
    monkeypatch.setattr(Q, "SMALL", 7)
    again = {r.id: (r.distance, r.kept) for r in Q.judge(docs).collect()}
    assert all(again[r.id][1] == r.kept and (r.distance is None or abs(again[r.id][0] - r.distance) < 1e-3 * max(1, r.distance)) for r in rows)


def test_a_small_group_is_not_its_own_measure(spark):
    """Three rows of junk are a source of their own, and still are far from what their language is like."""
    import random

    draw = random.Random(3)
    word = lambda: "".join(draw.choice("etaoinshrd") for _ in range(draw.randint(2, 8)))
    docs = [(k, " ".join(word() for _ in range(draw.randint(60, 200))) + ".", "en", f"s{k % 4}") for k in range(200)]
    docs += [(900 + k, " | ".join(word().upper() for _ in range(90)), "en", "junk") for k in range(3)]
    kept = {r.id: r.kept for r in Q.judge(table(spark, docs)).collect()}
    assert not any(kept[900 + k] for k in range(3)) and sum(kept.values()) >= 198
