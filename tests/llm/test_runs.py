"""Periodic runs against plain Python, with odd texts, misleading hashes and long repetitions."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from tests.llm.util import LONG, empty, odd, table
from vellum.llm import runs
from vellum.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(ws, least=6, times=4):
    """All runs, period by period: maximal stretches of words that equal those a period later, of smallest period."""
    found = {}
    for q in range(1, len(ws) // times + 1):
        k = 0
        while k + q < len(ws):
            if ws[k] != ws[k + q]:
                k += 1
                continue
            start = k
            while k + q < len(ws) and ws[k] == ws[k + q]:
                k += 1
            n = k - start + q
            # A stretch that a smaller period explains is no run of this one.
            if n >= max(least, times * q) and not any(q % p == 0 and a <= start and start + n <= b for a, b, p in found):
                found[start, start + n, q] = None
    return sorted((a, b - a, q) for a, b, q in found)


def collapse(ws, found):
    gone = {k for a, n, q in found for k in range(a + q, a + n)}
    return " ".join(w for k, w in enumerate(ws) if k not in gone)


def numbers(ws):
    index = {}
    return np.array([index.setdefault(w, len(index)) for w in ws], np.int32)


def found(*texts, **kw):
    ids = [numbers(t) for t in texts]
    out = [[] for _ in texts]
    for t, a, n, q in zip(*(x.tolist() for x in runs.find_runs(np.concatenate([np.zeros(0, np.int32), *ids]), np.cumsum([0, *map(len, ids)]), **kw))):
        out[t].append((a, n, q))
    return out


def made(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randint(0, 80))]
    if kind == 1:
        return list("abc"[: rng.randint(1, 3)]) * rng.randint(0, 30) + [rng.choice("abc") for _ in range(rng.randint(0, 9))]
    if kind == 2:
        part = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
        return [rng.choice("abcd") for _ in range(rng.randint(0, 20))] + part * rng.randint(2, 9) + part[: rng.randint(0, len(part))] + [rng.choice("abcd") for _ in range(rng.randint(0, 20))]
    if kind == 3:
        inner = ["a"] * rng.randint(4, 8) + ["b"]
        return (inner * rng.randint(4, 6) + ["c"] * rng.randint(1, 6)) * rng.randint(1, 5)
    x = "a"
    for _ in range(rng.randint(0, 7)):
        x += "".join({"a": "b", "b": "a"}[c] for c in x)
    return list(x * rng.randint(1, 4))


@pytest.mark.parametrize("least,times", [(6, 4), (1, 2), (3, 3)])
def test_against_plain(least, times):
    rng = random.Random(5)
    texts = [made(rng) for _ in range(500)] + [[], ["a"]]
    for t, got in zip(texts, found(*texts, least=least, times=times)):
        assert got == plain(t, least, times), t


def test_hashes_that_mislead(monkeypatch):
    """Letters of few values make equal hashes of unequal stretches, which the words then settle."""
    rng = random.Random(9)
    texts = [made(rng) for _ in range(300)]
    monkeypatch.setattr(runs, "letters", lambda ids: (ids.astype(np.int64) % 2).astype(np.uint64))
    assert found(*texts) == [plain(t) for t in texts]
    monkeypatch.setattr(runs, "letters", lambda ids: np.zeros(len(ids), np.uint64))
    assert found(*texts) == [plain(t) for t in texts]


def test_thue_morse():
    """Factors of 2,048 letters of this word have equal polynomial hashes modulo 2^64, whatever the base."""
    x = np.array([k.bit_count() & 1 for k in range(1 << 14)])
    ids = np.concatenate([x, x[:4096], x[:4096], x[:4096], x[:4096], x[:4096]])
    assert found(ids.tolist()) == [[(a, n, q) for a, n, q in plain_fast(ids)]]


def plain_fast(ids):
    rows, n = {}, len(ids)
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[0], ids[:-q] == ids[q:], [0]]).astype(np.int8)
        edges = np.flatnonzero(np.diff(same)).reshape(-1, 2)
        for a, b in edges[edges[:, 1] - edges[:, 0] + q >= max(6, 4 * q)].tolist():
            if not any(q % p == 0 and s <= a and b + q <= s + m for s, m, p in rows):
                rows[a, b - a + q, q] = None
    return sorted(rows)


def test_long_repetitions_take_linear_time():
    began = time.process_time()
    n = 200_000
    rng = np.random.default_rng(1)
    part = rng.integers(0, 1000, 20_000).tolist()
    got = found([0] * n, [0, 1] * (n // 2), part * 10, [0] * (n // 2) + [1] + [0] * (n // 2), [*range(50)] * (n // 50) + [7])
    assert got == [[(0, n, 1)], [(0, n, 2)], [(0, n, 20_000)], [(0, n // 2, 1), (n // 2 + 1, n // 2, 1)], [(0, n, 50)]]
    assert time.process_time() - began < 60


def test_odd_rows(spark):
    docs = odd(spark).unionByName(table(spark, [(20, "x " * 50), (21, " é\x1cé" * 9), (22, "a b " * 3 + "a c"), (23, "1 2 " * 9 + "2 1 " * 9)]))
    rows = sorted((r.id is not None, r.id or 0, tuple(map(tuple, r.runs)), r.collapsed) for r in runs.periodic_runs(docs).collect())
    want = []
    for r in docs.collect():
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", r.text or "") if w]
        f = plain(ws) if r.text != LONG else [(0, len(ws), 8)]
        want.append((r.doc_id is not None, r.doc_id or 0, tuple(f), collapse(ws, f)))
    assert rows == sorted(want)
    assert runs.periodic_runs(empty(spark)).collect() == []


def test_query(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    some = 0
    for d in docs:
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", d.text or "") if w]
        n, h = len(ws), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[k] if k < a else ws[a + (k - a) % p] for k in range(n)]
        got, index = rows[d.doc_id], numbers(ws)
        f = plain_fast(index)
        some += bool(f)
        best = min(f, key=lambda r: (-r[1], r[0], r[2])) if f else (None,) * 3
        assert (got.n_runs, got.start, got.length, got.period) == (len(f), *best)
        assert got.exponent_milli == (1000 * best[1] // best[2] if f else None)
        assert got.runs_sha256 == sha("".join(f"{a},{m},{q}\n" for a, m, q in f)) and got.collapsed_sha256 == sha(collapse(ws, f))
    assert some > 5
    assert {t: str(x) for t, x in QUERIES["op12_periodic_runs"](spark, SF).dtypes if t in ("n_runs", "start", "length", "period", "exponent_milli")} == dict.fromkeys(("n_runs", "start", "length", "period", "exponent_milli"), "bigint")
