"""Texts that repeat themselves: rows and time grow with what is distinct in them, and all is checked byte by byte."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vellum.llm import suffix_dedup
from vellum.llm.suffix_dedup import _anchor_rows, own_repeats, prefix_hashes, remove_repeats

from .util import table


def left_over(raw, length):
    """What is left of texts without bytes covered by a string that also starts elsewhere."""
    starts = Counter(t[a : a + length] for t in raw for a in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - length + 1):
            if starts[t[a : a + length]] > 1:
                gone[a : a + length] = True
        out.append(np.frombuffer(t, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize("run", [3, 2000])
def test_repetitive_texts(spark, run):
    draw = random.Random(33)
    word = lambda n: "".join(draw.choice("abé ") for _ in range(n))
    texts = ["a" * 300, "a" * 19, "a" * 20, "a" * 21, None, ""]
    for period in (1, 2, 3, 7, 19, 20, 21, 50):
        unit = word(period)
        texts += [word(15) + unit * (200 // period) + word(15), unit * (90 // period + 1), word(30) + unit + word(12) + unit + word(5)]
    texts += [texts[0], texts[8], word(30) + "a" * 35, "b" * 60 + "a" * 60 + "b" * 60]
    ids = [None if k % 5 == 0 else 3 if k % 7 == 0 else k for k in range(len(texts))]
    rows = remove_repeats(table(spark, list(zip(ids, texts))), length=20, gram=10, run=run).collect()
    raw = [(t or "").encode() for t in texts]
    assert Counter((r.id, r.n_bytes, bytes(r.kept)) for r in rows) == Counter((i, len(t), x) for i, t, x in zip(ids, raw, left_over(raw, 20)))
    assert all(len(r.kept) + sum(s.stop - s.start for s in r.spans) == r.n_bytes for r in rows)


def staged(text, **kinds):
    batch = pa.RecordBatch.from_arrays([pa.array([b"k"]), pa.array([text])], names=["k", "t"])
    return [r for b in _anchor_rows(iter([batch]), 400, 200, 256, 128) for r in b.to_pylist()]


def test_one_letter_makes_few_rows():
    began = time.time()
    rows = staged("a" * 10_000_000)
    assert len(rows) < 20 and time.time() - began < 60
    sure = [r for r in rows if r["lead"] < 0]
    assert [(r["first"], r["n"]) for r in sure] == [(0, 10_000_000 - 399)]
    # Of all marks one is told, with how often it stands there.
    assert [r["times"] for r in rows if r["n"] == 0] == [10_000_000 - 255]
    assert len(staged(("-" * 77 + "\n") * 50_000)) < 500


def test_hashes_alone_tell_nothing(monkeypatch):
    """With all hashes the same, only runs that are equal byte by byte are repeats."""
    raw = np.frombuffer(b"abcdefgh" * 2 + b"abcdefgx", np.uint8)
    first = np.arange(0, 24, 8)
    monkeypatch.setattr(suffix_dedup, "stretch_hash", lambda h, at, n: np.zeros(len(at), np.uint64))
    again, has, sure = own_repeats(raw, prefix_hashes(raw), np.zeros(3, np.int64), first, first, 8)
    assert again.tolist() == [False, True, False] and has.tolist() == [True, False, False] and sure.tolist() == [[0, 0, 1], [0, 8, 1]]
    # Other texts' runs are not a text's own.
    again, has, sure = own_repeats(raw, prefix_hashes(raw), np.array([0, 1, 1]), first, first, 8)
    assert not again.any() and not has.any() and len(sure) == 0


def test_one_letter_of_a_long_text(spark):
    rows = {r.id: r for r in remove_repeats(table(spark, [(1, "x" * 3_000_000), (2, "y" * 500 + "x" * 399), (3, "plain")])).collect()}
    assert len(rows[1].kept) == 0 and len(rows[1].spans) == 1 and rows[1].n_marks == 3_000_000 - 255
    assert bytes(rows[2].kept) == b"x" * 399 and rows[2].n_marks > 0 and bytes(rows[3].kept) == b"plain"
