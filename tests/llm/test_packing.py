"""Packing: every token in one piece, gapless sequences without padding, the rule against a plain sum of squares."""

import random
import zlib

import numpy as np
import pytest

from tests.llm.util import empty, odd
from vellum.llm import bpe, packing
from vellum.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def held(windows, size):
    """Checks windows of (who, start, ids, n) pieces; gives each document's ids."""
    docs = {}
    for w in windows:
        n = sum(len(p[2]) for p in w)
        assert n == size or n.bit_count() == 1
        for who, start, ids, total in w:
            docs.setdefault(who, []).append((start, list(ids), total))
    out = {}
    for who, parts in docs.items():
        got = []
        for start, ids, total in sorted(parts):
            assert start == len(got) and total == parts[0][2] and ids
            got += ids
        assert len(got) == parts[0][2]
        out[who] = got
    return out


@pytest.mark.parametrize("size,most,kind", [(64, 4096, "any"), (64, 8, "any"), (64, 8, "equal"), (1, 4, "any"), (100, 5, "long")])
def test_packer(size, most, kind):
    rng = random.Random(7)
    lengths = [{"any": rng.randint(1, 3 * size), "equal": size // 2 + 3, "long": rng.randint(1, 30 * size)}[kind] for _ in range(400)]
    texts = {k: np.arange(n, dtype=np.uint32) + 1000 * k for k, n in enumerate(lengths)}
    packer, seen = packing.Packer(size, most), 0
    for k, ids in texts.items():
        packer.add(k, ids)
        assert packer.open <= most and packer.open == sum(map(len, packer.windows)) == packer.count.sum()
        seen = max(seen, packer.open)
    packer.finish()
    assert packer.open == 0 and held(packer.done, size) == {k: ids.tolist() for k, ids in texts.items()}
    # Only the last windows are shorter than a full one.
    short = [sum(len(p[2]) for p in w) for w in packer.done if sum(len(p[2]) for p in w) < size]
    assert sum(short) < size and len(short) == len(set(short))


def test_rule():
    """The level is one of least sum of squares, told by trying all of them."""
    rng, size = random.Random(3), 20
    packer = packing.Packer(size)
    counts = [0] * (size + 1)
    for _ in range(3000):
        s = rng.choice([1, 2, 3, 5, 7, 7, 7, 11, 13, 19])
        sums = {}
        for h in range(size - s + 1):
            if h and not counts[h]:
                continue
            after = counts[:]
            after[h] -= 1
            after[h + s] += 1
            sums[h] = sum(x * x for x in after[1:size])
        h = packer.level(s)
        assert sums[h] == min(sums.values()) and h == max(k for k, x in sums.items() if x == sums[h])
        packer.add(0, np.zeros(s, np.uint32))
        if h:
            counts[h] -= 1
        if h + s < size:
            counts[h + s] += 1
        assert counts[1:size] == packer.count[1:size].tolist()
    # Sizes that fill windows together leave few of them open.
    assert packer.open < 0.1 * len(packer.done)


def test_encoder_is_the_librarys():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(bpe.default_vocabulary()), packing.encoder(bpe.default_vocabulary())
    rng = random.Random(1)
    letters = " \n\t\r\x0b\x1c\x85  ​ab'sltrevmdZé日本½٣1290#-_.<|endoftext|>😀̈"
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>", " the quick", "   x"])
        assert e.encode(s, allowed_special="all") == t.encode(s, add_special_tokens=False).ids
    for s in ("a" * 200_000, " " * 200_000, "ab" * 100_000, "日" * 50_000):
        assert e.encode(s, allowed_special="all") == t.encode(s, add_special_tokens=False).ids


def checked(rows, ids_of):
    """Rows of the query against each document's ids."""
    docs, windows = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == set(ids_of)
    for d, parts in docs.items():
        ids, at = ids_of[d], 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : at], "<u4").tobytes())
        assert at == len(ids)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and (at == 1024 or at.bit_count() == 1)
    return docs


def test_query(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [0] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = checked(QUERIES["op13_packing"](spark, SF).collect(), want)
    assert sum(len(p) == 1 for d, p in docs.items() if len(want[d]) <= 1024) > 0.5 * sum(len(x) <= 1024 for x in want.values())


def test_odd_rows(spark):
    docs = odd(spark)
    got = packing.pack(docs).collect()
    total = {}
    for r in docs.collect():
        total.setdefault(r.doc_id, []).append(packing.encoder(bpe.default_vocabulary()).encode(r.text or "", allowed_special="all") + [0])
    for d, all_ids in total.items():
        ids = b"".join(r.ids for r in sorted((r for r in got if r.id == d), key=lambda r: r.start))
        # Rows that repeat with their id are documents of their own.
        assert len(ids) // 4 == sum(map(len, all_ids)) and (len(all_ids) > 1 or ids == np.array(all_ids[0], "<u4").tobytes())
    assert packing.pack(empty(spark)).collect() == []
    one = packing.pack(docs.where("doc_id = 2")).collect()
    assert [(r.id, r.start, r.ids, r.doc_tokens, r.offset) for r in one] == [(2, 0, b"\0\0\0\0", 1, 0)]


def test_sequences(spark):
    pieces = packing.pack(odd(spark), size=100)
    rows = packing.sequences(pieces.where("length(ids) > 8"), size=100, pad=9).collect()
    assert rows
    for r in rows:
        n = len(r.ids) // 4
        assert n == r.n_tokens if r.n_tokens.bit_count() == 1 else n == 100
        assert set(np.frombuffer(r.ids, "<u4")[r.n_tokens :].tolist()) <= {9}
