"""Remarks and spans against all pairs, the bounds behind the prefixes, and one crowded document."""

import difflib
import random
import time

import pytest

from vellum.functions.predicates import match_text
from vellum.operators import spans as S


def score(a, b):
    if a in b:
        return 1.0
    if b in a:
        return min(0.95, len(b) / len(a)) if len(b) >= max(6, len(a) // 5) else 0.0
    return difflib.SequenceMatcher(None, a, b).ratio()


def brute(remarks, held, least=0.6):
    """For each (doc, pos, text) the span of all the document's, told by trying every one."""
    out = {}
    for doc, pos, a in remarks:
        if not a:
            continue
        first = {}
        for d, s, b in held:
            if d == doc and b:
                first[b] = min(s, first.get(b, s))
        rows = sorted((s, b, round(score(a, b), 6)) for b, s in first.items())
        sure = next((r for r in rows if r[2] >= S.SURE), None)
        best = sure or max(rows, key=lambda r: (r[2], len(r[1]), -r[0]), default=None)
        if best and best[2] >= least:
            out[doc, pos] = best[0], best[2]
    return out


def edited(rng, text, rate):
    out = []
    for c in text:
        x = rng.random()
        out.append("" if x < rate / 2 else rng.choice("etaoin") if x < rate else c)
    return "".join(out)


def made(rng, n, words):
    return "".join(rng.choice(words) for _ in range(n))


@pytest.mark.parametrize("letters,least", [("abc", 0.6), ("的是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里", 0.6), ("etaoinshrdlu", 0.5), ("ab", 0.75)])
def test_all_pairs(spark, letters, least):
    rng = random.Random(len(letters))
    held, remarks = [], []
    for doc in range(4):
        lines = [made(rng, rng.randint(1, 40), letters) for _ in range(30)]
        held += [(doc, k, x) for k, x in enumerate(lines)] + [(doc, 40, lines[3])]
        some = [edited(rng, rng.choice(lines), rate) for rate in (0, 0.02, 0.1, 0.3, 0.5, 0.7) for _ in range(6)]
        some += [x[2:-3] for x in lines[:6]] + [x + made(rng, 20, letters) for x in lines[6:12]] + [made(rng, rng.randint(1, 12), letters) for _ in range(8)] + [lines[0]]
        remarks += [(doc, k, x) for k, x in enumerate(some)]
    # Another document's spans aren't found, and one without spans finds nothing.
    remarks.append((9, 0, held[0][2]))
    a = spark.createDataFrame(remarks, "doc_id long, pos long, text string")
    b = spark.createDataFrame(held, "doc_id long, span_id long, content string")
    got = {(r.doc_id, r.pos): (r.span_id, r.ratio) for r in S.match_spans(a, b, least).collect()}
    assert got == brute(remarks, held, least) and len(got) > 50


def test_bounds():
    """What texts have in common, in letters and in pairs of letters, is never less than the bound says."""
    rng = random.Random(4)
    for _ in range(20_000):
        a = made(rng, rng.randint(1, 25), "abcd")
        b = edited(rng, a, rng.choice([0.1, 0.3, 0.6])) or "a"
        r = difflib.SequenceMatcher(None, a, b).ratio()
        assert 2 * S.longest_common(a, b) >= r * (len(a) + len(b)) - 1e-9
        for q in (1, 2, 3):
            both = len(set(S.elements(a, q)) & set(S.elements(b, q)))
            for need in (0.6, 0.8, 0.9, 0.98):
                assert r < need or both >= max(S.in_common(len(a), need, q), S.in_common(len(b), need, q))
    assert S.elements("aabaa", 2) == ["aa", "ab", "ba", "aa\x001"] and S.elements("aabaa", 2, False) == ["aa", "ab", "ba"] and S.elements("a", 2) == []


def test_odd_rows(spark):
    a = spark.createDataFrame([(1, 0, None), (1, 1, ""), (1, 2, " ,. "), (None, 3, "some text here"), (2, 4, "x"), (2, 5, "x"), (2, 6, "x" * 3000)], "doc_id long, pos long, text string")
    b = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (None, 2, "some text here"), (2, 3, None), (2, 4, "xyz"), (2, 5, "X"), (2, 6, "x" * 2900)], "doc_id long, span_id long, content string")
    got = sorted(tuple(r) for r in S.match_spans(a, b).collect())
    assert got == [(2, 4, 4, 1.0), (2, 5, 4, 1.0), (2, 6, 6, 0.95)]
    assert S.match_spans(a.where("false"), b).collect() == [] and S.match_spans(a, b.where("false")).collect() == []


def test_no_stage_holds_all_pairs(spark):
    """A document of 50,000 lines and 400 remarks: what meets is a small part of their 20 million pairs."""
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshrdlcumwfgypbvk") for _ in range(rng.randint(2, 9))) for _ in range(8000)]
    lines = ["".join(rng.choices(words, k=rng.randint(6, 14))) for _ in range(50_000)]
    remarks = [edited(rng, rng.choice(lines), 0.08) for _ in range(300)] + [rng.choice(lines)[5:] for _ in range(100)]
    a = spark.createDataFrame([(1, k, x) for k, x in enumerate(remarks)], "doc_id long, pos long, text string")
    b = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "doc_id long, span_id long, content string").repartition(8)
    began = time.time()
    got = {r.pos: (r.span_id, r.ratio) for r in S.match_spans(a, b).collect()}
    took = time.time() - began
    assert len(got) == 400 and all(got[k][1] == 1.0 and remarks[k] in lines[got[k][0]] for k in range(300, 400))
    assert all(got[k][1] == round(score(remarks[k], lines[got[k][0]]), 6) for k in range(300))
    said = spark.createDataFrame([(1, 1, k, x, 0.9, None) for k, x in enumerate(remarks)], "doc_id long, d long, k long, t string, need double, first long")
    held = b.selectExpr("doc_id", "1L d", "span_id k", "content t")
    assert S.alike(said, held, 3, 0.9).count() < 0.02 * len(lines) * len(remarks)
    assert took < 90


def test_match_text_is_what_is_compared(spark):
    rows = spark.createDataFrame([("A b, c。",)], "t string")
    assert rows.select(match_text(rows.t)).first()[0] == "abc"


@pytest.mark.parametrize("letters", ["abc", "etaoinshrdlu"])
def test_crowded_documents_find_the_same(spark, monkeypatch, letters):
    """Documents of few and of many remarks and spans are told by different means, with one result."""
    rng = random.Random(7)
    held = [(doc, k, made(rng, rng.randint(1, 40), letters)) for doc, n in ((0, 8), (1, 40)) for k in range(n)]
    remarks = [(doc, k, edited(rng, x, rng.choice([0, 0.02, 0.1, 0.4]))) for doc, k, x in held] + [(0, 50 + k, made(rng, 9, letters)) for k in range(5)]
    a = spark.createDataFrame(remarks, "doc_id long, pos long, text string")
    b = spark.createDataFrame(held, "doc_id long, span_id long, content string")
    for few in (512, 20, 0):
        monkeypatch.setattr(S, "FEW", few)
        assert {(r.doc_id, r.pos): (r.span_id, r.ratio) for r in S.match_spans(a, b).collect()} == brute(remarks, held)


def test_few_spans_make_no_strings(spark, monkeypatch):
    """Remarks of documents with few spans never become rows of strings of letters."""
    monkeypatch.setattr(S, "_prefixes", lambda *a, **k: pytest.fail("strings of a document with few spans"))
    a = spark.createDataFrame([(1, 0, "the same line"), (1, 1, "another line of it, and more")], "doc_id long, pos long, text string")
    b = spark.createDataFrame([(1, 3, "the same line"), (1, 4, "another line of it")], "doc_id long, span_id long, content string")
    assert sorted(tuple(r) for r in S.match_spans(a, b).collect()) == [(1, 0, 3, 1.0), (1, 1, 4, 0.681818)]


def test_pairs_let_no_like_text_go():
    rng, pairs = random.Random(6), S._Pairs()
    for _ in range(5000):
        a = made(rng, rng.randint(1, 30), "abcd")
        b = edited(rng, a, rng.choice([0.1, 0.3])) or "a"
        r = difflib.SequenceMatcher(None, a, b).ratio()
        assert pairs.enough(a, b, r - 1e-9)
