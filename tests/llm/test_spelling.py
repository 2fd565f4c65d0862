"""Spelling variants against all pairs and against plain Python on a whole table."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.util import LONG, empty, odd, table
from vellum.llm import spelling
from vellum.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def links(words):
    """Near words by what is left of each word when one letter is left out or open."""
    met = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            met[w[:k] + w[k + 1 :]].add(w)
            met[w[:k] + "*" + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for key, group in met.items():
        if "*" not in key:
            group = group | {key} if key in words else group
            group = {(a, b) for a in group for b in group if len(a) != len(b)}
        else:
            group = {(a, b) for a in group for b in group if a != b}
        for a, b in group:
            near[a].add(b)
            near[b].add(a)
    return near


def grouped(counts, near, margin=10):
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= margin * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], counts[form[w]] if form[w] else None, root)
    return out


@pytest.mark.parametrize("size,letters,most", [(10_000, "ab", 7), (7, "ab", 8), (3, "abc", 6), (20, "aé", 40), (1, "abcdefgh", 5)])
def test_all_pairs(spark, size, letters, most):
    rng = random.Random(size)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, most))) for _ in range(120)}
    words |= {"a" * k for k in range(1, 12)} | {"b" * 300 + x for x in ("", "a", "b", "ab", "aa")}
    counts = {w: rng.choice([1, 2, 10, 25, 100, 3000]) for w in words}
    near = {w: {x for x in words if one_edit(w, x)} for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.group_variants(df, size=size).collect()}
    assert got == grouped(counts, near)


def test_light_edges_are_few():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 30))) for _ in range(4000)} | {"a" * k for k in range(1, 200)})
    edges = spelling.light_edges(words, {}, [])
    assert max(map(len, edges)) <= len(words).bit_length() + 1
    # Terminals in all are a small multiple of the words, however long they are.
    assert sum(map(len, edges)) < 9 * len(words)


def test_meeting_across_batches():
    """Groups that batches cut apart are settled once and whole."""
    import pyarrow as pa

    rows = sorted([("abc", "abc", 5), ("abc", "abd", 1), ("abc", "ab", 2), ("ab*", "abc", 5), ("xyz", "xyy", 1), ("b*c", "bac", 3), ("b*c", "bbc", 3), ("b*c", "bcc", 9), ("zz", "zz", 4)])
    want = None
    for k in range(1, len(rows) + 1):
        cut = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + k])], names=["key", "word", "n"]) for a in range(0, len(rows), k)]
        got = sorted(tuple(r.values()) for b in spelling._meet(iter(cut)) for r in b.to_pylist())
        want = want or got
        assert got == want
    assert want == [("ab", 2, 1, "abc", 5), ("abc", 5, 2, "ab", 2), ("abd", 1, 1, "abc", 5), ("bac", 3, 2, "bcc", 9), ("bbc", 3, 2, "bcc", 9), ("bcc", 9, 2, "bac", 3)]


def counted(rows, shortest=7):
    total = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            total[w] += len(w) >= shortest
    return {w: n for w, n in total.items() if n >= 2}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    counts = counted(rows)
    got = QUERIES["op11_spelling_variants"](spark, SF)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()}
    want = grouped(counts, links(set(counts)))
    assert got == want and sum(x[2] is not None for x in want.values()) >= 10


def test_odd_rows(spark):
    docs = odd(spark).unionByName(table(spark, [(30, "ÀBCDEFGH Àbcdefgh ÀbcdefgH"), (31, "zebra" * 50_000 + " " + "zebra" * 50_000 + "s"), (32, "zebra" * 50_000 + " " + "zebra" * 50_000 + "s")]))
    counts = counted([(r.doc_id, r.text) for r in docs.collect()])
    words = spelling.count_words(docs, vary=True)
    assert {r.word: r.n for r in words.collect()} == counts and len(LONG) > 10_000
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.group_variants(words, 7).collect()}
    assert got == grouped(counts, {w: {x for x in counts if abs(len(x) - len(w)) < 2 and one_edit_long(w, x)} for w in counts})
    assert spelling.group_variants(spelling.count_words(empty(spark))).collect() == []


def one_edit_long(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])
