"""Spelling variants by errata tries.

In a trie of all words each node's largest child is heavy and its others are light, so a word's path has few light edges: at
most the logarithm of how many words there are. The one-edit pairs that part at a node are found from the light side alone: a
light subtree is merged into the node's own with its first letter skipped, replaced by the heavy letter, or preceded by it, and
light subtrees are merged with each other with their first letter left open. Terminals that coincide are pairs, each met once.

Words are dealt out to tasks by ranges in code-point order, each of which holds a stretch of the trie. The nodes that ranges
share lie on the paths of the words between ranges, which are few; their children are counted over all ranges first. What is
merged are terminals: each light edge of a word gives at most four strings, and equal strings meet by a shuffle.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import stage, text_slices

#: What a run of letters is, and those that are put in lower case.
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}
SHORTEST, FEWEST, MARGIN = 7, 2, 10
ONE_IN = 31
#: Words of a range, and how many ranges there are at most; letters of the words between ranges.
RANGE, RANGES, BOUND = 20_000, 10_000, 64
#: Distinct words that a task counts before it hands them on.
HELD = 300_000
#: Stands for the letter left open in what light subtrees have in common; no letter of a word.
OPEN = "*"
BATCH = 50_000


def variant_of(doc_id: object, word: str) -> str:
    """``word``, or without one letter if ``ONE_IN`` divides the hash of document and word."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    at = h % len(word)
    return word if h % ONE_IN else word[:at] + word[at + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, fewest: int = FEWEST, vary: bool = False) -> DataFrame:
    """(word, n): runs of letters, A-Z in lower case, of ``shortest`` letters or more that occur ``fewest`` times or more.

    With ``vary`` a run that ``variant_of`` changes in its document counts as what it becomes there.
    """
    run_of = re.compile(f"{LETTERS.pattern[:-1]}{{{shortest},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for piece in text_slices(batches, "t"):
            for who, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                if not text:
                    continue
                own: dict[str, int] = {}
                for w, n in Counter(run_of.findall(text)).items():
                    if not w.islower():
                        w = w.translate(LOWER)
                    own[w] = own.get(w, 0) + n
                if vary:
                    crc, start = zlib.crc32, zlib.crc32(f"{'' if who is None else who}:".encode())
                    for w, n in own.items():
                        h = crc(w.encode(), start)
                        if not h % ONE_IN:
                            w = variant_of(who, w)
                            if len(w) < shortest:
                                continue
                        total[w] += n
                else:
                    total.update(own)
            if len(total) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
                total.clear()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def common(a: str, b: str, known: int = 0) -> int:
    """Letters that two words have in common from their beginning, the first ``known`` at least."""
    low, high, step = known, min(len(a), len(b)), 8
    while low < high and a[low : low + step] == b[low : low + step]:
        low, step = min(low + step, high), 2 * step
    high = min(high, low + step)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def shared_paths(words: list[str], bounds: list[str]) -> Iterator[tuple[str, str]]:
    """For each word of a range the nodes on the paths of ``bounds`` that it passes, and its next letter ("" at its end)."""
    for w in words:
        for d in range(max((common(w, b) for b in bounds), default=-1) + 1):
            yield w[:d], w[d : d + 1]


def light_edges(words: list[str], heavy: dict[str, str], bounds: list[str]) -> list[list[tuple[int, str]]]:
    """For each of the sorted ``words`` its light edges: the letters before each, and the heavy letter there.

    ``heavy`` has the heavy letters of the nodes on the paths of ``bounds``, which other ranges share.
    """
    out: list[list[tuple[int, str]]] = [[] for _ in words]
    if bounds:
        for k, w in enumerate(words):
            for d in range(max(common(w, b) for b in bounds) + 1):
                at = heavy.get(w[:d])
                if at and w[d : d + 1] != at:
                    out[k].append((d, at))
    todo = [(0, len(words), 0)] if len(words) > 1 else []
    while todo:
        low, high, d = todo.pop()
        d = common(words[low], words[high - 1], d)
        children, at = [], low
        for letter, group in groupby([w[d : d + 1] for w in words[low:high]]):
            n = len(list(group))
            children.append((letter, at, n))
            at += n
        todo += [(a, a + n, d + 1) for letter, a, n in children if n > 1]
        if any(b.startswith(words[low][:d]) for b in bounds):
            continue
        best = max((c for c in children if c[0]), key=lambda c: (c[2], -c[1]))
        for letter, a, n in children:
            if letter != best[0]:
                for k in range(a, a + n):
                    out[k].append((d, best[0]))
    return out


def merged(word: str, edges: list[tuple[int, str]], shortest: int) -> Iterator[str]:
    """What a word's light edges are merged as: words it may be near to, and what it has in common with other light ones."""
    n = len(word)
    for d, heavy in edges:
        before, after = word[:d], word[d + 1 :]
        if d < n:
            yield before + heavy + after
            yield before + OPEN + after
            # Of equal letters in a row the last is skipped, so that a pair is met once.
            if n > shortest and after[:1] != word[d]:
                yield before + after
        yield before + heavy + word[d:]


def _batch(keys: list[str], words: list[str], ns: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(words, pa.string()), pa.array(ns, pa.int64())], names=["key", "word", "n"])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str], list[int]]]:
    """Rows (range, word, n) in order, a range at a time."""
    now, words, ns = None, [], []
    for batch in batches:
        for r, w, n in zip(*(c.to_pylist() for c in batch.columns)):
            if r != now:
                if words:
                    yield now, words, ns
                now, words, ns = r, [], []
            words.append(w)
            ns.append(n)
    if words:
        yield now, words, ns


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the rows (key, word, n) that meet at a key, in order: what each word is near to there, (word, n, n_near, near, near_n)."""
    names = ["word", "n", "n_near", "near", "near_n"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    rows: list[tuple] = []

    def settle(key: str, group: list[tuple[str, int]]) -> None:
        own = None if OPEN in key else next((n for w, n in group if w == key), None)
        if OPEN not in key and own is None:
            return
        # A word that others come to is near to all of them, and each of them to it alone; words that left the same letter open
        # are all near to each other.
        others = [g for g in group if g[0] != key]
        if not others:
            return
        best = sorted(others, key=lambda g: (-g[1], g[0]))[:2]
        if own is not None:
            rows.append((key, own, len(others), *best[0]))
            rows.extend((w, n, 1, key, own) for w, n in others)
        elif len(others) > 1:
            rows.extend((w, n, len(others) - 1, *(best[0] if best[0][0] != w else best[1])) for w, n in others)

    carry: tuple[str, list[tuple[str, int]]] | None = None
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(0)
        # Only rows whose key stands beside an equal one are looked at.
        same = pc.equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
        first, last = keys[0].as_py(), keys[len(keys) - 1].as_py()
        at = 0
        if carry and carry[0] == first:
            at = 1
            carry[1].append((batch.column(1)[0].as_py(), batch.column(2)[0].as_py()))
            while at < len(keys) and same[at - 1]:
                carry[1].append((batch.column(1)[at].as_py(), batch.column(2)[at].as_py()))
                at += 1
        if at == len(keys):
            continue
        if carry:
            settle(*carry)
        end = len(keys) - 1
        while end > at and same[end - 1]:
            end -= 1
        if end > at:
            inside = np.zeros(end - at, bool)
            inside[1:] = same[at : end - 1]
            inside[:-1] |= same[at : end - 1]
            some = batch.slice(at, end - at).filter(pa.array(inside))
            triples = zip(*(c.to_pylist() for c in some.columns))
            for key, group in groupby(triples, key=lambda x: x[0]):
                settle(key, [(w, n) for _, w, n in group])
        tail = batch.slice(end)
        carry = last, list(zip(tail.column(1).to_pylist(), tail.column(2).to_pylist()))
        while rows:
            some_rows, rows = rows[:BATCH], rows[BATCH:]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some_rows), kinds)], names=names)
    if carry:
        settle(*carry)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def near_words(words: DataFrame, shortest: int = 0, size: int = RANGE) -> DataFrame:
    """(word, n_near, near, near_n) for ``words`` (word, n: distinct words, counted) that differ by one letter from another.

    n_near: how many words differ from this one by exactly one letter inserted, deleted or replaced; near: the one of these
    with the largest n, the smallest in code-point order of equals; near_n its n. ``shortest``: no word is shorter. Words
    must not hold ``OPEN``. A null or empty word has no near words. Ranges are of ``size`` words or a ``RANGES``-th of them, and
    larger only where as many have their first ``BOUND`` letters in common.
    """
    words = words.where("word <> ''")
    spark = words.sparkSession
    total = words.count()
    size = max(size, -(-total // RANGES))
    bounds: list[str] = []
    if total > size:
        # Some twenty words for each range, of which every twentieth bounds one.
        every = max(1, size // 20)
        some = sorted(r[0] for r in words.where(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select(F.substring("word", 1, BOUND)).collect())
        bounds = sorted(set(some[20::20]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = pa.array([bisect_right(bounds, w) for w in batch.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([ranges, *batch.columns], names=["range", "word", "n"])

    dealt = words.select("word", "n").mapInArrow(deal, "range int, word string, n long").repartition("range").sortWithinPartitions("range", "word")
    heavy: dict[str, str] = {}
    if bounds:

        def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r, ws, _ in _ranges(batches):
                seen = Counter(shared_paths(ws, bounds[max(r - 1, 0) : r + 1]))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in seen]), pa.array([c for _, c in seen]), pa.array(seen.values(), pa.int64())], names=["node", "letter", "n"])

        children = dealt.mapInArrow(paths, "node string, letter string, n long").where("letter <> ''").groupBy("node", "letter").agg(F.sum("n").alias("n"))
        best = children.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "letter")).alias("best"))
        heavy = {r[0]: r[1] for r in best.select("node", "best.letter").collect()}
    here = spark.sparkContext.broadcast((heavy, bounds))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, borders = here.value
        for r, ws, ns in _ranges(batches):
            keys: list[str] = []
            of: list[str] = []
            counts: list[int] = []
            for w, n, edges in zip(ws, ns, light_edges(ws, top, borders[max(r - 1, 0) : r + 1])):
                before = len(keys)
                keys.append(w)
                keys.extend(merged(w, edges, shortest))
                of += [w] * (len(keys) - before)
                counts += [n] * (len(keys) - before)
                if len(keys) > BATCH:
                    yield _batch(keys, of, counts)
                    keys, of, counts = [], [], []
            if keys:
                yield _batch(keys, of, counts)

    terminals = dealt.mapInArrow(merge, "key string, word string, n long")
    met = terminals.repartition("key").sortWithinPartitions("key").mapInArrow(_meet, "word string, n long, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))
    found = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.n")).alias("near_n"))


def group_variants(words: DataFrame, shortest: int = 0, margin: int = MARGIN, size: int = RANGE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every row of ``words`` (word, n).

    form: the near word of largest n, if that is ``margin`` times the word's own n or more; root: where forms lead to at
    last, the word itself if it has none. As each form occurs ``margin`` times as often, chains are short.
    """
    if margin < 2:
        raise ValueError("forms must occur twice as often at least")
    words = stage(words.select("word", "n"), "words")
    near = near_words(words, shortest, size)
    all_ = words.join(near, "word", "left").withColumn("given", F.col("near_n") >= margin * F.col("n"))
    all_ = stage(all_.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("given"), F.col("near")).alias("form"), F.when(F.col("given"), F.col("near_n")).alias("form_n")), "formed")
    steps = all_.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        # Each round doubles how many steps a root is away from its word.
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stage(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        steps = after.select("word", "root")
        if not after.where("moved").limit(1).count():
            break
    return all_.join(steps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
