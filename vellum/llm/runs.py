"""Periodic runs of words, by Lyndon words.

A run is a stretch of words with a smallest period q that no neighbouring word extends. Under one of the two orders of the
words (any order, and its reverse) the longest Lyndon word from some place of the run has length q, so the candidates are two
for each place: the distances to the next smaller suffix under both orders. A stack scanned from right to left finds these;
comparing two suffixes takes their longest common extension.

Extensions are found by rolling hashes and binary search, and all that they say is verified on the words: stretches by
comparing them, ends by the words that differ. A hash that misleads is replaced by a plain comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import text_slices

#: Words that are compared one by one before hashes are asked.
NEAR = 6
LEAST, TIMES = 6, 4
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_state: dict[str, object] = {}


def powers(n: int) -> np.ndarray:
    """Powers of the base modulo 2^64."""
    if len(_state.get("up", ())) < n:
        step = np.full(max(n, 1 << 16), _BASE, np.uint64)
        step[0] = 1
        _state["up"] = np.multiply.accumulate(step)
        _state["list"] = _state["up"].tolist()
    return _state["up"]


def letters(ids: np.ndarray) -> np.ndarray:
    """A number of 64 bits for each word id."""
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(_BASE) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(ids: np.ndarray) -> np.ndarray:
    """h[i]: sum of letter(ids[k]) * base^k over k < i."""
    out = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(letters(ids) * powers(len(ids))[: len(ids)], out=out[1:])
    return out


class Text:
    """The words of one text as numbers, with the extensions of its suffixes."""

    def __init__(self, ids: np.ndarray):
        self.ids = np.ascontiguousarray(ids, np.int32)
        self.n = len(ids)
        self.w: list[int] = self.ids.tolist()
        self._raw = b""
        self._hashes: list[int] = []
        #: By distance: from where on, and up to where, words are known to equal those so far behind them.
        self.known: dict[int, tuple[int, int]] = {}

    def extension(self, i: int, j: int) -> int:
        """How many words the suffixes from i and from j > i, whose first words are equal, have in common."""
        known = self.known.get(j - i)
        if known and known[0] <= i + 1 <= known[1]:
            if i < known[0]:
                self.known[j - i] = i, known[1]
            return known[1] - i
        w, most = self.w, self.n - j
        k, near = 1, min(NEAR, most)
        while k < near and w[i + k] == w[j + k]:
            k += 1
        return k if k < near or k == most else self._far(i, j, known)

    def _far(self, i: int, j: int, known: tuple[int, int] | None) -> int:
        if not self._hashes:
            self._raw, self._hashes = self.ids.tobytes(), prefix_hashes(self.ids).tolist()
        h, up = self._hashes, _state["list"][j - i]
        at, to = h[i], h[j]
        most = self.n - j
        # Where a stretch that is known begins, no further hashes are needed.
        joint = known[0] - i if known and i < known[0] else most
        low, high = min(NEAR, joint), 2 * NEAR
        while high < joint and ((h[i + high] - at) * up - h[j + high] + to) & _MASK == 0:
            low, high = high, 2 * high
        high = min(high, joint)
        while low < high:
            mid = (low + high + 1) // 2
            if ((h[i + mid] - at) * up - h[j + mid] + to) & _MASK == 0:
                low = mid
            else:
                high = mid - 1
        if not self._same(i, j, low) or (low < joint and self.w[i + low] == self.w[j + low]):
            differ = np.flatnonzero(self.ids[i : i + most] != self.ids[j:])
            low = int(differ[0]) if len(differ) else most
        elif low == joint < most:
            low = known[1] - i
        self.known[j - i] = i, i + low
        return low

    def _same(self, i: int, j: int, n: int) -> bool:
        return self._raw[4 * i : 4 * (i + n)] == self._raw[4 * j : 4 * (j + n)]

    def next_smaller(self, sign: int) -> list[int]:
        """For each place the next one whose suffix is smaller (``n``, the empty one, at last), by the order of the numbers or its reverse."""
        w, n = (self.w if sign > 0 else [-x for x in self.w]), self.n
        self.known.clear()
        out = [n] * n
        extension = self.extension
        for i in range(n - 2, -1, -1):
            a, j = w[i], i + 1
            while j < n:
                b = w[j]
                if a > b:
                    break
                if a == b:
                    k = extension(i, j)
                    if j + k == n or w[i + k] > w[j + k]:
                        break
                j = out[j]
            out[i] = j
        return out


def _common(h: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common words of the stretches from a and from b > a, ``most`` at most, by binary search."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    up = powers(len(h))
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = (h[a + mid] - h[a]) * up[b - a] == h[b + mid] - h[b]
        low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
    return low


def _common_back(h: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The same for the words before a and b, backwards."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    up = powers(len(h))
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = (h[a] - h[a - mid]) * up[b - a] == h[b] - h[b - mid]
        low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
    return low


def _plainly(ids: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """Start and stop of the run of period q around i, word by word."""
    differ = np.flatnonzero(ids[:-q] != ids[q:]) if q < len(ids) else np.zeros(0, np.int64)
    at = int(np.searchsorted(differ, i))
    start = int(differ[at - 1]) + 1 if at else 0
    return start, (int(differ[at]) if at < len(differ) else len(ids) - q) + q


def find_runs(words: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``max(least, times * period)`` words or more: (text, start, length, period), in this order.

    words: all texts' word ids, which aren't negative; ends: where each text begins and, at last, where the last one ends.
    """
    if times < 2:
        raise ValueError("a run has its period twice at least")
    size = np.diff(ends)
    whose = np.repeat(np.arange(len(size)), size)
    # A word of no text between two texts keeps stretches apart.
    apart = np.full(len(words) + len(size), -1, np.int64)
    apart[np.arange(len(words)) + whose] = words
    apart[ends[1:] + np.arange(len(size))] = -1 - np.arange(len(size))
    begin = ends[:-1] + np.arange(len(size))
    h = prefix_hashes(apart)
    starts, periods = [], []
    for k in np.flatnonzero(size >= max(least, 1)).tolist():
        text = Text(words[ends[k] : ends[k + 1]])
        place = np.arange(text.n)
        for sign in (1, -1):
            j = np.array(text.next_smaller(sign))
            q = j - place
            # Every run has a Lyndon word in its first period, which the words after it repeat (times - 2) times and more.
            fit = np.flatnonzero(j + (times - 2) * q <= text.n)
            fit = fit[text.ids[fit] == text.ids[np.minimum(j[fit], text.n - 1)]]
            starts.append(begin[k] + fit)
            periods.append(q[fit])
    none = np.zeros(0, np.int64)
    i, q = (np.concatenate([none, *x]) for x in (starts, periods))
    m = (times - 2) * q
    keep = (h[i + m] - h[i]) * powers(len(h))[q] == h[i + m + q] - h[i + q]
    i, q = i[keep], q[keep]
    text = np.searchsorted(begin, i, "right") - 1
    last = begin[text] + size[text]
    stop = i + q + _common(h, i, i + q, last - i - q)
    start = i - _common_back(h, i, i + q, i - begin[text])
    rows = np.unique(np.stack([text, start, stop, q, i], axis=1), axis=0) if len(i) else np.zeros((0, 5), np.int64)
    _, one = np.unique(rows[:, :4], axis=0, return_index=True)
    found = set()
    for k, (t, a, b, p) in zip(one.tolist(), rows[one, :4].tolist()):
        x, y = a - begin[t], b - begin[t]
        ids = words[ends[t] : ends[t + 1]]
        if (ids[x : y - p] == ids[x + p : y]).all() and (x == 0 or ids[x - 1] != ids[x - 1 + p]) and (y == len(ids) or ids[y] != ids[y - p]):
            stretches = {(x, y)}
        else:
            same = rows[k : k + int((rows[k:, :4] == rows[k, :4]).all(axis=1).sum()), 4]
            stretches = {_plainly(ids, i - begin[t], p) for i in same.tolist()}
        found.update((t, int(x), int(y - x), p) for x, y in stretches if y - x >= max(least, times * p))
    out = np.array(sorted(found, key=lambda r: (r[0], r[1], r[3])), np.int64).reshape(-1, 4)
    return out[:, 0], out[:, 1], out[:, 2], out[:, 3]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per row of ``docs``: (id, runs, collapsed).

    runs: (start, length, period) in numbers of words, by start and then period: the stretches of words of smallest period
    ``period`` that no neighbouring word extends, of ``max(least, times * period)`` words or more. collapsed: the words
    without those that a run holds after its first period, joined by one space. Words are what white space of ASCII parts.

    A null or wordless text has no runs and collapses to the empty text; null and repeated ids stay as they are; a very long
    text is gone through whole, in time linear in its words but for the logarithm of binary searches; an empty table gives no
    rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for piece in text_slices(batches, "t", 1 << 20):
            texts = [(t or "").encode().split() for t in piece.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, texts)])
            words = pa.array([w for ws in texts for w in ws], pa.binary()).dictionary_encode().indices.to_numpy()
            text, start, length, period = find_runs(words, ends, least, times)
            runs: list[list[dict]] = [[] for _ in texts]
            for t, a, n, q in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist()):
                runs[t].append({"start": a, "length": n, "period": q})
            for t in np.unique(text).tolist():
                # Overlapping runs drop a word once.
                gone = np.zeros(len(texts[t]) + 1, np.int32)
                for r in runs[t]:
                    gone[r["start"] + r["period"]] += 1
                    gone[r["start"] + r["length"]] -= 1
                texts[t] = [w for w, x in zip(texts[t], np.cumsum(gone).tolist()) if not x]
            collapsed = pa.array([b" ".join(ws).decode() for ws in texts], pa.string())
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(runs, kind), collapsed], names=["id", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_periods(doc_id: Column, text: Column) -> Column:
    """Texts of which every tenth, by a hash of its id, repeats a stretch of its words up to its end; the others as they are."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(doc_id.cast("string").cast("binary"))
    n, g = F.size(words), F.floor(h / 10)
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    again = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), (F.floor((n - a) / p) + 1).cast("int")))
    made = F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), again), F.lit(1), n)
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), F.array_join(made, " ")).otherwise(text)
