"""Repeated passages by a hash-compared suffix sort.

Prefix polynomial hashes modulo 2^64 tell in one step whether two stretches of bytes are equal, so binary
search finds the common extension of two suffixes, and a mergesort orders suffixes with a logarithmic number
of hash comparisons each. Neighbours in that order that share ``LENGTH`` bytes, checked byte by byte, repeat.

Sorting every suffix of a corpus together is not needed: only suffixes that can match are sorted. Each window
of ``LENGTH`` bytes picks the GRAM-byte string of least hash inside it as its anchor, the leftmost of equals.
Equal windows pick equal anchors at equal places, so windows are compared only within an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import discard, stage, text_slices, utf8_slices

LENGTH, GRAM = 400, 200
#: Windows and strings of the marks, which tell passages that repeat but are too short to be removed.
MARK, MARK_GRAM = 256, 128
#: Bits of a place within a part of a text.
PLACE = np.uint64(24)
#: Stretches around one anchor that one task sorts together; more are dealt out and their results merged.
RUN = 2000
#: Bytes of stretches that a task sorts at once.
SORT_BYTES = 2 << 20
_ODD = 0x9E3779B97F4A7C15
_state: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse modulo 2^64."""
    if len(_state.get("up", ())) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
                step = np.full(size, base, np.uint64)
                step[0] = 1
                _state[name] = np.multiply.accumulate(step)
    return _state["up"][:n], _state["down"][:n]


_letters = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) >> np.uint64(17))


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """h[i]: sum of letter(raw[k]) * base^k over k < i."""
    up, _ = _powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_letters[raw] * up[:-1], out=out[1:])
    return out


def stretch_hash(h: np.ndarray, at: np.ndarray, length) -> np.ndarray:
    """Hash of ``length`` bytes from each place, the same wherever they are."""
    x = (h[at + length] - h[at]) * _powers(len(h))[1][at]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def extension(h: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common bytes of the suffixes from a and from b, ``most`` at most, by binary search."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), most, np.int64)
    down = _powers(len(h))[1]
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) // 2
        same = (h[a + mid] - h[a]) * down[a] == (h[b + mid] - h[b]) * down[b]
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)


def _less(raw: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whether suffix a comes before suffix b, by the first byte in which they differ."""
    n = extension(h, a, b, most)
    end = n >= most
    at = np.where(end, 0, n)
    return ~end & (raw[a + at] < raw[b + at])


def suffix_sort(raw: np.ndarray, h: np.ndarray, starts: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes from ``starts`` by group and then by their first ``most`` bytes.

    A bottom-up mergesort, all merges of a level at once: each suffix finds its place in the neighbouring run of
    its group by binary search, every probe one comparison of extensions. ``group`` is in ascending order.
    """
    n = len(starts)
    order = np.arange(n)
    first = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1]) if n else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [n]]))
    begin, length = np.repeat(first, size), np.repeat(size, size)
    place = np.arange(n) - begin
    width = 1
    while width < (size.max() if n else 0):
        run = place // width
        other = begin + np.where(run % 2 == 0, run + 1, run - 1) * width
        until = np.minimum(other + width, begin + length)
        low, high = other.copy(), np.maximum(until, other)
        own = starts[order]
        left = run % 2 == 0
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            mid = (low[live] + high[live]) // 2
            them, mine = own[mid], own[live]
            before = np.empty(len(live), bool)
            isleft = left[live]
            # Equal suffixes of the left run go first.
            before[isleft] = _less(raw, h, them[isleft], mine[isleft], most)
            before[~isleft] = ~_less(raw, h, mine[~isleft], them[~isleft], most)
            low[live] = np.where(before, mid + 1, low[live])
            high[live] = np.where(before, high[live], mid)
        ahead = low - other
        target = begin + (run - run % 2) * width + (place % width) + ahead
        new = np.empty_like(order)
        new[target] = order
        order = new
        width *= 2
    return order


def equal_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the bytes from a and from b are truly the same."""
    out = np.empty(len(a), bool)
    windows = np.lib.stride_tricks.sliding_window_view(raw, length)
    for at in range(0, len(a), 8192):
        out[at : at + 8192] = (windows[a[at : at + 8192]] == windows[b[at : at + 8192]]).all(axis=1)
    return out


def _least(raw: np.ndarray, h: np.ndarray, span: int, gram: int) -> np.ndarray:
    """For each run of ``span`` neighbouring GRAM-byte strings the place of the one of least hash, the leftmost of equals."""
    # The upper bits of a hash with its place below them, the same bits whatever the length.
    places = np.arange(len(raw) - gram + 1)
    best, width = stretch_hash(h, places, gram) >> PLACE << PLACE | places.astype(np.uint64), 1
    while width < span:
        step = min(width, span - width)
        best = np.minimum(best[:-step], best[step:])
        width += step
    return (best & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)


def anchors(raw: np.ndarray, h: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM, most: int = 1 << 23) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with the same anchor: the anchor, the first and the last window's start.

    ``ends``: offsets of the texts in ``raw``, whose windows never cross from one text into the next. Longer texts
    are gone through ``most`` windows at a time.
    """
    n = len(raw) - length + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    at = np.concatenate([k + _least(raw[k : k + most + length - 1], h[k : k + most + length], length - gram + 1, gram) for k in range(0, n, most)])
    starts = np.arange(n)
    text = np.searchsorted(ends, starts, "right") - 1
    inside = starts + length <= ends[text + 1]
    starts, at, text = starts[inside], at[inside], text[inside]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    return at[first], starts[first], starts[last]


ROWS = "k binary, anchor long, first int, n int, lead short, stretch long, other long, times int"


def own_repeats(raw: np.ndarray, h: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows (in order, ``text`` says whose) that stand in their text more than once, byte by byte.

    Gives which runs are an earlier one again, which have one that comes again, and ``sure``: (text, first window, windows) of
    the stretches that such runs make up together, as many as are apart.
    """
    size = last - first + length
    key = stretch_hash(h, first, size) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((key[a] == key[b]) & (text[a] == text[b]) & (size[a] == size[b]))
    same = np.zeros(len(near), bool)
    sizes = size[a[near]]
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        same[at] = equal_bytes(raw, first[a[near[at]]], first[b[near[at]]], n)
    near = near[same]
    again, has = np.zeros(len(first), bool), np.zeros(len(first), bool)
    again[b[near]] = has[a[near]] = True
    own = np.flatnonzero(again | has)
    start, stop, whose = first[own], last[own] + 1, text[own]
    new = np.flatnonzero(np.concatenate([[True], (start[1:] > stop[:-1]) | (whose[1:] != whose[:-1])])) if len(own) else own
    end = np.concatenate([new[1:], [len(own)]])[: len(new)] - 1
    return again, has & ~again, np.stack([whose[new], start[new], stop[end] - start[new]], axis=1)


def _rows(k: pa.Array, anchor: np.ndarray, first: np.ndarray, n: np.ndarray, lead: np.ndarray, digest: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    columns = [k, pa.array(anchor.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (first, n)), pa.array(lead.astype(np.int16)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(times.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["k", "anchor", "first", "n", "lead", "stretch", "other", "times"])


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int, mark: int, mark_gram: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows by their anchor, told by a 128-bit digest of their bytes; and marks, which have no windows (n = 0).

    A run that comes again in its text is one row, counted twice, and where such runs stand is told by rows of lead -1,
    one for each stretch of them. A mark that comes again is one row with how often it does.
    """
    for piece, raw, ends in utf8_slices(batches, "t", 1 << 20):
        h = prefix_hashes(raw)
        k = piece.column(0)
        none = lambda x: np.zeros((len(x), 2), np.int64)
        at, first, last = anchors(raw, h, ends, length, gram)
        if len(at):
            text = np.searchsorted(ends, first, "right") - 1
            again, has, sure = own_repeats(raw, h, text, first, last, length)
            if len(sure):
                whose = sure[:, 0]
                zero = np.zeros(len(sure), np.int64)
                yield _rows(k.take(pa.array(whose)), zero, sure[:, 1] - ends[whose], sure[:, 2], zero - 1, none(sure), zero)
            at, first, last, text, has = (x[~again] for x in (at, first, last, text, has))
            data = raw.tobytes()
            digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[a : b + length]) for a, b in zip(first.tolist(), last.tolist())]), np.int64).reshape(-1, 2)
            yield _rows(k.take(pa.array(text)), stretch_hash(h, at, gram), first - ends[text], last - first + 1, at - first, digest, has + 1)
        at, first, _ = anchors(raw, h, ends, mark, mark_gram)
        if len(at):
            text = np.searchsorted(ends, first, "right") - 1
            # Windows before and after one with a lesser anchor may have the same anchor.
            _, one = np.unique(at, return_index=True)
            at, text = at[one], text[one]
            anchor = stretch_hash(h, at, mark_gram) ^ np.uint64(_ODD)
            order = np.lexsort((at, anchor, text))
            new = np.flatnonzero(np.concatenate([[True], (anchor[order[1:]] != anchor[order[:-1]]) | (text[order[1:]] != text[order[:-1]])]))
            times = np.diff(np.concatenate([new, [len(order)]]))
            at, text, anchor = at[order[new]], text[order[new]], anchor[order[new]]
            zero = np.zeros(len(at), np.int64)
            yield _rows(k.take(pa.array(text)), anchor, at - ends[text], zero, zero, none(at), times)


RUNS = "anchor long, stretch long, other long, mask binary, ks array<int>, digests array<binary>"


def _sorted_runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Suffix-sorts stretches (anchor, piece, pieces, stretch, other, n, lead, bytes), which come in order of anchor and piece."""
    held: list[dict] = []
    size, key = 0, None
    for batch in batches:
        for row in batch.to_pylist():
            if (row["anchor"], row["piece"]) != key and size > SORT_BYTES:
                yield _sort(held, length)
                held, size = [], 0
            key = row["anchor"], row["piece"]
            held.append(row)
            size += len(row["bytes"])
    if held:
        yield _sort(held, length)


def _sort(rows: list[dict], length: int) -> pa.RecordBatch:
    """Which windows of each stretch repeat within its anchor and piece.

    For anchors in several pieces also digests of the windows that don't, and of one window of each kind that does.
    """
    data = b"".join(r["bytes"] for r in rows)
    raw = np.frombuffer(data, np.uint8)
    base = np.cumsum([0, *(len(r["bytes"]) for r in rows)])[:-1]
    h = prefix_hashes(raw)
    n = np.array([r["n"] for r in rows], np.int64)
    lead = np.array([r["lead"] for r in rows], np.int64)
    ends = np.cumsum(n)
    whose = np.repeat(np.arange(len(rows)), n)
    off = np.arange(ends[-1]) - (ends - n)[whose]
    starts = base[whose] + off
    # Windows can be equal only if their anchor, and its distance from their start, are.
    piece = np.cumsum([0, *((a["anchor"], a["piece"]) != (b["anchor"], b["piece"]) for a, b in zip(rows, rows[1:]))])
    group = piece[whose] * 65536 + lead[whose] - off
    by = np.argsort(group, kind="stable")
    order = by[suffix_sort(raw, h, starts[by], group[by], length)]
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((group[a] == group[b]) & (stretch_hash(h, starts[a], length) == stretch_hash(h, starts[b], length)))
    near = near[equal_bytes(raw, starts[a[near]], starts[b[near]], length)]
    hit, later = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    hit[order[near]] = hit[order[near + 1]] = later[order[near + 1]] = True
    mask = [np.packbits(hit[e - k : e]).tobytes() for e, k in zip(ends.tolist(), n.tolist())]
    ks: list[list[int]] = [[] for _ in rows]
    digests: list[list[bytes]] = [[] for _ in rows]
    wide = np.array([r["pieces"] > 1 for r in rows])
    for i in np.flatnonzero(wide[whose] & ~later).tolist():
        ks[whose[i]].append(int(off[i]))
        digests[whose[i]].append(xxhash.xxh3_128_digest(data[starts[i] : starts[i] + length]))
    names = ["anchor", "stretch", "other"]
    columns = [*(pa.array([r[c] for r in rows], pa.int64()) for c in names), pa.array(mask, pa.binary()), pa.array(ks, pa.list_(pa.int32())), pa.array(digests, pa.list_(pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, names=[*names, "mask", "ks", "digests"])


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, id, z): a key of 128 bits of each row's id and text, and the compressed text, which is what joins move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for piece in text_slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([pack.compress(t.encode()) for t in piece.column(2).to_pylist()], pa.binary())], names=["k", "id", "z"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, "k binary, id long, z binary")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    said = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "t")
    return own.select(F.unhex(F.md5(said.cast("binary"))).alias("k"), "id", "t")


def _stretches(docs: DataFrame, spots: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """The bytes of the stretches ``spots``, one text of each key being enough."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        names = ["anchor", "stretch", "other", "pieces", "piece", "n", "lead"]
        kinds = [pa.int64()] * 5 + [pa.int16()] * 2
        for batch in batches:
            for at in range(len(batch)):
                data = unpack.decompress(batch.column(1)[at].as_py())
                got = batch.column(0)[at].as_py()
                columns = [pa.array([x[c] for x in got], kind) for c, kind in zip(names, kinds)]
                columns.append(pa.array([data[x["first"] : x["first"] + x["n"] - 1 + length] for x in got], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "bytes"])

    lists = spots.groupBy("k").agg(F.collect_list(F.struct("anchor", "stretch", "other", "pieces", "piece", "n", "lead", "first")).alias("spots"))
    # Rows that repeat with their id, or without one, have the same key, and their texts are the same.
    texts = _packed(docs, id_col, text_col).select("k", "z").join(lists, "k").groupBy("k").agg(F.first("spots").alias("spots"), F.first("z").alias("z"))
    return texts.select("spots", "z").mapInArrow(cut, "anchor long, stretch long, other long, pieces long, piece long, n short, lead short, bytes binary")


def windows(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int, run: int, mark: int = MARK, mark_gram: int = MARK_GRAM) -> DataFrame:
    """(k, first, n, mask, more, times): of the ``n`` windows from byte ``first`` of a text, those that repeat.

    All of them if mask is null; else those with a bit in mask or listed in more. Rows without windows (n = 0) are marks
    that another place has too, and stand ``times`` in the text. A key's rows come as often as rows have it.
    """
    rows = _keyed(docs, id_col, text_col).select("k", "t").mapInArrow(lambda it: _anchor_rows(it, length, gram, mark, mark_gram), ROWS)
    all_rows = stage(rows, "anchors")
    sure = stage(all_rows.where("lead < 0").select("k", "first", "n"), "sure")
    told = all_rows.where("lead >= 0")
    # Windows of an anchor that occurs once have no equals.
    often = stage(told.groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1").select("anchor"), "anchors_often")
    rows = stage(told.join(often, "anchor"), "often")
    discard(all_rows)
    discard(often)
    same = ["anchor", "stretch", "other"]
    # Stretches that occur twice repeat whole; of the others each is compared with all kinds of its anchor.
    kinds = stage(rows.where("n > 0").groupBy(*same).agg(F.sum("times").alias("times"), F.min(F.struct("k", "first", "n", "lead")).alias("one")), "kinds")
    size = stage(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "sizes")
    ask = kinds.join(size, "anchor").withColumn("pieces", F.ceil(F.col("kinds") / run))
    ask = ask.select(*same, "pieces", F.pmod(F.xxhash64("stretch"), "pieces").alias("piece"), "one.*")
    parts = _stretches(docs, ask, id_col, text_col, length).repartition("anchor", "piece").sortWithinPartitions("anchor", "piece")
    found = stage(parts.mapInArrow(lambda it: _sorted_runs(it, length), RUNS), "runs")
    # Merge of the runs of anchors in several pieces: a window that another piece has too repeats.
    across = found.where("size(ks) > 0").select(*same, F.explode(F.arrays_zip("ks", "digests")).alias("x")).select(*same, "x.ks", "x.digests")
    twice = across.groupBy("anchor", "digests").agg(F.count("*").alias("times")).where("times > 1").select("anchor", "digests")
    more = across.join(twice, ["anchor", "digests"]).groupBy(*same).agg(F.collect_list("ks").alias("more"))
    known = found.select(*same, "mask").join(more, same, "left")
    known = kinds.select(*same, "times").join(known, same, "left")
    known = stage(known.select(*same, F.when(F.col("times") == 1, F.col("mask")).alias("mask"), "more"), "known")
    hits = rows.where("n > 0").join(known, same).select("k", "first", "n", "mask", "more", "times")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("mask", "binary"), ("more", "array<int>"))]
    plain = rows.where("n = 0").select("k", "first", "n", "times").unionByName(sure.select("k", "first", "n", F.lit(0).alias("times")))
    return hits.unionByName(plain.select("k", "first", "n", *none, "times"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, run: int = RUN) -> DataFrame:
    """One row per row of ``docs``: (id, n_bytes, spans, kept, n_marks), spans the removed byte ranges and kept the bytes left.

    Every byte covered by a string of ``length`` bytes that also starts anywhere else, in the same text or in
    another, is removed. Texts are UTF-8 bytes, so kept may split a character. A null text counts as empty and
    loses nothing, like texts shorter than ``length``; very long texts are gone through in parts. n_marks says how many of
    the text's marks (in each window of ``MARK`` bytes the string of ``MARK_GRAM`` bytes with the least hash) stand in
    another place too: a passage of ``MARK`` bytes that repeats has one at least, though it may be too short to be removed. Each row is a document of its own, whatever its id: rows
    repeated or without an id lose what they share. An empty table gives no rows; columns besides id and text are
    not looked at.
    """
    hits = windows(docs, id_col, text_col, length, gram, run)
    window = F.when(F.col("n") > 0, F.struct("first", "n", "mask", "more"))
    # Sets, so that rows that repeat with their id, or without one, are listed once, however many they are.
    marks = F.collect_set(F.when(F.col("n") == 0, F.struct("first", "times")))
    lists = hits.groupBy("k").agg(F.collect_set(window).alias("hits"), F.aggregate(marks, F.lit(0).cast("long"), lambda n, x: n + x.times).alias("n_marks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, spans, kept = [], [], []
            for z, found in zip(batch.column(1), batch.column(2)):
                data = unpack.decompress(z.as_py())
                gone = np.zeros(len(data) + length + 1, np.int32)
                for x in found.as_py() or []:
                    if x["mask"] is None:
                        gone[x["first"]] += 1
                        gone[x["first"] + x["n"] - 1 + length] -= 1
                        continue
                    starts = np.flatnonzero(np.unpackbits(np.frombuffer(x["mask"], np.uint8), count=x["n"]))
                    starts = np.union1d(starts, np.array(x["more"] or [], np.int64)).astype(np.int64)
                    np.add.at(gone, x["first"] + starts, 1)
                    np.add.at(gone, x["first"] + starts + length, -1)
                off = np.cumsum(gone)[: len(data)] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], off, [False]]).astype(np.int8)))
                sizes.append(len(data))
                spans.append([{"start": a, "stop": b} for a, b in edges.reshape(-1, 2).tolist()])
                kept.append(np.frombuffer(data, np.uint8)[~off].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), batch.column(3)], names=["id", "n_bytes", "spans", "kept", "n_marks"])

    texts = _packed(docs, id_col, text_col).join(lists, "k", "left").select("id", "z", "hits", F.coalesce("n_marks", F.lit(0)).alias("n_marks"))
    return texts.mapInArrow(cut, "id long, n_bytes long, spans array<struct<start: int, stop: int>>, kept binary, n_marks long")
