"""Packing documents into windows of a fixed number of tokens by the sum-of-squares rule.

A window's fill level is how many tokens it holds. N(h) counts the partially filled windows of level h, in an array of all
levels. A document of s tokens goes to a window of the level h (0: a new window) for which the sum of the squares of N
is least afterwards; it is placed when it comes, and no window that was filled is opened again. Documents longer than a
window fill windows of their own first, and only their rest is placed.

Each task packs the rows it reads and holds nothing but its open windows, of which there are ``most`` at most: when there
are more, and at the task's end, the fullest are filled up with what the emptiest hold, cut where need be. What is left then,
less than a window, is split at powers of two, so no sequence needs padding at all.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.bpe import WORD, default_vocabulary, printable
from vellum.llm.common import text_slices

SIZE, END = 1024, 0
#: Open windows of a task.
MOST = 4096
#: Bits of a sequence's number within its task.
TASK_BITS = 33
SCHEMA = "id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"
_encoders: dict[str, tiktoken.Encoding] = {}

#: A piece of a document: its row in the batch at hand or its id, the ids before it, its own ids, and all ids of the document.
Piece = tuple[int | None, int, np.ndarray, int]


def encoder(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary in the file ``path``, whose ids must be in the order of its merges; one per worker process."""
    if path not in _encoders:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or model.get("dropout") or spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        byte_of, vocab = printable(), model["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if made != sorted(made) or (made and made[0] < len(byte_of)):
            raise ValueError(f"{path} has ids in another order than its merges")
        ranks = {bytes(byte_of[c] for c in t): k for t, k in vocab.items() if t not in special}
        # Property names of the word pattern are written as this library has them.
        pattern = WORD.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S")
        _encoders[path] = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


class Packer:
    """Packs pieces into windows as they come; windows are lists of pieces, handed on when they are full."""

    def __init__(self, size: int = SIZE, most: int = MOST):
        self.size, self.most, self.open = size, most, 0
        self.count = np.zeros(size + 1, np.int64)
        # The same counts, but levels without a window are never chosen to be filled further.
        self.usable = np.full(size + 1, -(1 << 40), np.int64)
        self.usable[0] = 0
        self.windows: list[list[list[Piece]]] = [[] for _ in range(size + 1)]
        self.done: list[list[Piece]] = []

    def level(self, s: int) -> int:
        """The level to which ``s`` tokens are added: the fullest of those with the least sum of squares."""
        # Twice the change of half the sum: a window leaves h and one comes to h + s. New windows leave nothing and full ones
        # come to nothing.
        cost = self.count[s:] - self.usable[: self.size - s + 1]
        cost += cost
        cost[0] -= 1
        cost[-1] -= 1
        return self.size - s - int(cost[::-1].argmin())

    def _put(self, h: int, window: list[Piece]) -> None:
        if h == self.size:
            self.done.append(window)
            return
        self.windows[h].append(window)
        self.count[h] += 1
        self.usable[h] = self.count[h]
        self.open += 1

    def _take(self, h: int) -> list[Piece]:
        if not h:
            return []
        self.count[h] -= 1
        self.usable[h] = self.count[h] or -(1 << 40)
        self.open -= 1
        return self.windows[h].pop()

    def add(self, who: int | None, ids: np.ndarray) -> None:
        n, size = len(ids), self.size
        whole = n - n % size
        for at in range(0, whole, size):
            self.done.append([(who, at, ids[at : at + size], n)])
        if whole == n:
            return
        h = self.level(n - whole)
        window = self._take(h)
        window.append((who, whole, ids[whole:].copy() if whole else ids, n))
        self._put(h + n - whole, window)
        if self.open > self.most:
            self.pour()

    def pour(self) -> None:
        """Fill the fullest open windows with what the emptiest hold, until one is left at most."""
        order = [(h, w) for h in range(self.size - 1, 0, -1) for w in self.windows[h]]
        for h in range(1, self.size):
            while self.count[h]:
                self._take(h)
        first, last = 0, len(order) - 1
        while first < last:
            h, window = order[first]
            g, source = order[last]
            who, start, ids, n = source.pop()
            fit = min(self.size - h, len(ids))
            # The end of a piece goes, so that what stays has its place.
            window.append((who, start + len(ids) - fit, ids[len(ids) - fit :], n))
            if fit < len(ids):
                source.append((who, start, ids[: len(ids) - fit], n))
            order[first], order[last] = (h + fit, window), (g - fit, source)
            if h + fit == self.size:
                self.done.append(window)
                first += 1
            if g == fit:
                last -= 1
        if first == last:
            self._put(*order[first])

    def finish(self) -> None:
        """Close all windows: what does not fill one is split at powers of two."""
        self.pour()
        left = [p for h in range(1, self.size) for w in self.windows[h] for p in w]
        room, window = 0, []
        total = sum(len(p[2]) for p in left)
        for who, start, ids, n in left:
            at = 0
            while at < len(ids):
                if not room:
                    room = 1 << (total.bit_length() - 1)
                    window = []
                    self.done.append(window)
                fit = min(room, len(ids) - at)
                window.append((who, start + at, ids[at : at + fit], n))
                at, room, total = at + fit, room - fit, total - fit
        for h in range(1, self.size):
            while self.count[h]:
                self._take(h)


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the documents: (id, start, ids, doc_tokens, sequence_id, offset).

    A document is its text's token ids and then the id ``end``; doc_tokens counts them. Each of them lies in one piece:
    ``ids`` (little-endian unsigned 32-bit numbers), of which ``start`` come before it in its document, from ``offset`` on in
    a sequence of ``size`` tokens or, for a task's last ones, of a power of two. Offsets of a sequence have no gaps.

    A null text counts as empty and so has the end alone; a null id stays null; each row is a document of its own, whatever
    its id; very long texts are cut into windows of their own; an empty table gives no rows; other columns are not looked at.
    Documents are packed in the order in which a task reads them, so a task that runs again gives the same pieces.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_to_numpy
        packer, base, last = Packer(size, most), TaskContext.get().partitionId() << TASK_BITS, np.array([end], np.uint32)
        sequences = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequences
            done, packer.done = packer.done, []
            pieces = [p for w in done for p in w]
            number = np.repeat(np.arange(sequences, sequences + len(done)) + base, [len(w) for w in done])
            sequences += len(done)
            length = np.fromiter((len(p[2]) for p in pieces), np.int64, len(pieces))
            before = np.cumsum(length) - length
            first = np.concatenate([[True], number[1:] != number[:-1]])
            offset = before - np.maximum.accumulate(np.where(first, before, 0))
            ids = pa.array([p[2].astype("<u4", copy=False).tobytes() for p in pieces], pa.binary())
            columns = [pa.array([p[0] for p in pieces], pa.int64()), pa.array([p[1] for p in pieces], pa.int64()), ids, pa.array([p[3] for p in pieces], pa.int64()), pa.array(number, pa.int64()), pa.array(offset, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["id", "start", "ids", "doc_tokens", "sequence_id", "offset"])

        for piece in text_slices(batches, "t"):
            for who, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                packer.add(who, np.concatenate([encode(t, allowed_special="all"), last]) if t else last)
            if packer.done:
                yield flush()
        packer.finish()
        if packer.done:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, SCHEMA)


def sequences(pieces: DataFrame, size: int = SIZE, pad: int = END) -> DataFrame:
    """(sequence_id, ids, n_tokens): the sequences that ``pack`` made, padded to ``size`` tokens unless their length is a power of two."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x.ids)
    joined = pieces.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
    n = (F.length("ids") / 4).cast("int")
    lack = F.when(F.bit_count(n) == 1, 0).otherwise(F.lit(size) - n)
    padding = F.unhex(F.repeat(F.lit(int(pad).to_bytes(4, "little").hex()), lack))
    return joined.select("sequence_id", F.concat("ids", padding).alias("ids"), n.cast("long").alias("n_tokens"))
