"""Byte-pair encoding by speculation, and decoding.

Greedy longest match proposes the tokens of every word that has not been met before. Two tokens are
compatible if exact merging of their joined bytes gives just these two; a proposal all of whose adjacent pairs
are compatible is what exact merging gives. One vectorised pass looks up all adjacent pairs of a slice of
texts, and only the words with a failing pair undergo exact merging.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import text_slices

#: Fixed value of byte-level BPE: what a word is.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Entries that each cache of a worker holds before it starts anew.
CACHE = 250_000
NONE = np.int32(2**31 - 1)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def printable() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or model.get("dropout") or spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        byte_of = printable()
        self.token = [b""] * (1 + max([*model["vocab"].values(), *(x["id"] for x in spec["added_tokens"])]))
        self.id_of: dict[bytes, int] = {}
        for text, k in model["vocab"].items():
            if all(c in byte_of for c in text):
                self.token[k] = bytes(byte_of[c] for c in text)
                self.id_of[self.token[k]] = k
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for text, k in self.special.items():
            self.token[k] = text.encode()
        self.byte_id = [self.id_of[bytes([b])] for b in range(256)]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[model["vocab"][a], model["vocab"][b]] = rank, model["vocab"][a + b]
        prefix = {b"": 0}
        for t in self.id_of:
            for k in range(1, len(t) + 1):
                prefix.setdefault(t[:k], len(prefix))
        edge = np.fromiter((prefix[t[:-1]] * 256 + t[-1] for t in prefix if t), np.int64, len(prefix) - 1)
        order = np.argsort(edge)
        self._edge, self._child = edge[order], np.arange(1, len(prefix))[order]
        self._ends = np.fromiter((self.id_of.get(t, -1) for t in prefix), np.int64, len(prefix))
        size = len(self.token)
        codes = np.fromiter((a * size + b for a, b in self.merge), np.int64, len(self.merge))
        order = np.argsort(codes)
        self._codes = codes[order]
        rank_new = np.fromiter((x for m in self.merge.values() for x in m), np.int64, 2 * len(self.merge)).reshape(-1, 2)
        self._rank = rank_new[order, 0].astype(np.int32)
        self._new = np.zeros(len(self.merge), np.int32)
        self._new[rank_new[:, 0]] = rank_new[:, 1]
        self._word = regex.compile(WORD)
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._odd = re.compile(r"\s\s")
        self._safe = re.compile(r"(?<=\S) (?=\S)")
        self._words: dict[str, bytes] = {}
        self._chunks: dict[str, bytes] = {}
        self._spaced: dict[str, bytes] = {}
        self._fits: dict[int, bool] = {}
        self.merged_words = 0

    def exact(self, word: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, leftmost first, until none can be merged."""
        ids: list[int] = [self.byte_id[b] for b in word]
        n, merge = len(ids), self.merge
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if m := merge.get((new, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, new, ids[after[i]], m[1]))
            if before[i] >= 0 and (m := merge.get((ids[before[i]], new))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], new, m[1]))
        return [x for x in ids if x >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE for pairs that do not merge."""
        code = left.astype(np.int64) * len(self.token) + right
        at = np.minimum(np.searchsorted(self._codes, code), len(self._codes) - 1)
        return np.where((self._codes[at] == code) & (left >= 0) & (right >= 0), self._rank[at], NONE)

    def exact_all(self, words: list[bytes]) -> list[np.ndarray]:
        """``exact`` for many words: those of like length merge side by side, a pair of each word at a time."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        byte_id = np.array(self.byte_id, np.int32)
        for k in np.flatnonzero(size > 48).tolist():
            out[k] = np.array(self.exact(words[k]), np.int32)
        for low, high in ((0, 6), (6, 9), (9, 13), (13, 20), (20, 48)):
            rows = np.flatnonzero((size > low) & (size <= high))
            for at in range(0, len(rows), 20_000):
                some = rows[at : at + 20_000]
                ids = np.full((len(some), high + 1), -1, np.int32)
                ids[np.arange(high + 1) < size[some][:, None]] = byte_id[np.frombuffer(b"".join([words[k] for k in some.tolist()]), np.uint8)]
                rank = self._ranks(ids[:, :-1], ids[:, 1:])
                live, done = np.arange(len(some)), np.zeros((len(some), high + 1), np.int32)
                while len(live):
                    best = rank.argmin(axis=1)
                    least = np.take_along_axis(rank, best[:, None], 1)[:, 0]
                    stop = least == NONE
                    if stop.any():
                        done[live[stop]] = ids[stop]
                        live, ids, rank, best, least = live[~stop], ids[~stop], rank[~stop], best[~stop], least[~stop]
                        if not len(live):
                            break
                    each = np.arange(len(live))
                    ids[each, best] = self._new[least]
                    shift = np.arange(high + 1) + (np.arange(high + 1) > best[:, None])
                    ids = np.where(shift <= high, np.take_along_axis(ids, np.minimum(shift, high), 1), -1)
                    shift = np.arange(high) + (np.arange(high) > best[:, None])
                    rank = np.where(shift < high, np.take_along_axis(rank, np.minimum(shift, high - 1), 1), NONE)
                    rank[each, best] = np.where(best < high, self._ranks(ids[each, best], ids[each, np.minimum(best + 1, high)]), NONE)
                    some_left = np.flatnonzero(best > 0)
                    rank[some_left, best[some_left] - 1] = self._ranks(ids[some_left, best[some_left] - 1], ids[some_left, best[some_left]])
                for k, row, n in zip(some.tolist(), done, (done >= 0).sum(axis=1).tolist()):
                    out[k] = row[:n]
        return out

    def greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The longest token that fits, again and again: all tokens, word after word, and how many each word has.

        All words walk the trie of the vocabulary together, a byte of each at a time.
        """
        size = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        word, end = np.arange(len(words)), np.cumsum(size)
        at = end - size
        state, best, back = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), at.copy()
        said: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            edge = state * 256 + np.where(at < end, text[np.minimum(at, len(text) - 1)], 0)
            to = np.minimum(np.searchsorted(self._edge, edge), len(self._edge) - 1)
            on = (self._edge[to] == edge) & (at < end)
            state = np.where(on, self._child[to], 0)
            at = np.where(on, at + 1, back)
            token = self._ends[state]
            hit = on & (token >= 0)
            best, back = np.where(hit, token, best), np.where(hit, at, back)
            if not on.all():
                said.append((word[~on], best[~on]))
                at = np.where(on, at, back)
                over = ~on & (back >= end)
                if over.any():
                    word, end, at, state, best, back = (x[~over] for x in (word, end, at, state, best, back))
        whose = np.concatenate([w for w, _ in said])
        tokens = np.concatenate([t for _, t in said])[np.argsort(whose, kind="stable")]
        return tokens, np.bincount(whose, minlength=len(words))

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit numbers."""
        if not words:
            return []
        ids, n = self.greedy(words)
        ends = np.cumsum(n)
        # A pair's code is (left + 1, right); each word's first token pairs with 0, which asks whether it is one when merged alone.
        left = np.empty_like(ids)
        left[1:] = ids[:-1] + 1
        left[ends - n] = 0
        codes, of = np.unique(left * len(self.token) + ids, return_inverse=True)
        if len(self._fits) > 2 * CACHE:
            self._fits.clear()
        fits, size = self._fits, len(self.token)
        asked = [divmod(c, size) for c in codes.tolist() if c not in fits]
        for (a, b), got in zip(asked, self.exact_all([(self.token[a - 1] if a else b"") + self.token[b] for a, b in asked])):
            fits[a * size + b] = len(got) == 1 + (a > 0) and got[-1] == b and (not a or got[0] == a - 1)
        known = np.fromiter((fits[c] for c in codes.tolist()), bool, len(codes))
        good = np.logical_and.reduceat(known[of], ends - n)
        raw = ids.astype("<u4").tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip((ends - n).tolist(), ends.tolist())]
        wrong = np.flatnonzero(~good).tolist()
        for k, got in zip(wrong, self.exact_all([words[k] for k in wrong])):
            out[k] = got.astype("<u4").tobytes()
        self.merged_words += int((~good).sum())
        return out

    def _pieces(self, text: str) -> list[str]:
        """Parts of a text that no word crosses, cut at each space that stands alone between two other characters.

        All but the first begin with such a space, which is left out.
        """
        return self._safe.split(text) if self._odd.search(text) else text.split(" ")

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers; the strings of special tokens are those tokens."""
        for cache in (self._chunks, self._spaced, self._words):
            if len(cache) > CACHE:
                cache.clear()
        chunks, spaced, words = self._chunks, self._spaced, self._words
        plans: list[list[list[str]]] = []
        specials: list[list[bytes]] = []
        firsts: set[str] = set()
        others: set[str] = set()
        for text in texts:
            marks = self._special.findall(text) if self._special else []
            parts = [self._pieces(x) if x else [""] for x in (self._special.split(text) if marks else [text])]
            for part in parts:
                firsts.add(part[0])
                others.update(part[1:])
            plans.append(parts)
            specials.append([np.array([self.special[m]], "<u4").tobytes() for m in marks])
        find = self._word.findall
        # Letters and a space before them are one word.
        split = {c: [c] if c.isascii() and c.isalpha() else find(c) for c in firsts.difference(chunks)}
        after = {c: [" " + c] if c.isascii() and c.isalpha() else find(" " + c) for c in others.difference(spaced)}
        new = list(set().union(*split.values(), *after.values()).difference(words))
        words.update(zip(new, self.encode_words([w.encode() for w in new])))
        for cache, cut in ((chunks, split), (spaced, after)):
            for c, ws in cut.items():
                cache[c] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])
        out = []
        for plan, marks in zip(plans, specials):
            ids = [chunks[part[0]] + b"".join(map(spaced.__getitem__, part[1:])) for part in plan]
            out.append(ids[0] + b"".join(m + x for m, x in zip(marks, ids[1:])))
        return out

    def decode(self, ids: bytes) -> str:
        token = self.token
        return b"".join([token[k] for k in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_loaded: dict[str, ByteBPE] = {}


def vocabulary(path: str) -> ByteBPE:
    """One per worker process and path, with the words it has met."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, ids, decoded).

    ids: binary, the token ids as little-endian unsigned 32-bit numbers; decoded: the text they decode to.
    A null text counts as empty and has no ids; a very long one is encoded whole; null and repeated document ids stay as
    they are; an empty table gives no rows; other columns are not looked at. ``path`` names a byte-level BPE file that every worker can
    open (installed with the vocabulary package, like the Python libraries).
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for piece in text_slices(batches, "t", 2 << 20):
            ids = bpe.encode([t or "" for t in piece.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], names=["id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, ids binary, decoded string")
