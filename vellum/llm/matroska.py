"""Matroska media columns: EBML files written and parsed without outside help.

The writer stores bytes as 8-bit mono PCM in laced blocks; the parser walks variable-length EBML elements,
clusters, simple blocks and block groups with every lacing, and cues, into a table of packets with track,
timestamp and byte range.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import text_slices

# Fixed values of the format: element ids.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

FRAME = 576
RATE = 8000
FRAME_MS = 72
LACED = 8
BLOCKS = 32


def size_field(n: int) -> bytes:
    """A length as a variable-length number; all ones stay reserved for an unknown length."""
    width = 1
    while n >= (1 << (7 * width)) - 1:
        width += 1
    return ((1 << (7 * width)) | n).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_field(len(body)) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def real(kind: int, x: float) -> bytes:
    return element(kind, struct.pack(">d", x))


def pad(raw: bytes, frame: int = FRAME) -> bytes:
    """Bytes 255 are appended up to a positive multiple of ``frame``."""
    return raw + b"\xff" * (max(frame, -(-len(raw) // frame) * frame) - len(raw))


_HEAD = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(AUDIO, real(SAMPLING_FREQUENCY, RATE) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))))


def write(payload: bytes) -> bytes:
    """A file with one PCM track: frames of 576 samples, fixed-size lacing of 8, 32 blocks a cluster, a cue a cluster."""
    frames = len(payload) // FRAME
    if not frames or len(payload) % FRAME:
        raise ValueError("the payload must be a positive multiple of the frame")
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + real(DURATION, frames * FRAME_MS) + element(MUXING_APP, b"vellum") + element(WRITING_APP, b"vellum"))
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    for first in range(0, frames, LACED * BLOCKS):
        body = [number(TIMESTAMP, first * FRAME_MS)]
        for k in range(first, min(first + LACED * BLOCKS, frames), LACED):
            n = min(LACED, frames - k)
            lacing = b"\x84" + bytes([n - 1]) if n > 1 else b"\x80"
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">h", (k - first) * FRAME_MS) + lacing + payload[k * FRAME : (k + n) * FRAME]))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, number(CUE_TIME, first * FRAME_MS) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    return _HEAD + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def vint(data: bytes, at: int) -> tuple[int, int, int]:
    """A variable-length number: its value without and with the length marker, and its width."""
    lead = data[at]
    if not lead:
        raise ValueError(f"no variable-length number at byte {at}")
    width = 9 - lead.bit_length()
    if at + width > len(data):
        raise ValueError(f"cut off at byte {at}")
    whole = int.from_bytes(data[at : at + width], "big")
    return whole & ((1 << (7 * width)) - 1), whole, width


#: Elements that may come with an unknown size, and what ends them.
_TOP = {SEGMENT, INFO, TRACKS, CLUSTER, CUES}


def children(data: bytes, at: int, end: int, parent: int = 0) -> Iterator[tuple[int, int, int]]:
    """(id, first byte, end byte) of the elements in a range; one of unknown size lasts to the next top element or the end."""
    while at < end:
        _, kind, a = vint(data, at)
        size, _, b = vint(data, at + a)
        first = at + a + b
        stop = first + size
        if size == (1 << (7 * b)) - 1:
            stop, scan = end, first
            while kind != SEGMENT and scan < end:
                _, k, x = vint(data, scan)
                if k in _TOP:
                    stop = scan
                    break
                n, _, y = vint(data, scan + x)
                scan += x + y + n
        if stop > end:
            raise ValueError(f"element {kind:x} at byte {at} goes beyond its parent")
        yield kind, first, stop
        at = stop


def laces(data: bytes, at: int, end: int, how: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames. how: 0 none, 1 Xiph, 2 fixed size, 3 EBML lacing."""
    if not how:
        return [(at, end)]
    n, at, sizes = data[at] + 1, at + 1, []
    if how == 2:
        if (end - at) % n:
            raise ValueError("frames of fixed size don't fill their block")
        sizes = [(end - at) // n] * n
    elif how == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        for k in range(n - 1):
            value, _, width = vint(data, at)
            sizes.append(value if not k else sizes[-1] + value - ((1 << (7 * width - 1)) - 1))
            at += width
    if how != 2:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or sum(sizes) != end - at:
        raise ValueError("lacing sizes don't fit their block")
    edges = np.cumsum([at, *sizes]).tolist()
    return list(zip(edges, edges[1:]))


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


Packets = list[tuple[int, int, int, int, int, int]]
Cues = list[tuple[int, int, int]]


def parse(data: bytes) -> tuple[Packets, Cues]:
    """Packets (track, timestamp in ns, first byte, end byte, cluster, place in its lacing) and cues (time in ns, track, byte of the cluster).

    Segments follow each other, and clusters are counted through. Data that is cut off or isn't Matroska raises ValueError.
    """
    try:
        top = list(children(data, 0, len(data)))
        segments = [(a, b) for k, a, b in top if k == SEGMENT]
        if not segments or top[0][0] != EBML:
            raise ValueError("no EBML head or no segment")
        packets: Packets = []
        cues: Cues = []
        for a, b in segments:
            _segment(data, a, b, packets, cues)
    except (IndexError, KeyError, StopIteration, struct.error) as e:
        raise ValueError("the Matroska data is cut off or incomplete") from e
    return packets, cues


def _segment(data: bytes, base: int, end: int, packets: Packets, cues: Cues) -> None:
    durations, scale, cluster = {}, 1_000_000, packets[-1][4] if packets else -1
    for kind, a, b in children(data, base, end):
        if kind == INFO:
            scale = next((_uint(data, x, y) for k, x, y in children(data, a, b) if k == TIMESTAMP_SCALE), scale)
        elif kind == TRACKS:
            for k, x, y in children(data, a, b):
                if k == TRACK_ENTRY:
                    own = {i: _uint(data, p, q) for i, p, q in children(data, x, y) if i in (TRACK_NUMBER, DEFAULT_DURATION)}
                    durations[own[TRACK_NUMBER]] = own.get(DEFAULT_DURATION, 0)
        elif kind == CLUSTER:
            cluster, began = cluster + 1, 0
            for k, x, y in children(data, a, b):
                if k == TIMESTAMP:
                    began = _uint(data, x, y)
                for p, q in [(x, y)] if k == SIMPLE_BLOCK else [(p, q) for i, p, q in children(data, x, y) if i == BLOCK] if k == BLOCK_GROUP else []:
                    track, _, width = vint(data, p)
                    if p + width + 3 > q:
                        raise ValueError(f"block at byte {p} has no head")
                    ahead = struct.unpack_from(">h", data, p + width)[0]
                    at = (began + ahead) * scale
                    for lace, (m, n) in enumerate(laces(data, p + width + 3, q, data[p + width + 2] >> 1 & 3)):
                        packets.append((track, at + lace * durations.get(track, 0), m, n, cluster, lace))
        elif kind == CUES:
            for k, x, y in children(data, a, b):
                if k == CUE_POINT:
                    inside = list(children(data, x, y))
                    when = next(_uint(data, p, q) for i, p, q in inside if i == CUE_TIME)
                    for p, q in [(p, q) for i, p, q in inside if i == CUE_TRACK_POSITIONS]:
                        own = {i: _uint(data, m, n) for i, m, n in children(data, p, q)}
                        cues.append((when * scale, own[CUE_TRACK], base + own[CUE_CLUSTER_POSITION]))


def feature(payload: bytes, packets: list, cues: list) -> str:
    """Packets, cues, milliseconds, mean and mean square of the samples about 128 in thousandths, changes of sign, and a histogram in sixteenths of the range."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    turns = int(np.count_nonzero(np.diff(np.signbit(x))))
    shape = np.bincount((x + 128) >> 4, minlength=16).tolist()
    return f"{len(packets)}:{len(cues)}:{(packets[-1][1] // 1_000_000) + FRAME_MS}:{int(x.sum()) * 1000 // len(x)}:{int((x * x).sum()) * 1000 // len(x)}:{turns}:" + ",".join(map(str, shape))


PACKETS = "array<struct<track: int, ts_ns: long, first: int, stop: int, cluster: int, lace: int>>"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, n_bytes, media, packets, payload, feature).

    media: a Matroska file with the text's UTF-8 bytes; packets: what parsing that file finds; payload: the bytes
    read back from the packets' byte ranges, padded; feature: what ``feature`` makes of them. A null text counts
    as empty, whose payload is one frame of bytes 255; a very long one is one file. Null and repeated ids keep their rows, equal texts have
    equal values, an empty table gives no rows, other columns are not looked at.
    """
    names = ["track", "ts_ns", "first", "stop", "cluster", "lace"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, "t", 2 << 20):
            sizes, files, tables, payloads, said = [], [], [], [], []
            for text in piece.column(1).to_pylist():
                raw = (text or "").encode()
                data = write(pad(raw))
                packets, cues = parse(data)
                back = b"".join([data[a:b] for _, _, a, b, _, _ in packets])
                sizes.append(len(raw))
                files.append(data)
                tables.append(packets)
                payloads.append(back)
                said.append(feature(back, packets, cues))
            flat = list(zip(*(p for t in tables for p in t)))
            inner = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(flat, kinds)], names=names)
            offsets = np.cumsum([0, *map(len, tables)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), inner), pa.array(payloads, pa.binary()), pa.array(said, pa.string())], names=["id", "n_bytes", "media", "packets", "payload", "feature"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id long, n_bytes long, media binary, packets {PACKETS}, payload binary, feature string")
