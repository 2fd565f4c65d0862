"""Secret scans over an incremental ledger of blobs.

A text's blob is the SHA-256 of its bytes. The ledger has a row for each blob and version of a rule pack that
has been scanned, with the findings; a scan takes only the pairs that the ledger lacks, and findings are joined back
to every document that holds the blob, in every version of it. A pack's version is a digest of its rules, so a
changed rule makes its pairs unseen again.

Texts are scanned where they are read and are not shuffled, unless most of a large ledger is known: what is unseen is
found by blobs alone, and is broadcast to the texts up to ``SMALL`` blobs. A task scans a blob once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import stage, text_slices

FINDINGS = "array<struct<kind: string, start: int, stop: int>>"
LEDGER = f"blob binary, version string, findings {FINDINGS}"


@dataclass(frozen=True)
class Rule:
    """kind; pattern; group and least characters of that group; lower-case words one of which any match contains."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()


@dataclass(frozen=True)
class Pack:
    name: str
    rules: tuple[Rule, ...]

    @property
    def version(self) -> str:
        return f"{self.name}-{hashlib.sha256(repr(self.rules).encode()).hexdigest()[:12]}"


BASE = Pack(
    "base",
    (
        Rule("assign", r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6, ("passw", "secret", "token", "apikey", "api_key")),
        Rule("access", r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
        Rule("hex", r"[0-9a-f]+", 0, 24),
    ),
)
#: Formats of keys and tokens that name themselves by a public prefix.
PREFIXED = Pack(
    "prefixed",
    (
        Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
        Rule("google", r"AIza[0-9A-Za-z_-]{35}", 0, 39, ("aiza",)),
        Rule("slack", r"xox[abeoprs]-[0-9A-Za-z-]{10,}", 0, 15, ("xox",)),
        Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("private key-----",)),
        Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 24, ("eyj",)),
        Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:[^\s/:@]{3,100}@", 0, 8, ("://",)),
    ),
)
PACKS = (BASE, PREFIXED)
#: Unseen blobs (32 bytes each) up to which they are broadcast to the texts.
SMALL = 200_000
_LONG_HEX = re.compile(rb"[0-9a-f]{24}")


class Scanner:
    def __init__(self, pack: Pack):
        self.rules = [(r, re.compile(r.pattern), [h.encode() for h in r.hints]) for r in pack.rules]

    def spans(self, text: str, raw: bytes, low: bytes) -> list[tuple[str, int, int]]:
        """Matches in code points, by start and then in the rules' order; matches that are too short are dropped."""
        found = []
        for k, (rule, pattern, hints) in enumerate(self.rules):
            if hints and not any(h in low for h in hints) or rule.kind == "hex" and not _LONG_HEX.search(raw):
                continue
            found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return [(self.rules[k][0].kind, a, b) for a, k, b in sorted(found)]


def with_blob(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A null text has the blob of the empty text."""
    return docs.withColumn("blob", F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)))


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, packs: tuple[Pack, ...] = PACKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ledger rows (blob, version, findings) for the pairs that ``ledger`` lacks."""
    held = with_blob(docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")), "t")
    versions = [p.version for p in packs]
    known = {r.version for r in ledger.where(F.col("version").isin(versions)).select("version").distinct().collect()} if ledger is not None else set()
    fresh = ",".join(v for v in versions if v not in known)
    if known:
        pairs = held.select("blob").distinct().select("blob", F.explode(F.array(*[F.lit(v) for v in versions if v in known])).alias("version"))
        unseen = pairs.join(ledger.select("blob", "version"), ["blob", "version"], "left_anti")
        unseen = stage(unseen.groupBy("blob").agg(F.array_join(F.array_sort(F.collect_set("version")), ",").alias("more")), "unseen")
        n = unseen.count()
        if n:
            held = held.join(F.broadcast(unseen) if n <= SMALL else unseen, "blob", "left" if fresh else "inner")
            texts = held.select("blob", F.concat_ws(",", F.lit(fresh or None).cast("string"), "more").alias("versions"), "t")
        else:
            texts = held.select("blob", F.lit(fresh).alias("versions"), "t") if fresh else held.where("false").select("blob", F.lit("").alias("versions"), "t")
    else:
        texts = held.select("blob", F.lit(fresh).alias("versions"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = {p.version: Scanner(p) for p in packs}
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        done: set[bytes] = set()
        for piece in text_slices(batches, "t"):
            blobs, said, found = [], [], []
            for blob, which, text in zip(*(c.to_pylist() for c in piece.columns)):
                if blob in done:
                    continue
                done.add(blob)
                raw = text.encode()
                low = raw.lower()
                for version in which.split(","):
                    blobs.append(blob)
                    said.append(version)
                    found.append([{"kind": k, "start": a, "stop": b} for k, a, b in scanners[version].spans(text, raw, low)])
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(said, pa.string()), pa.array(found, kind)], names=["blob", "version", "findings"])

    return texts.mapInArrow(run, LEDGER).dropDuplicates(["blob", "version"])


def scan(docs: DataFrame, ledger: DataFrame | None = None, packs: tuple[Pack, ...] = PACKS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Findings of every document, and the ledger with what was new.

    First: one row per row of ``docs``: (id, blob, findings), findings ordered by start and then by kind as the
    packs list them; a document without any has an empty list. Null and empty texts share the empty blob. Rows
    with null or repeated ids keep their rows. Second: the ledger, staged in the shared folder; append the rows
    of new pairs to a lasting ledger and pass that in the next time. A very long text is scanned whole, in time that
    grows with its length. An empty table gives no rows. Of other columns nothing is read.
    """
    new = stage(scan_unseen(docs, ledger, packs, id_col, text_col), "ledger")
    after = new if ledger is None else ledger.select("blob", "version", "findings").unionByName(new)
    versions, order = [p.version for p in packs], [r.kind for p in packs for r in p.rules]
    hits = after.where(F.col("version").isin(versions) & (F.size("findings") > 0))
    rank = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("x.kind")).cast("int")
    hits = hits.select("blob", F.explode("findings").alias("x")).groupBy("blob").agg(F.array_sort(F.collect_set(F.struct(F.col("x.start").alias("start"), rank.alias("rank"), F.col("x.stop").alias("stop"), F.col("x.kind").alias("kind")))).alias("xs"))
    hits = hits.select("blob", F.transform("xs", lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.stop.alias("stop"))).alias("findings"))
    own = with_blob(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")), "t").select("id", "blob")
    out = own.join(hits, "blob", "left").select("id", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))
    return out, after


def scan_history(versions: Sequence[DataFrame], packs: Sequence[tuple[Pack, ...]] = (PACKS,), path_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Findings in every version of every path, and the ledger after all runs.

    ``versions`` are the tables of paths and texts as they were, oldest first; ``packs`` the rule packs of each run, the
    last ones for all that follow. First: (path, version, blob, findings) with ``version`` the table's place from 0 on,
    a row for each row of each table, with the findings of the last run's packs, also in older versions. What an
    earlier run has scanned isn't scanned again.
    """
    ledger = None
    for k, docs in enumerate(versions):
        ledger = scan(docs, ledger, packs[min(k, len(packs) - 1)], path_col, text_col)[1]
    parts = []
    for k, docs in enumerate(versions):
        found, ledger = scan(docs, ledger, packs[-1], path_col, text_col)
        parts.append(found.select(F.col("id").alias("path"), F.lit(k).alias("version"), "blob", "findings"))
    return reduce(DataFrame.unionByName, parts), ledger


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])
