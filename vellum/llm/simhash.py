"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint takes a majority vote, bit by bit, over the hashes of its word shingles. For radius r
every bit position i gets a vector m(i) of r + 1 bits, and every nonzero vector v a table whose mask keeps
the positions with odd <m(i), v>. The at most r vectors of the bits in which two fingerprints differ span at
most r dimensions, so some nonzero v is orthogonal to all of them: both fingerprints have the same bits under
that mask. No pair within the radius is missed, and 2^(r+1) - 1 tables suffice at every corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import stage, text_slices
from vellum.llm.components import connected_components

#: Distinct fingerprints of a bucket that are compared with each other in one task. Larger buckets are dealt
#: out by the points halfway between fingerprints, which grows with their size and not with its square.
BUCKET = 4096
#: Components of several fingerprints, and texts of over ``COPIES`` copies (16 bytes each), up to which they are broadcast.
SMALL, COPIES = 500_000, 100


def masks(radius: int = 4, bits: int = 64) -> list[int]:
    """The covering masks; position i has the vector 1 + i mod (2^(r+1) - 1)."""
    tables = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if ((1 + i % tables) & v).bit_count() & 1) for v in range(1, tables + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_digests(text: bytes, width: int, seed: int) -> list[bytes]:
    """XXH64 digests of a text's word shingles, A-Z in lower case, repeats included."""
    words = text.lower().split()
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        return [digest(b" ".join(words), seed)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-width] + 1])
    return [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())]


def vote(digests: list[bytes]) -> int:
    """The fingerprint, as a signed number: a bit is 1 if over half the hashes have it."""
    if not digests:
        return 0
    total, n = np.zeros(64, np.int64), len(digests)
    for at in range(0, n, 50_000):
        some = digests[at : at + 50_000]
        bits = np.unpackbits(np.frombuffer(b"".join(some), np.uint8).reshape(len(some), 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seeds: Sequence[int] = (42,)) -> DataFrame:
    """(id, fp0, fp1, ...): one row per row of ``docs``, a fingerprint a seed. A null or wordless text has fingerprint 0."""
    names = [f"fp{k}" for k in range(len(seeds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, "t"):
            texts = [(t or "").encode() for t in piece.column(1).to_pylist()]
            fps = [pa.array([vote(shingle_digests(t, width, seed)) for t in texts], pa.int64()) for seed in seeds]
            yield pa.RecordBatch.from_arrays([piece.column(0), *fps], names=["id", *names])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, " + ", ".join(f"{n} long" for n in names))


def _stars(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Within each bucket, an edge from every fingerprint to the smallest that it reaches inside the bucket."""
    for batch in batches:
        us, vs = [], []
        for members in batch.column(0).to_pylist():
            x = np.array(sorted(members), np.int64)
            left = np.ones(len(x), bool)
            for first in range(len(x)):
                if not left[first]:
                    continue
                left[first] = False
                todo = [first]
                while todo:
                    near = np.flatnonzero(left & (np.bitwise_count((x ^ x[todo.pop()]).view(np.uint64)) <= radius))
                    left[near] = False
                    todo += near.tolist()
                    us += x[near].tolist()
                    vs += [int(x[first])] * len(near)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def links(fps: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fps`` (fp) with the same components as all pairs within ``radius``."""
    tables = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks(radius))])
    keys = fps.select("fp", F.explode(tables).alias("x")).select("x.k", "x.key", "fp")
    sizes = keys.groupBy("k", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    sizes = stage(sizes, "buckets")
    pairs = sizes.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    some = keys.join(sizes.where((F.col("n") > 2) & (F.col("n") <= bucket)).select("k", "key"), ["k", "key"]).groupBy("k", "key").agg(F.collect_list("fp").alias("fps"))
    stars = some.select("fps").mapInArrow(lambda it: _stars(it, radius), "u long, v long")
    found = pairs.unionByName(stars)
    if (sizes.agg(F.max("n")).first()[0] or 0) > bucket:
        crowded = keys.join(sizes.where(F.col("n") > bucket).select("k", "key"), ["k", "key"]).select("fp").distinct()
        found = found.unionByName(_halfway(crowded, radius))
    return found


def _halfway(fps: DataFrame, radius: int) -> DataFrame:
    """Edges among ``fps``: two within the radius have a point at most half of it from both, and meet there."""
    ball, outer = [0], [(0, -1)]
    for _ in range(radius // 2):
        outer = [(p | (1 << i), i) for p, last in outer for i in range(last + 1, 64)]
        ball += [p for p, _ in outer]
    points = fps.select("fp", F.explode(F.array(*[F.lit(_signed(p)) for p in ball])).alias("p"))
    points = points.select("fp", F.col("fp").bitwiseXOR(F.col("p")).alias("at"))
    met = points.groupBy("at").agg(F.min("fp").alias("v"), F.max("fp").alias("w")).where("v < w")
    return points.join(met.select("at", "v"), "at").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, seeds: Sequence[int] = (42,)) -> DataFrame:
    """One row per row of ``docs``: (id, fp0, ..., component), component the smallest id reachable over links.

    Texts link if their fingerprints for one of the ``seeds`` differ in at most ``radius`` (even) bits; more seeds
    find more of the texts that share most shingles. Null and wordless texts have fingerprint 0 and link like any
    other; equal texts and repeated ids share a component; rows whose id is null keep their row, and get a null
    component if no row they reach has an id. A very long text is one fingerprint of all its shingles, which are
    counted a part at a time. An empty table gives no rows. Columns besides id and text are not looked at.
    """
    if radius % 2 or not 0 < radius <= 6:
        raise ValueError("radius must be 2, 4 or 6")
    own = stage(fingerprints(docs, id_col, text_col, width, seeds), "fingerprints")
    names = [c for c in own.columns if c != "id"]
    # A node stands for all texts with the same fingerprints; its number is the first fingerprint if there is only one.
    node = F.col("fp0") if len(names) == 1 else F.xxhash64(*names)
    nodes = own.withColumn("node", node).groupBy("node", *names).agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    if len(names) == 1:
        edges = links(nodes.select(F.col("node").alias("fp")), radius)
    else:
        nodes = stage(nodes, "nodes")
        parts = []
        for name in names:
            low = stage(nodes.groupBy(F.col(name).alias("fp")).agg(F.min("node").alias("low"), F.count("*").alias("n")), "low")
            near = links(low.select("fp"), radius)
            a, b = (low.select(F.col("fp").alias(x), F.col("low").alias(f"node_{x}")) for x in "uv")
            parts.append(near.join(a, "u").join(b, "v").select(F.col("node_u").alias("u"), F.col("node_v").alias("v")))
            same = nodes.select("node", F.col(name).alias("fp")).join(low.where("n > 1").select("fp", "low"), "fp")
            parts.append(same.where("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v")))
        edges = reduce(DataFrame.unionByName, parts)
    roots = stage(connected_components(edges), "roots")
    linked = nodes.join(roots, "node").select("node", "first", "root")
    low = stage(linked.groupBy("root").agg(F.min("first").alias("component")), "low")
    # One component may have a large share of all nodes, so its nodes aren't dealt by it unless there are too many components.
    low = F.broadcast(low) if low.count() <= SMALL else low
    linked = roots.join(low, "root").select("node", "component")
    known = nodes.join(linked.withColumn("linked", F.lit(True)), "node", "left")
    known = stage(known.select("node", "copies", F.when(F.col("linked"), F.col("component")).otherwise(F.col("first")).alias("component")), "known")
    # Texts with very many copies meet their component by a broadcast, as there are few of these; all others by a join.
    many = known.where(F.col("copies") > COPIES).select("node", "component")
    many = F.broadcast(many) if many.count() <= SMALL else many
    rows = own.withColumn("node", node)
    rest = rows.join(many.select("node"), "node", "left_anti").join(known.where(F.col("copies") <= COPIES).select("node", "component"), "node")
    return rows.join(many, "node").unionByName(rest).select("id", *names, "component")
