"""Near-duplicates by the overlap (Jaccard similarity) of their sets of word shingles.

Candidates share one of 32 bands of five MinHash values: a pair with an overlap of 0.8 is missed with a chance of
(1 - 0.8^5)^32, about 3 in a million, and closer pairs less often. Every candidate is confirmed on the whole sets.
Texts with equal sets are one node. First each node is held against the smallest node of each of its buckets, then
against the one with most links, which grows with the nodes and joins tight groups; then the pairs of a bucket that are
still in different components. Large buckets of this kind are not paired off but searched by how their sets differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import discard, stage, text_slices
from vellum.llm.components import connected_components
from vellum.llm.simhash import shingle_digests

BANDS, ROWS = 32, 5
#: Sets of a bucket whose pairs are made; larger ones are searched by differences. So are lists of sets that share an element
#: besides their norm, beyond twice as many. This changes only the way.
CROWD = 64
#: Rows, and bytes of norms, up to which what is known of groups is broadcast.
SMALL, SMALL_BYTES = 100_000, 8 << 20
#: Sets of a group from which its norm is made. Any norm gives the same links, a good one gives them soon.
NORM = 64
#: Sets of a group that one task holds against as many others.
BLOCK = 512
#: Groups halve with each step, so this is never reached.
MOST_DEPTH = 64


def shingle_set(text: str | None, width: int, seed: int) -> np.ndarray:
    """The distinct XXH64 hashes of a text's word shingles, rising."""
    return np.unique(np.frombuffer(b"".join(shingle_digests((text or "").encode(), width, seed)), np.uint64))


def multipliers(seeds: Sequence[int]) -> np.ndarray:
    return np.random.default_rng(list(seeds)).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray, factors: np.ndarray) -> list[int]:
    """A key for each band of smallest products; an empty set has none."""
    if not len(hashes):
        return []
    low = np.full(len(factors), 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(low, (hashes[at : at + 2048, None] * factors).min(axis=0), out=low)
    raw, size = low.tobytes(), 8 * ROWS
    return [xxhash.xxh64_intdigest(raw[k : k + size], k) - 2**63 for k in range(0, len(raw), size)]


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The sizes of what two sets share and of what they hold together."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def _across(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a bucket in different components whose sizes allow the overlap."""
    for batch in batches:
        for members in batch.column(0):
            flat = members.values
            x, n, root = (flat.field(k).to_numpy() for k in ("node", "n", "root"))
            fits = (x[:, None] > x) & (root[:, None] != root)
            fits &= 100 * np.minimum(n[:, None], n).astype(np.int64) >= percent * np.maximum(n[:, None], n).astype(np.int64)
            i, j = np.nonzero(fits)
            yield pa.RecordBatch.from_arrays([pa.array(x[i]), pa.array(x[j])], names=["u", "v"])


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What half of some sets of each group have in common."""
    for batch in batches:
        rows = []
        for sets in batch.column(1):
            some = [np.frombuffer(s.as_buffer(), np.uint64) for s in sets.values]
            values, times = np.unique(np.concatenate(some), return_counts=True)
            rows.append(values[2 * times >= len(some)].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["g", "norm"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each set lacks of its group's norm (a bit for each element), and what it has besides, some hundred sets at a time."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            size, missing, bits, extra = [], [], [], []
            for s, p in zip(part.column(3), part.column(4)):
                own, norm = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(p.as_buffer(), np.uint64)
                lacks = ~np.isin(norm, own, assume_unique=True)
                size.append(len(norm))
                missing.append(int(lacks.sum()))
                bits.append(np.packbits(lacks).tobytes())
                extra.append(np.setdiff1d(own, norm, assume_unique=True).view(np.int64))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(size, pa.int32()), pa.array(missing, pa.int32()), pa.array(bits, pa.binary()), pa.array(extra, pa.list_(pa.int64()))], names=["g", "node", "root", "p", "m", "bits", "extra"])


def _sharing(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of sets with an element besides the norm in common, if what they can share at most is enough."""
    for batch in batches:
        for members in batch.column(0):
            flat = members.values
            node, root, p, m, x = (flat.field(k).to_numpy().astype(np.int64) for k in ("node", "root", "p", "m", "x"))
            far = 100 * m + percent * x
            most = np.minimum(m[:, None], m) + np.minimum(x[:, None], x)
            i, j = np.nonzero((node[:, None] > node) & (root[:, None] != root) & ((100 + percent) * most >= far[:, None] + far - (100 - percent) * p))
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["u", "v"])


def _lacking(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of sets, one of each list, that link by what both lack, having nothing besides the norm in common."""
    for batch in batches:
        for left, right in zip(batch.column(0), batch.column(1)):
            a, b = left.values, right.values
            if not len(a) or not len(b):
                continue
            part = lambda t, k: t.field(k).to_numpy().astype(np.int64)
            bits = lambda t: np.unpackbits(np.frombuffer(b"".join(t.field("bits").to_pylist()), np.uint8).reshape(len(t), -1), axis=1).astype(np.float32)
            need = (100 * part(a, "m") + percent * part(a, "x"))[:, None] + 100 * part(b, "m") + percent * part(b, "x") - (100 - percent) * int(part(a, "p")[0])
            both = bits(a) @ bits(b).T
            i, j = np.nonzero((part(a, "root")[:, None] != part(b, "root")) & ((100 + percent) * both >= need))
            u, v = part(a, "node")[i], part(b, "node")[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])


def by_differences(family: DataFrame, sets: DataFrame, tried: DataFrame, confirmed: Callable[[DataFrame], DataFrame], percent: int, crowd: int) -> DataFrame:
    """Links between nodes (node, g, root) of different components of a crowded group ``g``.

    Copies of one text differ from each other by little, but each in its own way. So sets are held against a norm, what
    half of some of the group's sets have: a set lacks m elements of the norm, p in all, and has x besides. Two sets
    overlap by ``percent`` = q or more just if (100 + q) o >= 100 (m + m') + q (x + x') - (100 - q) p, where o counts what
    they both lack and both have besides. Sets for which the right side is never positive link without a look. Of the
    others those pairs are held against each other that have an element besides the norm in common, by a join on these
    elements; and where both lack enough to link without one, the bits of what they lack decide. Elements that many sets
    have besides the norm make groups of their own, of half the size at most.
    """
    spark = family.sparkSession
    links: list[DataFrame] = []
    family, depth = stage(family, "family"), 0
    while depth < MOST_DEPTH:
        depth += 1
        some = family.withColumn("nth", F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("node"), "node"))).where(F.col("nth") <= NORM)
        norms = some.join(sets, "node").groupBy("g").agg(F.collect_list("hashes").alias("sets")).select("g", "sets").mapInArrow(_norms, "g long, norm binary")
        norms = stage(norms, "norms")
        weight = norms.agg(F.sum(F.length("norm")).alias("bytes"), F.count("*").alias("n")).first()
        few = lambda df: F.broadcast(df) if weight.n <= SMALL else df
        light = F.broadcast(norms) if (weight.bytes or 0) <= SMALL_BYTES else norms
        held = family.join(sets, "node").join(light, "g").select("g", "node", "root", "hashes", "norm")
        held = held.mapInArrow(_differences, "g long, node long, root long, p int, m int, bits binary, extra array<long>")
        held = stage(held.withColumn("x", F.size("extra")), "differences")
        far = 100 * F.col("m") + percent * F.col("x")
        core = held.where(2 * far <= (100 - percent) * F.col("p"))
        low = core.groupBy("g").agg(F.min("node").alias("v"))
        links.append(stage(core.join(few(low), "g").where("node > v").select(F.col("node").alias("u"), "v"), "core"))
        # A pair that shares nothing besides the norm shares no more than either lacks: is that enough with the nearest set
        # of another component?
        by_root = stage(held.groupBy("g", "root").agg(F.min(far).alias("far")), "by_root")
        best = by_root.groupBy("g").agg(F.min(F.struct("far", "root")).alias("best"))
        second = by_root.join(best, "g").where("root <> best.root").groupBy("g").agg(F.min("far").alias("second"))
        other = F.when(F.col("root") == F.col("best.root"), F.col("second")).otherwise(F.col("best.far"))
        enough = (100 + percent) * F.col("m") >= far + other - (100 - percent) * F.col("p")
        able = held.join(few(stage(best.join(second, "g"), "best")), "g").where(enough).select(*held.columns)
        pieces = able.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).alias("pieces"))
        able = stage(able.join(few(pieces), "g").withColumn("piece", F.pmod(F.xxhash64("node"), "pieces")), "able")
        body = F.struct("node", "root", "p", "m", "x", "bits")
        every = F.sequence(F.lit(0), F.col("pieces") - 1)
        left = able.select("g", F.col("piece").alias("i"), F.explode(every).alias("j"), body.alias("a"), F.lit(None).alias("b"))
        right = able.select("g", F.explode(every).alias("i"), F.col("piece").alias("j"), F.lit(None).alias("a"), body.alias("b"))
        met = left.where("i <= j").unionByName(right.where("i <= j")).groupBy("g", "i", "j").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
        links.append(stage(met.select("a", "b").mapInArrow(lambda it: _lacking(it, percent), "u long, v long"), "lacking"))
        tokens = held.select("g", "node", "root", "p", "m", "x", F.explode("extra").alias("token"))
        lists = tokens.groupBy("g", "token").agg(F.count("*").alias("many"), F.min("root").alias("a"), F.max("root").alias("b"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).where("many > 1 and a < b")
        # Elements of just the same sets are one list.
        lists = stage(lists.groupBy("g", "who", "many").agg(F.min("token").alias("token")), "lists")
        short = tokens.join(lists.where(F.col("many") <= 2 * crowd).select("g", "token"), ["g", "token"]).groupBy("g", "token").agg(F.collect_list(F.struct("node", "root", "p", "m", "x")).alias("members"))
        pairs = short.select("members").mapInArrow(lambda it: _sharing(it, percent), "u long, v long").distinct().join(tried, ["u", "v"], "left_anti")
        links.append(confirmed(pairs))
        crowded = lists.where(F.col("many") > 2 * crowd).select("g", "token")
        family = tokens.join(crowded, ["g", "token"]).select("node", F.xxhash64("g", "token").alias("g"), "root")
        family = stage(family, "family")
        if not family.limit(1).count():
            break
    else:
        raise RuntimeError("groups of copies did not split")
    return reduce(DataFrame.unionByName, links)


def similar(docs: DataFrame, id_col: str, text_col: str = "text", width: int = 5, percent: int = 80, seeds: Sequence[int] = (42,), crowd: int = CROWD) -> DataFrame:
    """One row per row of ``docs``: (id, component), component a number that all texts share which links join.

    Texts link if their sets of shingles of ``width`` words overlap by ``percent`` or more; null and empty texts, which
    have no words, link with each other. Ids are not null, and rows of the same id have the same text. Equal texts and
    repeated rows are one node; a very long text is one set of as many hashes as it has shingles. An empty table gives no
    rows; columns besides id and text are not looked at. Buckets of over ``crowd`` sets are searched by differences.
    """
    factors = multipliers(seeds)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, "t"):
            nodes, sizes, keys = [], [], []
            for t in piece.column(1).to_pylist():
                hashes = shingle_set(t, width, seeds[0])
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes()) - 2**63)
                sizes.append(len(hashes))
                keys.append(bands(hashes, factors))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "node", "n", "keys"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, "t"):
            sets = [shingle_set(t, width, seeds[0]).tobytes() for t in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sets, pa.binary())], names=["node", "hashes"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                both, all_ = overlap(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64))
                keep.append(100 * both >= percent * all_)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    own = stage(texts.mapInArrow(sketch, "id long, node long, n int, keys array<long>"), "sketches")
    nodes = own.groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    keys = nodes.select("node", "n", "id", F.posexplode("keys").alias("k", "key"))
    sizes = keys.groupBy("k", "key").agg(F.count("*").alias("many"), F.min(F.struct("node", "n")).alias("low")).where("many > 1")
    shared = stage(keys.join(sizes, ["k", "key"]), "shared")

    wanted = shared.select("id", "node").distinct()
    sets = texts.join(wanted, "id").dropDuplicates(["node"]).select("node", "t").mapInArrow(sets_of, "node long, hashes binary")
    sets = stage(sets, "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"hashes_{x}")) for x in "uv")
        return stage(pairs.join(a, "u").join(b, "v").select("u", "v", "hashes_u", "hashes_v").mapInArrow(confirm, "u long, v long"), "links")

    def against(rows: DataFrame, to: str) -> DataFrame:
        """Each node with the node ``to`` of its bucket, if their sizes allow the overlap."""
        fits = F.least("n", f"{to}.n") * 100 >= F.greatest("n", f"{to}.n") * percent
        pairs = rows.where((F.col("node") != F.col(f"{to}.node")) & fits)
        return pairs.select(F.greatest("node", f"{to}.node").alias("u"), F.least("node", f"{to}.node").alias("v")).distinct()

    def place(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Components by ``links``, and the members of buckets that hold several of them."""
        roots = stage(connected_components(links), "roots")
        placed = shared.join(roots, "node", "left").select("k", "key", "many", "node", "n", F.coalesce("root", "node").alias("root"))
        open_ = placed.groupBy("k", "key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("k", "key")
        return roots, placed.join(open_, ["k", "key"])

    first = stage(against(shared, "low"), "first")
    near = confirmed(first)
    _, split = place(near)
    # The node with most links of each bucket that is still split joins what the smallest left.
    degree = near.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    split = stage(split.join(degree, "node", "left"), "split")
    hubs = split.groupBy("k", "key").agg(F.max(F.struct(F.coalesce("links", F.lit(0)).alias("links"), "node", "n", "root")).alias("hub"))
    second = against(split.join(hubs, ["k", "key"]).where("root <> hub.root"), "hub").join(first, ["u", "v"], "left_anti")
    second = stage(second, "second")
    near = stage(near.unionByName(confirmed(second)), "near")
    roots, split = place(near)
    split = stage(split, "split")
    tried = first.unionByName(second)
    listed = split.where(F.col("many") <= crowd).groupBy("k", "key").agg(F.collect_list(F.struct("node", "n", "root")).alias("members"))
    rest = listed.select("members").mapInArrow(lambda it: _across(it, percent), "u long, v long").distinct().join(tried, ["u", "v"], "left_anti")
    near = near.unionByName(confirmed(rest))
    crowds = split.where(F.col("many") > crowd)
    if crowds.limit(1).count():
        low = crowds.groupBy("k", "key").agg(F.min("node").alias("v"))
        family = connected_components(crowds.join(low, ["k", "key"]).select(F.col("node").alias("u"), "v").distinct())
        family = family.select("node", F.col("root").alias("g")).join(crowds.select("node", "root").distinct(), "node")
        near = near.unionByName(by_differences(family, sets, tried, confirmed, percent, crowd))
    roots = connected_components(near)
    out = own.join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("component"))
    out = stage(out, "components")
    for done in (shared, sets, first, second, split):
        discard(done)
    return out
