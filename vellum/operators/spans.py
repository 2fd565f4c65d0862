"""The span of a document that is most like a remark, without holding every remark against every span.

In a document of up to ``FEW`` remarks and spans, all pairs are told by what costs little, and only those of like length go on. In
a crowded one, a remark inside a span, or a span inside a remark, has the rarest of its strings of three letters there: these meet by an
equi-join. Others must be alike: of two texts of T letters in all, which match in M letters in blocks, the blocks are parted by
letters without a match, so they are T - 2M + 1 at most, and the texts have M - (q - 1)(T - 2M + 1) strings of q letters in
common. If x and y have n elements in common or more, any fixed order of elements lets the first |x| - n + m of x and the first
|y| - n + m of y share m of them: only such prefixes meet, and pairs that share fewer are let go. The order is from rare to
frequent in the document, by counts in a fixed number of buckets, which decide how many texts meet and never which are found.

A remark that has found a span asks only for better ones. So longer strings come first, for the likenesses that they can tell,
and single letters last, for the remarks that found nothing as good.
"""

from __future__ import annotations

import difflib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.predicates import match_text
from vellum.storage import stage

LEAST, SURE = 0.6, 0.98
#: Letters of a string, and the likeness from which on strings of that length are looked for.
LEVELS = ((3, 0.9), (2, 0.8))
#: Elements of their prefixes that two texts must share, if they must share as many.
SHARED = 4
#: Buckets in which elements of texts are counted (eight bytes each).
BUCKETS = 1 << 18
ROUND = 1e-6
#: Remarks and spans up to which all pairs of a document are held against each other by their lengths and by containment.
FEW = 512
#: Letters of texts whose pairs of letters a batch holds at once.
HELD = 200_000


def elements(text: str, q: int, numbered: bool = True) -> list[str]:
    """A text's strings of ``q`` letters; those that come again are told apart by a number, or left out."""
    parts = [text[k : k + q] for k in range(len(text) - q + 1)]
    seen: dict[str, int] = {}
    out = []
    for p in parts:
        k = seen.get(p, 0)
        seen[p] = k + 1
        if not k or numbered:
            out.append(f"{p}\0{k}" if k else p)
    return out


def in_common(n: int, need: float, q: int) -> int:
    """How many elements a text of ``n`` letters has in common with any that is like it to ``need``."""
    # The shorter of the two has at least need / (2 - need) as many letters.
    total = 2 * n / (2 - need)
    return math.ceil(total * ((2 * q - 1) * need / 2 - (q - 1)) - (q - 1) - 1e-9)


def _bucket(doc: int, element: str) -> int:
    return zlib.crc32(element.encode(), doc & 0xFFFFFFFF) % BUCKETS


def counts(texts: DataFrame, q: int, numbered: bool = True) -> np.ndarray:
    """How often elements of ``texts`` (d: a hash of the document, t) fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                np.add.at(total, [_bucket(d, e) for e in elements(t, q, numbered)], 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in texts.select("d", "t").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def _prefixes(texts: DataFrame, seen: np.ndarray, q: int, numbered: bool = True) -> DataFrame:
    """(doc_id, k, n, e, *others): the ``most`` rarest elements of each text (doc_id, d, k, t, most, *others)."""
    here = texts.sparkSession.sparkContext.broadcast(seen)

    def rarest(ds: pd.Series, ts: pd.Series, mosts: pd.Series) -> pd.Series:
        known, out = here.value, []
        for d, t, most in zip(ds, ts, mosts):
            out.append(sorted(elements(t, q, numbered), key=lambda e: (known[_bucket(d, e)], e))[: int(most)])
        return pd.Series(out)

    run = F.pandas_udf(rarest, "array<string>")
    others = [c for c in texts.columns if c not in ("d", "t", "most")]
    return texts.select(*others, F.length("t").alias("n"), F.explode(run("d", "t", "most")).alias("e"))


def _inside(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(doc_id, inner, outer): which of ``inner`` (doc_id, d, k, t) may be parts of which of ``outer``, by the rarest string of each."""
    found = None
    for q, which in ((3, F.length("t") >= 3), (2, F.length("t") == 2), (1, F.length("t") == 1)):
        some = inner.where(which)
        if q < 3 and not some.limit(1).count():
            continue
        seen = counts(outer, q, False)
        anchors = _prefixes(some.withColumn("most", F.lit(1)), seen, q, False).select("doc_id", F.col("k").alias("inner"), "e")
        # Of the longer texts only those strings go on that may be an anchor.
        wanted = counts(some.join(anchors.select("doc_id", F.col("inner").alias("k"), "e"), ["doc_id", "k"]).select("d", F.col("e").alias("t")), q, False) > 0
        held = _filtered(outer, wanted, q)
        met = anchors.join(held, ["doc_id", "e"]).select("doc_id", "inner", "outer")
        found = met if found is None else found.unionByName(met)
    return found


def _filtered(outer: DataFrame, wanted: np.ndarray, q: int) -> DataFrame:
    here = outer.sparkSession.sparkContext.broadcast(wanted)

    def run(ds: pd.Series, ts: pd.Series) -> pd.Series:
        ok = here.value
        return pd.Series([[e for e in elements(t, q, False) if ok[_bucket(d, e)]] for d, t in zip(ds, ts)])

    return outer.select("doc_id", F.col("k").alias("outer"), F.explode(F.pandas_udf(run, "array<string>")("d", "t")).alias("e"))


def alike(asked: DataFrame, held: DataFrame, q: int, floor: float) -> DataFrame:
    """(doc_id, r, s): pairs of ``asked`` (doc_id, d, k, t, need, first) and ``held`` (doc_id, d, k, t) that can be as alike as is needed."""
    seen = counts(held, q)

    def most(need: Column) -> Column:
        run = F.pandas_udf(lambda ns, needs: pd.Series([max(0, min(n - q + 1, n - q + 1 - max(1, in_common(n, x, q)) + SHARED)) for n, x in zip(ns, needs)], dtype="int64"), "long")
        return run(F.length("t"), need)

    shared = F.pandas_udf(lambda ns, needs: pd.Series([min(SHARED, max(1, in_common(n, x, q))) for n, x in zip(ns, needs)], dtype="int64"), "long")
    asked = asked.withColumn("most", most(F.col("need"))).withColumn("shared", shared(F.length("t"), F.col("need")))
    a = _prefixes(asked, seen, q).select("doc_id", F.col("k").alias("r"), "e", F.col("n").alias("na"), "need", "first", "shared")
    b = _prefixes(held.withColumn("most", most(F.lit(floor))), seen, q).select("doc_id", F.col("k").alias("s"), "e", F.col("n").alias("nb"))
    close = 2 * F.least("na", "nb") >= F.col("need") * (F.col("na") + F.col("nb"))
    met = a.join(b, ["doc_id", "e"]).where(close & (F.col("first").isNull() | (F.col("s") < F.col("first"))))
    return met.groupBy("doc_id", "r", "s").agg(F.count("*").alias("n"), F.first("shared").alias("shared")).where("n >= shared").select("doc_id", "r", "s")


def longest_common(a: str, b: str) -> int:
    """Letters of a longest common subsequence, a bit for each letter of ``a``."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    every = (1 << len(a)) - 1
    open_ = every
    for c in b:
        hit = open_ & at.get(c, 0)
        open_ = (open_ + hit | open_ - hit) & every
    return len(a) - open_.bit_count()


class _Pairs:
    """Pairs of letters of texts that come again and again, of about ``HELD`` letters at a time."""

    def __init__(self) -> None:
        self.known: dict[str, set[str]] = {}
        self.letters = 0

    def of(self, text: str) -> set[str]:
        if text not in self.known:
            if self.letters + len(text) > HELD:
                self.known.clear()
                self.letters = 0
            self.known[text] = set(elements(text, 2))
            self.letters += len(text)
        return self.known[text]

    def enough(self, a: str, b: str, need: float) -> bool:
        """Whether two texts have as many pairs in common as texts that are like each other to ``need``."""
        least = max(in_common(len(a), need, 2), in_common(len(b), need, 2))
        return least <= 0 or len(self.of(a) & self.of(b)) >= least


def ratio(a: pd.Series, b: pd.Series, need: pd.Series) -> pd.Series:
    """How alike two texts are, or null where they can't be as alike as is needed."""
    out, pairs = [], _Pairs()
    for x, y, n in zip(a, b, need):
        # Blocks that match are a common subsequence.
        if x is None or n > 1 or not pairs.enough(x, y, n - ROUND) or 2 * longest_common(x, y) < (n - ROUND) * (len(x) + len(y)):
            out.append(None)
        else:
            out.append(difflib.SequenceMatcher(None, x, y).ratio())
    return pd.Series(out, dtype="float64")


def _known() -> Column:
    """How alike texts a and b are if one of them holds the other, else null."""
    a, b = F.col("a"), F.col("b")
    some = F.length(b) >= F.greatest(F.lit(6), F.floor(F.length(a) / 5))
    return F.when(F.contains(b, a), F.lit(1.0)).when(F.contains(a, b), F.when(some, F.least(F.lit(0.95), F.length(b) / F.length(a))).otherwise(F.lit(0.0)))


def _rated(rows: DataFrame) -> DataFrame:
    """(doc_id, r, s, ratio, n): pairs (doc_id, r, s, a, b, need) as alike as the remark needs."""
    rows = rows.withColumn("known", _known())
    like = F.pandas_udf(ratio, "double")(F.when(F.col("known").isNull(), F.col("a")), F.col("b"), F.col("need"))
    return rows.withColumn("ratio", F.round(F.coalesce("known", like), 6)).select("doc_id", "r", "s", "ratio", F.length("b").alias("n"))


def _scored(pairs: DataFrame, said: DataFrame, held: DataFrame) -> DataFrame:
    """``_rated`` of pairs (doc_id, r, s)."""
    rows = pairs.join(said.select("doc_id", F.col("k").alias("r"), F.col("t").alias("a"), "need"), ["doc_id", "r"])
    return _rated(rows.join(held.select("doc_id", F.col("k").alias("s"), F.col("t").alias("b")), ["doc_id", "s"]))


def _all_pairs(said: DataFrame, held: DataFrame, *more: str) -> DataFrame:
    """(doc_id, r, a, *more, s, b): all pairs of a document, of which the join lets those go on that are asked for after it."""
    return said.select("doc_id", F.col("k").alias("r"), F.col("t").alias("a"), *more).join(held.select("doc_id", F.col("k").alias("s"), F.col("t").alias("b")), "doc_id")


def _best(pairs: DataFrame) -> DataFrame:
    """(doc_id, k, ratio, s, first): the best span of each remark, and the first that is sure."""
    sure = F.when(F.col("ratio") >= SURE, -F.col("s"))
    best = pairs.groupBy("doc_id", F.col("r").alias("k")).agg(F.max(F.struct(sure.isNotNull().alias("sure"), sure.alias("first"), "ratio", "n", (-F.col("s")).alias("s"))).alias("x"))
    return best.select("doc_id", "k", F.col("x.ratio").alias("ratio"), (-F.col("x.s")).alias("s"), (-F.col("x.first")).alias("first"))


def _levels(said: DataFrame, held: DataFrame, pairs: DataFrame, least: float, few: bool) -> DataFrame:
    """(doc_id, k, ratio, s, first): the best span of each remark, from those that hold one another (``pairs``) on."""
    open_ = said
    for q, floor in (*LEVELS, (1, least)):
        need = F.when(F.col("first").isNotNull(), F.lit(SURE)).otherwise(F.greatest(F.lit(floor), F.coalesce("ratio", F.lit(0.0)) - ROUND))
        asked = open_.join(_best(pairs).select("doc_id", "k", "ratio", "first"), ["doc_id", "k"], "left").withColumn("need", need)
        # Too short a text may be like another without any string of q letters in common, and is left to shorter ones.
        common = 2 * F.length("t") / (2 - F.col("need")) * ((2 * q - 1) * F.col("need") / 2 - (q - 1)) - (q - 1)
        fits = F.lit(True) if few else common > 1e-6
        asked = stage(asked.select("doc_id", "d", "k", "t", "need", "first", fits.alias("fits")), "asked")
        fit = asked.where("fits")
        if few:
            close = 2 * F.least(F.length("a"), F.length("b")) >= (F.col("need") - ROUND) * (F.length("a") + F.length("b"))
            found = _rated(_all_pairs(fit, held, "need", "first").where(close & (F.col("first").isNull() | (F.col("s") < F.col("first")))))
        else:
            some = held.join(fit.select("doc_id").distinct(), "doc_id", "left_semi")
            found = _scored(alike(fit, some, q, floor), fit, held)
        pairs = stage(pairs.unionByName(found.where(F.col("ratio") >= least)), "pairs")
        settled = _best(pairs).where(F.col("ratio") >= floor).select("doc_id", "k")
        open_ = asked.where("not fits").unionByName(fit.join(settled, ["doc_id", "k"], "left_anti")).select("doc_id", "d", "k", "t")
    return _best(pairs)


def match_spans(remarks: DataFrame, spans: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, pos, span_id, ratio): the span (doc_id, span_id, content) of the same document that is most like each remark (doc_id, pos, text).

    1 if the span holds the remark; their lengths' ratio (0.95 at most) if the remark holds the span, and 0 if that has under 6
    letters or a fifth of the remark's; else how alike their letters are. The first span of ``SURE`` or more wins, else the
    best, the longest, the first; below ``least`` (from 0.1 to 0.8) none does. White space, marks and case don't count. Remarks and spans without
    letters, null ones included, find nothing and aren't found. Equal texts of a document are looked up once.
    """
    if not 0.1 <= least <= LEVELS[-1][1]:
        raise ValueError(f"least must be from 0.1 to {LEVELS[-1][1]}")
    own = remarks.select("doc_id", "pos", match_text(F.col("text")).alias("t")).where("t <> ''")
    own = stage(own, "own")
    said = own.groupBy("doc_id", "t").agg(F.min("pos").alias("k"))
    said = stage(said.withColumn("d", F.xxhash64("doc_id")), "said")
    held = spans.select("doc_id", "span_id", match_text(F.col("content")).alias("t")).where("t <> ''").groupBy("doc_id", "t").agg(F.min("span_id").alias("k"))
    # Spans of documents without remarks are never looked at.
    held = stage(held.join(said.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("d", F.xxhash64("doc_id")), "held")
    crowded = said.select("doc_id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(held.select("doc_id", F.lit(0).alias("a"), F.lit(1).alias("b")))
    crowded = stage(crowded.groupBy("doc_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(f"a > {FEW} or b > {FEW}").select("doc_id"), "crowded")
    few, among = said.join(crowded, "doc_id", "left_anti"), held.join(crowded, "doc_id", "left_anti")
    known = F.round(_known(), 6)
    inside = _all_pairs(few, among).where(known >= least).select("doc_id", "r", "s", known.alias("ratio"), F.length("b").alias("n"))
    best = _levels(few, among, stage(inside, "inside"), least, True)
    if crowded.limit(1).count():
        many, among = stage(said.join(crowded, "doc_id", "left_semi"), "many"), stage(held.join(crowded, "doc_id", "left_semi"), "among")
        around = _inside(many, among).select("doc_id", F.col("inner").alias("r"), F.col("outer").alias("s"))
        within = _inside(among.where("length(t) >= 6"), many).select("doc_id", F.col("outer").alias("r"), F.col("inner").alias("s"))
        pairs = stage(_scored(around.unionByName(within).distinct(), many.withColumn("need", F.lit(2.0)), among).where(F.col("ratio") >= least), "inside")
        best = best.unionByName(_levels(many, among, pairs, least, False))
    best = best.join(said.select("doc_id", "k", "t"), ["doc_id", "k"])
    return own.join(best, ["doc_id", "t"]).select("doc_id", "pos", F.col("s").alias("span_id"), "ratio")
