"""Dictionaries of many entries over texts: forms found by one automaton, and words like an entry by deleted letters."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from vellum.operators import spans

#: Forms of one automaton; more are looked for by several, one after the other.
FORMS = 200_000
#: Forms up to which texts are asked for a piece of each before they go to Python.
ASKED = 32
#: Entries of up to ``SHORT`` letters are like words (``CUTOFF``, two letters longer or shorter at most) that become equal to
#: them when two letters at most are left out of each; longer ones may differ in more.
SHORT, LEFT_OUT, CUTOFF, REACH = 12, 2, 0.85, 2
_LATIN, _SPACE, _WORD = regex.compile("[A-Za-z]"), regex.compile(r"\s+"), regex.compile(r"\w")
_built: dict[str, ahocorasick.Automaton] = {}


class _Letters(dict):
    """What each letter is without case, worked out when it is first met."""

    def __missing__(self, k: int) -> str:
        c = chr(k)
        u = up if len(up := c.upper()) == 1 else c
        self[k] = x if len(x := u.lower()) == 1 else u
        return self[k]


_letters = _Letters()


def fold(text: str) -> str:
    """Without case, letter by letter, so that places stay."""
    return text.lower() if text.isascii() else text.translate(_letters)


def _automaton(number: str, forms: list[tuple[int, str, bool]]) -> ahocorasick.Automaton:
    """One per worker process and dictionary: folded forms with the entries that have them."""
    if number not in _built:
        _built.clear()
        entries: dict[str, list] = {}
        for k, form, loose in forms:
            key = fold(form)
            entries.setdefault(_SPACE.sub(" ", key) if loose else key, []).append((k, form, loose))
        found = ahocorasick.Automaton()
        for key, of in entries.items():
            found.add_word(key, (len(key), of))
        found.make_automaton()
        _built[number] = found
    return _built[number]


def _drawn_together(text: str) -> tuple[str, list[int]]:
    """The text with each run of white space as one space, and where each of its letters began."""
    out, at, last = [], [], 0
    for m in _SPACE.finditer(text):
        out += [text[last : m.start()], " "]
        at += [*range(last, m.start()), m.start()]
        last = m.end()
    return "".join([*out, text[last:]]), [*at, *range(last, len(text)), len(text)]


def hits_in(text: str, found: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(entry, start, stop) for each form in a text, leftmost ones that don't overlap of each entry.

    A form with Latin letters counts in any case, and where words begin and end; others count as they are.
    """
    word = _WORD.match

    def edge(k: int) -> bool:
        return (k > 0 and bool(word(text[k - 1]))) != (k < len(text) and bool(word(text[k])))

    out = []
    tight = fold(text)
    # Most texts have no form, so where letters were before white space was drawn together is worked out at the first one.
    wide, at = _SPACE.sub(" ", tight), None
    for loose, body in ((False, tight), (True, wide)):
        for end, (n, entries) in found.iter(body):
            for k, form, is_loose in entries:
                if is_loose != loose:
                    continue
                start, stop = end + 1 - n, end + 1
                if loose and wide is not tight:
                    at = at or _drawn_together(tight)[1]
                    start, stop = at[start], at[stop - 1] + 1 if form[-1:] != " " else at[stop]
                latin = _LATIN.search(form)
                if (edge(start) and edge(stop)) if latin else text[start:stop] == form:
                    out.append((k, start, stop))
    out.sort()
    kept: list[tuple[int, int, int]] = []
    for k, start, stop in out:
        if not kept or kept[-1][0] != k or kept[-1][2] <= start:
            kept.append((k, start, stop))
    return kept


def may_have(c: Column, forms: list[tuple[int, str, bool]]) -> Column:
    """Whether a text can have one of the forms: the longest piece without white space of each is looked for.

    Without case, only long s and dotless i become letters of ASCII that lower case leaves alone.
    """
    if len(forms) > ASKED:
        return F.lit(True)
    out, low = F.lit(False), F.lower(c)
    for _, form, _ in forms:
        piece = max(_SPACE.split(form), key=len)
        if not _LATIN.search(form):
            out = out | F.contains(c, F.lit(piece))
        elif piece.isascii():
            out = out | F.contains(low, F.lit(piece.lower()))
        else:
            return F.lit(True)
    return out | F.contains(c, F.lit("ſ")) | F.contains(c, F.lit("ı")) if any(_LATIN.search(f) for _, f, _ in forms) else out


def find_forms(texts: DataFrame, forms: DataFrame, text_col: str = "content") -> DataFrame:
    """A row for each form found in ``texts``: its other columns, ``entry``, ``start``, ``stop`` (in characters) and ``hit``, the text there.

    forms: (entry: int, form: string, loose: boolean); in loose forms a space stands for any white space. All texts are read once for
    each ``FORMS`` forms. Forms with Latin letters match in any case as whole words, others as they are. Null and empty texts
    and forms have no hits.
    """
    others = [c for c in texts.columns if c != text_col]
    schema = StructType([*(texts.schema[c] for c in others), *(StructField(n, t) for n, t in (("entry", IntegerType()), ("start", IntegerType()), ("stop", IntegerType()), ("hit", StringType())))])
    all_forms = sorted((r.entry, r.form, bool(r.loose)) for r in forms.where("form <> ''").select("entry", "form", "loose").distinct().toLocalIterator())
    parts = []
    for a in range(0, max(len(all_forms), 1), FORMS):
        here = texts.sparkSession.sparkContext.broadcast(all_forms[a : a + FORMS])
        number = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], here=here, number=number) -> Iterator[pa.RecordBatch]:
            if not here.value:
                return
            found = _automaton(number, here.value)
            for batch in batches:
                rows, values = [], []
                for k, t in enumerate(batch.column(len(others)).to_pylist()):
                    if t:
                        for entry, start, stop in hits_in(t, found):
                            rows.append(k)
                            values.append((entry, start, stop, t[start:stop]))
                if rows:
                    columns = [batch.column(c).take(pa.array(rows)) for c in range(len(others))]
                    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, t) for v, t in zip(zip(*values), kinds))], names=[*others, "entry", "start", "stop", "hit"])

        asked = texts.where(may_have(F.col(text_col), all_forms[a : a + FORMS]))
        parts.append(asked.select(*others, text_col).mapInArrow(run, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def without_letters(word: str, most: int = LEFT_OUT) -> set[str]:
    """A word and what is left of it without ``most`` letters at most."""
    out, outer = {word}, {word}
    for _ in range(most):
        outer = {w[:k] + w[k + 1 :] for w in outer for k in range(len(w))}
        out |= outer
    return out


def candidates(words: DataFrame, entries: list[str]) -> DataFrame:
    """(word, entry): which of ``words`` (word) may be like which entry, by ``CUTOFF`` and ``REACH``; none that is like one is left out.

    Likeness is twice the letters that match over all letters. At least 0.425 of both words' letters must match, so 0.15 of
    them at most are left over: three for an entry of ``SHORT`` letters and a word of two more. What is left of a word without
    one or two letters is the key by which it meets its entry; keys that no entry has are never made into rows. Longer entries meet
    by the rarest of their pairs of letters.
    """
    spark = words.sparkSession
    short, long = [e for e in entries if len(e) <= SHORT], [e for e in entries if len(e) > SHORT]
    parts = []
    if short:
        keys = [(v, e) for e in short for v in sorted(without_letters(e))]
        size = 1 << max(16, (32 * len(keys)).bit_length())
        marked = np.zeros(size >> 3, np.uint8)
        spots = np.fromiter((zlib.crc32(v.encode()) % size for v, _ in keys), np.int64, len(keys))
        np.bitwise_or.at(marked, spots >> 3, (1 << (spots & 7)).astype(np.uint8))
        here = spark.sparkContext.broadcast(marked)
        least, most = max(0, min(map(len, short)) - REACH), max(map(len, short)) + REACH

        def known(ws: pd.Series) -> pd.Series:
            bits = here.value
            return pd.Series([[v for v in without_letters(w) if bits[(at := zlib.crc32(v.encode()) % size) >> 3] >> (at & 7) & 1] for w in ws])

        run = F.pandas_udf(known, "array<string>")
        asked = words.where(F.length("word").between(least, most)).select("word", F.explode(run("word")).alias("v"))
        parts.append(asked.join(spark.createDataFrame(keys, "v string, entry string"), "v").where(F.abs(F.length("word") - F.length("entry")) <= REACH).select("word", "entry").distinct())
    if long:
        same = [F.lit(0).alias("doc_id"), F.lit(0).cast("long").alias("d")]
        asked = spark.createDataFrame([(e,) for e in long], "t string").select(*same, F.col("t").alias("k"), "t", F.lit(CUTOFF).alias("need"), F.lit(None).cast("string").alias("first"))
        held = words.where(F.length("word") >= min(map(len, long)) - REACH).select(*same, F.col("word").alias("k"), F.col("word").alias("t"))
        met = spans.alike(asked, held, 2, CUTOFF).select(F.col("s").alias("word"), F.col("r").alias("entry"))
        parts.append(met.where(F.abs(F.length("word") - F.length("entry")) <= REACH))
    out = parts[0] if parts else words.select("word", F.col("word").alias("entry")).where("false")
    return out.unionByName(parts[1]) if len(parts) > 1 else out
