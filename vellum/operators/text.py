"""Chunks, embeddings, nearest neighbours, facts, comments and model answers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from vellum.batches import text_slices
from vellum.functions import patterns as P
from vellum.functions.predicates import strip
from vellum.operators import vectors
from vellum.storage import stage

WIDTH = 768
# Marks at which a long paragraph may be cut, with their bonus.
CUTS = ((".!?。！？", 10000), (";:；：", 4000), (",，、", 1000))


def _last(text: str, start: int, stop: int, marks: str | None) -> int:
    """The place after the last of ``marks`` (None: white space) in a range, or -1."""
    if marks is None:
        return next((k + 1 for k in range(stop - 1, start - 1, -1) if text[k].isspace()), -1)
    return max((text.rfind(m, start, stop) for m in marks), default=-1) + 1 or -1


def split_paragraph(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of a long paragraph, each cut where reach and kind of mark together are best."""
    out, at, least = [], 0, min(2000, size // 5)
    while at < len(text):
        target = min(at + size, len(text))
        if target == len(text):
            out.append((at, target))
            break
        low = min(at + least, target)
        high = min(len(text), target + 100)
        kinds = [*CUTS, (None, 0)]
        # Of equal scores the kind that is named first wins.
        found = [(cut - at + bonus, -k, cut) for k, (marks, bonus) in enumerate(kinds) if (cut := _last(text, low, high, marks)) > 0]
        if found:
            cut = max(found)[2]
        else:
            cut = next((c for marks in (*(m for m, _ in CUTS), " \t\n") if (c := _last(text, at, low, marks)) > 0), target)
        cut = cut if cut > at else target
        out.append((at, cut))
        if cut >= len(text):
            break
        at = cut - overlap if cut - overlap > at else cut
    return out


def chunk_ranges(text: str, size: int = 5000, overlap: int = 500) -> list[tuple[int, int]]:
    """Ranges of chunks: whole paragraphs up to ``size`` characters, the last ones up to ``overlap`` said again."""
    if not text:
        return []
    lines = text.split("\n")
    begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])]).tolist()
    out, at = [], 0
    while at < len(lines):
        if begin[at + 1] - begin[at] > size:
            out += [(begin[at] + a, begin[at] + b) for a, b in split_paragraph(lines[at], size, overlap)]
            at += 1
            continue
        end = at
        while end < len(lines) and begin[end + 1] - begin[at] <= size:
            end += 1
        out.append((begin[at], begin[end] - 1))
        if end == len(lines):
            break
        back = end
        while back > at and begin[end] - begin[back - 1] <= overlap:
            back -= 1
        at = back + (back == at)
    return out


def chunks(docs: DataFrame, size: int = 5000, overlap: int = 500, text_col: str = "text") -> DataFrame:
    """(doc_id, chunk, start, stop, text): places are in characters."""

    def cut(text: str) -> Iterator[tuple]:
        for n, (a, b) in enumerate(chunk_ranges(text, size, overlap)):
            yield n, a, b, text[a:b]

    return rows_of(docs, text_col, cut, {"chunk": LongType(), "start": LongType(), "stop": LongType(), "text": StringType()})


def rows_of(docs: DataFrame, text_col: str, make: Callable[[str], Iterator[tuple]], columns: dict[str, LongType | StringType]) -> DataFrame:
    """(doc_id, *columns): the rows that ``make`` makes of each text (null: empty), a few MB of texts at a time."""
    schema = StructType([docs.schema["doc_id"], *(StructField(n, t) for n, t in columns.items())])
    kinds = [pa.int64() if isinstance(t, LongType) else pa.string() for t in columns.values()]
    own = docs.select("doc_id", F.col(text_col).cast("string").alias("t"))
    return own.mapInArrow(lambda batches: made(batches, make, list(columns), kinds), schema)


def made(batches: Iterator[pa.RecordBatch], make: Callable[[str], Iterator[tuple]], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """What ``make`` makes of the texts of batches (doc_id, t), a batch for each slice of them."""
    for piece in text_slices(batches, "t"):
        whose, rows = [], []
        for k, t in enumerate(piece.column(1)):
            for row in make(t.as_py() or ""):
                whose.append(k)
                rows.append(row)
        values = zip(*rows) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(whose, pa.int64())), *(pa.array(v, t) for v, t in zip(values, kinds))], names=["doc_id", *names])


def hash_vector(text: str) -> list[float]:
    """Signed counts of hashed words, of length one."""
    return hash_array(text).tolist()


def hash_array(text: str) -> np.ndarray:
    """``hash_vector`` as an array, which takes an eighth of the memory."""
    out = np.zeros(WIDTH, np.float32)
    for token in re.findall("[一-鿿]+|[a-zA-Z0-9_]+", text.lower()):
        h = hashlib.blake2b(token.encode(), digest_size=8).digest()
        out[int.from_bytes(h[:4], "little") % WIDTH] += 1.0 if h[4] % 2 == 0 else -1.0
    norm = float(np.linalg.norm(out))
    return out / np.float32(norm) if norm else out


def embed(docs: DataFrame, text_col: str = "text", out_col: str = "embedding", model: Callable[[str], list[float] | np.ndarray] = hash_array) -> DataFrame:
    """Adds an embedding; answers of a model that haven't the right width are replaced by the hashed vector."""
    return docs.withColumn(out_col, F.pandas_udf(lambda texts: embedded(texts, model), "array<float>")(F.col(text_col)))


def embedded(texts: pd.Series, model: Callable[[str], list[float] | np.ndarray] = hash_array) -> pd.Series:
    """An embedding of each text, none of which is held as a list of numbers."""
    vectors = (model(t or "") for t in texts)
    return pd.Series([np.asarray(v, np.float32) if len(v) == WIDTH else hash_array(t or "") for v, t in zip(vectors, texts)], dtype=object)


def pad(embedding: Column, width: int = WIDTH) -> Column:
    return F.concat(embedding, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(width) - F.size(embedding), F.lit(0))))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.lit(1.0) - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(rows: DataFrame, query: list[float], k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows (1 to 20) nearest by cosine distance, ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    d = F.round(cosine_distance(F.col(vector_col), q), 6)
    return rows.where(F.col(vector_col).isNotNull()).withColumn("distance", d).orderBy("distance", id_col).limit(max(1, min(int(k), 20)))


def facts(text: Column, most: int = 12, reach: int = 12000) -> Column:
    """The first sentences of a text, cut to 30 characters, a line each."""
    parts = F.transform(F.split(F.substring(strip(text), 1, reach), "[。！？\n]+"), strip)
    # White space is drawn together only in the sentences that are kept.
    kept = F.slice(F.filter(parts, lambda p: p != ""), 1, most)
    return F.array_join(F.transform(kept, lambda p: F.concat(F.lit("- "), F.substring(F.regexp_replace(p, f"{P.S}+", " "), 1, 30))), "\n")


def mock_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """What the stand-in for a language model finds: (doc_id, issue_type, severity, evidence)."""
    t = F.col(text_col)
    term = F.when(t.contains("LLM") & ~t.contains("Large Language Model"), F.struct(F.lit("Terminology_Inconsistency").alias("issue_type"), F.lit("Info").alias("severity"), F.lit("LLM").alias("evidence")))
    short = F.when(t.contains("e.g."), F.struct(F.lit("Abbreviation_Definition").alias("issue_type"), F.lit("Info").alias("severity"), F.lit("e.g.").alias("evidence")))
    return docs.select("doc_id", F.explode(F.filter(F.array(term, short), lambda x: x.isNotNull())).alias("x")).select("doc_id", "x.*")


# What the stand-in says.
MOCK_SAYS = {
    "Terminology_Inconsistency": "术语 'LLM' 建议在首次出现时使用全称 'Large Language Model (LLM)'",
    "Abbreviation_Definition": "建议使用 '例如' 或 'for example' 代替拉丁缩写",
}


def mock_answer(text: Column) -> Column:
    """The stand-in's whole answer, as JSON."""

    def said(kind: str, evidence: str) -> Column:
        return F.struct(F.lit(kind).alias("issue_type"), F.lit("Info").alias("severity"), F.lit(evidence).alias("evidence"), F.lit(MOCK_SAYS[kind]).alias("message"))

    term = F.when(text.contains("LLM") & ~text.contains("Large Language Model"), said("Terminology_Inconsistency", "LLM"))
    short = F.when(text.contains("e.g."), said("Abbreviation_Definition", "e.g."))
    return F.to_json(F.struct(F.filter(F.array(term, short), lambda x: x.isNotNull()).alias("issues"), F.lit("Mock LLM scan completed.").alias("summary")))


ANSWER = "array<struct<issue_type: string, severity: string, evidence: string, message: string, suggestion: string, location: string, page_num: string>>"


def _answer(answer_col: str) -> tuple[Column, Column]:
    """Issues and summary of an answer: fences are taken off, an object or a list is read, else the widest braces in it."""
    body = F.trim(F.regexp_replace(F.trim(F.col(answer_col)), r"^```(?:json)?|```$", ""))
    inner = F.regexp_extract(F.col(answer_col), r"(?s)\{.*\}", 0)
    listed = F.when(F.substring(body, 1, 1) == "[", F.from_json(body, ANSWER))
    whole = lambda x: F.from_json(x, f"struct<issues: {ANSWER}, summary: string>")
    return F.coalesce(whole(body).issues, listed, whole(inner).issues), F.coalesce(whole(body).summary, F.when(listed.isNull(), whole(inner).summary), F.lit(""))


def model_issues(answers: DataFrame, answer_col: str = "answer", keep: list[str] | None = None) -> DataFrame:
    """Issues in a model's answers: (doc_id, pos, issue_type, severity, evidence, message, page, source).

    Types outside ``MODEL_TYPES`` are dropped. A missing citation whose evidence is nothing but a numbered citation, or
    whose message speaks of a citation on a line of its own, is a remark on layout, and the message says so. ``keep``
    names other columns that go on.
    """
    keep = keep or []
    found, _ = _answer(answer_col)
    rows = answers.select("doc_id", *keep, F.posexplode(found).alias("pos", "x")).select("doc_id", *keep, "pos", "x.*").where(F.col("issue_type").isin(*P.MODEL_TYPES))
    message = F.coalesce("message", F.lit(""))
    lone = F.regexp_like(message, F.lit("|".join(P.LONE_WORDS))) & F.regexp_like(message, F.lit(r"\[[0-9]+(?:,\s*[0-9]+)*\]"))
    plain = F.regexp_like(strip(F.coalesce("evidence", F.lit(""))), F.lit(r"^\[[0-9,\s-]+\]$"))
    layout = (F.col("issue_type") == "Citation_Placeholder") & (plain | lone)
    return rows.select(
        "doc_id", *keep, F.col("pos").cast("long").alias("pos"), F.when(layout, "Citation_Layout_Check").otherwise(F.col("issue_type")).alias("issue_type"),
        F.when(layout, "Info").otherwise(F.col("severity")).alias("severity"), "evidence",
        F.when(layout, F.concat(message, F.lit(P.LONE_CITATION))).otherwise(F.col("message")).alias("message"), F.col("page_num").alias("page"), F.lit("LLM").alias("source"),
    )


def model_summary(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """(doc_id, feedback): the summaries of a document's answers, or the answers as they are where there is none, by place."""
    _, summary = _answer(answer_col)
    at = F.col("chunk") if "chunk" in answers.columns else F.lit(0)
    said = F.struct(at.alias("at"), F.when(summary != "", summary).otherwise(F.col(answer_col)).alias("said"))
    return answers.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x.said), "\n").alias("feedback"))


def comments(issues: DataFrame, tips: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, comment, suggestion): a document's issue counts in words, and its first expert tip (doc_id, tip) if there is one.

    For the documents with issues, or for all ``docs`` (doc_id), which may have none.
    """
    by_type = issues.groupBy("doc_id", "issue_type").agg(F.count("*").alias("n"))
    lines = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "issue_type")))
    rows = by_type.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x.issue_type, F.lit(": "), (-x.m).cast("string"))), "\n").alias("summary"))
    rows = rows if docs is None else docs.select("doc_id").join(rows, "doc_id", "left")
    rows = rows.withColumn("tip", F.lit(None).cast("string")) if tips is None else rows.join(tips, "doc_id", "left")
    comment = F.coalesce(F.concat(F.lit("发现以下问题：\n"), "summary"), F.lit("已完成格式审计。"))
    suggestion = F.concat(F.lit("请优先修复 Critical/Warning，再统一排版细节。"), F.coalesce(F.concat(F.lit("\n参考建议："), F.col("tip")), F.lit("")))
    return rows.select("doc_id", comment.alias("comment"), suggestion.alias("suggestion"))


def expert_tips(docs: DataFrame, experts: DataFrame, k: int = 5, require_text: bool = True, require_metric: bool = False, require_active: bool = True) -> DataFrame:
    """(doc_id, tips): for each document (doc_id, embedding) the texts of the ``k`` (1 to 20) nearest of the expert rows (comment_id, text, active, embedding[, metric_id]), nearest first.

    Rows without an embedding aren't looked at, nor, where asked for, those without text or metric or not active (null
    counts as active). Texts without a direction have no tips. A block of experts is broadcast; more are searched by blocks.
    """
    k = max(1, min(20, k))
    used = experts.where("embedding is not null")
    if require_text:
        used = used.where("trim(text) <> ''")
    if require_metric:
        used = used.where("trim(metric_id) <> ''")
    if require_active:
        used = used.where("coalesce(active, true)")
    near = vectors.against(docs.select(F.col("doc_id").alias("query_id"), "embedding"), used, k, WIDTH, "comment_id")
    tips = near.join(used.select(F.col("comment_id").alias("vec_id"), F.col("text").alias("tip")), "vec_id")
    best = tips.groupBy(F.col("query_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "tip"))).alias("xs"))
    return best.select("doc_id", F.transform("xs", lambda x: x.tip).alias("tips"))


def commentary(docs: DataFrame, issues: DataFrame, experts: DataFrame, rules: dict[str, Any] | None = None, text_col: str = "text") -> DataFrame:
    """(doc_id, comment, suggestion): a text's facts find expert rows, and these and the issues make up a commentary.

    ``rag_eval`` of the rules turns it off and sets how many expert rows are looked up. A document without facts has no
    commentary.
    """
    r = (rules or {}).get("rag_eval", {})
    none = docs.select("doc_id", F.lit("").alias("comment"), F.lit("").alias("suggestion")).where("false")
    if not r.get("enabled", True):
        return none
    # Facts are asked for three times; they are worked out once, before they are compared.
    said = stage(docs.select("doc_id", facts(F.col(text_col)).alias("facts")), "facts").where("facts <> ''")
    tips = expert_tips(embed(said, "facts").select("doc_id", "embedding"), experts, int(r.get("top_k") or 5), r.get("require_text", True), r.get("require_metric_id", False), r.get("require_active", True))
    return comments(issues, tips.select("doc_id", F.col("tips")[0].alias("tip")), said)


def numbered_remarks(text: str, most: int = 4) -> list[str]:
    """The first ``most`` numbered items of a review, from the heading that announces its remarks on, or from the start.

    An item goes on with the lines after it, up to a blank line, a heading, a table or the next item; of these lines those
    of over 200 characters are left out. A heading or a table after an item ends the list.
    """
    lines = [x.strip() for x in text.splitlines()]
    items = [re.match(P.REMARK_ITEM, x) for x in lines]
    # A letter for each line: heading, blank, numbered, text.
    kinds = "".join("h" if x.startswith("#") or x.lower().startswith("<table") else "b" if not x else "n" if m else "t" for x, m in zip(lines, items))
    heads = (next((k + 1 for k, x in enumerate(lines) if x.startswith("#") and any(all(w in x for w in words) for words in ways)), 0) for ways in P.REMARK_HEADINGS)
    start = next(filter(None, heads), 0)
    first = kinds.find("n", start)
    end = kinds.find("h", max(first, 0))
    runs = re.finditer("nt*", kinds[: end if end >= 0 else len(kinds)][start:]) if first >= 0 else ()
    out = []
    for run in runs:
        a, b = start + run.start(), start + run.end()
        out.append(" ".join([items[a][2].strip(), *(x for x in lines[a + 1 : b] if len(x) <= 200)]))
    return out[:most]


def numbered_rows(reviews: DataFrame, text_col: str = "text", most: int = 4) -> DataFrame:
    return rows_of(reviews, text_col, lambda t: enumerate(numbered_remarks(t, most)), {"pos": LongType(), "text": StringType()})
