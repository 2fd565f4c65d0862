"""Corpus operators as stages: each takes the documents that the stage before kept, and decides what goes on.

In all of them null and repeated ids, columns of any other name (which go on as they are), very long texts and empty
tables (which stay empty) pass: rows are told apart by a key of their id, text, language and source.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vellum.llm import mixing, overlap, quality_rules, secret_scan, simhash
from vellum.llm.bpe import encode_decode
from vellum.llm.common import stage
from vellum.llm.components import connected_components

KEY = "_vellum_key"
#: Near-duplicates have fingerprints of five-word shingles that differ in ``RADIUS`` of 64 bits at most, or share ``PERCENT``
#: or more of these shingles. The first seed is that of the shingle hashes, all together that of the MinHash values.
WIDTH, SEEDS, RADIUS, PERCENT = 5, (42, 1, 2, 3), 4, 80
MARK = "[SECRET]"


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64("doc_id", "text", "lang", "source"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: rows of null and empty texts go, equal rows stay or go together."""
    rows = keyed(docs)
    good = quality_rules.judge(rows, id_col=KEY).where("kept").select(F.col("id").alias(KEY)).distinct()
    return rows.join(good, KEY, "left_semi").select(*docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id; rows without an id come after all others.

    Texts link if their SimHash fingerprints differ in ``RADIUS`` bits at most, or if their shingles overlap, which also
    finds those that are farther apart. Of equal rows one stays; null and empty texts are one group, and so are texts of
    fewer words than a shingle that have the same words.
    """
    rows = keyed(docs)
    near = simhash.near_duplicates(rows, id_col=KEY, width=WIDTH, radius=RADIUS, seeds=SEEDS[:1]).select(F.col("id").alias(KEY), F.col("component").alias("near"))
    alike = overlap.similar(rows, KEY, width=WIDTH, percent=PERCENT, seeds=SEEDS).select(F.col("id").alias(KEY), "component")
    groups = stage(alike.distinct().join(near.distinct(), KEY), "groups")
    # Groups by overlap that a fingerprint joins become one.
    met = groups.select("near", "component").distinct()
    low = met.groupBy("near").agg(F.min("component").alias("v"), F.count("*").alias("n")).where("n > 1").select("near", "v")
    roots = stage(connected_components(met.join(low, "near").select(F.col("component").alias("u"), "v")), "joined")
    groups = groups.join(roots.withColumnRenamed("node", "component"), "component", "left").select(KEY, F.coalesce("root", "component").alias("component"))
    ids = rows.select(KEY, "doc_id").distinct()
    best = groups.join(ids, KEY).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", KEY)).alias("best"))
    best = stage(best.select(F.col(f"best.{KEY}").alias(KEY)), "best")
    return rows.join(best, KEY, "left_semi").dropDuplicates([KEY]).select(*docs.columns)


@F.pandas_udf(StringType())
def redacted(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
    """Texts with each run of overlapping spans replaced by the mark; null stays null."""
    return pd.Series([t if t is None else secret_scan.redact(t, list(zip(a, b)), MARK) for t, a, b in zip(texts, starts, stops)])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts; null texts stay null, and equal rows stay as many as they are."""
    rows = keyed(docs)
    found, _ = secret_scan.scan(rows, id_col=KEY)
    found = stage(found.where(F.size("findings") > 0).select(F.col("id").alias(KEY), F.col("findings").alias("_vellum_spans")).dropDuplicates([KEY]), "found")
    out = rows.join(found, KEY, "left").withColumn("text", F.coalesce(redacted(F.when(F.size("_vellum_spans") > 0, F.col("text")), F.col("_vellum_spans.start"), F.col("_vellum_spans.stop")), F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_vellum_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights ask for: rows of a null or repeated id are chosen together, ties fall by id."""
    levels = {f"_vellum_{k}": v for k, v in mixing.default_levels().items()}
    slim = stage(mixing.leaf_rows(docs, levels), "slim")
    made = mixing.plan(slim, list(levels), mixing.WEIGHTS)
    own = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias(KEY), *[F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in levels.items()])
    return mixing.choose(own, made, list(levels), id_col=KEY, epoch="_vellum_epoch").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian unsigned 32-bit numbers), and digests of them and of what they decode to.

    A null text has no tokens. A row for each row that comes, whatever its id.
    """
    done = encode_decode(docs)
    return done.select(F.col("id").alias("doc_id"), (F.length("ids") / 4).cast("long").alias("n_tokens"), F.col("ids").alias("token_ids"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
