"""The registered queries of the corpus operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import licenses
from vellum.llm.bpe import encode_decode
from vellum.llm.common import table
from vellum.llm.matroska import media_columns
from vellum.llm.mixing import ORACLE as MIXING_SQL
from vellum.llm.mixing import WEIGHTS, default_levels, mix
from vellum.llm.packing import pack
from vellum.llm.quality_classifier import classify
from vellum.llm.quality_rules import judge
from vellum.llm.runs import periodic_runs, with_periods
from vellum.llm.secret_scan import BASE, scan
from vellum.llm.simhash import near_duplicates
from vellum.llm.spelling import SHORTEST, count_words, group_variants
from vellum.llm.suffix_dedup import remove_repeats
from vellum.llm.toxicity import severity


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), default_levels(), WEIGHTS).withColumnRenamed("id", "doc_id")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    said = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x.license, F.format_string("%.3f", x.coverage), x.start, x.stop)), ",")
    return found.select(F.col("id").alias("doc_id"), F.size("licenses").cast("long").alias("n_licenses"), said.alias("licenses"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: one with the base rules, and one with all, for which only the other rules' pairs are new."""
    docs = table(spark, sf_dir, "documents")
    found, _ = scan(docs, scan(docs, packs=(BASE,))[1])
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x.kind, x.start, x.stop)), ",")
    base = F.filter("findings", lambda x: x.kind.isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("findings", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("findings")).alias("spans"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode_decode(table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return seen.select(F.col("id").alias("doc_id"), F.round(F.col("chances")[0], 6).alias("score"), F.round("severity", 6).alias("severity"), F.col("grade").cast("long").alias("grade"), (F.col("grade") > 0).cast("int").alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = judge(table(spark, sf_dir, "documents"))
    return seen.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 6).alias("distance"))


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media_columns(table(spark, sf_dir, "documents"))
    tail = F.crc32(F.expr("substring(payload, -32)"))
    return m.select(F.col("id").alias("doc_id"), "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", F.size("packets").cast("long").alias("n_packets"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x.stop - x.start))
    return done.select(F.col("id").alias("doc_id"), "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_marks")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return seen.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = count_words(table(spark, sf_dir, "documents"), vary=True)
    return group_variants(words, SHORTEST).select("word", "form", "root", "n", "n_near", "form_n")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", with_periods(F.col("doc_id"), F.col("text")).alias("text")))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    most = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    rows = found.select("id", F.size("runs").cast("long").alias("n_runs"), most.alias("most"), F.sha2(said.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, length, period = (-F.col("most.start"), F.col("most.length"), -F.col("most.period"))
    return rows.select(F.col("id").alias("doc_id"), "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select(F.col("id").alias("doc_id"), "start", (F.length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_simhash": op1_simhash, "op2_mixing": op2_mixing, "op3_licenses": op3_licenses, "op4_secrets": op4_secrets, "op5_bpe": op5_bpe, "op6_toxicity": op6_toxicity, "op7_quality_rules": op7_quality_rules, "op8_matroska": op8_matroska, "op9_suffix_dedup": op9_suffix_dedup, "op10_quality_classifier": op10_quality_classifier, "op11_spelling_variants": op11_spelling_variants, "op12_periodic_runs": op12_periodic_runs, "op13_packing": op13_packing}
ORACLES: dict[str, str] = {"op2_mixing": MIXING_SQL}
