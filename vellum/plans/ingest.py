"""From payloads to audited documents: opening, pages asked for, lines, elements, errors and a report of the parse."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vellum.operators.parse import parse_report, select_pages
from vellum.plans import audit
from vellum.sources.documents import open_payloads
from vellum.storage import stage


class Ingested(NamedTuple):
    """elements; errors (doc_id, error_type, message); report (doc_id, encrypted, pages, scanned_pages, multi_column_pages).

    ``counts`` (payloads, invalid_pdf, encrypted_pdf, lines, characters) were taken in passing, while rows were staged.
    """

    elements: DataFrame
    errors: DataFrame
    report: DataFrame
    docs: DataFrame
    counts: dict[str, int]


def ingest(payloads: DataFrame, lines_of: Callable[[DataFrame], DataFrame], rects_of: Callable[[DataFrame], DataFrame] | None = None, column: str = "payload") -> Ingested:
    """Elements of ``payloads`` (doc_id, payload, and maybe pages: array<int>), of the pages asked for; of all if none are.

    ``lines_of`` makes placed lines of payloads that can be opened, ``rects_of`` the drawings of their pages. A payload that
    is no PDF, or is encrypted or null, has an error and no elements, and zeros in the report; so has the report of one
    without lines on the pages asked for. ``docs`` are the documents with the pages selected, for ``find_issues``.
    """
    opened = open_payloads(payloads, column)
    asked = F.col("pages") if "pages" in payloads.columns else F.lit(None).cast("array<int>")
    told, read = Observation(), Observation()
    n = lambda error: F.count(F.when(F.col("error") == error, 1)).alias(error)
    verdicts = opened.select("doc_id", asked.cast("array<int>").alias("pages"), "error")
    verdicts = stage(verdicts.observe(told, F.count("*").alias("payloads"), n("invalid_pdf"), n("encrypted_pdf")), "opened")
    errors = verdicts.where("error is not null").select("doc_id", F.col("error").alias("error_type"), F.when(F.col("error") == "encrypted_pdf", "pdf is encrypted").otherwise("payload is no pdf").alias("message"))
    good = opened.where("error is null").drop("error")
    selection = verdicts.where("error is null").select("doc_id", "pages")
    lines = select_pages(lines_of(good), selection)
    lines = stage(lines.observe(read, F.count("*").alias("lines"), F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("long").alias("characters")), "lines")
    rects = None
    if rects_of is not None:
        rects = select_pages(rects_of(good), selection)
    counted = verdicts.select("doc_id", (F.coalesce("error", F.lit("")) == "encrypted_pdf").alias("encrypted")).join(parse_report(lines), "doc_id", "left")
    counts = ["pages", "scanned_pages", "multi_column_pages"]
    report = counted.select("doc_id", "encrypted", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts])
    return Ingested(audit.elements_of(lines, rects), errors, report, verdicts.select("doc_id", F.col("pages").alias("selected")), told.get | read.get)


def audit_payloads(payloads: DataFrame, lines_of: Callable[[DataFrame], DataFrame], rules: dict[str, Any] | None = None, rects_of: Callable[[DataFrame], DataFrame] | None = None, stored: DataFrame | None = None, model: audit.Model | None = None, column: str = "payload") -> DataFrame:
    """Results of an audit with each document's ``error`` (null if it was read) and pages.

    ``stored`` (rule_id, content) are rules of a store, which replace sections of ``rules``.
    """
    if stored is not None:
        rules = audit.stored_rules(stored, rules)
    got = ingest(payloads, lines_of, rects_of, column)
    found = audit.find_issues(got.elements, rules, model=model, docs=got.docs)
    done = audit.results(found, got.docs, rules)
    return done.join(got.report.select("doc_id", "pages", "scanned_pages"), "doc_id", "left").join(got.errors.select("doc_id", F.col("error_type").alias("error")), "doc_id", "left")
