"""The whole audit of documents: elements, checks, issues, results."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from functools import partial, reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.config import RULES, stored_rules
from vellum.operators import charts, citations, issues, service, store, structure, terms, text
from vellum.operators.marks import MARKS, marked
from vellum.operators.parse import document_pages, document_text, pages_at, parse, place_issues, with_offsets
from vellum.storage import stage

Check = Callable[[DataFrame, dict[str, Any]], DataFrame]
Model = Callable[[Column], Column]
LAYOUT: list[Check] = [structure.labels_missing, charts.misplaced_captions, charts.images_without_caption, structure.formulas, structure.headings, citations.layout_faults]
IMAGES: list[Check] = [charts.misplaced_captions, charts.images_without_caption]
#: Checks that run side by side.
AT_A_TIME = 4
SEMANTIC: list[Check] = [terms.typos, terms.mixed_forms, terms.forbidden, terms.punctuation, citations.positions, citations.styles, citations.list_missing, citations.numbers_missing, citations.authors_missing]


def model_scan(elements: DataFrame, model: Model, rules: dict[str, Any] | None = None) -> DataFrame:
    """Issues that a language model finds in a document's text, a chunk at a time, with the pages of their chunk.

    ``model`` makes an answer (JSON, or text with JSON in it) of a column of texts; ``llm_scan.enabled`` turns it off.
    """
    none = elements.where("false").select(*issues.issue("", "", ""))
    if not (rules or RULES).get("llm_scan", {}).get("enabled", False):
        return none
    chunks = text.chunks(document_text(elements), 15000, 500)
    answers = chunks.select("doc_id", "chunk", "start", "stop", model(F.col("text")).alias("answer"))
    found = text.model_issues(answers, keep=["chunk", "start", "stop"])
    found = pages_at(with_offsets(elements), found)
    page = F.coalesce(F.when(~F.coalesce("page", F.lit("")).isin("", "?"), F.col("page")), "pages")
    return found.withColumn("seq", F.col("chunk") * 10000 + F.col("pos")).select(
        "doc_id", "seq", "issue_type", "severity", page.alias("page"), *[F.lit(None).cast("double").alias(b) for b in issues.BOX], "evidence", "message"
    )


def with_marks(elements: DataFrame, lasting: bool = False) -> DataFrame:
    """``elements`` staged with what several checks ask of them; those that have it are staged, or part of what is."""
    return elements if set(MARKS) <= set(elements.columns) else stage(marked(elements), "elements", lasting)


def find_issues(elements: DataFrame, rules: dict[str, Any] | None = None, checks: list[Check] | None = None, model: Model | None = None, docs: DataFrame | None = None) -> DataFrame:
    """Deduplicated issues of all checks, in the order of the checks, then those of a language model if there is one.

    An issue without a page gets its document's range, for which ``docs`` may tell more (as in ``document_pages``). Elements are read by every check and issues by counts and tags, so
    both are staged in the shared folder, which also keeps the plan of each step small.
    """
    rules = rules or RULES
    elements = with_marks(elements)
    checks = checks or LAYOUT + SEMANTIC
    # Where there are no images, the checks of images find nothing.
    used = checks if elements.where("type = 'image'").limit(1).count() else [c for c in checks if c not in IMAGES]
    # Each check is a job of its own, some at a time: one plan of them all would be planned anew after each of its stages.

    def work(check: Check) -> Callable[[], DataFrame]:
        # Each job runs in its caller's scope, and with its caller's job group and properties, of which it has a copy.
        inherit = inheritable_thread_target(elements.sparkSession)
        run = lambda: stage(check(elements, rules), check.__name__)
        # Where threads aren't pinned to those of the JVM there is nothing to inherit, and no wrapper.
        return partial(copy_context().run, inherit(run) if callable(inherit) else run)

    with ThreadPoolExecutor(AT_A_TIME) as pool:
        parts = [f.result() for f in [pool.submit(work(check)) for check in used]]
    parts = parts or [elements.where("false").select(*issues.issue("", "", ""))]
    if model is not None:
        parts.append(model_scan(elements, model, rules))
    found = issues.dedupe(issues.union(parts))
    pages = document_pages(elements.select("doc_id").distinct() if docs is None else docs, elements)
    return stage(place_issues(found, pages), "issues")


def results(found: DataFrame, docs: DataFrame, rules: dict[str, Any] | None = None) -> DataFrame:
    """One row a document: issue counts, score, level and tags; documents without issues score 100."""
    return _scored(found, docs.select("doc_id").distinct(), (rules or RULES).get("score_weights", {}))


def _scored(found: DataFrame, docs: DataFrame, weights: dict[str, Any]) -> DataFrame:
    """Results of ``docs``, a row each, with their other columns; weights may be columns of theirs."""
    others = [c for c in docs.columns if c != "doc_id"]
    counts = docs.join(issues.severity_counts(found), "doc_id", "left").fillna(0, ["n_critical", "n_warning", "n_info"])
    out = issues.score(counts, weights).join(issues.tags(found), "doc_id", "left")
    total = F.col("n_critical") + F.col("n_warning") + F.col("n_info")
    return out.select("doc_id", total.alias("n_issues"), "n_critical", "n_warning", "n_info", "score", "audit_level", F.coalesce("tags", F.lit("")).alias("tags"), *others)


def elements_of(lines: DataFrame, rects: DataFrame | None = None) -> DataFrame:
    """Elements of placed lines; drawings of pages (``rects`` as in ``charts.drawing_regions``) with captions but no images are images."""
    own = parse(lines)
    return own if rects is None else charts.drawn_images(stage(own, "parsed"), rects)


def audit(lines: DataFrame, rules: dict[str, Any] | None = None, checks: list[Check] | None = None, model: Model | None = None, rects: DataFrame | None = None) -> DataFrame:
    return results(find_issues(elements_of(lines, rects), rules, checks, model), lines, rules)


#: Versions of rules that one run may use.
VERSIONS = 100
#: Sections of the rules that none of the checks here reads.
UNREAD = ("score_weights", "scoring", "rag_eval")


def audit_versions(lines: DataFrame, chosen: DataFrame, stored: DataFrame, base: dict[str, Any] | None = None, checks: list[Check] | None = None, model: Model | None = None) -> DataFrame:
    """Results with ``version``: each document is audited with the version of the rules that ``chosen`` (doc_id, version) has for it.

    stored: (version, rule_id, content), sections over ``base``. Documents without a version, or with one that isn't stored,
    are audited with ``base``, and keep the version they have. All documents are parsed at once, and those whose rules don't
    differ in what checks read are checked at once.
    """
    base = RULES if base is None else base
    named = sorted(r[0] for r in chosen.where("version is not null").select("version").distinct().limit(VERSIONS + 1).collect())
    if len(named) > VERSIONS:
        raise ValueError(f"more than {VERSIONS} versions of rules")
    kinds: list[dict[str, Any]] = []
    known = []
    for version in [None, *named]:
        rules = base if version is None else stored_rules(stored.where(F.col("version") == version), base)
        read = {k: x for k, x in rules.items() if checks or k not in UNREAD}
        if read not in kinds:
            kinds.append(read)
        known.append((version, kinds.index(read), *issues.weights(rules.get("score_weights", {})).values()))
    named_rules = lines.sparkSession.createDataFrame(known, f"_version {chosen.schema['version'].dataType.simpleString()}, _kind int, critical double, warning double, info double")
    docs = lines.select("doc_id").distinct().join(chosen.select("doc_id", "version"), "doc_id", "left")
    docs = stage(docs.join(F.broadcast(named_rules), F.col("version").eqNullSafe(F.col("_version"))).drop("_version"), "versions")
    elements = parse(lines)
    if len(kinds) > 1:
        elements = elements.join(docs.groupBy("doc_id").agg(F.collect_set("_kind").alias("_kinds")), "doc_id", "left")
    elements = with_marks(elements)
    parts = []
    for k, rules in enumerate(kinds):
        # The first kind has the documents without a version.
        some = elements.where(F.array_contains(F.coalesce("_kinds", F.array(F.lit(0))), k)).drop("_kinds") if len(kinds) > 1 else elements
        own = docs.where(F.col("_kind") == k).drop("_kind").distinct()
        done = _scored(find_issues(some, rules, checks, model), own, {w: F.col(w) for w in issues.WEIGHTS})
        parts.append(done.drop(*issues.WEIGHTS))
    return reduce(DataFrame.unionByName, parts)


def answer(docs: DataFrame, lines: DataFrame, experts: DataFrame, rules: dict[str, Any] | None = None, model: Model | None = None) -> DataFrame:
    """(doc_id, answer): the whole audit of documents (doc_id, text) and their lines as an answer in JSON, with a commentary."""
    found = find_issues(parse(lines), rules, model=model)
    return service.answers(results(found, docs, rules), docs, text.commentary(docs, found, experts, rules or RULES))


def evaluation(found: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of issues against labelled ones (issue_type, severity, page, evidence, message, bbox)."""
    box = F.when(F.col("x0").isNotNull(), F.array(*issues.BOX))
    return store.evaluate(found.withColumn("bbox", box), truth, by)
