"""What several checks ask of an element, worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import patterns as P
from vellum.functions import predicates as B


def _parts() -> Column:
    """The numbers of a heading that isn't an entry of a table of contents; null for other elements."""
    c = F.col("content")
    return F.when(B.is_heading(c) & ~B.is_toc_heading(c), B.heading_parts(c))


MARKS: dict[str, Callable[[], Column]] = {
    "mark_likely": lambda: B.is_likely_reference(F.col("content"), F.col("region")),
    "mark_numeric": lambda: B.numeric_citations(F.col("content")),
    "mark_authors": lambda: B.author_year_citations(F.col("content")),
    "mark_caption": lambda: B.is_caption(F.col("content")),
    "mark_parts": _parts,
    "mark_titled": lambda: B.has(F.col("content"), P.REFERENCE_TITLE_LOOSE),
    "mark_item": lambda: (F.length("content") >= 15) & B.has(F.col("content"), P.REFERENCE_ITEM),
}


def marked(elements: DataFrame) -> DataFrame:
    """``elements`` with a column for each mark."""
    return elements.select("*", *[make().alias(name) for name, make in MARKS.items() if name not in elements.columns])


def mark(elements: DataFrame, name: str) -> Column:
    """The mark ``name`` (without its prefix): the column if there is one."""
    name = f"mark_{name}"
    return F.col(name) if name in elements.columns else MARKS[name]()
