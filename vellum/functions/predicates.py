"""What a line of text is: captions, headings, formulas, references and citations, as column expressions."""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import patterns as P


def has(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(c, F.lit(P.WHITE))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, f"{P.S}+", "")


def let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once, which also keeps long expressions small."""
    return F.element_at(F.transform(F.array(value), then), 1)


def cascade(c: Column, steps, otherwise: bool) -> Column:
    """The verdict of the first step whose conditions all hold for the stripped text."""
    return let(strip(c), lambda s: _cascade(s, steps, otherwise))


def _cascade(s: Column, steps, otherwise: bool) -> Column:
    share = F.regexp_count(s, F.lit(P.CJK)) / F.greatest(F.length(s), F.lit(1))
    tests = {
        "has": lambda x: has(s, x),
        "not": lambda x: ~has(s, x),
        "longer": lambda x: F.length(s) > x,
        "shorter": lambda x: F.length(s) < x,
        "chinese": lambda x: share > x,
        "fewer": lambda x: F.regexp_count(s, F.lit(P.OPERATORS)) < x,
    }
    out = None
    for verdict, conditions in steps:
        holds = None
        for kind, x in conditions:
            test = tests[kind](x)
            holds = test if holds is None else holds & test
        out = F.when(holds, verdict) if out is None else out.when(holds, verdict)
    return out.otherwise(otherwise)


def is_reference_title(c: Column) -> Column:
    return has(c, P.REFERENCE_TITLE)


def is_caption(c: Column) -> Column:
    return let(strip(c), caption_like)


def caption_like(s: Column) -> Column:
    """``is_caption`` of a stripped text."""
    return has(s, P.CAPTION) & ~has(s, P.TOC_DOTS) & ~has(s, P.TOC_SPACES)


def is_formula(c: Column) -> Column:
    return cascade(c, P.FORMULA, P.FORMULA_ELSE)


def formula_like(s: Column) -> Column:
    """``is_formula`` of a stripped text."""
    return _cascade(s, P.FORMULA, P.FORMULA_ELSE)


def is_display_formula(c: Column) -> Column:
    return (strip(c) != "") & cascade(c, P.DISPLAY, P.DISPLAY_ELSE)


def is_heading(c: Column) -> Column:
    return let(strip(c), heading_like)


def heading_like(s: Column) -> Column:
    """``is_heading`` of a stripped text."""

    def numbered(x):
        number, rest = x.number, x.rest
        plain = (F.length(rest) >= 2) & (F.length(rest) <= 60) & ~F.lower(rest).isin(*P.HEADING_NOT) & ~has(rest, "[，；：]")
        return plain & ~(~F.contains(number, F.lit(".")) & has(rest, "^[A-Za-z]{2,4}$"))

    parts = F.struct(F.regexp_extract(s, P.HEADING, 1).alias("number"), strip(F.regexp_extract(s, P.HEADING, 2)).alias("rest"))
    return F.when(has(s, P.HEADING), ~has(s, P.HEADING_DATE) & ~has(s, P.SENTENCE_END) & let(parts, numbered)).otherwise(has(s, P.HEADING_CHAPTER) & ~has(s, P.SENTENCE_END))


def is_toc_heading(c: Column) -> Column:
    s = strip(c)
    return has(s, P.TOC_LEADER) | (has(s, P.TOC_LEADER_SHORT) & has(s, P.TOC_GAP))


def cn_number(c: Column) -> Column:
    """The value of a number in Chinese characters or digits; null if it isn't one, or is 0."""
    digits = F.create_map(*[F.lit(x) for pair in P.CN_DIGITS.items() for x in pair])
    units = F.create_map(*[F.lit(x) for pair in P.CN_UNITS.items() for x in pair])
    s = strip(c)
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("digit"))

    def step(a, ch):
        unit = units[ch]
        return F.when(unit.isNotNull(), F.struct((a["sum"] + F.greatest(a["digit"], F.lit(1)) * unit).alias("sum"), F.lit(0).alias("digit"))).otherwise(F.struct(a["sum"].alias("sum"), digits[ch].alias("digit")))

    value = F.aggregate(F.filter(F.split(s, ""), lambda x: x != ""), start, step, lambda a: a["sum"] + a["digit"])
    spelled = F.when(has(s, f"^[{''.join([*P.CN_DIGITS, *P.CN_UNITS])}]+$") & (value > 0), value)
    return F.when(has(s, "^[0-9]+$"), s.try_cast("int")).otherwise(spelled)


#: A line may begin with a long number, as those of cards are; one more than the largest still is a decimal.
HEADING_NUMBER = "decimal(37,0)"


def heading_parts(c: Column) -> Column:
    """Numbers of a heading as an array, null if it has none."""
    return let(strip(c), _heading_parts)


def _heading_parts(s: Column) -> Column:
    rest = strip(F.regexp_extract(s, P.HEADING, 2))
    numbered = F.when((F.length(rest) >= 2) & has(rest, f"[A-Za-z]|{P.CJK}"), F.transform(F.split(F.regexp_extract(s, P.HEADING, 1), r"\."), lambda x: x.try_cast(HEADING_NUMBER)))
    chapter = cn_number(F.regexp_extract(s, P.HEADING_PARTS_CHAPTER, 1)).cast(HEADING_NUMBER)
    return F.when(has(s, P.HEADING), numbered).when(has(s, P.HEADING_PARTS_CHAPTER) & chapter.isNotNull(), F.array(chapter))


def line_region(c: Column, size: Column, body: Column, in_references: Column) -> Column:
    title = (is_heading(c) & (size >= body * 1.15)) | (size >= body * 1.3)
    numbers = F.split(squeeze(F.regexp_extract(c, P.REGION_CITATION, 1)), ",")
    cited = has(c, P.REGION_CITATION) & ((F.length(c) < 100) | has(c, f"^{P.S}*\\[[0-9]+\\]")) & F.forall(numbers, lambda n: n.try_cast("int").between(1, 999))
    return F.when(in_references, "reference").when(is_caption(c), "chart").when(is_formula(c), "formula").when(title, "title").when(cited, "citation").otherwise("main")


def layout_citations(c: Column) -> Column:
    """Citations of a line: bracketed numbers from 1 to 999 unless it looks like code, and (Author ... year)."""
    def fine(x):
        return F.forall(F.split(F.regexp_replace(squeeze(x), r"[\[\]]", ""), ","), lambda n: n.try_cast("long").between(1, 999))

    groups = F.filter(_all(c, "[", P.CITATION_GROUP, 0), fine)
    # Whether a line looks like code is asked only if it has numbers in brackets.
    groups = F.when(F.contains(c, F.lit("[")) & has(c, P.CITATION_GROUP) & has(c, P.CITATION_CODE), F.array().cast("array<string>")).otherwise(groups)
    return F.concat(groups, _all(c, "(", P.CITATION_AUTHOR, 0))


def _all(c: Column, sign: str, pattern: str, group: int) -> Column:
    """All that a pattern finds, which is looked for only in texts that have the sign it can't do without."""
    return F.when(~F.contains(c, F.lit(sign)), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)))


def numeric_citations(c: Column) -> Column:
    """Contents of bracketed numbers that no word character or bracket comes before: none all zeros, none with 1000 or more."""
    found = _all(c, "[", f"(?<![\\p{{L}}\\p{{N}}_\\]]){P.CITATION_GROUP}", 1)

    def fine(x):
        numbers = F.filter(F.split(squeeze(x), ","), lambda n: n != "0")
        return (F.size(numbers) > 0) & F.forall(numbers, lambda n: F.coalesce(n.try_cast("long"), F.lit(1000)) < 1000)

    return F.filter(found, fine)


def author_year_citations(c: Column) -> Column:
    return F.filter(F.transform(_all(c, "(", P.AUTHOR_YEAR, 1), strip), lambda x: x != "")


def is_likely_reference(c: Column, region: Column) -> Column:
    long = (F.length(c) > 20) & has(c, P.REFERENCE_WORDS) | (F.length(c) > 40) & has(c, P.REFERENCE_SPACED)
    return F.coalesce((region == "reference") | has(c, P.REFERENCE_LONE) | (has(c, P.REFERENCE_START) & long), F.lit(False))


def reference_numbers(c: Column) -> Column:
    """Numbers that lines of a text start with, as [n], n. or n)."""
    def number(line):
        return F.concat(F.regexp_extract(line, P.REFERENCE_NUMBER, 1), F.regexp_extract(line, P.REFERENCE_NUMBER, 2))

    return F.filter(F.transform(F.split(c, "\n"), number), lambda n: n != "")


def label_number(c: Column) -> Column:
    """A figure's or table's number with - between its parts."""
    return F.translate(squeeze(c), "−–—－.", "-----")


def formula_number(c: Column) -> Column:
    """A formula's number with . between its parts."""
    s = F.translate(squeeze(c), "−–—－", "----")
    return F.when(has(s, "^[0-9]+(?:-[0-9]+)+$"), F.translate(s, "-", ".")).otherwise(s)


def is_caption_continuation(c: Column) -> Column:
    return let(strip(c), lambda s: goes_on(s, is_reference_title(s) | caption_like(s) | heading_like(s) | formula_like(s)))


def goes_on(s: Column, other: Column) -> Column:
    """Whether a stripped text, which is something of its own if ``other``, can go on with a caption."""
    return F.length(s).between(4, 90) & ~other & ~has(s, f"^第{P.S}*[0-9]+{P.S}*页$") & ~has(s, "[。！？]$")


def match_text(c: Column) -> Column:
    """Lower case without white space and common marks, for fuzzy matching."""
    return F.lower(F.regexp_replace(c, f"{P.S}|{P.MARKS}", ""))


def normal_level(c: Column) -> Column:
    s = F.trim(F.coalesce(c, F.lit("")))
    low = F.lower(s)
    named = F.when(s == "", "Info").when(low.isin("critical", "error", "fatal"), "Critical").when(low.isin("warning", "warn"), "Warning").when(low == "info", "Info")
    return named.otherwise(F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30))))


def rule_id(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    known = F.create_map(*[F.lit(x) for k, (n, _) in P.ISSUE_RULES.items() for x in (k, f"{P.RULE_PREFIX}-{n}")])
    return F.coalesce(known[t], F.concat(F.lit(f"{P.RULE_PREFIX}-AUTO-"), F.when(t == "", "Other").otherwise(t)))


def point(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    known = F.create_map(*[F.lit(x) for k, (_, p) in P.ISSUE_RULES.items() for x in (k, p)])
    return F.coalesce(known[t], F.when(t == "", "其他").otherwise(t))


def level_score(c: Column) -> Column:
    level = normal_level(c)
    return F.when(level == "Critical", 5).when(level == "Warning", 3).otherwise(1)


def first_int(c: Column) -> Column:
    return F.regexp_extract(c, "[0-9]+", 0).try_cast("long")


def normal_page(c: Column) -> Column:
    """A page as a number: the first whole number of a text, 0 for none and for negative ones."""
    return F.greatest(F.coalesce(F.regexp_extract(c, "-?[0-9]+", 0).try_cast("int"), F.lit(0)), F.lit(0))


def normal_bbox(c: Column) -> Column:
    """Four numbers: cut off or filled up with zeros, all zeros for null."""
    return F.slice(F.concat(F.coalesce(c, F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), 4)), 1, 4)


def clamp_weight(c: Column) -> Column:
    w = c.try_cast("double")
    return F.when(w.isNotNull(), F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0)))


def page_list(c: Column, spaces: bool = False, empty_is_all: bool = False) -> Column:
    """Sorted distinct pages of "1,3-5": reversed ranges are turned, other parts skipped.

    Where ``empty_is_all``, null stands for all pages if no page is named.
    """
    parts = F.split(squeeze(c) if not spaces else F.regexp_replace(strip(c), f"{P.S}+", ","), ",")

    def pages(p):
        a, b = F.regexp_extract(p, "^([0-9]+)-([0-9]+)$", 1).try_cast("int"), F.regexp_extract(p, "^([0-9]+)-([0-9]+)$", 2).try_cast("int")
        one = p.try_cast("int")
        return F.when(a.isNotNull(), F.sequence(F.least(a, b), F.greatest(a, b))).when(has(p, "^[0-9]+$"), F.array(one)).otherwise(F.array().cast("array<int>"))

    out = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(parts, pages)), lambda n: n > 0)))
    return F.when(F.size(out) > 0, out) if empty_is_all else out


def term_found(c: Column, term: str) -> Column:
    """Whether a text has a term: one in Latin letters as a word of its own, without case."""
    if not term:
        return F.lit(False)
    if any("a" <= x.lower() <= "z" for x in term):
        # What ends a quotation is quoted by itself.
        return has(c, r"(?iU)\b\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E\b")
    return F.contains(c, F.lit(term))


def term_key(c: Column) -> Column:
    return F.when(has(c, "[A-Za-z]"), F.lower(c)).otherwise(c)


def box_by_page(box: Column, width: Column, height: Column) -> Column:
    """A box in shares of its page."""
    return F.array(box[0] / width, box[1] / height, box[2] / width, box[3] / height)


def truncate(c: Column, most: int = 120) -> Column:
    """White space drawn together, and cut to ``most`` characters, the last of which then says so."""
    flat = strip(F.regexp_replace(F.coalesce(c, F.lit("")), f"{P.S}+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def _above(tie: Fraction) -> float:
    """The least double that is rounded up from ``tie``, halfway between two tenths; a true half goes to the even one."""
    x = float(tie)
    if Fraction(x) == tie:
        return x if int(tie * 10) % 2 else math.nextafter(x, 1)
    return x if Fraction(x) > tie else math.nextafter(x, 1)


_TIES = [_above(Fraction(2 * k + 1, 20)) for k in range(10)]


def tenths(x: Column) -> Column:
    """A number rounded to one decimal, as text. What counts is its exact binary value, as in C, and not its shortest decimal one."""
    size = F.abs(x.cast("double"))
    # What is left of a double without its whole part is exact.
    rest = size - F.floor(size)
    n = F.floor(size) * 10 + reduce(Column.__add__, [(rest >= t).cast("int") for t in _TIES])
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def format_box(box: Column) -> Column:
    """[x0, y0, x1, y1] with one decimal, empty for what isn't four numbers."""
    said = F.concat(F.lit("["), F.concat_ws(", ", *[tenths(box[k]) for k in range(4)]), F.lit("]"))
    return F.when(F.size(box) == 4, said).otherwise("")


def mask_url(c: Column) -> Column:
    """A database's address without its user and password; Hidden for what has no host."""
    s = F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("postgresql+asyncpg://"), F.lit("postgresql://"))
    part = lambda k: F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#]*@)?([^/?#@:]+)(:[0-9]+)?(/[^?#]*)?", k)
    return F.when(part(2) == "", "Hidden").otherwise(F.concat(part(1), F.lit("://***@"), F.lower(part(2)), part(3), part(4)))


def token_estimate(c: Column) -> Column:
    """Four characters a token."""
    return F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)


def is_pdf_base64(c: Column) -> Column:
    head = F.substring(F.try_to_binary(c, F.lit("base64")), 1, 1024)
    return F.coalesce(F.instr(F.decode(head, "ISO-8859-1"), "%PDF") > 0, F.lit(False))


def guess_issue_type(c: Column) -> Column:
    """Type of a reviewer's remark, by the first rule of which it has a word of every list."""
    t = strip(F.coalesce(c, F.lit("")))
    out = F.when(t == "", "Other")
    for name, lists in P.REMARK_TYPES:
        holds = F.lit(True)
        for words in lists:
            holds = holds & has(t, "|".join(words))
        out = out.when(holds, name)
    return out.otherwise("Other")


def guess_severity(c: Column) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    out = F.when(t == "", None)
    for name, words in P.REMARK_SEVERITIES:
        out = out.when(has(t, "|".join(words)), name)
    return out.otherwise("Info")
