"""Forms and words like an entry against one pattern a form and against all pairs."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from vellum.operators import dictionary as D
from vellum.operators import terms

ELEMENTS = "doc_id long, seq long, page_num int, content string"


def made(rng, low, high, letters="abcdefgh"):
    return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))


def pattern(form, loose):
    quoted = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", form)
    if re.search("[A-Za-z]", form):
        return "(?iU)\\b" + (quoted.replace(" ", r"\s+") if loose else quoted) + "\\b"
    return quoted


@pytest.mark.parametrize("loose", [False, True])
def test_forms_are_what_patterns_find(spark, loose, monkeypatch):
    rng = random.Random(int(loose))
    forms = ["Deep Learning", "deep-learning", "C.N.N.", "AI", "a a", "神经网络", "网络", "哈哈", "x_y", "é1", "(a)", "\\E", "a b c", "ab", "abc", "ſa", "K2"] + [made(rng, 1, 3, "ab ") for _ in range(20)]
    forms = sorted({f.strip() for f in forms if f.strip()})
    bits = [*forms, " ", "  ", "\n", "\t ", " ", "-", "_", ".", "x", "一", "DEEP", "learning", "S", "ſ", "K", "k", "2", "É"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(250)] + ["a a a a", "a  a a", "C.N.N.s", "哈哈哈", None, ""]
    df = spark.createDataFrame([(k, k, 1, t) for k, t in enumerate(texts)], ELEMENTS)
    entries = spark.createDataFrame([(k, f) for k, f in enumerate(forms)], "entry int, form string").select("entry", "form", (F.lit(loose) & F.regexp_like("form", F.lit("[A-Za-z]"))).alias("loose"))
    monkeypatch.setattr(D, "FORMS", 15)
    got = sorted((r.doc_id, r.entry, r.hit) for r in D.find_forms(df, entries).collect())
    want = []
    for k, f in enumerate(forms):
        rows = df.select("doc_id", F.explode(F.regexp_extract_all("content", F.lit(pattern(f, loose)), F.lit(0))).alias("hit")).collect()
        want += [(r.doc_id, k, r.hit) for r in rows]
    assert got == sorted(want) and len(got) > 300
    for r in D.find_forms(df, entries).limit(50).collect():
        assert texts[r.doc_id][r.start : r.stop] == r.hit


def test_five_thousand_terms_in_one_scan(spark):
    rng = random.Random(5)
    forms = sorted({made(rng, 4, 7) for _ in range(5200)})[:5000]
    texts = [" ".join(rng.choice(forms) if rng.random() < 0.1 else made(rng, 4, 7) for _ in range(60)) for _ in range(400)]
    df = spark.createDataFrame([(k, k, 1, t) for k, t in enumerate(texts)], ELEMENTS)
    entries = spark.createDataFrame([(k, f, False) for k, f in enumerate(forms)], "entry int, form string, loose boolean")
    hits = D.find_forms(df, entries)
    # A form that is found again and again does not overlap itself; these forms are whole words.
    want = sorted((k, w) for k, t in enumerate(texts) for w in t.split() if w in set(forms))
    assert sorted((r.doc_id, r.hit) for r in hits.collect()) == want and len(want) > 2000
    assert hits._jdf.queryExecution().toString().count("MapInArrow") == 4  # one in each of the four plans shown


def test_odd_forms(spark):
    df = spark.createDataFrame([(1, 1, 1, "some deep learning")], ELEMENTS)
    none = spark.createDataFrame([], "entry int, form string, loose boolean")
    assert D.find_forms(df, none).collect() == []
    odd = spark.createDataFrame([(0, None, False), (1, "", False), (2, "deep learning", True), (2, "deep learning", True)], "entry int, form string, loose boolean")
    assert [(r.entry, r.start, r.stop) for r in D.find_forms(df, odd).collect()] == [(2, 5, 18)]


def test_mixed_and_forbidden_forms(spark):
    rules = {"terminology_check": {"warn_on_mixed_allowed_forms": True, "terms": {"深度学习": ["Deep Learning", "deep-learning"]}, "forbidden_variants": {"CNN": ["C N N", "Cnn net"], "RNN": ["R.N"], "none": None}}}
    rows = [(1, 1, 1, "Deep\n learning and c n n"), (1, 2, 3, "DEEP-LEARNING, cnn NET x R.N"), (2, 1, 1, "deep learning"), (3, 1, 1, "深度学习 deep learning"), (3, 2, 2, "C N N R.Nx")]
    df = spark.createDataFrame(rows, ELEMENTS)
    got = sorted((r.doc_id, r.message[-3:], r.evidence, r.page) for r in terms.forbidden(df, rules).collect())
    assert got == [(1, "CNN", "C N N, Cnn net", "1, 3"), (1, "RNN", "R.N", "3"), (3, "CNN", "C N N", "2")]
    mixed = sorted((r.doc_id, r.evidence, r.page) for r in terms.mixed_forms(df, rules).collect())
    assert mixed == [(1, "deep\n learning, deep learning", "1, 3"), (3, "deep learning, 深度学习", "1")]
    assert sorted(r.doc_id for r in terms.mixed_forms(df, rules, compat=False).collect()) == [3]


def closest(words, keywords):
    """What the library's own function gives for each keyword, over all words of fitting length."""
    out = []
    for k in keywords:
        latin = bool(re.search("[A-Za-z]", k))
        fit = [w for w in words if (abs(len(w) - len(k)) <= 2 if latin else len(w) == len(k))]
        for m in difflib.get_close_matches(k, fit, n=3, cutoff=0.85):
            if m != k and m.lower() != k.lower() and m not in (k + "s", k + "es") and not (not latin and (m in k or k in m)):
                out.append((k, m))
    return out


def edited(rng, w, n):
    for _ in range(n):
        k = rng.randint(0, len(w) - 1)
        w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcdefgh") + w[k:], w[:k] + rng.choice("abcdefgh") + w[k + 1 :]]) or "a"
    return w


def test_no_word_is_left_out(spark):
    """Words and entries of all lengths: every pair that is like enough is among the candidates."""
    rng = random.Random(11)
    entries = sorted({made(rng, 1, 26) for _ in range(300)})
    words = sorted({edited(rng, e, rng.randint(1, 4)) for e in entries for _ in range(5)} | {made(rng, 1, 12) for _ in range(300)})
    got = {(r.word, r.entry) for r in D.candidates(spark.createDataFrame([(w,) for w in words], "word string"), entries).collect()}
    want = {(w, e) for w in words for e in entries if abs(len(w) - len(e)) <= 2 and difflib.SequenceMatcher(None, w, e).ratio() >= 0.85}
    assert want <= got and len(want) > 400 and len(got) < 20 * len(want)


def test_ten_thousand_keywords(spark):
    rng = random.Random(12)
    keywords = sorted({made(rng, 6, 18, "abcdefghijklmnop") for _ in range(10_000)})
    words = [edited(rng, rng.choice(keywords), rng.randint(0, 3)) for _ in range(1500)] + [made(rng, 6, 18, "abcdefghijklmnop") for _ in range(500)]
    df = spark.createDataFrame([(1, 1, 1, " ".join(words))], ELEMENTS)
    pairs = D.candidates(spark.createDataFrame([(w,) for w in set(words)], "word string"), keywords)
    # Of twenty million pairs a few thousand meet.
    assert pairs.count() < 100_000
    _, found = terms.close_words(df, keywords)
    got = sorted((r.keyword, r.word) for r in found.collect() for _ in range(r.times))
    some = sorted({k for k, _ in got})[::8] + keywords[::400]
    want = sorted(closest(words, sorted(set(some))))
    assert want == [x for x in got if x[0] in set(some)] and len(want) > 60


def test_limit_names_the_first_three(spark):
    text = "Pydantik " + "TensorFlw " * 6 + "TensorFlo TensorFlow Pydantc"
    rules = {"typo_check": {"critical_keywords": ["TensorFlow", "Pydantic"], "max_typos_total_warning": 5}}
    df = spark.createDataFrame([(1, 1, 1, text), (2, 1, 1, "Pydantik only")], ELEMENTS)
    words = re.findall(r"\w+", text)
    said = [m for _, m in closest(words, ["TensorFlow", "Pydantic"]) for _ in range(words.count(m))]
    over = [r for r in terms.typos(df, rules).collect() if r.issue_type == "Typo_Limit_Exceeded"]
    assert [(r.doc_id, r.evidence) for r in over] == [(1, f"Found {len(said)} typos (including: {', '.join(said[:3])}...)")]
    assert said[:3] == ["TensorFlw"] * 3 and said[-1].startswith("Pydant")
    later = spark.createDataFrame([(1, 1, 1, "TensorFlw Pydantik Pydantik Pydantik")], ELEMENTS)
    over = [r.evidence for r in terms.typos(later, {"typo_check": {**rules["typo_check"], "max_typos_total_warning": 1}}).collect() if r.issue_type == "Typo_Limit_Exceeded"]
    assert over == ["Found 10 typos (including: TensorFlw, Pydantik, Pydantik...)"]
