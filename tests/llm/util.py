"""Small tables with the awkward cases: nulls, empty and long texts, repeated rows, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, t string, k int, fp0 string, blob string, name string, g string"
LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit " * 3000


def table(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""
    full = []
    for d, t, *more in rows:
        lang, source = more or ("en", "src1")
        full.append((d, t, lang, source, len(t or ""), "x", None, 7, "y", None, "n", ""))
    return spark.createDataFrame(full, SCHEMA)


def odd(spark):
    base = "the quick brown fox jumps over the lazy dog and then runs far away from all of the other animals in the wood"
    return table(spark, [(1, base), (1, base), (2, None), (3, ""), (None, base), (5, base + " again"), (6, LONG), (7, "   \n\t "), (8, "é 日本語 \x1c x", None, None), (9, "a" * 3000)])


def empty(spark):
    return table(spark, [(1, "x")]).where("false")
