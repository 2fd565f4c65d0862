"""Mixing sources to target weights by hierarchical budgeting.

A tree of levels, by default domain, language and source, splits a budget of tokens. At each node the children
share their parent's budget by weight; a child that can't use its share keeps what it can use, and its siblings
share the rest. A node can use what its leaves can use together, so a shortage goes to siblings before it goes to
the parent's siblings, and so on up. All shares are whole tokens, by integer arithmetic.

A leaf's rows are in a seeded random order, another one each epoch. A leaf takes whole epochs and then the longest
prefix of the next one within its budget, which is a cut point in that order: choosing rows is a filter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import stage

#: Leaves up to which the cut points are broadcast.
SMALL = 20_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column, domains: int = 4) -> Column:
    """The domain that a numbered source belongs to, by its number."""
    number = F.regexp_extract(source, r"(\d+)$", 1)
    return F.when(F.coalesce(number, F.lit("")) == "", "domain").otherwise(F.concat(F.lit("domain"), F.pmod(number.try_cast("long"), F.lit(domains)).cast("string")))


def place(key: Column, epoch: Column, seed: int) -> Column:
    """A row's place in an epoch, from 0 to 2^32 - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def share(nodes: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Adds ``got``: what each node (budget of its parent, cap, w, own) gets of it.

    Nodes in order of cap / w keep their cap as long as their share of what is left is no less; the others share the rest.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap") / F.col("w"), "own")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    df = nodes.withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("heavy", F.sum("w").over(onward)).withColumn("at", F.row_number().over(order))
    # Products of tokens and weights are more than a long holds in a large corpus.
    tokens, weight = (lambda c: c.cast("decimal(20,0)")), (lambda c: F.col(c).cast("decimal(17,0)"))
    full = tokens(F.col("cap")) * weight("heavy") <= tokens(F.col("budget") - F.col("used")) * weight("w")
    df = df.withColumn("firstopen", F.min(F.when(~full, F.col("at"))).over(by))
    left = F.min(F.when(F.col("at") == F.col("firstopen"), F.col("budget") - F.col("used"))).over(by)
    heavy = F.min(F.when(F.col("at") == F.col("firstopen"), F.col("heavy"))).over(by)
    df = df.withColumn("rest", left).withColumn("over", heavy)
    got = F.when(F.col("firstopen").isNull() | (F.col("at") < F.col("firstopen")), F.col("cap")).otherwise(F.expr("(cast(rest as decimal(20,0)) * cast(w as decimal(17,0))) div cast(over as decimal(17,0))"))
    return df.withColumn("got", got.cast("long")).drop("used", "heavy", "at", "firstopen", "rest", "over")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple[str, ...], int], tokens: int | None, epochs: int) -> DataFrame:
    """Leaves (levels, tokens) with ``got``, the tokens each is to give."""
    caps = leaves.select(*levels, "tokens", (F.col("tokens") * epochs).alias("cap"))
    total = F.lit(tokens) if tokens is not None else F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    above = None
    for depth in range(1, len(levels) + 1):
        path, parent = list(levels[:depth]), list(levels[: depth - 1])
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        weight = F.lit(1).cast("long")
        for key, w in weights.items():
            if len(key) == depth:
                if w < 1 or w != int(w):
                    raise ValueError("weights are whole numbers from 1 on")
                match = F.lit(True)
                for level, name in zip(path, key):
                    if name != "*":
                        match = match & (F.col(level) == name)
                weight = F.when(match, F.lit(int(w)).cast("long")).otherwise(weight)
        nodes = nodes.withColumn("w", weight).withColumn("own", F.col(path[-1]))
        nodes = nodes.withColumn("budget", total.cast("long")) if above is None else nodes.join(above, parent)
        done = share(nodes, parent)
        above = done.select(*path, F.col("got").alias("budget"))
    return done.select(*levels, "tokens", "got")


def plan(rows: DataFrame, levels: Sequence[str], weights: Mapping[tuple[str, ...], int] | None = None, tokens: int | None = None, epochs: int = 2, seed: int = 42) -> DataFrame:
    """For each leaf of ``rows`` (id, levels, n_tokens): (levels, whole, cut_place, cut_id).

    The leaf gives all rows in ``whole`` epochs, and in the next one the rows up to the cut point; a null cut gives none.
    """
    leaves = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    got = budgets(leaves.select(*levels, "tokens"), levels, weights or {}, tokens, epochs)
    whole = F.when(F.col("tokens") > 0, F.least(F.expr("got div tokens"), F.lit(epochs))).otherwise(F.lit(1)).cast("int")
    goal = got.join(leaves.select(*levels, "n"), list(levels)).withColumn("whole", whole)
    goal = stage(goal.withColumn("rest", F.col("got") - F.col("whole") * F.col("tokens")).withColumn("parts", F.ceil(F.sqrt("n"))), "goals")
    open_ = goal.where("whole < %d and rest > 0" % epochs)
    at = rows.join(open_.select(*levels, "whole", "rest", "parts"), list(levels)).withColumn("place", place(F.col("id"), F.col("whole"), seed))
    at = at.select("id", *levels, "n_tokens", "rest", "place", F.expr("(place * parts) div 4294967296").alias("part"))
    upto = Window.partitionBy(*levels).orderBy("part")
    sums = at.groupBy(*levels, "part").agg(F.sum("n_tokens").alias("inside"), F.max(F.struct("place", "id")).alias("last"), F.first("rest").alias("rest"))
    sums = stage(sums.withColumn("upto", F.sum("inside").over(upto)), "parts")
    # A leaf of n rows has the root of n parts of about as many rows. Whole parts come first; the part in which the budget
    # ends is ordered row by row.
    edge = sums.where("upto > rest and upto - inside <= rest").select(*levels, "part", (F.col("upto") - F.col("inside")).alias("began"))
    by = Window.partitionBy(*levels, "part").orderBy("place", "id")
    inside = at.join(edge, [*levels, "part"]).withColumn("upto", F.col("began") + F.sum("n_tokens").over(by)).where("upto <= rest")
    last = sums.where("upto <= rest").select(*levels, "last").unionByName(inside.select(*levels, F.struct("place", "id").alias("last")))
    cut = last.groupBy(*levels).agg(F.max("last").alias("cut"))
    return stage(goal.select(*levels, "got", "whole").join(cut, list(levels), "left").select(*levels, "got", "whole", F.col("cut.place").alias("cut_place"), F.col("cut.id").alias("cut_id")), "plan")


def choose(rows: DataFrame, made: DataFrame, levels: Sequence[str], seed: int = 42, id_col: str = "id", epoch: str = "epoch") -> DataFrame:
    """Rows of ``rows`` as often as ``plan`` has them, with ``epoch``. Rows aren't shuffled if the plan is small."""
    p = "_vellum_plan_"
    here = made.select(*[F.col(c).alias(p + c) for c in (*levels, "whole", "cut_place", "cut_id")])
    here = F.broadcast(here) if made.count() <= SMALL else here
    at = place(F.col(id_col), F.col(f"{p}whole"), seed)
    more = F.coalesce((at < F.col(f"{p}cut_place")) | ((at == F.col(f"{p}cut_place")) & (F.col(id_col) <= F.col(f"{p}cut_id"))), F.lit(False))
    joined = rows.join(here, [F.col(p + c) == rows[c] for c in levels]).withColumn(f"{p}times", F.col(f"{p}whole") + more.cast("int")).where(f"{p}times > 0")
    return joined.select(*[rows[c] for c in rows.columns], F.explode(F.sequence(F.lit(0), F.col(f"{p}times") - 1)).alias(epoch))


def leaf_rows(docs: DataFrame, levels: Mapping[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, levels, n_tokens): a null level counts as empty, a null id as -1, a null text has no tokens."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"), *[F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in levels.items()], words(F.col(text_col).cast("string")).alias("n_tokens"))


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple[str, ...], int] | None = None, tokens: int | None = None, epochs: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, levels, n_tokens, epoch): a row for each time that a row of ``docs`` is chosen.

    levels: names and columns from the root down. weights: whole numbers by path, "*" for any name; 1 otherwise.
    tokens: the budget, by default all there are. A leaf gives each row ``epochs`` times at most. Rows with the
    same id have the same place, and are chosen together; leaves without tokens give their rows once; an empty
    table gives none; a very long text is a row of many tokens, which is chosen whole or not at all. Columns that
    ``levels`` doesn't use are not looked at.
    """
    rows = stage(leaf_rows(docs, levels, id_col, text_col), "rows")
    return choose(rows, plan(rows, list(levels), weights, tokens, epochs, seed), list(levels), seed)


#: The weights of the registered query.
WEIGHTS = {("domain0",): 4, ("domain1",): 3, ("domain2",): 2, ("*", "en"): 5, ("*", "de"): 2, ("*", "fr"): 2}


def default_levels() -> dict[str, Column]:
    return {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def _sql() -> str:
    """The same in DuckDB, with one ordered sum over each leaf."""
    level = ["domain", "lang", "source"]
    weight = {1: "CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END", 2: "CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END", 3: "1"}
    parts = [
        r"""r AS (SELECT doc_id, CASE WHEN coalesce(regexp_extract(source, '(\d+)$', 1), '') = '' THEN 'domain' ELSE 'domain' || (CAST(regexp_extract(source, '(\d+)$', 1) AS BIGINT) % 4) END AS domain,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents)""",
        "l AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM r GROUP BY ALL)",
    ]
    for d in (1, 2, 3):
        path, parent = ", ".join(level[:d]), ", ".join(level[: d - 1])
        over = f"PARTITION BY {parent} " if parent else ""
        budget = "(SELECT sum(tokens) FROM l)" if d == 1 else "budget"
        source = f"(SELECT {path}, sum(tokens) * 2 AS cap FROM l GROUP BY {path})" + (f" JOIN b{d - 1} USING ({parent})" if parent else "")
        parts += [
            f"n{d} AS (SELECT {path}, CAST(cap AS BIGINT) AS cap, CAST({budget} AS BIGINT) AS budget, {weight[d]} AS w FROM {source})",
            f"o{d} AS (SELECT *, coalesce(sum(cap) OVER ({over}ORDER BY cap / w, {level[d - 1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, sum(w) OVER ({over}ORDER BY cap / w, {level[d - 1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy, row_number() OVER ({over}ORDER BY cap / w, {level[d - 1]}) AS pos FROM n{d})",
            f"p{d} AS (SELECT *, min(CASE WHEN cap * heavy > (budget - used) * w THEN pos END) OVER ({over}) AS fo FROM o{d})",
            f"q{d} AS (SELECT *, min(CASE WHEN pos = fo THEN budget - used END) OVER ({over}) AS rest, min(CASE WHEN pos = fo THEN heavy END) OVER ({over}) AS whole FROM p{d})",
            f"b{d} AS (SELECT {path}, CAST(CASE WHEN fo IS NULL OR pos < fo THEN cap ELSE (rest * w) // whole END AS BIGINT) AS budget FROM q{d})",
        ]
    parts += [
        "g AS (SELECT *, CASE WHEN tokens > 0 THEN least(budget // tokens, 2) ELSE 1 END AS whole FROM b3 JOIN l USING (domain, lang, source))",
        "s AS (SELECT r.*, whole, budget - whole * tokens AS rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY CAST('0x' || substr(md5('42:' || whole || ':' || doc_id), 1, 8) AS BIGINT), doc_id) AS upto FROM r JOIN g USING (domain, lang, source))",
        "t AS (SELECT *, whole + CASE WHEN whole < 2 AND rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM s)",
    ]
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, domain, lang, source, n_tokens, CAST(e AS INTEGER) AS epoch FROM t, unnest(range(CAST(times AS BIGINT))) AS x(e)"


ORACLE = _sql()
