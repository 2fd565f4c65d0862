"""Near-duplicates by overlap against all pairs."""

import random

import corpus_pipeline
from tests.llm.util import empty, odd, table
from vellum.llm import overlap


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def linked(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def families(draw):
    """Texts, each with copies in which one to seven scattered words differ."""
    word = lambda: "".join(draw.choice("etaoinshrd") for _ in range(draw.randint(2, 8)))
    out = []
    for k in range(40):
        base = [word() for _ in range(draw.randint(40, 200))]
        out.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for at in draw.sample(range(len(copy)), draw.randint(1, 7)):
                copy[at] = word()
            out.append(" ".join(copy))
    return out


def test_stage_equals_all_pairs(spark):
    texts = families(random.Random(31))
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, table(spark, enumerate(texts)), "").collect()}
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    changed, scattered = True, 0
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(len(texts)):
                if root[b] < root[a] and linked(sets[a], sets[b]):
                    root[a], changed = root[b], True
    for a in range(len(texts)):
        scattered += any(linked(sets[a], sets[b]) and len(sets[a] & sets[b]) < 0.9 * len(sets[a] | sets[b]) for b in range(a))
    assert scattered > 20 and got == {k for k in range(len(texts)) if root[k] == k}


def test_pairs_left_by_the_smallest_node(spark):
    """A chain: its ends don't overlap enough, and its links need not pass the smallest node of a bucket."""
    words = [f"w{k}" for k in range(160)]
    texts = [" ".join(words[k : k + 100]) for k in range(0, 60, 6)] + ["", None, "one two", "ONE  two", "two one"]
    rows = overlap.similar(table(spark, enumerate(texts)).drop("id"), "doc_id", seeds=(1, 2)).collect()
    of = {r.id: r.component for r in rows}
    assert len(rows) == 15 and len({of[k] for k in range(10)}) == 1 and of[10] == of[11] and of[12] == of[13] != of[14] and len(set(of.values())) == 4
    assert overlap.similar(odd(spark).where("doc_id is not null").drop("id").distinct(), "doc_id").count() == 8
    assert overlap.similar(empty(spark), "doc_id").count() == 0


def test_crowds_equal_all_pairs(spark):
    """Copies of two texts with words changed, added and left out; halves of buckets that the first rounds leave apart."""
    draw = random.Random(77)
    word = lambda: "".join(draw.choice("etaoinshrd") for _ in range(draw.randint(3, 8)))
    base = [word() for _ in range(110)]
    texts = []
    for k in range(260):
        copy = list(base if k % 5 else [*base[:70], *reversed(base[70:])])
        for _ in range(draw.randint(0, 9)):
            at = draw.randrange(len(copy))
            kind = draw.random()
            copy[at : at + (kind < 0.75)] = [] if kind < 0.3 else [word()]
        if k % 11 == 0:
            copy = copy[: draw.randint(50, 110)]
        texts.append(" ".join(copy))
    sets = [shingles(t) for t in texts]
    want = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(len(texts)):
                if want[b] < want[a] and linked(sets[a], sets[b]):
                    want[a], changed = want[b], True
    for crowd in (3, 1000):
        of = {r.id: r.component for r in overlap.similar(table(spark, enumerate(texts)).drop("id"), "doc_id", crowd=crowd).collect()}
        least = {}
        for k in range(len(texts)):
            least.setdefault(of[k], k)
        assert [least[of[k]] for k in range(len(texts))] == want, crowd
    assert 20 < len(set(want)) < 200
