"""The near-duplicate stage of the pipeline links by fingerprints, and by overlaps."""

from tests.llm.util import table
from vellum.llm import overlap, stages


def test_fingerprints_join_groups_by_overlap(spark):
    """Texts of one phrase that is repeated have nearly equal fingerprints, though half of their shingles differ."""
    phrase = " ".join(["seven words that come again and again"] * 60)
    other = " ".join(f"other{k}" for k in range(80))
    docs = table(spark, [(4, phrase + " with a few more words", "en", "a"), (2, phrase, "en", "a"), (9, other, "en", "a"), (7, other + " x", "en", "a"), (None, None, "en", "a"), (8, "", "en", "a")])
    apart = overlap.similar(stages.keyed(docs), stages.KEY)
    assert len({r.component for r in apart.collect()}) == 4
    assert sorted(r.doc_id for r in stages.keep_one(spark, docs, "").collect()) == [2, 7, 8]
