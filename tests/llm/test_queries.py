"""The registered queries, over the whole smallest tables, against plain Python."""

import hashlib
import zlib

import pytest

from tests.llm.test_operators import counts, fingerprint, groups, left_over, spans
from vellum.llm import bpe, matroska
from vellum.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
sha = lambda x: hashlib.sha256(x).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    rows = {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}
    spark.catalog.clearCache()
    return rows


def test_op1(spark, texts):
    rows = run(spark, "op1_simhash")
    fps = {d: fingerprint(t) for d, t in texts.items()}
    assert {d: r.fingerprint for d, r in rows.items()} == {d: f"{f:016x}" for d, f in fps.items()}
    root = groups(sorted(set(fps.values())), 4)
    least = {}
    for d, f in fps.items():
        least[root[f]] = min(d, least.get(root[f], d))
    assert {d: r.component_id for d, r in rows.items()} == {d: least[root[f]] for d, f in fps.items()}


def test_op2(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = QUERIES["op2_mixing"](spark, SF)
    want = con.execute(ORACLES["op2_mixing"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def common(a, b):
    """The length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        above = row[:]
        for k, y in enumerate(b, 1):
            row[k] = above[k - 1] + 1 if x == y else max(above[k], row[k - 1])
    return row[-1]


def test_op3(spark, texts):
    """Every template that stands in a text word for word is found, and every finding has the coverage that it says."""
    from vellum.llm import licenses

    templates = {name: licenses.words(t.encode()) for name, t in licenses.TEMPLATES.items()}
    found_any = 0
    for d, r in run(spark, "op3_licenses").items():
        said = [x.rsplit(":", 3) for x in r.licenses.split(",")] if r.licenses else []
        assert r.n_licenses == len(said)
        ws = licenses.words(texts[d].encode())
        for name, coverage, start, stop in said:
            part = licenses.words(texts[d][int(start) : int(stop)].encode())
            best = common(templates[name], part)
            assert 0.8 <= float(coverage) <= round(best / len(templates[name]), 3) and len(part) <= 1.4 * len(templates[name]) + 2
        for name, t in templates.items():
            if any(ws[k : k + len(t)] == t for k in range(len(ws) - len(t) + 1)):
                found_any += 1
                assert any(x[0] == name and float(x[1]) == 1 for x in said)
    assert found_any >= 3


def test_op4(spark, texts):
    for d, r in run(spark, "op4_secrets").items():
        base = spans(texts[d])
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode())
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, *_ in base) for kind in ("assign", "access", "hex")]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))


def test_op5(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    for d, r in run(spark, "op5_bpe").items():
        ids = t.encode(texts[d], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)))
        assert r.decoded_sha256 == sha(t.decode(ids, skip_special_tokens=False).encode())


def test_op7(spark, texts):
    for d, r in run(spark, "op7_quality_rules").items():
        want = counts(texts[d])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_op8(spark, texts):
    for d, r in run(spark, "op8_matroska").items():
        raw = texts[d].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]))
        assert r.media_bytes > r.payload_bytes and r.media_sha256 == sha(matroska.write(payload))
        frames, n = len(payload) // 576, len(payload)
        x = [b - 128 for b in payload]
        turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        shape = ",".join(str(sum(b >> 4 == k for b in payload)) for k in range(16))
        head, cues, last, mean, square, *rest = r.feature.split(":")
        assert (int(head), int(cues), int(last)) == (frames, -(-frames // 256), frames * matroska.FRAME_MS)
        assert (int(mean), int(square), ":".join(rest)) == (sum(x) * 1000 // n, sum(b * b for b in x) * 1000 // n, f"{turns}:{shape}")


def test_op9(spark, texts):
    raw = [t.encode() for t in texts.values()]
    rows = run(spark, "op9_suffix_dedup")
    for d, b, kept in zip(texts, raw, left_over(raw, 400)):
        assert (rows[d].n_bytes, rows[d].n_removed, rows[d].kept_sha256) == (len(b), len(b) - len(kept), sha(kept))


def test_op10_and_op6(spark):
    """On the largest of the small tables: the smallest has 19 held-out labels, which tell little."""
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op10_quality_classifier"](spark, sf_dir).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for d, r in rows.items())
    held = [(r.predicted, labels[d].quality) for d, r in rows.items() if r.held_out and d in labels]
    assert len(held) > 800 and sum(p == y for p, y in held) >= 0.97 * len(held)
    toxic = {r.doc_id: r.predicted for r in QUERIES["op6_toxicity"](spark, sf_dir).collect()}
    assert set(toxic) == set(rows)
    found = [(toxic[d], r.toxic) for d, r in labels.items()]
    assert sum(p and not y for p, y in found) <= 0.005 * len(found) and sum(p and y for p, y in found) >= 0.9 * sum(y for _, y in found)
