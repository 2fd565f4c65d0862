import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.engine.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(str([round(v[k], 6) if isinstance(v[k], float) else v[k] for k in order]) for v in values)


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([d[0] for d in want.description], want.fetchall())
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(NAMES) - set(entry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = entry.engine.QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() == 200


def test_stream_equals_batch(spark, tmp_path):
    from vellum.plans import audit
    from vellum.plans.queries import RULES_HERE
    from vellum.sources.documents import decorated_lines
    from vellum.streaming.audit_stream import current, start

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    checks = audit.LAYOUT + audit.SEMANTIC
    start(spark, str(tmp_path / "in"), docs.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), str(tmp_path / "out"), str(tmp_path / "ck"), RULES_HERE, checks, decorated_lines).awaitTermination()
    want = audit.audit(decorated_lines(docs), RULES_HERE, checks)
    assert sorted(map(tuple, current(spark, str(tmp_path / "out")).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
