import os

import duckdb
import pytest

from trivium.llm import merkle, store
from trivium.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _norm(v):
    return f"{v:.9g}" if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(_norm(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(map(_norm, r)) for r in result.fetchall())


def test_audit_with_all_kinds_of_damage_equals_its_sql(spark):
    sql = ORACLES["op1_merkle_audit"].replace("% 97 ", "% 20 ").replace("% 9973 ", "% 40 ").replace("/ 512", "/ 32")
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    got = merkle.audit_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), 32, 20, 40).collect()
    assert sorted(tuple(_norm(r[c]) for c in columns) for r in got) == sorted(tuple(map(_norm, r)) for r in result.fetchall())
    assert {r.kind for r in got} == {"changed", "missing", "extra", "moved"}


def test_tables_are_written_once_and_released(spark):
    df = store.materialize(spark.range(5), "numbers")
    assert df.count() == 5 and os.path.isdir(df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
    assert store.release(spark) >= 1 and store.release(spark) == 0
