import duckdb
import pytest

from quadrille.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    frame = queries.queries()[name](spark, SF)
    assert sorted(names) == sorted(frame.columns)
    want = sorted(map(repr, found.fetchall()))
    assert sorted(repr(tuple(r)) for r in frame.select(*names).collect()) == want
