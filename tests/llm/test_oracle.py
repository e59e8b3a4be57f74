import duckdb
import pytest

from graphloom.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in cur.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(cols) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == sorted(cur.fetchall(), key=str)
