"""Every query with SQL gives the rows that DuckDB gives for it."""

import math

import duckdb
import pytest

from graphloom.queries import flow, items, programs, sets, trees

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages"
QUERIES = trees.QUERIES | sets.QUERIES | flow.QUERIES | programs.QUERIES | items.QUERIES
ORACLE = trees.ORACLE | sets.ORACLE | flow.ORACLE | programs.ORACLE | items.ORACLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(got.columns)
    want = sorted((tuple(plain(v) for v in r) for r in cur.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str) == want


def test_all_queries_have_sql_or_a_test_of_their_own():
    assert set(QUERIES) - set(ORACLE) == {"provenance_fold", "perm_masked", "glob_equal_runs", "nested_hashes", "scc_all_parts"}


def test_components_of_all_parts(spark):
    after, back = {}, {}
    for r in trees._rings(spark, SF, "true").collect():
        after.setdefault(r.src, set()).add(r.dst)
        back.setdefault(r.dst, set()).add(r.src)

    def reached(start, hop, inside):
        seen, todo = {start}, [start]
        while todo:
            for y in hop.get(todo.pop(), ()):
                if y in inside and y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    left, want = {r.p_partkey for r in spark.read.parquet(f"{SF}/part.parquet").collect()}, {}
    while left:
        i = min(left)
        both = reached(i, after, left) & reached(i, back, left)
        want |= dict.fromkeys(both, i)
        left -= both
    assert {r.id: r.component for r in trees.scc_all_parts(spark, SF).collect()} == want
