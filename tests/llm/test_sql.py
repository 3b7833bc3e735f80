"""Registered queries of the training-data operators against their SQL on DuckDB."""

import duckdb
import pytest

from plumbline.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(d[0] for d in cur.description)
    want = [tuple(row[[d[0] for d in cur.description].index(c)] for c in columns) for row in cur.fetchall()]
    got = queries.QUERIES[name](spark, SF).select(*columns)
    assert len(want) > 0 and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
