import duckdb
import pytest

from millrace.llm import queries


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = queries.queries()[name](spark, d)
    want = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(repr([r[c] for c in names]) for r in df.collect())
    assert got == sorted(repr(list(r)) for r in want.fetchall())
