import duckdb
import pytest

from tracewright.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(map(str, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()))
    assert rows
    if name in ORACLE_SQL:
        want = con.execute(ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == columns
        assert rows == sorted(tuple(map(str, (dict(zip(names, r, strict=True))[c] for c in columns))) for r in want.fetchall())
