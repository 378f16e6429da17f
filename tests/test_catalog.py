import duckdb
import pytest

import __spark_entry__ as entry
from tidemill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tidy(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert tidy(df.select(*(f"`{c}`" for c in names)).collect()) == tidy(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert {*catalog.queries()} <= {*entry.queries()}
    assert {*entry.oracle_sql()} <= {*entry.queries()}
