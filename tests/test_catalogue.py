"""Every query with SQL gives what DuckDB gives."""

import duckdb
import pytest

from glyphloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted(columns), sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalogue.SQL[name])
    df = catalogue.QUERIES[name](spark, SF)
    assert rows(df.columns, map(tuple, df.collect())) == rows([c[0] for c in want.description], want.fetchall())
