"""Every query that has SQL gives the rows that DuckDB gives, on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{float(value):.6g}" if isinstance(value, float) or type(value).__name__ == "Decimal" else str(value)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = rows(df.columns, df.collect())
    result = duck.execute(entry.oracle_sql()[name])
    assert got == rows([c[0] for c in result.description], result.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_components_equal_union_find(spark, duck):
    edges = duck.execute("SELECT l_orderkey, l_partkey + 1000000000 FROM lineitem").fetchall()
    part = {}

    def find(x):
        part.setdefault(x, x)
        while part[x] != x:
            part[x] = part[part[x]]
            x = part[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        part[y] = x
    got = {r["node"]: r["component"] for r in entry.queries()["g08_components"](spark, DATA).collect()}
    assert got == {x: find(x) for x in part}
