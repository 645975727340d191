"""Every catalogue query against its DuckDB oracle, on the smallest tables."""

import math

import duckdb
import pytest

from tickerloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def canonical(rows):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(value, r)) for r in rows)


def test_every_query_has_an_oracle():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_oracle(spark, duck, data, name):
    got = catalogue.queries()[name](spark, data)
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    expected = [[r[i] for i in order] for r in want.fetchall()]
    assert sorted(got.columns) == columns
    assert canonical(map(tuple, got.select(*columns).collect())) == canonical(expected)
