import duckdb
import pytest
from test_oracles import canonical

from tickerloom.llm import oracles, queries


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 11)}


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_oracle(spark, data, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = con.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, data)
    assert sorted(got.columns) == sorted(names)
    assert canonical(map(tuple, got.select(*names).collect())) == canonical(want.fetchall())
