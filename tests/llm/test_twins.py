import os

import duckdb
import pytest

from tabwise.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_equal_the_twin(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    want = found.fetchall()
    got = queries.queries()[name](spark, SF)
    assert set(got.columns) == set(columns) and want

    def ordered(rows):
        return sorted(rows, key=repr)
    assert ordered(tuple(r) for r in got.select(*columns).collect()) == ordered(want)
