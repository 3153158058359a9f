"""Compare a registered query with its SQL on a folder of tables."""

import os

import duckdb
from evidora.llm.queries import ORACLES, QUERIES


def check_query(spark, name, folder):
    got = QUERIES[name](spark, folder).toPandas()
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.sql(f"create view {file.split('.')[0]} as select * from '{folder}/{file}'")
    want = con.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = ([*map(tuple, df[columns].astype(str).sort_values(columns).to_numpy())] for df in (got, want))
    assert got == want
    return got
