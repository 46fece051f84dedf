"""The operators' queries against their SQL."""

import duckdb
import pytest

from kbspark.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = Q.QUERIES[name](spark, sf).toPandas(), con.sql(Q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(tuple, got[cols].astype(str).to_numpy())) == sorted(map(tuple, want[cols].astype(str).to_numpy()))
