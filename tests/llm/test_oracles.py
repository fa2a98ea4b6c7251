"""Every query with SQL gives the rows of its SQL."""

import duckdb
import pytest

from cleanlake.llm import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted(map(tuple, frame[names].convert_dtypes().astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query(spark, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name in plans.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        assert rows_of(got) == rows_of(con.execute(plans.ORACLES[name]).df())
