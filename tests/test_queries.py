"""Every query with SQL gives the rows of its SQL."""

import duckdb
import pytest

from cleanlake.functions.urls import parse_url
from cleanlake.plans import data_queries, operator_queries  # noqa: F401  (they add their queries)
from cleanlake.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted(map(tuple, frame[names].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name in plans.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        assert rows_of(got) == rows_of(con.execute(plans.ORACLES[name]).df())


def test_joined_links_leaves_its_sql_only_where_that_names_no_url(spark, tmp_path):
    """Ids about the first that need five hexadecimal digits: the SQL of one link in 13 writes an IPv6 address that has no reading."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE pages AS SELECT page_id + shift AS page_id, url, html FROM read_parquet('{SF}/pages.parquet'), (SELECT unnest([0, 65490, 65540, 131050, 1000000]) AS shift)")
    con.execute(f"COPY pages TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    got = {r.page_id: r.href for r in plans.QUERIES["joined_links"](spark, str(tmp_path)).collect()}
    want = dict(con.execute(plans.ORACLES["joined_links"]).fetchall())
    differ = [i for i in want if got[i] != want[i]]
    assert len(want) == 250 and got.keys() == want.keys() and all(i % 13 == 12 and i >= 65535 for i in differ)
    assert all(got[i] is None and parse_url(want[i], None) is None for i in differ)


def test_joined_links_follows_its_sql_beyond_three_bytes(spark, tmp_path):
    """Ids about the first that three bytes of an IPv4 address do not hold; rows of the link above are left to that test."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE pages AS SELECT page_id + shift AS page_id, url, html FROM read_parquet('{SF}/pages.parquet'), (SELECT unnest([16777190, 16777240, 33554400, 1000000000, 5000000000]) AS shift)")
    con.execute(f"COPY pages TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    got = {r.page_id: r.href for r in plans.QUERIES["joined_links"](spark, str(tmp_path)).collect()}
    want = dict(con.execute(plans.ORACLES["joined_links"]).fetchall())
    assert len(want) == 250 and got.keys() == want.keys() and sum(i % 13 == 11 and i >= 1 << 24 for i in want) > 10
    assert {i: got[i] for i in got if i % 13 != 12} == {i: want[i] for i in want if i % 13 != 12}
