"""A spread of registered queries against their SQL on the small tables."""

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from tests.oracle_check import TABLES, compare, table  # noqa: E402
from tests.session import make_session  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = ["pan01_forward_panel", "pan05_total_return", "mom09_trajectory", "flw01_group_fund_flows", "sta02_daily_ic", "cal02_ambush_episodes", "reg06_traffic_light", "val05_self_medians", "src03_institutional_feed", "str01_light_stream"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(con, name):
    spark = make_session("4", 4)
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    want = table([d[0] for d in cur.description], cur.fetchall())
    assert compare(table(df.columns, df.collect()), want) is None


def test_entry_and_registry():
    assert not entry.entry(make_session("4", 4)).isEmpty()
    assert set(entry.oracle_sql()) <= set(entry.queries())
