"""What the entity panels move: no row per entity and calendar day, no second shuffle of wide rows."""

import re
from datetime import date, timedelta

import pytest

from tests.session import make_session
from tidewater.operators import features as X
from tidewater.operators import panel as P


@pytest.fixture(scope="module")
def spark():
    return make_session("4", 4)


def days(n):
    return [date(2024, 1, 1) + timedelta(i) for i in range(n)]


def test_group_returns_hold_one_series_a_set_of_groups(spark):
    level = {"a": [100.0 + i * i for i in range(6)], "b": [100.0 - i for i in range(6)]}
    baskets = spark.createDataFrame([(g, d, v) for g, x in level.items() for d, v in zip(days(6), x)], "grp string, date date, basket_index double")
    members = [(g, e) for e in range(40) for g in (("a",), ("b",), ("b", "a"))[e % 3]]
    of, grouped = X.group_returns(baskets, spark.createDataFrame(members, "grp string, entity long"), 2)
    assert of.count() == 40 and grouped.count() == 3 * 6
    got = {(r["entity"], r["date"]): r["subind_ret"] for r in of.join(grouped, "grps").collect()}
    for e in range(40):
        for i, d in enumerate(days(6)):
            rets = [(level[g][i] / level[g][i - 2] - 1) * 100 for g in (("a",), ("b",), ("b", "a"))[e % 3]] if i > 1 else []
            want = sum(rets) / len(rets) if rets else None
            assert got[e, d] == (pytest.approx(want, abs=1e-9) if rets else None)


def test_market_median_does_not_shuffle_the_panel(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a panel and a table of unknown sizes
    rows = [(d, e, float(e * 7 % 5 + i)) for i, d in enumerate(days(4)) for e in range(9)]
    panel = spark.createDataFrame(rows, "date date, entity long, r5 double")
    out = P.with_market_median(panel, (5,))
    top = out._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in top
    for r in out.collect():
        values = sorted(v for d, _, v in rows if d == r["date"])
        assert r["mkt_ew_r5"] == values[4] and r["alpha5"] == r["r5"] - values[4]


def test_group_joins_do_not_shuffle_rows_by_entity(spark, tmp_path):
    """Membership has a known size, so it is sent to the rows."""
    from tidewater.sources.tables import Tables

    root = str(tmp_path)
    spark.createDataFrame([(e, e % 3) for e in range(30)], "s_suppkey long, s_nationkey int").write.parquet(f"{root}/supplier.parquet")
    spark.createDataFrame([(i, f"n{i}", 0) for i in range(3)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{root}/nation.parquet")
    spark.createDataFrame([(0, "r")], "r_regionkey int, r_name string").write.parquet(f"{root}/region.parquet")
    t = Tables(spark, root)
    for m in (t.membership, t.broad):
        assert m.count() == 30 and int(str(m._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 100_000
    joined = t.membership.join(t.raw("supplier").selectExpr("s_suppkey as entity"), "entity")
    assert "SortMergeJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_relative_strength_on_some_days_is_that_of_all_days(spark):
    from tidewater.operators import momentum as M

    prices = spark.createDataFrame([(d, e, 50.0 + (e * 13 + i * 7) % 11) for e in range(6) for i, d in enumerate(days(8))], "date date, entity long, close double")
    members = spark.createDataFrame([("ab"[e % 2], e) for e in range(6)], "grp string, entity long")
    some = spark.createDataFrame([(days(8)[i],) for i in (4, 7)], "date date")
    get = lambda df: {(r["date"], r["entity"], r["grp"]): r["rs_subind"] for r in df.collect()}
    whole = get(M.rs_vs_group(prices, members, 3))
    part = get(M.rs_vs_group(prices, members, 3, some))
    assert set(part) == {k for k in whole if k[0] in (days(8)[4], days(8)[7])}
    assert all(v == pytest.approx(whole[k], abs=1e-9) for k, v in part.items())


def test_rows_of_an_entity_are_shuffled_once_for_dividends_flows_and_windows(spark):
    schema = "date date, entity long, close double, volume double"
    px = [(d, e, 10.0 + e + i, 5.0) for i, d in enumerate(days(9)) for e in (1, 2, 3)] + [(days(9)[2], None, 4.0, 1.0), (None, 2, 4.0, 1.0), (days(9)[4], 1, 77.0, 1.0)]
    div = [(1, days(9)[1], 2.0), (1, days(9)[1], 0.5), (2, date(2023, 12, 1), 1.0), (3, date(2024, 3, 1), 9.0), (None, days(9)[2], 3.0)]
    nets = [(days(9)[3], 1, 7), (days(9)[4], 1, 8), (days(9)[2], None, 6), (date(2024, 3, 1), 2, 5)]
    prices, flows = spark.createDataFrame(px, schema), spark.createDataFrame(nets, "date date, entity long, foreign_net long")
    d = P.with_cumulative_dividends(prices, spark.createDataFrame(div, "entity long, ex_date date, cash double"), flows)
    plan = P.forward_levels(d)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning(entity") <= 4 and "hashpartitioning(entity#" in plan
    got = sorted(map(str, d.where("date is not null and entity is not null").collect()))
    net = {(x, e): v for x, e, v in nets}
    paid = {1: days(9)[1], 2: days(9)[0]}
    cash = {1: 2.5, 2: 1.0}
    want = [spark.createDataFrame([(x, e, c, v, net.get((x, e)), cash[e] if e in paid and x >= paid[e] else 0.0)], schema + ", foreign_net long, cum_div double").first() for x, e, c, v in px if x and e and c != 77.0]
    assert len(got) == 28 and set(map(str, want)) <= set(got)
    assert d.where("entity is null or date is null").where("foreign_net is not null").count() == 0


def test_the_wide_panel_is_not_written(spark, monkeypatch):
    """Medians of a date and returns against them are left to the reader: what is written has the rows' own columns."""
    seen = []
    monkeypatch.setattr(P, "cut", lambda df: seen.append(df.columns) or df)
    prices = spark.createDataFrame([(d, e, 10.0 + e, 5.0) for d in days(9) for e in (1, 2, 3)], "date date, entity long, close double, volume double")
    members = spark.createDataFrame([("a", 1), ("b", 2)], "grp string, entity long")
    panel = P.build_price_panel(prices, spark.createDataFrame([], "entity long, ex_date date, cash double"), None, members, horizons=(2,))
    assert {"alpha2", "mkt_ew_r2", "sub_industry"} <= set(panel.columns) and len(seen) == 2
    assert "sub_industry" in seen[0] and not any("alpha2" in x for x in seen)


def test_daily_ranks_shuffle_wide_rows(spark, tmp_path, monkeypatch):
    """Rows go by date before they become one per factor and target."""
    from tidewater.operators import stats as S
    from tidewater.plans import stats_plans as SP

    rows = [(d, e, float(e), float(e % 4), float(e * i % 7), float(e % 5), float(-e)) for i, d in enumerate(days(3)) for e in range(12)]
    panel = spark.createDataFrame(rows, "date date, entity long, ma20_dist_pct double, ma60_dist_pct double, vol_ratio double, alpha5 double, alpha20 double")
    monkeypatch.setattr(SP, "panel_of", lambda t: panel)
    keys, plans, found = ["factor", "target"], [], []
    for by_date in (False, True):
        d = S.daily_ic(SP.long_of(None, by_date=by_date), keys, "x", "y")
        plans.append(d._jdf.queryExecution().executedPlan().toString())
        found.append(sorted(map(tuple, d.selectExpr("factor", "target", "date", "round(ic, 9)", "n").collect())))
    assert found[0] == found[1] and len(found[0]) == 16  # vol_ratio is constant on the first day
    assert "hashpartitioning(date" in plans[1] and "hashpartitioning(factor" not in plans[1] and "hashpartitioning(factor" in plans[0]


def test_breadth_shuffles_a_row_once(spark):
    from tidewater.operators import flows as W

    fi = spark.createDataFrame([(e, i, (e * i) % 5 - 2, i % 3 - 1) for e in range(4) for i in range(9)], "entity long, idx long, total_net long, foreign_net long")
    members = spark.createDataFrame([("a", e) for e in range(4)], "grp string, entity long")
    d = W._breadth(fi, members, None)
    assert not re.search(r"hashpartitioning\(entity#\d+L, idx", d._jdf.queryExecution().executedPlan().toString())
    on, want = {}, {}
    for e in range(4):
        net = {i: (e * i) % 5 - 2 for i in range(9)}
        state = [int(sum(net.get(j, 0) for j in range(i - 4, i + 1)) > 0) for i in range(14)]
        for i in range(14):
            want[i] = want.get(i, 0) + state[i] - (state[i - 1] if i else 0)
    got = {r["idx"]: r["d_flow_breadth_5d"] for r in d.collect()}
    assert {i: v for i, v in got.items() if v} == {i: v for i, v in want.items() if v}


def test_pool_joins_rows_of_the_weeks_only(spark, tmp_path, monkeypatch):
    """The days between are gone before the pool's rows are joined; lags and lows still see them."""
    from tidewater.plans import cell_plans, outcome_plans as OP
    from tidewater.sources.tables import Tables

    closes = {d: 50.0 + (i * 7) % 11 for i, d in enumerate(days(20))}
    panel = spark.createDataFrame([(d, 1, c, 2e6, 0.1, 1.0) for d, c in closes.items()], "date date, entity long, close double, volume double, ma20_dist_pct double, vol_ratio double")
    fridays = [d for d in closes if d.isocalendar()[2] == 5]
    weeks = spark.createDataFrame([(d,) for d in fridays], "date date")
    rows = spark.createDataFrame([(d, 1, "a", 0.5, 60.0) for d in fridays], "date date, entity long, grp string, ma60_dist_pct double, trend_score double")
    spark.createDataFrame([(1, 500.0)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    plans = []
    monkeypatch.setattr(OP, "panel_of", lambda t: panel)
    monkeypatch.setattr(OP.P, "weekly_dates", lambda p: weeks)
    monkeypatch.setattr(cell_plans, "srows_of", lambda t: rows)
    monkeypatch.setattr(OP, "staged", lambda s, r, n, build: plans.append(build()) or plans[-1])
    t = Tables(spark, str(tmp_path))
    t.__dict__["prices"] = None
    d = OP.pool_of(t)
    assert "_wk" in d._jdf.queryExecution().optimizedPlan().toString()
    for r in d.collect():
        own = [c for x, c in closes.items() if x <= r["date"]]
        assert r["low_60d"] == min(own) and r["close"] == own[-1] and r["amount_million"] == own[-1] * 2 and r["price_discontinuity"] == (abs(own[-1] / own[-2] - 1) * 100 > 9)
    assert len(d.collect()) == len(fridays)


def test_an_entity_listed_twice_counts_once_in_the_median(spark):
    prices = spark.createDataFrame([(d, e, 10.0 + i * e, 5.0) for i, d in enumerate(days(5)) for e in (1, 2, 3)], "date date, entity long, close double, volume double")
    flows = spark.createDataFrame([(days(5)[0], 1, 7, 8, 9)], "date date, entity long, foreign_net long, trust_net long, dealer_net long")
    div = spark.createDataFrame([], "entity long, ex_date date, cash double")
    once = [(1, "m"), (2, "m"), (3, "m")]
    at = lambda mk: P.build_price_panel(prices, div, flows, None, spark.createDataFrame(mk, "entity long, market string"), horizons=(1,)).where(f"date = '{days(5)[0]}'").collect()
    a, b = at(once), at([*once, (3, "m"), (3, "z")])
    assert (len(a), len(b)) == (3, 5) and "_again" not in a[0].asDict()
    assert {r["mkt_ew_r1"] for r in a} == {r["mkt_ew_r1"] for r in b} and len({r["alpha1"] for r in b}) == 3
