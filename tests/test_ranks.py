"""Ranks and quantiles against plain Python, and how often their rows are shuffled."""

import random
from datetime import date

import numpy as np
import pytest

from tests.session import make_session
from tidewater.operators import order as O
from tidewater.operators import stats as S


@pytest.fixture(scope="module")
def spark():
    return make_session("4", 4)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def ranks(v):
    return [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]


@pytest.mark.parametrize("hot", [100_000, 20])
def test_pooled_spearman_shuffles_a_row_twice_and_is_exact(spark, monkeypatch, hot):
    """Ties, a hot value spread over tasks (the low limit) and two groups."""
    monkeypatch.setattr(O, "HOT", hot)
    rnd = random.Random(3)
    rows = [(g, rnd.choice([0.0, 0.0, 1.5, round(rnd.gauss(0, 3), 1)]), rnd.choice([-2.0, rnd.gauss(0, 1)])) for g in "ab" for _ in range(150)]
    df = S.spearman(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y")
    assert shuffles(df) <= 3  # by the cells of x, by the cells of y, the sums of a group
    for r in df.collect():
        x, y = zip(*[v[1:] for v in rows if v[0] == r["g"]])
        assert r["n"] == 150 and r["ic"] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1], abs=1e-9)


def test_daily_ic_shuffles_a_row_once(spark):
    rnd = random.Random(4)
    rows = [(date(2020, 1, d), rnd.choice([None, float(rnd.randint(-3, 3))]), rnd.gauss(0, 1)) for d in (1, 2, 3) for _ in range(60)]
    df = S.daily_ic(spark.createDataFrame(rows, "date date, x double, y double"), [], "x", "y")
    assert shuffles(df) == 1
    for r in df.collect():
        x, y = zip(*[v[1:] for v in rows if v[0] == r["date"] and v[1] is not None])
        assert r["n"] == len(x) and r["ic"] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1], abs=1e-9)


def test_quantile_rows_are_not_shuffled_to_find_their_cells(spark):
    """The wanted cells, a few a group, are broadcast; before, every row was shuffled to meet them."""
    rnd = random.Random(5)
    rows = [(g, rnd.choice([None, 0.0, rnd.gauss(0, 5)])) for g in "ab" for _ in range(201)]
    df = O.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"m": 0.5, "q": 0.9}, "n")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
    for r in df.collect():
        v = [x for g, x in rows if g == r["g"] and x is not None]
        assert r["n"] == len(v) and [r["m"], r["q"]] == pytest.approx(list(np.quantile(v, [0.5, 0.9])))


def test_flows_join_narrow_prices(spark, monkeypatch):
    """Flows come along with the prices, so the wide panel is not shuffled once more to meet them."""
    from tidewater.operators import panel as P

    seen = []
    monkeypatch.setattr(P, "cut", lambda df: seen.append(df.columns) or df)
    days = [date(2020, 1, d) for d in range(1, 9)]
    prices = spark.createDataFrame([(d, e, 10.0 + e, 5.0) for d in days for e in (1, 2)], "date date, entity long, close double, volume double")
    div = spark.createDataFrame([], "entity long, ex_date date, cash double")
    flows = spark.createDataFrame([(days[0], 1, 7, 8, 9)], "date date, entity long, foreign_net long, trust_net long, dealer_net long")
    P.build_price_panel(prices, div, flows, horizons=(5,))
    assert "foreign_net" in seen[0]
