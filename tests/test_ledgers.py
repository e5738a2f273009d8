"""Breach lookup, Gram edges, recall check and the frozen ledger against plain Python."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.session import make_session
from tidewater.operators import groups as G
from tidewater.operators import outcome as O
from tidewater.operators.breach import first_below
from tidewater.streaming import forms as T

D0 = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def spark():
    return make_session("4", 4)


def test_first_below_over_all_levels(spark):
    rnd = random.Random(5)
    series = {}
    for k, n in (("long", 9000), ("short", 3), ("block", 64)):
        # Falls slowly with noise, so breaches lie from one to thousands of places ahead.
        series[k] = [1000 - i / 10 + rnd.randint(-5, 5) for i in range(n)]
    rows = [(k, i + 1, float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    marks = []
    for m in range(300):
        k = rnd.choice(["long"] * 6 + ["short", "block", "absent"])
        n = len(series.get(k, [0]))
        at = rnd.randint(1, n)
        marks.append((m, k, at, rnd.choice([float(1000 - rnd.randint(0, 950)), series.get(k, [0.0])[at - 1] - rnd.random()])))
    marks += [(300, "long", None, 500.0), (301, "long", 1, None), (302, "long", 1, -1e9), (303, "long", 9000, 1e9), (304, "short", 4, 1e9), (305, None, 1, 5.0)]
    got = {r["m"]: r["hit"] for r in first_below(
        spark.createDataFrame(marks, "m long, k string, at long, lv double"), spark.createDataFrame(rows, "k string, i long, v double"), "k", "at", "lv", "hit").collect()}
    want = {}
    for m, k, at, lv in marks:
        vs = series.get(k, [])
        want[m] = None if at is None or lv is None else next((i + 1 for i in range(at - 1, len(vs)) if vs[i] < lv), None)
    assert got == want and any(w and w > 4200 for w in want.values())


def test_gram_edges_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(G, "GRAM_NAMES", 7)
    rng = np.random.default_rng(3)
    common = rng.normal(0, 0.01, 90)
    rows = []
    for e in range(30):
        price = 100.0
        for i in range(90):
            if e == 29 or rng.random() < 0.8:  # names miss days; the last never moves
                price = price if e == 29 else price * (1 + common[i] * (e % 3) + rng.normal(0, 0.01))
                rows.append((D0 + dt.timedelta(days=i), e, float(price), 10.0))
    prices = spark.createDataFrame(rows, "date date, entity long, close double, volume double")
    held = spark.createDataFrame([(e,) for e in [*range(1, 30), 5, 77, None]], "entity long")
    got = {(r["a"], r["b"]): (r["n"], round(r["rho"], 9)) for r in G.correlation_edges(prices, held, 60, 20, 0.25).collect()}
    rets = {}
    for e in range(1, 30):
        own = [(d, c) for d, x, c, _ in rows if x == e]
        rets[e] = dict([(d, min(0.1, max(-0.1, c / p - 1))) for (_, p), (d, c) in zip(own, own[1:])][-60:])
    want = {}
    for a in rets:
        for b in rets:
            days = sorted(set(rets[a]) & set(rets[b]))
            if a < b and len(days) >= 20:
                x, y = (np.array([rets[e][d] for d in days]) for e in (a, b))
                if x.std() * y.std() > 1e-12 and abs(np.corrcoef(x, y)[0, 1]) >= 0.25:
                    want[(a, b)] = (len(days), round(float(np.corrcoef(x, y)[0, 1]), 9))
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-8 for k in want)


def test_gram_edges_of_nothing(spark):
    prices = spark.createDataFrame([], "date date, entity long, close double, volume double")
    assert G.correlation_edges(prices, spark.createDataFrame([], "entity long"), 60, 20, 0.25).collect() == []


def _recall(spark, rets, tagged, n_weeks=1):
    picks = [(f"w{i % n_weeks}", i, "opportunity", "T-x" if i in tagged else None, D0 + dt.timedelta(days=7 * (i % n_weeks))) for i in range(len(rets[10]))]
    rows = [(f"w{i % n_weeks}", i, "opportunity", h, "matured", r, r) for h, rs in rets.items() for i, r in enumerate(rs)]
    rows += [("w0", 0, "core", 10, "matured", 99.0, 99.0), ("w0", 1, "opportunity", 10, "delisted", None, None)]
    return O.recall_check(spark.createDataFrame(rows, "week string, entity long, layer string, hold int, status string, return_pct double, excess_pct double"),
                          spark.createDataFrame(picks, "week string, entity long, layer string, thesis_tag string, data_date date"), "T-").orderBy("hold").collect()


def test_recall_check(spark):
    low = [-1.0] * 10 + [2.0] * 10
    d = _recall(spark, {10: low, 20: low}, set(range(10)))
    assert [(r["n_tagged"], r["n_left"], r["alpha_left"], r["win_other"], r["eligible"], r["warn"]) for r in d] == [(10, 10, -1.0, 1.0, True, True)] * 2
    # one hold is not worse: no warning
    assert not any(r["warn"] for r in _recall(spark, {10: low, 20: low[::-1]}, set(range(10))))
    # too few tagged and too early; enough weeks instead
    assert not any(r["eligible"] for r in _recall(spark, {10: low, 20: low}, {0}))
    assert all(r["eligible"] and r["warn"] for r in _recall(spark, {10: low, 20: low}, {0}, 14))
    # an empty group never warns
    assert [(r["n_left"], r["n_comparable"], r["warn"]) for r in _recall(spark, {10: low, 20: low}, set(range(20)))] == [(20, 0, False)] * 2


def test_frozen_ledger_over_batches(spark, tmp_path):
    day = lambda n: D0 + dt.timedelta(days=n)
    schema = "week string, data_date date, entity long, layer string, now date"
    f1 = spark.createDataFrame([(1, day(0), 0.5), (2, day(-1), 9.0), (3, day(7), 1.5)], "entity long, date date, f1 double")
    twice = spark.createDataFrame([(8, day(0), 1.0), (8, day(0), 2.0)], "entity long, date date, f2 double")
    work = T.frozen_batch(f"{tmp_path}/l", f"{tmp_path}/r", {"f1": f1, "f2": twice}, 14)

    def send(n, rows, times=1):
        for _ in range(times):
            work(spark.createDataFrame(rows, schema), n)

    def table():
        return {(str(r["week"]), r["entity"], r["layer"], r["f1"]) for r in spark.read.parquet(f"{tmp_path}/l").collect()}

    def refused(n):
        return {(r["week"], r["reason"]) for r in spark.read.parquet(f"{tmp_path}/r/batch={n}").collect()}

    a = [("a", day(0), 1, "x", day(3)), ("a", day(0), 2, "x", day(3))]
    send(0, [*a, ("b", day(7), 3, "y", day(21)), ("c", day(7), 4, "y", day(22)), ("d", None, 5, "z", day(1)), ("e", day(0), 8, "z", day(1)),
             ("g", day(0), 1, "z", day(1)), ("g", day(1), 2, "z", day(1)), ("h", day(0), 1, "z", None)])
    first = {("a", 1, "x", 0.5), ("a", 2, "x", None), ("b", 3, "y", 1.5)}
    assert table() == first and refused(0) == {("c", "late"), ("d", "no_date"), ("e", "rows"), ("g", "dates"), ("h", "late")}
    # after the deadline of the ledger's own date nothing changes, whatever date the new rows claim
    send(1, [("a", day(30), 1, "changed", day(31))])
    assert table() == first and refused(1) == {("a", "late")}
    # in time the week is replaced as a whole, and a replay changes nothing
    send(2, [("a", day(0), 1, "new", day(14))], 2)
    assert table() == {("a", 1, "new", 0.5), ("b", 3, "y", 1.5)} and refused(2) == set()
    send(3, [])
    assert len(table()) == 2


def test_factors_of_a_frozen_ledger_are_not_broadcast(spark, tmp_path):
    from tidewater.operators.outcome import with_frozen

    rows = spark.createDataFrame([(1, dt.date(2024, 1, 5)), (2, dt.date(2024, 1, 5)), (1, dt.date(2024, 1, 12))], "entity int, data_date date")
    spark.createDataFrame([(1, dt.date(2024, 1, 5), 0.5), (2, dt.date(2024, 1, 12), 0.7)], "entity int, date date, f double").write.parquet(f"{tmp_path}/f")
    d = with_frozen(rows, {"f": spark.read.parquet(f"{tmp_path}/f")})
    assert sorted(tuple(r) for r in d.select("entity", "data_date", "f").where("f is not null").collect()) == [(1, dt.date(2024, 1, 5), 0.5)]
    assert d.count() == 3
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()


def test_frozen_ledger_holds_all_names_with_whole_windows(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry
    from tests.oracle_check import compare, table

    rnd = random.Random(9)
    lines = [(o * 1000 + i, o, 1, i % 3 + 1, float(rnd.randint(1, 50)), 40000.0 + 3000 * o + 10 * min(i, 400 - i) + rnd.randint(0, 50), rnd.choice([0.0, 0.05, 0.1]), 0.02, rnd.choice("NRA"), rnd.choice("FO"), dt.datetime(2020, 1, 1) + dt.timedelta(days=i))
             for o in range(1, 10) for i in range(300 if o < 9 else 120)]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
        "supplier": ([(o, o % 2, 100.0) for o in range(1, 10)], "s_suppkey long, s_nationkey int, s_acctbal double"),
        "nation": ([(0, "a", 0), (1, "b", 0)], "n_nationkey int, n_name string, n_regionkey int"), "region": ([(0, "r")], "r_regionkey int, r_name string")}
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    d = entry.queries()["out12_frozen_ledger"](spark, str(tmp_path))
    got = d.collect()
    per_week = {w: sum(r["week"] == w for r in got) for w in {r["week"] for r in got}}
    assert max(per_week.values()) == 9 and {r["entity"] for r in got} == set(range(1, 10))
    assert any(r["mom_6_1"] is not None for r in got) and any(r["high52_near"] not in (None, 1.0) for r in got)
    cur = con.execute(entry.oracle_sql()["out12_frozen_ledger"])
    assert compare(table(d.columns, got), table([x[0] for x in cur.description], cur.fetchall())) is None
