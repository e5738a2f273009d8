"""Hand frames for the null, tie, gap and tail rules, against brute force."""

from __future__ import annotations

import datetime as dt
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tests.session import make_session
from tidewater.functions import labels as L
from tidewater.functions.exprs import own_rows, with_whole_z
from tidewater.operators import episodes as E
from tidewater.operators import flows as W
from tidewater.operators import groups as G
from tidewater.operators import outcome as O
from tidewater.operators import panel as P
from tidewater.operators import ranking as K
from tidewater.operators import regime as R
from tidewater.operators import valuation as V
from tidewater.operators.order import average_rank, exact_quantiles
from tidewater.operators.resample import block_bootstrap
from tidewater.sources import feeds as S
from tidewater.streaming import forms as T

D0 = dt.date(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    return make_session("4", 4)


def day(i):
    return D0 + dt.timedelta(days=i)


def test_average_rank_with_ties_nulls_and_a_hot_value(spark):
    rnd = random.Random(1)
    rows = [("a", float(rnd.choice([0.0, 0.0, 0.0, rnd.uniform(-5, 5)]))) for _ in range(300)] + [("b", None), ("b", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("i", F.monotonically_increasing_id())
    got = {r["i"]: r["r"] for r in average_rank(df, ["g"], "v", "r").collect()}
    data = df.collect()
    for r in data:
        if r["v"] is None:
            assert got[r["i"]] is None
            continue
        same = [x["v"] for x in data if x["g"] == r["g"] and x["v"] is not None]
        below = sum(v < r["v"] for v in same)
        ties = sum(v == r["v"] for v in same)
        assert got[r["i"]] == below + (ties + 1) / 2


def test_exact_quantiles_match_sorted_lists(spark):
    rnd = random.Random(2)
    rows = [(g, rnd.choice([rnd.gauss(0, 10), 1.0, -1e-9])) for g in "abc" for _ in range(rnd.randint(1, 120))]
    df = spark.createDataFrame(rows, "g string, v double")
    out = exact_quantiles(df, ["g"], "v", {"med": 0.5, "p90": 0.9}, "n").collect()
    for r in out:
        vals = sorted(v for g, v in rows if g == r["g"])
        assert r["n"] == len(vals)
        assert r["med"] == pytest.approx(statistics.median(vals), abs=1e-12)
        pos = 0.9 * (len(vals) - 1)
        lo = int(pos)
        hi = min(lo + 1, len(vals) - 1)
        assert r["p90"] == pytest.approx(vals[lo] + (vals[hi] - vals[lo]) * (pos - lo), abs=1e-9)


def test_bootstrap_is_repeatable_and_short_series_give_null(spark):
    long = [("x", day(i), float(i % 7)) for i in range(40)] + [("y", day(i), 1.0) for i in range(5)]
    df = spark.createDataFrame(long, "k string, date date, v double")
    a = {r["k"]: r for r in block_bootstrap(df, ["k"], "date", "v", 5, 200).collect()}
    b = {r["k"]: r for r in block_bootstrap(df.repartition(3), ["k"], "date", "v", 5, 200).collect()}
    assert a["x"]["ci_lo"] == b["x"]["ci_lo"] and a["x"]["ci_lo"] <= a["x"]["mean"] <= a["x"]["ci_hi"]
    assert a["y"]["ci_lo"] is None


def test_forward_return_enters_next_row_and_rolls_dividend_forward(spark):
    px = spark.createDataFrame([(day(d), 1, c, 1.0) for d, c in ((0, 10.0), (2, 20.0), (4, 30.0), (6, 40.0))], "date date, entity long, close double, volume double")
    div = spark.createDataFrame([(1, day(3), 5.0)], "entity long, ex_date date, cash double")
    rows = P.forward_levels(P.with_cumulative_dividends(px, div), (1,), ()).orderBy("date").collect()
    assert rows[0]["r1"] == pytest.approx((30 - 20 + 5) / 20 * 100)
    assert rows[1]["r1"] == pytest.approx((40 - 30) / 30 * 100)
    assert rows[2]["r1"] is None


def test_total_return_is_null_across_an_invalid_event(spark):
    px = spark.createDataFrame([(day(i), 1, 10.0) for i in range(5)], "date date, entity long, close double")
    ev = spark.createDataFrame([(1, day(2), 2.0), (1, day(4), None)], "entity long, ex_date date, adj double")
    r = P.total_return_targets(px, ev, (1,)).orderBy("date").collect()
    assert r[0]["r1"] == pytest.approx(100.0) and r[2]["r1"] is None and r[2]["bad_evt_1"]


def test_whole_number_z_equals_the_sliding_definition(spark):
    rnd = random.Random(3)
    vals = [5] * 10 + [rnd.randint(-50, 50) for _ in range(60)]
    df = spark.createDataFrame([(1, day(i), v) for i, v in enumerate(vals)], "entity long, date date, x long")
    got = [r["x_z"] for r in with_whole_z(df, own_rows(), ["x"], 12, 6).orderBy("date").collect()]
    for i in range(len(vals)):
        win = vals[max(0, i - 11):i + 1]
        sd = statistics.stdev(win) if len(win) > 1 else 0
        want = (vals[i] - statistics.mean(win)) / sd if len(win) >= 6 and sd > 0 else None
        assert (got[i] is None) == (want is None)
        if want is not None:
            assert got[i] == pytest.approx(want, abs=1e-9)


def test_greedy_cooldown(spark):
    rnd = random.Random(4)
    pos = sorted(rnd.sample(range(200), 70))
    got = sorted(r["i"] for r in E.cooled_starts(spark.createDataFrame([("k", p) for p in pos], "k string, i int"), "k", 7).collect())
    want, last = [], -10**9
    for p in pos:
        if p > last + 7:
            want.append(p)
            last = p
    assert got == want


def test_group_flows_match_a_dense_grid(spark):
    rnd = random.Random(5)
    ents, days = [1, 2, 3], list(range(0, 60, 2))
    rows = {(e, d): (rnd.randint(-9, 9), rnd.randint(-9, 9), rnd.randint(-9, 9)) for e in ents for d in days if rnd.random() < 0.4}
    rows[(1, 0)] = (1, 1, 1)
    fl = spark.createDataFrame([(day(d), e, *v, sum(v)) for (e, d), v in rows.items()], "date date, entity long, foreign_net long, trust_net long, dealer_net long, total_net long")
    mem = spark.createDataFrame([("g", 1), ("g", 2), ("h", 2), ("h", 3)], "grp string, entity long")
    got = {(r["grp"], r["date"]): r for r in W.group_fund_flows(mem, fl).collect()}
    cal = sorted({d for _, d in rows})
    for g, ms in {"g": (1, 2), "h": (2, 3)}.items():
        for i, d in enumerate(cal):
            s20 = [sum(sum(rows.get((e, x), (0, 0, 0))) for x in cal[max(0, i - 19):i + 1]) for e in ms]
            r = got[(g, day(d))]
            assert r["net_flow_20d"] == sum(s20) and r["flow_breadth_20d"] == pytest.approx(sum(x > 0 for x in s20) / len(ms))


def test_decumulation_needs_the_exact_previous_quarter(spark):
    y = spark.createDataFrame([(1, 2020, 1, 10.0, 50.0, 1.0, 2.0), (1, 2020, 3, 40.0, 50.0, 3.0, 2.0)], "entity long, year int, quarter int, revenue double, m double, eps double, bvps double")
    r = {x["quarter"]: x for x in W.decumulate(y, ["m"]).collect()}
    assert r[1]["revenue"] == 10.0 and r[3]["revenue"] is None and r[3]["eps"] is None


def test_stop_price_patterns(spark):
    texts = ["收盤跌破41.5(MA60)、隔日未收復出場", "收盤確認跌破 MA60 20.35、隔日未收復出場", "未定", "跌破 5 日線 33"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(O.stop_price(F.col("t"))).collect()]
    assert got == [41.5, 20.35, None, 33.0]


def test_leave_self_out_median(spark):
    rnd = random.Random(6)
    rows = [(g, i, float(rnd.randint(1, 6))) for g in ("a", "b") for i in range(rnd.randint(6, 11))]
    df = spark.createDataFrame(rows, "grp string, entity long, v double")
    for r in V.leave_self_out_median(df, ["grp"], "v", "m", 3).collect():
        rest = [v for g, i, v in rows if g == r["grp"] and i != r["entity"]]
        assert r["m"] == pytest.approx(statistics.median(rest))


def test_capped_selection_equals_the_sequential_rule(spark):
    rnd = random.Random(7)
    rows = [("w", i, rnd.choice("abcd"), [rnd.choice("xyz")], rnd.randint(1, 3), rnd.random(), rnd.random(), rnd.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "week string, entity long, grp string, clusters array<string>, trend_bucket int, band_dist double, trend_score double, amount_million double")
    got = {r["entity"]: (r["rank"], r["cap_reason"]) for r in K.capped_selection(df, 2, 3, 6).collect()}
    n, seen, busy = 0, {}, {}
    for r in sorted(rows, key=lambda r: (r[4], r[5], -r[6], -r[7], r[1])):
        if seen.get(r[2], 0) >= 2:
            want = (None, K.CAP_SUB)
        elif any(busy.get(c, 0) >= 3 for c in r[3]):
            want = (None, K.CAP_CLUSTER)
        elif n >= 6:
            want = (None, K.BEYOND)
        else:
            n += 1
            seen[r[2]] = seen.get(r[2], 0) + 1
            for c in r[3]:
                busy[c] = busy.get(c, 0) + 1
            want = (n, None)
        assert got[r[1]] == want


def test_lights_batch_and_single_step_agree(spark):
    rnd = random.Random(8)
    scores = [None if rnd.random() < 0.05 else rnd.random() for _ in range(120)]
    df = spark.createDataFrame([("s", day(i), s) for i, s in enumerate(scores)], "series_id string, date date, score double")
    got = [r["color"] for r in R.light_series(df, 60, 80, 3).orderBy("date").collect()]
    prev, want = None, []
    for s in scores:
        prev = T.step(prev, None if s is None else s * 100, 60, 80, 3)
        want.append(prev)
    assert got == want


def test_flow_labels_keep_the_size_guard(spark):
    df = spark.createDataFrame([(-100.0, 10.0), (-100.0, -60.0), (100.0, -1.0), (1.0, 1.0), (None, 5.0)], "a double, b double")
    got = [r[0] for r in df.select(L.flow_inflection(F.col("a"), F.col("b"), 20.0)).collect()]
    assert got == ["轉買", "加速賣", "轉賣", None, None]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 9)], "a long, b long")
    assert {(r["node"], r["component"]) for r in G.connected_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (9, 5)}


def test_landed_json_payloads(spark, tmp_path):
    ok = {"stat": "OK", "date": "20260514", "fields": [S.CODE, S.FOREIGN[1], S.TRUST, S.DEALER, S.TOTAL], "data": [["1101 ", "1,200", "-5", "0", "1,195"], []]}
    for i, p in enumerate((ok, {"stat": "NO", "date": "20260515", "fields": [], "data": []})):
        (tmp_path / f"{i}.json").write_text(json.dumps(p), encoding="utf-8")
    rows = S.parse_institutional(S.read_payloads(spark, str(tmp_path))).collect()
    assert [(r["entity"], r["foreign_net"], r["total_net"]) for r in rows] == [("1101", 1200, 1195)]


def test_minguo_dates(spark):
    df = spark.createDataFrame([("1150514",), ("115/05/14",), ("99/01/02",), ("bad",)], "t string")
    assert [r[0] for r in df.select(S.minguo(F.col("t"))).collect()] == [dt.date(2026, 5, 14), dt.date(2026, 5, 14), dt.date(2010, 1, 2), None]


def test_upsert_partitions_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "week string, entity long")
    for _ in range(2):
        O.upsert_partitions(rows, str(tmp_path / "t"), "week")
    O.upsert_partitions(spark.createDataFrame([("b", 3)], "week string, entity long"), str(tmp_path / "t"), "week")
    assert sorted((r["week"], r["entity"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", 1), ("b", 3)]


def test_big_holder_changes_are_ranked_as_they_are(spark, monkeypatch):
    from tidewater.plans import cell_plans as CP

    pairs = [(10.2, 10.3), (5.1, 5.2), (30.4, 30.5), (7.7, 7.8), (2.2, 2.3), (50.0, 49.0)]
    rows = [(e, day(i), p) for e, pair in enumerate(pairs) for i, p in enumerate(pair)]
    panel = spark.createDataFrame(rows, "entity int, date date, big_holder_pct double")
    monkeypatch.setattr(CP, "panel_mh", lambda t: panel)
    got = {r["entity"] for r in CP.bh_cells(None).where("cell = 'hit'").collect()}
    change = [b - a for a, b in pairs]
    want = {e for e, c in enumerate(change) if sum(x > c for x in change) < 2}
    assert len({round(c, 9) for c in change}) == 2 and got == want
