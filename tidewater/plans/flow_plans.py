"""Fund-flow, rotation and flow-label queries."""

from pyspark.sql import functions as F

from tidewater.functions import labels as L
from tidewater.functions.exprs import iso, own_rows, r6, roll_avg
from tidewater.operators import flows as W
from tidewater.operators import momentum as M
from tidewater.operators import panel as P
from tidewater.plans.momentum_plans import baskets_of
from tidewater.plans.panel_plans import panel_of
from tidewater.plans.registry import query, view
from tidewater.sources.staging import staged

_G = ["net_flow_5d", "net_flow_20d", "foreign_flow_5d", "foreign_flow_20d", "trust_flow_5d", "trust_flow_20d",
      "flow_momentum", "foreign_momentum", "trust_momentum"]
_B = ["flow_breadth_5d", "flow_breadth_20d", "foreign_breadth_5d", "flow_concentration_5d", "flow_concentration_20d"]

view("flow_days", "SELECT date, row_number() OVER (ORDER BY date)-1 AS idx FROM (SELECT DISTINCT date FROM flows)")
view("dense", """
SELECT e.entity, d.date, d.idx, coalesce(f.total_net,0) AS n, coalesce(f.foreign_net,0) AS f, coalesce(f.trust_net,0) AS t, coalesce(p.volume,0) AS v
FROM flow_days d CROSS JOIN (SELECT DISTINCT entity FROM membership) e
LEFT JOIN flows f ON f.date=d.date AND f.entity=e.entity LEFT JOIN prices p ON p.date=d.date AND p.entity=e.entity
""")
view("dense_s", "SELECT *, " + ", ".join(
    f"CAST(sum({x}) OVER w{k} AS BIGINT) AS {x}{k}" for x in "nftv" for k in (5, 20))
    + " FROM dense WINDOW w5 AS (PARTITION BY entity ORDER BY idx ROWS 4 PRECEDING), w20 AS (PARTITION BY entity ORDER BY idx ROWS 19 PRECEDING)")
view("dense_m", "SELECT *, " + ", ".join(f"{x}5-lag({x}5,5) OVER (PARTITION BY entity ORDER BY idx) AS {x}m" for x in "nft") + " FROM dense_s")
view("gflows", """
SELECT grp, date, count(DISTINCT entity) AS members,
  CAST(sum(n5) AS BIGINT) AS net_flow_5d, CAST(sum(n20) AS BIGINT) AS net_flow_20d, CAST(sum(f5) AS BIGINT) AS foreign_flow_5d,
  CAST(sum(f20) AS BIGINT) AS foreign_flow_20d, CAST(sum(t5) AS BIGINT) AS trust_flow_5d, CAST(sum(t20) AS BIGINT) AS trust_flow_20d,
  CAST(coalesce(sum(nm),0) AS BIGINT) AS flow_momentum, CAST(coalesce(sum(fm),0) AS BIGINT) AS foreign_momentum, CAST(coalesce(sum(tm),0) AS BIGINT) AS trust_momentum,
  avg((n5>0)::INT) AS flow_breadth_5d, avg((n20>0)::INT) AS flow_breadth_20d, avg((f5>0)::INT) AS foreign_breadth_5d,
  CASE WHEN sum(v5)>0 THEN sum(n5)::DOUBLE/sum(v5)::DOUBLE END AS flow_concentration_5d,
  CASE WHEN sum(v20)>0 THEN sum(n20)::DOUBLE/sum(v20)::DOUBLE END AS flow_concentration_20d
FROM membership JOIN dense_m USING (entity) GROUP BY 1,2
""")


def gflows_of(t):
    return staged(t.spark, t.root, "group_flows", lambda: W.group_fund_flows(t.membership, t.flows, t.prices))


@query("flw01_group_fund_flows", "SELECT grp, strftime(date,'%Y-%m-%d') AS date, members, " + ", ".join(_G) + ", "
       + ", ".join(f"round({x},6)+0.0 AS {x}" for x in _B) + " FROM gflows")
def flw01(t):
    return gflows_of(t).select("grp", iso("date").alias("date"), "members", *_G, *[r6(x).alias(x) for x in _B])


view("gflows_z", "SELECT *, " + ", ".join(
    f"CASE WHEN count({x}) OVER w >= 30 AND stddev_samp({x}) OVER w > 0 THEN ({x}-avg({x}) OVER w)/stddev_samp({x}) OVER w END AS {x}_z"
    for x in W.SIGNALS) + " FROM gflows WINDOW w AS (PARTITION BY grp ORDER BY date ROWS 59 PRECEDING)")
view("ranked_now", """
SELECT *, row_number() OVER (ORDER BY net_flow_20d DESC NULLS LAST, grp) AS radar_rank FROM gflows
WHERE date=(SELECT max(date) FROM gflows) AND members>=2
""")
view("ranked_prev", """
SELECT grp, row_number() OVER (ORDER BY net_flow_20d DESC NULLS LAST, grp) AS radar_rank FROM gflows
WHERE date=(SELECT max(date) FROM gflows WHERE date < (SELECT max(date) FROM gflows) - 6) AND members>=2
""")


def prev_flows(t):
    g = gflows_of(t)
    last = g.agg(F.date_sub(F.max("date"), 6).alias("_cut"))
    from tidewater.functions.exprs import with_scalar

    return with_scalar(g, last).where(F.col("date") < F.col("_cut")).drop("_cut")


@query("flw02_rank_flows", """
SELECT n.grp, n.net_flow_20d, n.radar_rank, CAST(p.radar_rank-n.radar_rank AS BIGINT) AS rank_delta FROM ranked_now n LEFT JOIN ranked_prev p USING (grp)""")
def flw02(t):
    prev = W.rank_flows(prev_flows(t), min_members=2)
    return W.rank_flows(gflows_of(t), prev=prev, min_members=2).select(
        "grp", "net_flow_20d", F.col("radar_rank").cast("bigint").alias("radar_rank"), F.col("rank_delta").cast("bigint").alias("rank_delta"))


view("member_trend", """
SELECT date, entity, close > avg(close) OVER (PARTITION BY entity ORDER BY date ROWS 59 PRECEDING) AS above,
  close/lag(close,20) OVER (PARTITION BY entity ORDER BY date)-1.0::DOUBLE AS ret_w FROM prices WHERE close>0
""")
view("grp_ma", """
SELECT grp, date, basket_index > avg(basket_index) OVER (PARTITION BY grp ORDER BY date ROWS 19 PRECEDING) AS s,
  basket_index > avg(basket_index) OVER (PARTITION BY grp ORDER BY date ROWS 59 PRECEDING) AS l FROM baskets
""")
view("lead_rs", """
SELECT grp, date, max(ret_w-med) AS rs FROM membership JOIN member_trend USING (entity)
JOIN (SELECT date, median(ret_w) AS med FROM member_trend WHERE ret_w IS NOT NULL GROUP BY 1) USING (date) WHERE ret_w IS NOT NULL GROUP BY 1,2
""")
view("lead_c", """
SELECT grp, date, CASE WHEN count(*) OVER (PARTITION BY date)>1 THEN
  (rank() OVER (PARTITION BY date ORDER BY rs)+(count(*) OVER (PARTITION BY date, rs)-1)/2.0::DOUBLE-1)/(count(*) OVER (PARTITION BY date)-1) ELSE 0.5::DOUBLE END AS c_rs FROM lead_rs
""")
view("trend", """
SELECT m.grp, m.date, round(round(((m.s::INT*0.5::DOUBLE+m.l::INT*0.5::DOUBLE)*0.4::DOUBLE+coalesce(b.br,0.0::DOUBLE)*0.35::DOUBLE+coalesce(c.c_rs,0.0::DOUBLE)*0.25::DOUBLE)*100,9),1) AS trend_score
FROM grp_ma m LEFT JOIN (SELECT grp, date, avg(above::INT) AS br FROM membership JOIN member_trend USING (entity) GROUP BY 1,2) b USING (grp,date)
LEFT JOIN lead_c c USING (grp,date)
""")


def trend_of(t):
    return staged(t.spark, t.root, "trend", lambda: W.trend_score_series(t.prices, t.membership, baskets_of(t)))


@query("flw03_trend_series", "SELECT grp, strftime(date,'%Y-%m-%d') AS date, trend_score FROM trend")
def flw03(t):
    return trend_of(t).select("grp", iso("date").alias("date"), "trend_score")


view("trend_now", """
WITH ma AS (SELECT grp, arg_max(s, date) AS s, arg_max(l, date) AS l FROM grp_ma GROUP BY 1),
br AS (SELECT grp, avg(above::INT) AS b FROM membership JOIN member_trend USING (entity) WHERE date=(SELECT max(date) FROM prices) GROUP BY 1),
ld AS (SELECT grp, entity, rs_pct, row_number() OVER (PARTITION BY grp ORDER BY rs_pct DESC, entity) AS k FROM membership JOIN rs_latest USING (entity)),
l1 AS (SELECT grp, entity, rs_pct, CASE WHEN count(*) OVER ()>1 THEN (rank() OVER (ORDER BY rs_pct)+(count(*) OVER (PARTITION BY rs_pct)-1)/2.0::DOUBLE-1)/(count(*) OVER ()-1) ELSE 0.5::DOUBLE END AS c FROM ld WHERE k=1)
SELECT grp, round(round(((s::INT*0.5::DOUBLE+l::INT*0.5::DOUBLE)*0.4::DOUBLE+coalesce(b,0.0::DOUBLE)*0.35::DOUBLE+coalesce(c,0.0::DOUBLE)*0.25::DOUBLE)*100,9),1) AS trend_score,
  CASE WHEN s AND l THEN '雙線上' WHEN s THEN '月線上' WHEN l THEN '季線上' ELSE '雙線下' END AS trend_ma_state, b AS above_ma60_breadth,
  l1.entity AS leader_entity, round(round(rs_pct,9),1)+0.0 AS leader_rs_pct
FROM ma FULL JOIN br USING (grp) FULL JOIN l1 USING (grp)
""")


@query("flw03_trend_asof", "SELECT grp, trend_score, trend_ma_state, round(above_ma60_breadth,6) AS above_ma60_breadth, leader_entity, leader_rs_pct FROM trend_now")
def flw03b(t):
    return W.trend_scores_asof(baskets_of(t), t.membership, t.prices).withColumn("above_ma60_breadth", r6("above_ma60_breadth"))


@query("flw04_trend_leaders", """
WITH px AS (SELECT date, entity, close, avg(close) OVER (PARTITION BY entity ORDER BY date ROWS 59 PRECEDING) AS ma,
    avg(close*volume) OVER (PARTITION BY entity ORDER BY date ROWS 19 PRECEDING) AS amt, sum(volume) OVER (PARTITION BY entity ORDER BY date ROWS 19 PRECEDING) AS vol20 FROM prices WHERE close>0),
b AS (SELECT px.*, ret_pct, rs_pct, (close/ma-1)*100 AS dist FROM px JOIN rs_latest USING (entity) WHERE date=(SELECT max(date) FROM prices) AND amt>=100000 ORDER BY rs_pct DESC, entity LIMIT 15),
f AS (SELECT entity, sum(foreign_net) AS f20, sum(trust_net) AS t20 FROM flows WHERE date IN (SELECT DISTINCT date FROM flows ORDER BY date DESC LIMIT 20) GROUP BY 1)
SELECT b.entity, coalesce(tg.s,'') AS sub_industry, round(round(ret_pct,9),1)+0.0 AS ret_pct, round(round(rs_pct,9),1)+0.0 AS rs_pct, round(round(dist,9),1)+0.0 AS dist_ma60_pct,
  concat_ws(';', CASE WHEN dist>2 THEN '過熱' END, CASE WHEN f20*t20<0 AND least(abs(f20),abs(t20))>=5 AND least(abs(f20),abs(t20))>=vol20*0.5/100 THEN '土洋對作' END) AS flags
FROM b LEFT JOIN f USING (entity) LEFT JOIN (SELECT entity, string_agg(grp,'、' ORDER BY grp) AS s FROM themes GROUP BY 1) tg USING (entity)""")
def flw04(t):
    return W.trend_leaders(t.themes, t.prices, t.flows, 15, 100000, 2.0, 5, 0.5)


@query("flw05_source_lag", "SELECT count(*) AS lag_days FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderpriority='1-URGENT') WHERE d > (SELECT max(ex_date)-400 FROM dividends)")
def flw05(t):
    a = t.series.where(F.col("series_id") == "1-URGENT")
    return W.source_lag_days(a, t.dividends.select(F.date_sub("ex_date", 400).alias("date")))


view("trend_prev", """
SELECT grp, row_number() OVER (ORDER BY trend_score DESC NULLS LAST, grp) AS radar_rank FROM gflows LEFT JOIN trend_now USING (grp)
WHERE date=(SELECT max(date) FROM gflows WHERE date < (SELECT max(date) FROM gflows) - 6) AND members>=3
""")
view("rotation", """
WITH z AS (SELECT g.*, trend_score, trust_flow_20d_z > 1.0 AS et, flow_breadth_5d > 0.6 AS ct FROM gflows_z g LEFT JOIN trend_now USING (grp)
  WHERE g.date=(SELECT max(date) FROM gflows) AND members>=3),
p AS (SELECT grp, arg_max(above_low_pct, date) AS al, arg_max(basket_ret_5d, date) AS b5 FROM basket_pos GROUP BY 1)
SELECT z.*, al AS above_low_pct, b5 AS basket_ret_5d, row_number() OVER (ORDER BY trend_score DESC NULLS LAST, grp) AS radar_rank,
  CASE WHEN al IS NULL THEN NULL WHEN net_flow_20d>0 AND NOT al>10 THEN '下一棒' WHEN net_flow_20d>0 THEN '主升續勢' WHEN al>10 THEN '出貨警訊' ELSE '退潮觀察' END AS quadrant,
  round(round(CASE WHEN al IS NOT NULL THEN net_flow_20d_z*greatest(least(1-al/60,1.0::DOUBLE),0.0::DOUBLE) END,9),2)+0.0 AS cp_score,
  CASE WHEN flow_momentum>0 THEN '加速' WHEN flow_momentum<0 THEN '放緩' END AS freshness,
  CASE WHEN net_flow_20d<0 AND net_flow_5d>0 THEN '資金回流' WHEN net_flow_20d>0 AND net_flow_5d<0 THEN '退潮' END AS flow_turn
FROM z LEFT JOIN p USING (grp)
""")


def rotation_of(t):
    tr = W.trend_scores_asof(baskets_of(t), t.membership, t.prices).select("grp", "trend_score")
    prev = W.rank_flows(prev_flows(t).join(tr, "grp", "left"), "trend_score", None, 3)
    return W.rotation_table(gflows_of(t), baskets_of(t), tr, prev)


@query("flw06_rotation_table", """
SELECT r.grp, r.radar_rank, CAST(p.radar_rank-r.radar_rank AS BIGINT) AS rank_delta, trend_score, quadrant, coalesce(et,false)::INT AS entry_triggered, coalesce(ct,false)::INT AS confirm_triggered,
  coalesce(quadrant='下一棒' AND above_low_pct<=5,false)::INT AS next_precision, round(net_flow_20d/1000.0)+0.0 AS net_flow_20d_lots, cp_score, freshness, flow_turn,
  round(above_low_pct,6)+0.0 AS above_low_pct, round(basket_ret_5d,6)+0.0 AS basket_ret_5d FROM rotation r LEFT JOIN trend_prev p USING (grp)""")
def flw06(t):
    i = lambda x: F.col(x).cast("int").alias(x)
    return rotation_of(t).select(
        "grp", F.col("radar_rank").cast("bigint").alias("radar_rank"), F.col("rank_delta").cast("bigint").alias("rank_delta"), "trend_score", "quadrant",
        i("entry_triggered"), i("confirm_triggered"), i("next_precision"), (F.col("net_flow_20d_lots").cast("double") + 0.0).alias("net_flow_20d_lots"),
        "cp_score", "freshness", "flow_turn", r6("above_low_pct").alias("above_low_pct"), r6("basket_ret_5d").alias("basket_ret_5d"))


view("weekly", "SELECT max(date) AS date FROM (SELECT DISTINCT date FROM prices) GROUP BY isoyear(date), weekofyear(date)")
view("signal_panel", """
SELECT *, CAST(lag(radar_rank) OVER (PARTITION BY grp ORDER BY date)-radar_rank AS BIGINT) AS rank_delta FROM (
SELECT g.grp, g.date, trend_score, CASE WHEN above_low_pct IS NULL THEN NULL WHEN net_flow_20d>0 AND NOT above_low_pct>10 THEN '下一棒' WHEN net_flow_20d>0 THEN '主升續勢' WHEN above_low_pct>10 THEN '出貨警訊' ELSE '退潮觀察' END AS quadrant,
  CASE WHEN flow_momentum>0 THEN '加速' WHEN flow_momentum<0 THEN '放緩' END AS freshness,
  CASE WHEN net_flow_20d<0 AND net_flow_5d>0 THEN '資金回流' WHEN net_flow_20d>0 AND net_flow_5d<0 THEN '退潮' END AS flow_turn,
  coalesce(trust_flow_20d_z>1.0,false) AS entry_triggered, members>=3 AS on_board,
  CASE WHEN members>=3 AND trend_score IS NOT NULL THEN row_number() OVER (PARTITION BY g.date, members>=3 ORDER BY trend_score DESC NULLS LAST, g.grp) END AS radar_rank
FROM gflows_z g LEFT JOIN basket_pos p USING (grp,date) LEFT JOIN trend t USING (grp,date) WHERE g.date IN (SELECT date FROM weekly))
""")


def signal_panel_of(t):
    def build():
        fz = W.standardize(gflows_of(t))
        return W.rotation_signal_panel(fz, M.basket_position(baskets_of(t)), trend_of(t), P.weekly_dates(t.prices), min_members=3)

    return staged(t.spark, t.root, "signal_panel", build)


@query("flw07_rotation_signals", """
SELECT grp, strftime(date,'%Y-%m-%d') AS date, trend_score, quadrant, freshness, flow_turn, entry_triggered::INT AS entry_triggered, on_board::INT AS on_board, radar_rank, rank_delta FROM signal_panel""")
def flw07(t):
    return signal_panel_of(t).select(
        "grp", iso("date").alias("date"), "trend_score", "quadrant", "freshness", "flow_turn", F.col("entry_triggered").cast("int").alias("entry_triggered"),
        F.col("on_board").cast("int").alias("on_board"), F.col("radar_rank").cast("bigint").alias("radar_rank"), F.col("rank_delta").cast("bigint").alias("rank_delta"))


@query("flw08_participation", """
WITH tg AS (SELECT m.entity, m.grp, coalesce(r.quadrant,'位階未取得') AS q, coalesce(r.net_flow_20d,0)>0 AS inflow, r.grp IS NOT NULL AS known FROM membership m LEFT JOIN rotation r USING (grp)),
s AS (SELECT DISTINCT c_mktsegment AS source, c_custkey AS entity FROM customer),
p AS (SELECT source, entity, count(grp) AS n, bool_or(coalesce(inflow,false)) AS i, bool_or(coalesce(known AND q='出貨警訊',false)) AS w FROM s LEFT JOIN tg USING (entity) GROUP BY 1,2)
SELECT source, count(*) AS n_total, count(*) FILTER (WHERE i) AS n_inflow, count(*) FILTER (WHERE w) AS n_warning, count(*) FILTER (WHERE n=0) AS n_untagged FROM p GROUP BY 1""")
def flw08(t):
    src = t.raw("customer").select(F.col("c_mktsegment").alias("source"), F.col("c_custkey").alias("entity"))
    return W.participation(src, t.membership, rotation_of(t))


@query("flw09_agreement", """
WITH b AS (SELECT grp, date, trend_score, quadrant, freshness, flow_turn, lag(trend_score) OVER w AS pt, lag(quadrant) OVER w AS pq, lag(freshness) OVER w AS pf, lag(flow_turn) OVER w AS pz,
  row_number() OVER w AS k FROM signal_panel WINDOW w AS (PARTITION BY grp ORDER BY date))
SELECT strftime(date,'%Y-%m-%d') AS date, count(*) AS n, round(avg(abs(trend_score-pt)),6) AS trend_mad, round(avg((quadrant IS NOT DISTINCT FROM pq)::INT),6) AS quadrant_match,
  round(avg((freshness IS NOT DISTINCT FROM pf)::INT),6) AS freshness_match, round(avg((flow_turn IS NOT DISTINCT FROM pz)::INT),6) AS flow_turn_match FROM b WHERE k>1 GROUP BY date""")
def flw09(t):
    s = signal_panel_of(t)
    w = own_rows("grp")
    prev = s.select("grp", "date", *[F.lag(x).over(w).alias(x) for x in ("trend_score", "quadrant", "freshness", "flow_turn")],
                    F.row_number().over(w).alias("k")).where("k > 1").drop("k")
    d = W.agreement(s, prev)
    return d.select(iso("date").alias("date"), "n", *[r6(x).alias(x) for x in d.columns if x not in ("date", "n")])


# ------------------------------------------------------------- entity labels

view("ent", """
SELECT p.date, p.entity, close, volume, foreign_net, trust_net, total_net,
  sum(foreign_net) OVER w5 AS f5, sum(foreign_net) OVER w20 AS f20, sum(trust_net) OVER w5 AS t5, sum(trust_net) OVER w20 AS t20,
  CASE WHEN count(*) OVER w60>=60 THEN min(close) OVER w60 END AS low60, (close/lag(close,5) OVER w-1)*100 AS mom5,
  CASE WHEN count(*) OVER w20>=20 THEN (close/avg(close) OVER w20-1)*100 END AS ma20, CASE WHEN count(*) OVER w60>=60 THEN (close/avg(close) OVER w60-1)*100 END AS ma60
FROM prices p LEFT JOIN flows f USING (date, entity)
WINDOW w AS (PARTITION BY entity ORDER BY date), w5 AS (PARTITION BY entity ORDER BY date ROWS 4 PRECEDING), w20 AS (PARTITION BY entity ORDER BY date ROWS 19 PRECEDING), w60 AS (PARTITION BY entity ORDER BY date ROWS 59 PRECEDING)
""")


def entity_rows(t):
    w = own_rows()
    p = t.prices.join(t.flows, ["date", "entity"], "left")

    def s(x, n):
        return F.sum(x).over(w.rowsBetween(-(n - 1), 0))

    f60 = w.rowsBetween(-59, 0)
    return p.select(
        "date", "entity", "close", "volume", "foreign_net", "trust_net", "total_net", s("foreign_net", 5).alias("f5"), s("foreign_net", 20).alias("f20"),
        s("trust_net", 5).alias("t5"), s("trust_net", 20).alias("t20"), F.when(F.count(F.lit(1)).over(f60) >= 60, F.min("close").over(f60)).alias("low60"),
        ((F.col("close") / F.lag("close", 5).over(w) - 1) * 100).alias("mom5"), ((F.col("close") / roll_avg("close", w, 20) - 1) * 100).alias("ma20"),
        ((F.col("close") / roll_avg("close", w, 60) - 1) * 100).alias("ma60"))


def _side(s20, s5, lab, o):
    return (f"CASE WHEN {s20}>=20 AND {s5} IS NOT NULL THEN {{'o': CASE WHEN {s5}<0 THEN 0 WHEN {s5}/{s20}*100<5 THEN 1 WHEN {s5}/{s20}*100>=40 THEN 2 ELSE 3 END, 'k': {o}, "
            f"'state': CASE WHEN {s5}<0 THEN '轉賣' WHEN {s5}/{s20}*100<5 THEN '熄火' WHEN {s5}/{s20}*100>=40 THEN '加速' ELSE '平穩' END || '({lab})', 'share': round(round({s5}/{s20}*100,9),1)+0.0}} END")


view("near_state", f"""
SELECT *, x.state AS flow_state, x.share AS flow_share FROM (SELECT *, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN a.o<=b.o THEN a ELSE b END AS x FROM (
  SELECT date, entity, ma20, ma60, mom5, {_side('f20', 'f5', '外資', 0)} AS a, {_side('t20', 't5', '投信', 1)} AS b
  FROM (SELECT * REPLACE (f20::DOUBLE AS f20, f5::DOUBLE AS f5, t20::DOUBLE AS t20, t5::DOUBLE AS t5) FROM ent)))
""")


@query("flw10_near_flow_state", "SELECT strftime(date,'%Y-%m-%d') AS date, entity, flow_state, flow_share FROM near_state")
def flw10(t):
    e = entity_rows(t).withColumn("x", L.near_flow_state(F.col("f20"), F.col("f5"), F.col("t20"), F.col("t5"), 20.0))
    return e.select(iso("date").alias("date"), "entity", F.col("x.state").alias("flow_state"), F.col("x.share").alias("flow_share"))


@query("flw11_risk_kind", """
SELECT strftime(date,'%Y-%m-%d') AS date, entity, CASE WHEN mom5 < -1 AND ma20<0 THEN '價格已跌' WHEN flow_state LIKE '%熄火%' OR flow_state LIKE '%轉賣%' THEN '籌碼熄火' WHEN ma60>2 THEN '價格延伸' ELSE '' END AS risk_kind FROM near_state""")
def flw11(t):
    st = L.near_flow_state(F.col("f20"), F.col("f5"), F.col("t20"), F.col("t5"), 20.0)["state"]
    return entity_rows(t).select(iso("date").alias("date"), "entity", L.risk_kind(st, F.col("ma60"), F.col("ma20"), F.col("mom5"), 2.0, -1.0).alias("risk_kind"))


_INF = """CASE WHEN f20 IS NULL OR f5 IS NULL OR greatest(abs(f20),abs(f5))<20 THEN NULL
  WHEN f20<0 THEN CASE WHEN f5>0 THEN '轉買' WHEN abs(f5)/5.0>abs(f20)/20.0 THEN '加速賣' WHEN abs(f5)/abs(f20)*100<5 THEN '熄火' ELSE '平穩' END
  WHEN f5<0 THEN CASE WHEN abs(f5)/5.0>abs(f20)/20.0 THEN '加速賣' ELSE '轉賣' END WHEN abs(f5)/5.0>abs(f20)/20.0 THEN '加速買' ELSE '平穩' END"""
view("inflect", f"SELECT *, {_INF} AS inflection, CASE WHEN low60>0 THEN round(round((close-low60)/low60*100.0,9),1)+0.0 END AS dist_low FROM (SELECT * REPLACE (f20::DOUBLE AS f20, f5::DOUBLE AS f5) FROM ent)")


def inflect(t):
    return entity_rows(t).withColumn("inflection", L.flow_inflection(F.col("f20"), F.col("f5"), 20.0)).withColumn(
        "dist_low", L.dist_to_low(F.col("close"), F.col("low60")))


@query("flw12_flow_inflection", "SELECT strftime(date,'%Y-%m-%d') AS date, entity, inflection FROM inflect")
def flw12(t):
    return inflect(t).select(iso("date").alias("date"), "entity", "inflection")


_PROX = "CASE WHEN dist_low IS NULL THEN '' WHEN dist_low<=2 THEN '在低' WHEN dist_low<=5 THEN '貼低' WHEN dist_low<=20 THEN '中段' ELSE '高檔' END"


@query("flw13_base_proximity", f"SELECT strftime(date,'%Y-%m-%d') AS date, entity, dist_low, {_PROX} AS proximity FROM inflect")
def flw13(t):
    return inflect(t).select(iso("date").alias("date"), "entity", "dist_low", L.base_proximity(F.col("dist_low")).alias("proximity"))


view("rev_d", """
SELECT entity, year_month, m, yoy_pct, yoy_pct-lag(yoy_pct) OVER w AS d, lag(yoy_pct) OVER w-lag(yoy_pct,2) OVER w AS dp FROM revenue WINDOW w AS (PARTITION BY entity ORDER BY m)
""")
view("health", """
SELECT *, CASE WHEN yoy_pct IS NULL THEN '待查' WHEN yoy_pct<0 THEN '轉差' WHEN d<=-30 AND dp<=-30 THEN '轉差'
  WHEN mg<5 THEN CASE g WHEN '強化' THEN '穩健' WHEN '穩健' THEN '減速' ELSE '轉差' END ELSE g END AS health FROM (
SELECT *, CASE WHEN yoy_pct<5 THEN '減速' WHEN d<=-30 THEN '減速' WHEN yoy_pct>=20 AND d>=0 THEN '強化' ELSE '穩健' END AS g FROM (
  SELECT r.*, s.net_margin_pct AS mg FROM rev_d r LEFT JOIN statements s ON s.entity=r.entity AND s.year=r.m//12 AND s.quarter=(r.m%12)//3+1))
""")


def health_of(t):
    w = own_rows("entity", "m")
    y = F.col("yoy_pct")
    r = t.revenue.select("entity", "year_month", "m", "yoy_pct", (y - F.lag(y).over(w)).alias("d"), (F.lag(y).over(w) - F.lag(y, 2).over(w)).alias("dp"))
    r = r.withColumn("year", F.floor(F.col("m") / 12).cast("int")).withColumn("quarter", (F.floor((F.col("m") % 12) / 3) + 1).cast("int"))
    r = r.join(t.statements.select("entity", "year", "quarter", "net_margin_pct"), ["entity", "year", "quarter"], "left")
    return r.withColumn("health", L.fundamental_health(y, F.col("d"), F.col("dp"), F.col("net_margin_pct")))


@query("flw14_fundamental_health", "SELECT entity, year_month, health FROM health")
def flw14(t):
    return health_of(t).select("entity", "year_month", "health")


view("contra", f"""
SELECT i.date, i.entity, i.dist_low, i.f5, i.f20, i.mom5, coalesce(h.health,'待查') AS health, i.inflection, {_PROX} AS proximity,
  (SELECT NULL) AS z FROM inflect i LEFT JOIN health h ON h.entity=i.entity AND h.m=year(i.date)*12+month(i.date)-1
""")


def contra(t):
    m = F.year("date") * 12 + F.month("date") - 1
    return inflect(t).withColumn("m", m).join(health_of(t).select("entity", "m", "health"), ["entity", "m"], "left").withColumn(
        "health", F.coalesce("health", F.lit(L.UNKNOWN))).withColumn("proximity", L.base_proximity(F.col("dist_low")))


view("streaks", """
SELECT date, entity, CASE WHEN foreign_net>0 THEN k-coalesce(max(CASE WHEN foreign_net IS NULL OR foreign_net<=0 THEN k END) OVER (PARTITION BY entity ORDER BY date),0) ELSE 0 END AS streak
FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS k FROM ent)
""")


def streaks(t):
    w = own_rows()
    d = t.prices.join(t.flows, ["date", "entity"], "left").withColumn("k", F.row_number().over(w))
    stop = F.max(F.when(F.col("foreign_net").isNull() | (F.col("foreign_net") <= 0), F.col("k"))).over(w)
    return d.select("date", "entity", F.when(F.col("foreign_net") > 0, F.col("k") - F.coalesce(stop, F.lit(0))).otherwise(F.lit(0)).alias("streak"))


@query("flw15_contrarian_tags", """
SELECT strftime(date,'%Y-%m-%d') AS date, entity, c::INT AS contrarian, (c AND streak>=2 AND dist_low>0)::INT AS ready FROM (
  SELECT c.*, s.streak, health IN ('強化','穩健') AND coalesce(inflection='轉買',false) AND proximity IN ('在低','貼低') AS c FROM contra c JOIN streaks s USING (date, entity))""")
def flw15(t):
    c = contra(t).join(streaks(t), ["date", "entity"])
    flag = L.is_contrarian(F.col("health"), F.col("inflection"), F.col("proximity"))
    return c.select(iso("date").alias("date"), "entity", flag.cast("int").alias("contrarian"),
                    L.contrarian_ready(flag, F.col("streak"), F.col("dist_low")).cast("int").alias("ready"))


view("lifted", f"SELECT p.date, p.entity, i.inflection, {_PROX} AS proximity, p.alpha5, p.alpha20, "
     "coalesce(i.inflection='轉買',false) AND (" + _PROX + ") IN ('在低','貼低') AS focal, p.alpha20-avg(p.alpha20) OVER (PARTITION BY p.date) AS lift20 "
     "FROM panel p JOIN inflect i USING (date, entity)")


def lifted(t):
    i = inflect(t).select("date", "entity", "inflection", "dist_low")
    p = panel_of(t).select("date", "entity", "alpha5", "alpha20").join(i, ["date", "entity"])
    mean = p.groupBy("date").agg(F.avg("alpha20").alias("_m"))
    prox = L.base_proximity(F.col("dist_low"))
    focal = F.coalesce((F.col("inflection") == L.TURN_BUY) & prox.isin(L.AT_LOW, L.NEAR_LOW), F.lit(False))
    return p.join(F.broadcast(mean), "date").select(
        "date", "entity", "inflection", prox.alias("proximity"), "alpha5", "alpha20", focal.alias("focal"), (F.col("alpha20") - F.col("_m")).alias("lift20"))


@query("flw16_contrarian_signal", "SELECT strftime(date,'%Y-%m-%d') AS date, entity, inflection, proximity, focal::INT AS focal, round(lift20,6)+0.0 AS lift20 FROM lifted")
def flw16(t):
    return lifted(t).select(iso("date").alias("date"), "entity", "inflection", "proximity", F.col("focal").cast("int").alias("focal"), r6("lift20").alias("lift20"))


_FF = ["f_dif_rate", "f_accel", "f_foreign_dif", "f_trust_dif", "ref_level20", "f_zz"]
view("flow_factors", """
WITH c AS (SELECT date, entity, volume, CASE WHEN cov THEN coalesce(foreign_net,0) END AS f, CASE WHEN cov THEN coalesce(trust_net,0) END AS t,
    CASE WHEN cov THEN coalesce(foreign_net,0)+coalesce(trust_net,0)+coalesce(dealer_net,0) END AS n
  FROM (SELECT *, bool_or(foreign_net IS NOT NULL) OVER (PARTITION BY date) AS cov FROM panel)),
s AS (SELECT date, entity, CASE WHEN count(volume) OVER w20>=20 THEN avg(volume) OVER w20 END AS v20,
    CASE WHEN count(n) OVER w5>=5 THEN sum(n) OVER w5 END AS s5, CASE WHEN count(n) OVER w20>=20 THEN sum(n) OVER w20 END AS s20,
    CASE WHEN count(f) OVER w5>=5 THEN sum(f) OVER w5 END AS f5, CASE WHEN count(f) OVER w20>=20 THEN sum(f) OVER w20 END AS f20,
    CASE WHEN count(t) OVER w5>=5 THEN sum(t) OVER w5 END AS t5, CASE WHEN count(t) OVER w20>=20 THEN sum(t) OVER w20 END AS t20
  FROM c WINDOW w5 AS (PARTITION BY entity ORDER BY date ROWS 4 PRECEDING), w20 AS (PARTITION BY entity ORDER BY date ROWS 19 PRECEDING)),
d AS (SELECT * REPLACE (s5::DOUBLE AS s5, s20::DOUBLE AS s20, f5::DOUBLE AS f5, f20::DOUBLE AS f20, t5::DOUBLE AS t5, t20::DOUBLE AS t20) FROM s),
z AS (SELECT *, CASE WHEN v20>0 THEN (s5/5-s20/20)/v20 END AS f_dif_rate, CASE WHEN v20>0 THEN (s5-lag(s5,5) OVER w)/v20 END AS f_accel,
    CASE WHEN v20>0 THEN (f5/5-f20/20)/v20 END AS f_foreign_dif, CASE WHEN v20>0 THEN (t5/5-t20/20)/v20 END AS f_trust_dif, CASE WHEN v20>0 THEN (s20/20)/v20 END AS ref_level20,
    CASE WHEN count(s20) OVER w60>=30 AND stddev_samp(s20) OVER w60>0 THEN (s20-avg(s20) OVER w60)/stddev_samp(s20) OVER w60 END AS z20
  FROM d WINDOW w AS (PARTITION BY entity ORDER BY date), w60 AS (PARTITION BY entity ORDER BY date ROWS 59 PRECEDING)),
y AS (SELECT *, z20-lag(z20,5) OVER (PARTITION BY entity ORDER BY date) AS zc FROM z)
SELECT *, CASE WHEN count(zc) OVER w60>=30 AND stddev_samp(zc) OVER w60>0 THEN (zc-avg(zc) OVER w60)/stddev_samp(zc) OVER w60 END AS f_zz FROM y
WINDOW w60 AS (PARTITION BY entity ORDER BY date ROWS 59 PRECEDING)
""")


@query("flw17_flow_factors", "SELECT strftime(date,'%Y-%m-%d') AS date, entity, " + ", ".join(f"round({x},9)+0.0 AS {x}" for x in _FF) + " FROM flow_factors")
def flw17(t):
    return W.flow_factors(panel_of(t)).select(iso("date").alias("date"), "entity", *[r6(x, 9).alias(x) for x in _FF])


view("early", """
SELECT c.*, round(round(f5-f20/4.0,9),1)+0.0 AS flow_diff, CASE WHEN mc IS NOT NULL AND mom5 IS NOT NULL THEN mc<0 AND mom5>=-1 END AS slim, s.streak,
  health IN ('強化','穩健') AS k1, coalesce(dist_low<=10,false) AS k2, coalesce(streak BETWEEN 1 AND 5,false) AS k3, coalesce(f20<=50,false) AS k4
FROM contra c JOIN streaks s USING (date, entity) JOIN (SELECT date, entity, margin_balance-lag(margin_balance,5) OVER (PARTITION BY entity ORDER BY date) AS mc FROM margin) USING (date, entity)
""")


def early(t):
    mc = t.margin.select("date", "entity", (F.col("margin_balance") - F.lag("margin_balance", 5).over(own_rows())).alias("mc"))
    e = contra(t).join(streaks(t), ["date", "entity"]).join(mc, ["date", "entity"])
    ck = L.ambush_checks(F.col("health"), F.lit(None).cast("string"), F.col("dist_low"), F.col("streak"), F.col("f20"), max_lots=50.0)
    return e.withColumns({
        "flow_diff": L.flow_diff_5_20(F.col("f5"), F.col("f20")), "slim": L.margin_slimming(F.col("mc"), F.col("mom5")), **{f"k_{n}": x for n, x in ck.items()}})


@query("flw18_inflection_columns", """
SELECT strftime(date,'%Y-%m-%d') AS date, entity, flow_diff, slim::INT AS slim, (k1 AND k2 AND k3 AND k4)::INT AS ambush FROM early""")
def flw18(t):
    return early(t).select(iso("date").alias("date"), "entity", "flow_diff", F.col("slim").cast("int").alias("slim"),
                           (F.col("k_fund") & F.col("k_position") & F.col("k_days") & F.col("k_flow")).cast("int").alias("ambush"))


@query("flw19_ambush_near_miss", """
SELECT strftime(date,'%Y-%m-%d') AS date, entity, CASE WHEN n=4 THEN '' WHEN NOT k1 THEN 'fund' WHEN NOT k2 THEN 'position' WHEN NOT k3 THEN 'days' ELSE 'flow' END AS failed
FROM (SELECT *, k1::INT+k2::INT+k3::INT+k4::INT AS n FROM early) WHERE n>=3""")
def flw19(t):
    names = ["fund", "position", "days", "flow"]
    failed = F.array_compact(F.array(*[F.when(~F.col(f"k_{n}"), F.lit(n)) for n in names]))
    return early(t).withColumn("_f", failed).where(F.size("_f") <= 1).select(iso("date").alias("date"), "entity", F.concat_ws("", "_f").alias("failed"))


view("bigh", """
SELECT data_date, entity, CASE WHEN t>0 THEN round(round(100.0::DOUBLE*b/t,9),2) END AS big_holder_pct, CASE WHEN t>0 THEN round(round(100.0::DOUBLE*v/t,9),2) END AS big_holder_1000_pct
FROM (SELECT data_date, entity, sum(shares) FILTER (WHERE level=17) AS t, coalesce(sum(shares) FILTER (WHERE level IN (4,5,6)),0) AS b, coalesce(sum(shares) FILTER (WHERE level IN (5,6)),0) AS v FROM holders GROUP BY 1,2) WHERE t IS NOT NULL
""")


def bigh_of(t):
    return W.big_holders(t.holders, (4, 5, 6), (5, 6), 17)


view("panel_mh", """
SELECT p.date, p.entity, volume, margin_balance, big_holder_pct, alpha5, alpha10, alpha20, alpha40 FROM panel p LEFT JOIN margin USING (date, entity)
LEFT JOIN (SELECT data_date AS date, entity, big_holder_pct FROM bigh) USING (date, entity)
""")


def panel_mh(t):
    h = bigh_of(t).select(F.col("data_date").alias("date"), "entity", "big_holder_pct")
    p = panel_of(t).select("date", "entity", "volume", "alpha5", "alpha10", "alpha20", "alpha40")
    return p.join(t.margin, ["date", "entity"], "left").join(h, ["date", "entity"], "left")


@query("flw20_margin_factors", """
SELECT strftime(m.date,'%Y-%m-%d') AS date, m.entity, round(CASE WHEN pm<>0 THEN -1*(margin_balance-pm)/pm END,6)+0.0 AS margin_slim,
  round(CASE WHEN va>0 THEN margin_balance*1000/va END,6)+0.0 AS margin_to_vol, round(h.wow,6)+0.0 AS big_holder_wow
FROM (SELECT *, lag(margin_balance,20) OVER (PARTITION BY entity ORDER BY date) AS pm,
    CASE WHEN count(volume) OVER w>=20 THEN avg(volume) OVER w END AS va FROM panel_mh WINDOW w AS (PARTITION BY entity ORDER BY date ROWS 19 PRECEDING)) m
LEFT JOIN (SELECT date, entity, CASE WHEN date-lag(date) OVER w<=40 THEN big_holder_pct-lag(big_holder_pct) OVER w END AS wow FROM panel_mh WHERE big_holder_pct IS NOT NULL WINDOW w AS (PARTITION BY entity ORDER BY date)) h
ON h.date=m.date AND h.entity=m.entity""")
def flw20(t):
    return W.margin_factors(panel_mh(t), 20, 40).select(iso("date").alias("date"), "entity", r6("margin_slim").alias("margin_slim"),
                                                      r6("margin_to_vol").alias("margin_to_vol"), r6("big_holder_wow").alias("big_holder_wow"))


@query("flw21_big_holders", "SELECT strftime(data_date,'%Y-%m-%d') AS data_date, entity, big_holder_pct, big_holder_1000_pct FROM bigh")
def flw21(t):
    return bigh_of(t).select(iso("data_date").alias("data_date"), "entity", "big_holder_pct", "big_holder_1000_pct")


@query("flw21_big_holders_wow", """
SELECT a.entity, strftime(a.data_date,'%Y-%m-%d') AS data_date, a.big_holder_pct, round(a.big_holder_pct-b.big_holder_pct,2)+0.0 AS big_holder_wow
FROM bigh a LEFT JOIN bigh b ON b.entity=a.entity AND b.data_date=(SELECT max(data_date) FROM bigh WHERE data_date<(SELECT max(data_date) FROM bigh))
WHERE a.data_date=(SELECT max(data_date) FROM bigh)""")
def flw21b(t):
    d = W.latest_vs_nth(bigh_of(t), "data_date", ["big_holder_pct"], 2, "_wow")
    return d.select("entity", iso("data_date").alias("data_date"), "big_holder_pct", r6("big_holder_pct_wow", 2).alias("big_holder_wow"))


@query("flw22_margin_signals", """
WITH d AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS k FROM (SELECT DISTINCT date FROM margin))
SELECT a.entity, strftime(a.date,'%Y-%m-%d') AS date, a.margin_balance, a.margin_balance-b.margin_balance AS margin_chg_5d
FROM margin a LEFT JOIN margin b ON b.entity=a.entity AND b.date=(SELECT date FROM d WHERE k=6) WHERE a.date=(SELECT date FROM d WHERE k=1)""")
def flw22(t):
    d = W.latest_vs_nth(t.margin, "date", ["margin_balance"], 6, "_chg")
    return d.select("entity", iso("date").alias("date"), "margin_balance", F.col("margin_balance_chg").alias("margin_chg_5d"))


@query("flw23_revenue_second_difference", """
SELECT entity, round(max(CASE WHEN k=1 THEN yoy_pct END)-max(CASE WHEN k=2 THEN yoy_pct END),6)+0.0 AS delta, round(max(CASE WHEN k=2 THEN yoy_pct END)-max(CASE WHEN k=3 THEN yoy_pct END),6)+0.0 AS delta_prev
FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year_month DESC) AS k FROM revenue) WHERE k<=3 GROUP BY 1""")
def flw23(t):
    return W.second_difference(t.revenue).select("entity", r6("delta").alias("delta"), r6("delta_prev").alias("delta_prev"))


_MG = ["gross_margin_pct", "net_margin_pct"]
view("single_q", "SELECT a.entity, a.year, a.quarter, CASE WHEN a.quarter=1 THEN a.revenue ELSE a.revenue-b.revenue END AS revenue, " + ", ".join(
    f"CASE WHEN a.quarter=1 THEN a.{m} WHEN a.revenue-b.revenue>0 THEN (a.{m}*a.revenue-b.{m}*b.revenue)/(a.revenue-b.revenue) END AS {m}" for m in _MG)
    + ", CASE WHEN a.quarter=1 THEN a.eps ELSE a.eps-b.eps END AS eps, a.bvps, CASE WHEN a.bvps>0 THEN (CASE WHEN a.quarter=1 THEN a.eps ELSE a.eps-b.eps END)/a.bvps*100 END AS roe_q_pct "
    "FROM statements a LEFT JOIN statements b ON b.entity=a.entity AND b.year=a.year AND b.quarter=a.quarter-1")


def single_q(t):
    return W.decumulate(t.statements, _MG)


@query("flw24_decumulate", "SELECT entity, year, quarter, revenue, " + ", ".join(f"round({m},6)+0.0 AS {m}" for m in [*_MG, "eps", "roe_q_pct"]) + " FROM single_q")
def flw24(t):
    return single_q(t).select("entity", "year", "quarter", "revenue", *[r6(m).alias(m) for m in [*_MG, "eps", "roe_q_pct"]])


view("latest_q", """
SELECT entity, max(CASE WHEN k=1 THEN year||'Q'||quarter END) AS quarter_label, max(CASE WHEN k=1 THEN net_margin_pct END) AS net_margin_pct, max(CASE WHEN k=1 THEN gross_margin_pct END) AS gross_margin_pct,
  max(CASE WHEN k=1 THEN roe_q_pct END) AS roe_q_pct, max(CASE WHEN k=1 THEN net_margin_pct END)-max(CASE WHEN k=2 THEN net_margin_pct END) AS delta_net_margin_pct
FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year DESC, quarter DESC) AS k FROM single_q) WHERE k<=2 GROUP BY 1
""")


def latest_q(t):
    return W.latest_quarter_with_deltas(single_q(t), ["net_margin_pct", "gross_margin_pct", "roe_q_pct"], ["net_margin_pct"])


@query("flw25_latest_quarter", "SELECT entity, quarter_label, " + ", ".join(f"round({x},6)+0.0 AS {x}" for x in ("net_margin_pct", "gross_margin_pct", "roe_q_pct", "delta_net_margin_pct")) + " FROM latest_q")
def flw25(t):
    return latest_q(t).select("entity", "quarter_label", *[r6(x).alias(x) for x in ("net_margin_pct", "gross_margin_pct", "roe_q_pct", "delta_net_margin_pct")])


view("confirm", """
SELECT entity, coalesce(arg_max(mn>0, date),false) AS confirm_buy FROM (SELECT p.entity, p.date, CASE WHEN count(*) OVER w>=2 THEN min(coalesce(total_net,0)) OVER w ELSE NULL END AS mn
  FROM prices p LEFT JOIN flows f USING (date, entity) WINDOW w AS (PARTITION BY p.entity ORDER BY p.date ROWS 1 PRECEDING)) GROUP BY 1
""")


@query("flw26_buy_confirm", "SELECT entity, confirm_buy::INT AS confirm_buy FROM confirm")
def flw26(t):
    return W.recent_buy_confirm(t.prices, t.flows).select("entity", F.col("confirm_buy").cast("int").alias("confirm_buy"))


view("nfz", """
SELECT date, entity, CASE WHEN count(s) OVER w>=30 AND stddev_samp(s) OVER w>0 THEN (s-avg(s) OVER w)/stddev_samp(s) OVER w END AS net_flow_z FROM (
  SELECT date, entity, CASE WHEN count(*) OVER w20>=20 THEN CAST(sum(coalesce(foreign_net,0)+coalesce(trust_net,0)+coalesce(dealer_net,0)) OVER w20 AS DOUBLE) END AS s
  FROM panel WINDOW w20 AS (PARTITION BY entity ORDER BY date ROWS 19 PRECEDING)) WINDOW w AS (PARTITION BY entity ORDER BY date ROWS 59 PRECEDING)
""")


@query("flw27_net_flow_z", "SELECT strftime(date,'%Y-%m-%d') AS date, entity, round(net_flow_z,6)+0.0 AS net_flow_z FROM nfz")
def flw27(t):
    return W.net_flow_z(panel_of(t)).select(iso("date").alias("date"), "entity", r6("net_flow_z").alias("net_flow_z"))
