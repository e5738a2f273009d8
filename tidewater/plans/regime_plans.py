"""Regime, macro percentile, light, event and washout queries."""

from pyspark.sql import functions as F

from tidewater.functions.exprs import iso, r6, with_scalar
from tidewater.operators import flows as W
from tidewater.operators import momentum as M
from tidewater.operators import regime as R
from tidewater.plans.momentum_plans import index_of
from tidewater.plans.registry import query, view
from tidewater.sources.staging import staged

_SAT = 300.0
view("rg_trend", """
SELECT date, CASE WHEN count(*) OVER w120>=120 THEN (CASE WHEN market_index>avg(market_index) OVER w20 THEN 1 ELSE -1 END+CASE WHEN avg(market_index) OVER w20>avg(market_index) OVER w60 THEN 1 ELSE -1 END
  +CASE WHEN avg(market_index) OVER w60>avg(market_index) OVER w120 THEN 1 ELSE -1 END)/3.0::DOUBLE END AS trend_score, min(market_index) OVER w120 AS lo, max(market_index) OVER w120 AS hi, market_index, count(*) OVER w120 AS c
FROM mkt_index WINDOW w20 AS (ORDER BY date ROWS 19 PRECEDING), w60 AS (ORDER BY date ROWS 59 PRECEDING), w120 AS (ORDER BY date ROWS 119 PRECEDING)
""")
view("rg_above", """
SELECT date, avg((close>ma)::INT) AS frac, count(*) AS n_priced FROM (SELECT date, close, CASE WHEN count(*) OVER w>=60 THEN avg(close) OVER w END AS ma FROM prices WHERE close>0
  WINDOW w AS (PARTITION BY entity ORDER BY date ROWS 59 PRECEDING)) WHERE ma IS NOT NULL GROUP BY 1
""")
view("rg_flow", f"""
SELECT date, (greatest(least((avg(net) OVER w5)/{_SAT}::DOUBLE,1.0::DOUBLE),-1.0::DOUBLE)+greatest(least((avg(net) OVER w20)/{_SAT}::DOUBLE,1.0::DOUBLE),-1.0::DOUBLE))/2 AS flow_score
FROM (SELECT date, CAST(sum(total_net) AS DOUBLE) AS net FROM flows GROUP BY 1) WINDOW w5 AS (ORDER BY date ROWS 4 PRECEDING), w20 AS (ORDER BY date ROWS 19 PRECEDING)
""")
view("rg_all", """
SELECT t.date, trend_score, CASE WHEN n_priced>=5 THEN CASE WHEN c>=2 THEN (2*frac-1+(2*(CASE WHEN hi>lo THEN (market_index-lo)/(hi-lo) ELSE 0.5 END)-1))/2.0::DOUBLE ELSE 2*frac-1 END END AS breadth_score,
  f.flow_score, frac AS frac_above_ma FROM rg_trend t LEFT JOIN rg_above a USING (date) ASOF LEFT JOIN rg_flow f ON t.date>=f.date
""")
view("regime", """
SELECT *, CASE WHEN regime_score IS NULL THEN '資料不足' WHEN regime_score>=0.33 THEN '進攻' WHEN regime_score<=-0.33 THEN '防禦' ELSE '中性' END AS regime_label FROM (
SELECT *, round((coalesce(trend_score*0.4::DOUBLE,0)+coalesce(breadth_score*0.3::DOUBLE,0)+coalesce(flow_score*0.3::DOUBLE,0))
  /nullif(CASE WHEN trend_score IS NULL THEN 0 ELSE 0.4::DOUBLE END+CASE WHEN breadth_score IS NULL THEN 0 ELSE 0.3::DOUBLE END+CASE WHEN flow_score IS NULL THEN 0 ELSE 0.3::DOUBLE END,0),9) AS regime_score FROM rg_all)
""")


def regime_of(t):
    return staged(t.spark, t.root, "regime", lambda: R.regime_history(t.prices, t.flows, index_of(t), 5, _SAT))


_RS = ["trend_score", "breadth_score", "flow_score"]


view("rg_last", """
SELECT avg((close>ma)::INT) AS frac, count(*) AS n_priced FROM (SELECT close, CASE WHEN count(*) OVER w>=60 THEN avg(close) OVER w END AS ma, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS k FROM prices WHERE close>0
  WINDOW w AS (PARTITION BY entity ORDER BY date ROWS 59 PRECEDING)) WHERE k=1 AND ma IS NOT NULL
""")


@query("reg01_sub_scores", "SELECT strftime(date,'%Y-%m-%d') AS date, " + ", ".join(f"round({x},6)+0.0 AS {x}" for x in _RS) + """ FROM (SELECT t.date, trend_score, CASE WHEN n_priced>=5 THEN CASE WHEN c>=2 THEN (2*frac-1+(2*(CASE WHEN hi>lo THEN (market_index-lo)/(hi-lo) ELSE 0.5 END)-1))/2.0::DOUBLE ELSE 2*frac-1 END END AS breadth_score,
  (SELECT arg_max(flow_score, f.date) FROM rg_flow f WHERE f.date<=(SELECT max(date) FROM rg_trend)) AS flow_score FROM rg_trend t CROSS JOIN rg_last WHERE t.date=(SELECT max(date) FROM rg_trend))""")
def reg01(t):
    return R.latest_scores(t.prices, t.flows, index_of(t), min_priced=5, saturate=_SAT).select(iso("date").alias("date"), *[r6(x).alias(x) for x in _RS])


@query("reg03_regime_history", "SELECT strftime(date,'%Y-%m-%d') AS date, regime_label, round(regime_score,6)+0.0 AS regime_score, " + ", ".join(f"round({x},6)+0.0 AS {x}" for x in _RS) + " FROM regime")
def reg03(t):
    return regime_of(t).select(iso("date").alias("date"), "regime_label", *[r6(x).alias(x) for x in ("regime_score", *_RS)])


@query("reg02_regime_days", "SELECT regime_label, count(*) AS n_days, round(avg(regime_score),6)+0.0 AS mean_score FROM regime GROUP BY 1")
def reg02(t):
    return regime_of(t).groupBy("regime_label").agg(F.count(F.lit(1)).alias("n_days"), r6(F.avg("regime_score")).alias("mean_score"))


view("lvl", """
SELECT series_id, date, value, k, (SELECT count(*) FROM unnest(v) u(x) WHERE x<=value)/len(v)::DOUBLE AS score FROM (
  SELECT *, list(value) OVER (PARTITION BY series_id ORDER BY date ROWS 249 PRECEDING) AS v, row_number() OVER (PARTITION BY series_id ORDER BY date) AS k FROM series) WHERE k>=30
""")
view("dlt", "SELECT * FROM (SELECT series_id, date, value-lag(value,20) OVER (PARTITION BY series_id ORDER BY date) AS value FROM series) WHERE value IS NOT NULL")
view("spd", """
SELECT series_id, date, (SELECT count(*) FROM unnest(v) u(x) WHERE x<=value)/len(v)::DOUBLE AS score FROM (
  SELECT *, list(value) OVER (PARTITION BY series_id ORDER BY date ROWS 249 PRECEDING) AS v, row_number() OVER (PARTITION BY series_id ORDER BY date) AS k FROM dlt) WHERE k>=30
""")


def levels_of(t):
    return staged(t.spark, t.root, "level_pct", lambda: R.level_pct(t.series, 250))


@query("reg04_level_percentile", "SELECT series_id, strftime(date,'%Y-%m-%d') AS date, round(score,6) AS score FROM lvl")
def reg04(t):
    return levels_of(t).select("series_id", iso("date").alias("date"), r6("score").alias("score"))


@query("reg05_speed_and_dual_risk", "SELECT series_id, strftime(date,'%Y-%m-%d') AS date, round(score,6) AS speed_pct, round(2*abs(score-0.5),6)+0.0 AS dual_risk FROM spd")
def reg05(t):
    s = R.speed_pct(t.series, 250, 20)
    return s.select("series_id", iso("date").alias("date"), r6("score").alias("speed_pct"), r6(2 * F.abs(F.col("score") - 0.5)).alias("dual_risk"))


view("lights", """
WITH RECURSIVE o AS (SELECT series_id, date, score*100 AS s, row_number() OVER (PARTITION BY series_id ORDER BY date) AS n FROM lvl),
r AS (SELECT series_id, n, date, CASE WHEN s<60 THEN 'green' WHEN s>=80 THEN 'red' ELSE 'yellow' END AS color FROM o WHERE n=1
  UNION ALL SELECT o.series_id, o.n, o.date, CASE r.color WHEN 'green' THEN CASE WHEN s>=83 THEN 'red' WHEN s>=63 THEN 'yellow' ELSE 'green' END
    WHEN 'red' THEN CASE WHEN s>=77 THEN 'red' WHEN s<57 THEN 'green' ELSE 'yellow' END ELSE CASE WHEN s>=83 THEN 'red' WHEN s<57 THEN 'green' ELSE 'yellow' END END
  FROM r JOIN o ON o.series_id=r.series_id AND o.n=r.n+1) SELECT series_id, date, color FROM r
""")


@query("reg06_traffic_light", "SELECT series_id, strftime(date,'%Y-%m-%d') AS date, color FROM lights")
def reg06(t):
    return R.light_series(levels_of(t), 60, 80, 3).select("series_id", iso("date").alias("date"), "color")


_AS1, _AS0 = "2001-06-29", "2001-06-22"


def _read_sql(d):
    return f"""SELECT a.series_id, a.date, a.value AS raw_value, DATE '{d}'-a.date AS age, DATE '{d}'-a.date>10 AS stale, CASE WHEN DATE '{d}'-a.date<=10 THEN l.score*100 END AS score_pct
FROM (SELECT series_id, max(date) AS date, arg_max(value, date) AS value FROM series WHERE date<=DATE '{d}' GROUP BY 1) a LEFT JOIN lvl l ON l.series_id=a.series_id AND l.date=a.date"""


@query("reg07_panel_reading", f"""
SELECT n.series_id, strftime(n.date,'%Y-%m-%d') AS as_of, n.raw_value, CAST(n.age AS BIGINT) AS age_days, n.stale::INT AS stale, round(n.score_pct,6) AS score_pct,
  round(n.raw_value-p.raw_value,6)+0.0 AS delta_raw, round(CASE WHEN NOT n.stale THEN n.score_pct-p.score_pct END,6)+0.0 AS delta_score,
  CASE WHEN n.stale OR n.score_pct-p.score_pct IS NULL THEN 'no_prev' WHEN n.score_pct-p.score_pct>2 THEN 'up' WHEN n.score_pct-p.score_pct<-2 THEN 'down' ELSE 'flat' END AS arrow
FROM ({_read_sql(_AS1)}) n LEFT JOIN ({_read_sql(_AS0)}) p USING (series_id)""")
def reg07(t):
    now = R.panel_reading(t.series, levels_of(t), F.to_date(F.lit(_AS1)), 10)
    prev = R.panel_reading(t.series, levels_of(t), F.to_date(F.lit(_AS0)), 10)
    d = R.panel_deltas(now, prev, 2.0).select("series_id", "delta_raw", "delta_score", "arrow")
    return now.join(d, "series_id").select("series_id", iso("as_of").alias("as_of"), "raw_value", F.col("age_days").cast("bigint").alias("age_days"),
                                           F.col("stale").cast("int").alias("stale"), r6("score_pct").alias("score_pct"), r6("delta_raw").alias("delta_raw"), r6("delta_score").alias("delta_score"), "arrow")


def margin_series(t):
    w = R.own_rows()
    chg = F.col("margin_balance") - F.lag("margin_balance").over(w)
    return t.margin.select("date", "margin_balance", chg.alias("c")).groupBy("date").agg(
        F.sum("margin_balance").alias("total"), F.sum(F.coalesce("c", F.lit(0.0))).alias("chg"))


view("mser", """
SELECT date, sum(margin_balance) AS total, sum(coalesce(c,0)) AS chg FROM (SELECT date, margin_balance, margin_balance-lag(margin_balance) OVER (PARTITION BY entity ORDER BY date) AS c FROM margin) GROUP BY 1
""")
view("mser250", """
SELECT *, CASE WHEN count(chg) OVER w>=5 THEN sum(chg) OVER w END AS d5 FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS b FROM mser) WHERE b<=250 WINDOW w AS (ORDER BY date ROWS 4 PRECEDING)
""")
view("washout", """
SELECT 'margin' AS name, coalesce(least(z1,z5)<-2,false) AS hit, round(round(least(z1,z5),9),2)+0.0 AS value, CASE WHEN least(z1,z5) IS NULL THEN 'insufficient_data' ELSE 'ok' END AS status
FROM (SELECT CASE WHEN count(chg)>=60 THEN ((max(chg) FILTER (WHERE b=1))-avg(chg))/stddev_samp(chg) END AS z1,
    CASE WHEN max(date)-(max(date) FILTER (WHERE b=5))<=9 AND count(d5)>=60 THEN ((max(d5) FILTER (WHERE b=1))-avg(d5))/stddev_samp(d5) END AS z5 FROM mser250)
UNION ALL SELECT 'breadth', coalesce(v<0.2,false), round(round(v,9),3)+0.0, CASE WHEN v IS NULL THEN 'missing' ELSE 'ok' END FROM (SELECT arg_max(frac_above_ma, date) AS v FROM regime)
UNION ALL SELECT 'flow', coalesce(n>=15 AND v < -0.9,false), CASE WHEN n>=15 THEN round(round(v,9),3)+0.0 END, CASE WHEN n>=15 THEN 'ok' ELSE 'insufficient_data' END
FROM (SELECT count(*) AS n, max(flow_score) AS v FROM (SELECT * FROM regime WHERE flow_score IS NOT NULL ORDER BY date DESC LIMIT 15))
UNION ALL SELECT 'index', coalesce(n>=60 AND v*100 < -7,false), CASE WHEN n>=60 THEN round(round(v*100,9),2)+0.0 END, CASE WHEN n>=60 THEN 'ok' ELSE 'insufficient_data' END
FROM (SELECT count(*) AS n, arg_max(market_index, date)/avg(market_index)-1 AS v FROM (SELECT * FROM mkt_index ORDER BY date DESC LIMIT 60))
""")


@query("reg09_washout_signals", "SELECT name, hit::INT AS hit, value, status FROM washout")
def reg09(t):
    return R.washout_signals(margin_series(t), regime_of(t), index_of(t)).withColumn("hit", F.col("hit").cast("int"))


@query("reg10_washout_trigger", "SELECT count(*) FILTER (WHERE hit) AS n_hit, count(*) FILTER (WHERE status='ok') AS n_evaluable, (count(*) FILTER (WHERE hit)>=2)::INT AS triggered FROM washout")
def reg10(t):
    return R.washout_trigger(R.washout_signals(margin_series(t), regime_of(t), index_of(t))).withColumn("triggered", F.col("triggered").cast("int"))


view("ev20", """
SELECT series_id, date, (1-m/value>=0.5)::INT AS event FROM (SELECT *, min(value) OVER w AS m, count(value) OVER w AS c FROM series
WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) WHERE value>0 AND c=3
""")


@query("reg11_event_labels", "SELECT series_id, strftime(date,'%Y-%m-%d') AS date, event FROM ev20")
def reg11(t):
    return R.event_labels(t.series, 3, 0.5).select("series_id", iso("date").alias("date"), "event")


view("lift_rows", """
SELECT series_id, date, (score>=0.8)::INT::DOUBLE AS b, event::DOUBLE AS e, row_number() OVER (PARTITION BY series_id ORDER BY date)-1 AS i, count(*) OVER (PARTITION BY series_id) AS t FROM lvl JOIN ev20 USING (series_id, date)
""")
view("lift_pre", "SELECT series_id, i, sum(b) OVER w AS b, sum(e) OVER w AS e, sum(b*e) OVER w AS be FROM lift_rows WINDOW w AS (PARTITION BY series_id ORDER BY i)")
view("lift_draw", """
SELECT series_id, t, r, CASE WHEN k<nb-1 THEN l ELSE t-l*(nb-1) END AS take, (('0x'||substr(md5('42:'||r||':'||k),1,8))::BIGINT) % (t-l+1) AS st
FROM (SELECT series_id, max(t) AS t, least(20,max(t)) AS l, CAST(ceil(max(t)/least(20,max(t))) AS BIGINT) AS nb FROM lift_rows GROUP BY 1) h, range(1000) a(r), range(nb) c(k)
""")
view("lift_boot", """
SELECT d.series_id, d.r, (sum(h.be-coalesce(g.be,0))/nullif(sum(h.b-coalesce(g.b,0)),0))/nullif(sum(h.e-coalesce(g.e,0))/max(t),0) AS lift
FROM lift_draw d JOIN lift_pre h ON h.series_id=d.series_id AND h.i=st+take-1 LEFT JOIN lift_pre g ON g.series_id=d.series_id AND g.i=st-1 GROUP BY 1,2
""")
view("lift_ci", """
SELECT series_id, max(CASE WHEN q=25 THEN lift END) AS ci_lo, max(CASE WHEN q=974 THEN lift END) AS ci_hi FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY lift ASC NULLS LAST)-1 AS q FROM lift_boot) GROUP BY 1
""")


@query("reg12_bucket_lift", """
SELECT series_id, count(*) AS n_all, CAST(sum(b) AS BIGINT) AS n_high, CAST(sum(b*e) AS BIGINT) AS n_high_event, CAST(sum(e) AS BIGINT) AS n_event, round((sum(b*e)/sum(b))/(sum(e)/count(*)),6) AS lift,
  CAST(ceil(count(*)/20.0) AS BIGINT) AS n_blocks, round(max(c.ci_lo),6) AS ci_lo, round(max(c.ci_hi),6) AS ci_hi FROM lift_rows JOIN lift_ci c USING (series_id) GROUP BY 1""")
def reg12(t):
    b = levels_of(t).select("series_id", "date", (F.col("score") >= 0.8).alias("in_bucket"))
    e = R.event_labels(t.series, 3, 0.5)
    d = R.bucket_lift(b, e, ["series_id"], 20).join(R.lift_ci(b, e, ["series_id"], 20), "series_id")
    return d.select("series_id", "n_all", "n_high", "n_high_event", "n_event", r6("lift").alias("lift"), F.col("n_blocks").cast("bigint").alias("n_blocks"), r6("ci_lo").alias("ci_lo"), r6("ci_hi").alias("ci_hi"))


def _fire_views(th, name):
    view(f"fired_{name}", f"SELECT series_id, date, score>={th} AS fired, row_number() OVER (PARTITION BY series_id ORDER BY date) AS i FROM lvl")
    view(f"fep_{name}", f"""SELECT series_id, min(date) AS s, max(date) AS e FROM (SELECT *, sum(nw) OVER (PARTITION BY series_id ORDER BY date) AS g FROM (
  SELECT *, coalesce((i-lag(i) OVER (PARTITION BY series_id ORDER BY date)>6)::INT,0) AS nw FROM fired_{name} WHERE fired)) GROUP BY series_id, g""")


for _th in (0.75, 0.8, 0.85, 0.9):
    _fire_views(_th, str(int(_th * 100)))


@query("reg13_fired_episodes", "SELECT series_id, strftime(s,'%Y-%m-%d') AS start, strftime(e,'%Y-%m-%d') AS \"end\" FROM fep_80")
def reg13(t):
    f = levels_of(t).select("series_id", "date", (F.col("score") >= 0.8).alias("fired"))
    return R.fired_episodes(f, ["series_id"], 5).select("series_id", iso("start").alias("start"), iso("end").alias("end"))


@query("reg13_combined_fired", "SELECT strftime(date,'%Y-%m-%d') AS date, (count(*) FILTER (WHERE fired)>=2)::INT AS fired FROM fired_80 GROUP BY date HAVING count(*)=(SELECT count(DISTINCT series_id) FROM series)")
def reg13b(t):
    f = levels_of(t).select("series_id", "date", (F.col("score") >= 0.8).alias("fired"))
    n = f.select("series_id").distinct().agg(F.count(F.lit(1)).alias("n_parts"))
    c = f.groupBy("date").agg(F.count(F.when(F.col("fired"), 1)).alias("c"), F.count(F.lit(1)).alias("n"))
    return with_scalar(c, n).where(F.col("n") == F.col("n_parts")).select(iso("date").alias("date"), (F.col("c") >= 2).cast("int").alias("fired"))


view("cal_i", "SELECT date, row_number() OVER (ORDER BY date)-1 AS i FROM (SELECT DISTINCT date FROM prices)")


@query("reg14_day_offsets", """
SELECT strftime(a.d,'%Y-%m-%d') AS anchor, strftime(lo.date,'%Y-%m-%d') AS before, strftime(hi.date,'%Y-%m-%d') AS after
FROM (SELECT d, greatest(coalesce((SELECT max(i) FROM cal_i WHERE date<=d),0)-10,0) AS b, least(least(coalesce((SELECT min(i) FROM cal_i WHERE date>=d),(SELECT max(i) FROM cal_i)),(SELECT max(i) FROM cal_i))+10,(SELECT max(i) FROM cal_i)) AS f
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)) a JOIN cal_i lo ON lo.i=b JOIN cal_i hi ON hi.i=f""")
def reg14(t):
    anchors = t.raw("orders").select(F.to_date("o_orderdate").alias("anchor")).distinct()
    d = R.day_offset(W.numbered_days(t.prices), anchors, 10)
    return d.select(iso("anchor").alias("anchor"), iso("before").alias("before"), iso("after").alias("after"))


_EVW = [("a", "1996-01-01", "1996-06-30"), ("b", "1998-01-01", "1998-06-30"), ("c", "2000-01-01", "2000-06-30")]


@query("reg15_parameter_grid", "WITH ev(name,w0,w1) AS (VALUES " + ",".join(f"('{a}',DATE '{b}',DATE '{c}')" for a, b, c in _EVW) + ") " + " UNION ALL ".join(f"""
SELECT {th}::DOUBLE AS threshold, f.series_id, round(f.fr,6) AS fire_rate, coalesce(e.n,0) AS n_episodes, coalesce(e.fp,0) AS false_positives, coalesce(e.h,0) AS n_events_hit, (coalesce(e.h,0)=3 AND f.fr<0.3 AND coalesce(e.fp,0)<=60)::INT AS candidate
FROM (SELECT series_id, avg(fired::INT) AS fr FROM fired_{int(th * 100)} GROUP BY 1) f LEFT JOIN (SELECT series_id, count(DISTINCT s) AS n, count(DISTINCT CASE WHEN name IS NULL THEN s END) AS fp, count(DISTINCT name) AS h
  FROM fep_{int(th * 100)} LEFT JOIN ev ON s BETWEEN w0 AND w1 GROUP BY 1) e USING (series_id)""" for th in (0.75, 0.8, 0.85, 0.9)))
def reg15(t):
    th = F.explode(F.array(*[F.lit(x) for x in (0.75, 0.8, 0.85, 0.9)]))
    f = levels_of(t).select(th.alias("threshold"), "series_id", "date", "score").withColumn("fired", F.col("score") >= F.col("threshold"))
    ev = t.spark.createDataFrame(_EVW, "name string, w0 string, w1 string").select("name", F.to_date("w0").alias("w0"), F.to_date("w1").alias("w1"))
    s = R.episode_scores(f, ["threshold", "series_id"], ev, 5)
    cand = (F.col("n_events_hit") == 3) & (F.col("fire_rate") < 0.3) & (F.col("false_positives") <= 60)
    return s.select("threshold", "series_id", r6("fire_rate").alias("fire_rate"), F.col("n_episodes").cast("bigint").alias("n_episodes"), F.col("false_positives").cast("bigint").alias("false_positives"),
                    F.col("n_events_hit").cast("bigint").alias("n_events_hit"), cand.cast("int").alias("candidate"))


@query("reg16_market_state", """
SELECT r.regime_label, l.color AS macro_light, w.n_hit AS washout_hits FROM (SELECT arg_max(regime_label, date) AS regime_label FROM regime) r,
(SELECT arg_max(color, date) AS color FROM lights WHERE series_id='1-URGENT') l, (SELECT count(*) FILTER (WHERE hit) AS n_hit FROM washout) w""")
def reg16(t):
    lab = regime_of(t).agg(F.max_by("regime_label", "date").alias("regime_label"))
    li = R.light_series(levels_of(t).where(F.col("series_id") == "1-URGENT"), 60, 80, 3).agg(F.max_by("color", "date").alias("macro_light"))
    w = R.washout_trigger(R.washout_signals(margin_series(t), regime_of(t), index_of(t))).select(F.col("n_hit").alias("washout_hits"))
    return with_scalar(with_scalar(lab, li), w)


@query("val19_market_state", """
SELECT strftime(date,'%Y-%m-%d') AS date, CASE WHEN ma IS NULL THEN NULL WHEN market_index>=ma THEN '多' ELSE '空' END AS mkt_state FROM (
  SELECT date, market_index, CASE WHEN count(*) OVER w>=200 THEN avg(market_index) OVER w END AS ma FROM mkt_index WINDOW w AS (ORDER BY date ROWS 199 PRECEDING))""")
def val19(t):
    return state_of(t).withColumn("date", iso("date"))


def state_of(t):
    ma = M.roll_avg("market_index", R.day_window(), 200)
    d = index_of(t).withColumn("ma", ma)
    return d.select("date", F.when(F.col("ma").isNotNull(), F.when(F.col("market_index") >= F.col("ma"), "多").otherwise("空")).alias("mkt_state"))
