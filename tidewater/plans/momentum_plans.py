"""Momentum, index, basket and streak queries."""

from pyspark.sql import functions as F

from tidewater.functions.exprs import iso, r6
from tidewater.operators import momentum as M
from tidewater.plans.registry import query, view
from tidewater.sources.staging import staged

view("backs", """
SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY entity) AS n_rows FROM prices
""")
view("ndr", """
SELECT a.entity, (a.close-b.close)/b.close*100 AS ret_pct, least(5, a.n_rows-1) AS gap, a.close AS now, b.close AS base,
  a.date AS now_date, b.date AS base_date
FROM backs a JOIN backs b ON a.entity=b.entity AND a.back=1 AND b.back=least(6, b.n_rows) WHERE a.n_rows>=2 AND b.close<>0
""")


@query("mom01_n_day_return", "SELECT entity, round(ret_pct,6)+0.0 AS ret_pct, CAST(gap AS BIGINT) AS gap FROM ndr")
def mom01(t):
    return M.n_day_return(t.prices).select("entity", r6("ret_pct").alias("ret_pct"), F.col("gap").cast("bigint").alias("gap"))


@query("mom02_trailing_extrema", """
SELECT entity, min(close) FILTER (WHERE back<=20) AS min_20, max(close) FILTER (WHERE back<=20) AS max_20,
  min(close) FILTER (WHERE back<=60) AS min_60, max(close) FILTER (WHERE back<=60) AS max_60 FROM backs GROUP BY 1""")
def mom02(t):
    return M.trailing_extrema(t.prices)


@query("mom03_dividend_addback", """
SELECT entity, round((sum(ratio)*max(now)+sum(cash))/max(base)*100,6)+0.0 AS addback_pct, sum(cash) AS cash, round(sum(ratio),6)+0.0 AS ratio
FROM (SELECT n.*, d.cash, CASE WHEN d.after_price IS NULL THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS ratio
      FROM (SELECT a.entity, a.close AS now, b.close AS base, a.date AS now_date, b.date AS base_date
            FROM backs a JOIN backs b ON a.entity=b.entity AND a.back=1 AND b.back=least(61, b.n_rows) WHERE a.n_rows>=2 AND b.close<>0) n
      JOIN dividends d USING (entity) WHERE base_date<ex_date AND ex_date<=now_date)
WHERE cash>0 OR ratio>0 GROUP BY entity HAVING sum(cash)>0 OR sum(ratio)>0""")
def mom03(t):
    div = t.dividends.withColumn("ratio", F.when(F.col("after_price").isNull(), 0.05).otherwise(F.lit(0.0)))
    return M.dividend_addback(t.prices, div, 60).select("entity", r6("addback_pct").alias("addback_pct"), "cash", r6("ratio").alias("ratio"))


@query("mom04_price_discontinuity", """
SELECT entity, round(ret1d,6)+0.0 AS ret1d, strftime(date,'%Y-%m-%d') AS date FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY abs(ret1d) DESC, date) AS rn FROM (
    SELECT entity, date, (close-prev)/prev*100 AS ret1d, abs(close-prev) AS mv, change FROM (
      SELECT b.entity, b.date, b.close, lag(b.close) OVER (PARTITION BY b.entity ORDER BY b.date) AS prev,
        CASE WHEN f.date IS NULL THEN NULL ELSE f.foreign_net::DOUBLE END AS change
      FROM backs b LEFT JOIN flows f ON f.entity=b.entity AND f.date=b.date WHERE b.back<=61) WHERE prev IS NOT NULL AND prev<>0)
  WHERE abs(ret1d)>5 AND (change IS NULL OR abs(change)<0.5*mv)) WHERE rn=1""")
def mom04(t):
    px = t.prices.join(t.flows.select("date", "entity", F.col("foreign_net").cast("double").alias("change")), ["date", "entity"], "left")
    return M.price_discontinuity(px, 60, 5.0).select("entity", r6("ret1d").alias("ret1d"), iso("date").alias("date"))


@query("mom05_group_momentum", """
SELECT grp, round(coalesce(avg(ret_pct),0.0::DOUBLE),6)+0.0 AS mean_ret, CAST(coalesce(min(gap),0) AS BIGINT) AS min_gap
FROM themes LEFT JOIN ndr USING (entity) GROUP BY 1""")
def mom05(t):
    return M.group_mean_return(t.themes, M.n_day_return(t.prices)).select(
        "grp", r6("mean_ret").alias("mean_ret"), F.col("min_gap").cast("bigint").alias("min_gap"))


view("clipped", """
SELECT date, entity, r AS ret FROM (SELECT date, entity,
  greatest(least(close/lag(close) OVER (PARTITION BY entity ORDER BY date)-1.0::DOUBLE, 0.1::DOUBLE), -0.1::DOUBLE) AS r,
  lag(close) OVER (PARTITION BY entity ORDER BY date) AS pv FROM prices WHERE close>0) WHERE pv IS NOT NULL
""")
view("mkt_index", """
SELECT date, mkt_ret, round(exp(sum(ln(1+mkt_ret)) OVER (ORDER BY date))*100,9) AS market_index FROM (SELECT date, avg(ret) AS mkt_ret FROM clipped GROUP BY 1)
""")
view("baskets", """
SELECT grp, date, basket_return_pct, members_priced,
  round(exp(sum(ln(1+basket_return_pct/100)) OVER (PARTITION BY grp ORDER BY date))*100,9) AS basket_index
FROM (SELECT grp, date, avg(ret)*100 AS basket_return_pct, count(DISTINCT entity) AS members_priced
      FROM membership JOIN clipped USING (entity) GROUP BY 1,2)
""")


def baskets_of(t):
    return staged(t.spark, t.root, "baskets", lambda: M.group_baskets(t.membership, t.prices))


def index_of(t):
    return staged(t.spark, t.root, "market_index", lambda: M.market_index(t.prices))


@query("mom06_market_index", "SELECT strftime(date,'%Y-%m-%d') AS date, round(mkt_ret,8)+0.0 AS mkt_ret, round(market_index*(1+1e-12),6) AS market_index FROM mkt_index")
def mom06(t):
    return index_of(t).select(iso("date").alias("date"), r6("mkt_ret", 8).alias("mkt_ret"), r6("market_index").alias("market_index"))


@query("mom07_group_baskets", """
SELECT grp, strftime(date,'%Y-%m-%d') AS date, round(basket_return_pct,6)+0.0 AS basket_return_pct, members_priced, round(basket_index*(1+1e-12),6) AS basket_index FROM baskets""")
def mom07(t):
    return baskets_of(t).select("grp", iso("date").alias("date"), r6("basket_return_pct").alias("basket_return_pct"),
                                "members_priced", r6("basket_index").alias("basket_index"))


view("basket_pos", """
SELECT grp, date, basket_index, (basket_index/min(basket_index) OVER (PARTITION BY grp ORDER BY date ROWS 59 PRECEDING)-1)*100 AS above_low_pct,
  (basket_index/lag(basket_index,5) OVER (PARTITION BY grp ORDER BY date)-1)*100 AS basket_ret_5d FROM baskets
""")


@query("mom08_basket_position", """
SELECT grp, strftime(date,'%Y-%m-%d') AS date, round(above_low_pct,6)+0.0 AS above_low_pct, round(basket_ret_5d,6)+0.0 AS basket_ret_5d FROM basket_pos""")
def mom08(t):
    return M.basket_position(baskets_of(t)).select(
        "grp", iso("date").alias("date"), r6("above_low_pct").alias("above_low_pct"), r6("basket_ret_5d").alias("basket_ret_5d"))


@query("mom09_trajectory", """
WITH d AS (SELECT *, close < lag(close) OVER w AS down,
    CASE WHEN count(*) OVER w20 >= 20 THEN close > avg(close) OVER w20 END AS side FROM backs
    WINDOW w AS (PARTITION BY entity ORDER BY date), w20 AS (PARTITION BY entity ORDER BY date ROWS 19 PRECEDING)),
s AS (SELECT *, first_value(side) OVER (PARTITION BY entity ORDER BY back) AS side0 FROM d),
g AS (SELECT entity, min(CASE WHEN NOT coalesce(down,false) THEN back END)-1 AS streak,
    coalesce(min(CASE WHEN side IS NULL OR side<>side0 THEN back END)-1, max(n_rows)) AS run, bool_or(CASE WHEN back=1 THEN side END) AS top
  FROM s WHERE n_rows>=25 GROUP BY 1),
v AS (SELECT entity, round(round((avg(volume) FILTER (WHERE back<=5))/(avg(volume) FILTER (WHERE back>5 AND back<=25)),9),2) AS vr, count(*) AS n FROM backs GROUP BY 1),
z AS (SELECT g.entity, streak, CASE WHEN top THEN run ELSE -run END AS ab, CASE WHEN n>=25 THEN vr END AS vr FROM g JOIN v USING (entity))
SELECT entity, streak AS down_days_streak, ab AS above_ma20_days, vr AS pullback_vol_ratio,
  CASE WHEN ab<0 AND (streak>=4 OR vr>=1.5) THEN '破線' WHEN ab>0 AND streak<=1 AND vr<=0.8 THEN '止穩' ELSE '觀察' END AS pullback_quality FROM z""")
def mom09(t):
    return M.trajectory(t.prices)


@query("mom10_buy_streak", """
SELECT entity, coalesce(min(CASE WHEN foreign_net<=0 THEN back END)-1, count(*)) AS streak FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS back FROM flows) GROUP BY 1""")
def mom10(t):
    return M.buy_streak(t.flows, "foreign_net").withColumn("streak", F.col("streak").cast("bigint"))


@query("mom11_latest_values", """
SELECT entity, strftime(max(date) FILTER (WHERE back=1),'%Y-%m-%d') AS date, max(close) FILTER (WHERE back=1) AS close,
  (max(close) FILTER (WHERE back=1)) - (max(close) FILTER (WHERE back=2)) AS change,
  round(round((max(volume) FILTER (WHERE back=1))*(max(close) FILTER (WHERE back=1))/1e6,9),2) AS amount_million,
  round(CASE WHEN max(n_rows)>=20 THEN ((max(close) FILTER (WHERE back=1))-(avg(close) FILTER (WHERE back<=20)))/(avg(close) FILTER (WHERE back<=20))*100 END,6)+0.0 AS ma20_dist_pct,
  round(CASE WHEN max(n_rows)>=60 THEN ((max(close) FILTER (WHERE back=1))-(avg(close) FILTER (WHERE back<=60)))/(avg(close) FILTER (WHERE back<=60))*100 END,6)+0.0 AS ma60_dist_pct,
  round(CASE WHEN max(n_rows)>=70 THEN ((avg(close) FILTER (WHERE back<=60))-(avg(close) FILTER (WHERE back>10 AND back<=70)))/(avg(close) FILTER (WHERE back>10 AND back<=70))*100 END,6)+0.0 AS ma60_slope_pct
FROM backs GROUP BY 1""")
def mom11(t):
    d = M.ma_distance(t.prices)
    return d.select("entity", iso("date").alias("date"), "close", "change", "amount_million",
                    *[r6(x).alias(x) for x in ("ma20_dist_pct", "ma60_dist_pct", "ma60_slope_pct")])


view("rs_latest", """
SELECT entity, ret*100 AS ret_pct, (ret-median(ret) OVER ())*100 AS rs_pct FROM (
  SELECT entity, date, close/lag(close,20) OVER (PARTITION BY entity ORDER BY date)-1 AS ret FROM prices WHERE close>0)
WHERE date=(SELECT max(date) FROM prices) AND ret IS NOT NULL
""")


@query("mom12_rs_vs_median", "SELECT entity, round(ret_pct,6)+0.0 AS ret_pct, round(rs_pct,6)+0.0 AS rs_pct FROM rs_latest")
def mom12(t):
    return M.window_return_vs_median(t.prices).select("entity", r6("ret_pct").alias("ret_pct"), r6("rs_pct").alias("rs_pct"))


view("rs_group", """
SELECT date, entity, grp, (r-avg(r) OVER (PARTITION BY grp, date))*100 AS rs_subind FROM membership JOIN (
  SELECT date, entity, close/lag(close,20) OVER (PARTITION BY entity ORDER BY date)-1 AS r FROM prices) USING (entity) WHERE r IS NOT NULL
""")


@query("mom13_rs_vs_group", "SELECT strftime(date,'%Y-%m-%d') AS date, entity, grp, round(rs_subind,6)+0.0 AS rs_subind FROM rs_group")
def mom13(t):
    return M.rs_vs_group(t.prices, t.membership).select(iso("date").alias("date"), "entity", "grp", r6("rs_subind").alias("rs_subind"))


