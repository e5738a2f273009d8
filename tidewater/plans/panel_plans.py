"""Panel, target and health queries."""

from pyspark.sql import functions as F

from tidewater.functions.exprs import iso, r6
from tidewater.operators import panel as P
from tidewater.operators import stats as S
from tidewater.plans.registry import query, view
from tidewater.sources.staging import shared, staged
from tidewater.sources.tables import Tables

HS = (5, 10, 20, 40)

view("div_rows", """
SELECT entity, date, sum(cash) AS div_cash FROM (
  SELECT d.entity, d.cash, (SELECT min(p.date) FROM prices p WHERE p.entity=d.entity AND p.date>=d.ex_date) AS date
  FROM (SELECT entity, ex_date, sum(cash) AS cash FROM dividends WHERE cash>0 GROUP BY 1,2) d)
WHERE date IS NOT NULL GROUP BY 1,2
""")
view("px_div", """
SELECT p.date, p.entity, p.close, p.volume,
  sum(coalesce(d.div_cash,0.0::DOUBLE)) OVER (PARTITION BY p.entity ORDER BY p.date) AS cum_div
FROM prices p LEFT JOIN div_rows d ON p.entity=d.entity AND p.date=d.date WHERE p.close>0
""")
_fw = ", ".join(
    f"((lead(close,{1 + h}) OVER w - lead(close,1) OVER w + (lead(cum_div,{1 + h}) OVER w - lead(cum_div,1) OVER w))"
    f" / lead(close,1) OVER w * 100) AS r{h}" for h in HS
)
view("fwd_levels", f"""
SELECT date, entity, close, volume, {_fw},
  CASE WHEN count(*) OVER w20 >= 20 THEN (close/avg(close) OVER w20 - 1)*100 END AS ma20_dist_pct,
  CASE WHEN count(*) OVER w60 >= 60 THEN (close/avg(close) OVER w60 - 1)*100 END AS ma60_dist_pct,
  CASE WHEN count(*) OVER wv >= 20 AND avg(volume) OVER wv > 0 THEN volume/avg(volume) OVER wv END AS vol_ratio
FROM px_div WINDOW w AS (PARTITION BY entity ORDER BY date),
  w20 AS (PARTITION BY entity ORDER BY date ROWS 19 PRECEDING),
  w60 AS (PARTITION BY entity ORDER BY date ROWS 59 PRECEDING),
  wv AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
""")
view("mkt_med", "SELECT date, " + ", ".join(f"median(r{h}) AS mkt_ew_r{h}" for h in HS) + " FROM fwd_levels GROUP BY date")
view("panel0", "SELECT f.*, " + ", ".join(f"mkt_ew_r{h}" for h in HS) + ", "
     + ", ".join(f"r{h}-mkt_ew_r{h} AS alpha{h}" for h in HS) + " FROM fwd_levels f JOIN mkt_med USING (date)")
view("chip_days", "SELECT DISTINCT f.date, b.grp AS market FROM flows f JOIN broad b USING (entity)")
view("panel", """
SELECT p.*, c.date IS NOT NULL AS chip_coverage,
  CASE WHEN c.date IS NOT NULL THEN f.foreign_net END AS foreign_net,
  CASE WHEN c.date IS NOT NULL THEN f.trust_net END AS trust_net,
  CASE WHEN c.date IS NOT NULL THEN f.dealer_net END AS dealer_net, t.sub_industry
FROM panel0 p LEFT JOIN broad b USING (entity)
LEFT JOIN flows f ON f.entity=p.entity AND f.date=p.date
LEFT JOIN chip_days c ON c.date=p.date AND c.market=b.grp
LEFT JOIN (SELECT entity, min(grp) AS sub_industry FROM membership GROUP BY 1) t ON t.entity=p.entity
""")


def panel_of(t: Tables):
    """The forward-return panel: the one table most studies start from; each reader joins the medians of the dates."""
    def build():
        market = t.broad.select("entity", F.col("grp").alias("market"))
        return P.build_price_panel(t.prices, t.dividends, t.flows, t.membership, market)

    return shared(t.spark, t.root, "panel", build)


_num = [f"{a}{h}" for a in ("r", "mkt_ew_r", "alpha") for h in HS] + ["ma20_dist_pct", "ma60_dist_pct", "vol_ratio"]


@query("pan01_forward_panel", "SELECT strftime(date,'%Y-%m-%d') AS date, entity, close, volume, sub_industry, "
       "CAST(chip_coverage AS INTEGER) AS chip_coverage, foreign_net, trust_net, dealer_net, "
       + ", ".join(f"round({x},6)+0.0 AS {x}" for x in _num) + " FROM panel")
def pan01(t):
    nets = ["foreign_net", "trust_net", "dealer_net"]
    return panel_of(t).select(
        iso("date").alias("date"), "entity", "close", "volume", "sub_industry",
        F.col("chip_coverage").cast("int").alias("chip_coverage"), *nets, *[r6(x).alias(x) for x in _num]
    )


@query("pan02_cumulative_dividends", """
SELECT strftime(date,'%Y-%m-%d') AS date, entity, cum_div FROM px_div""")
def pan02(t):
    return P.with_cumulative_dividends(P.clean_prices(t.prices), t.dividends).select(
        iso("date").alias("date"), "entity", "cum_div")


_cov = ["r5", "r10", "r20", "r40", "ma20_dist_pct", "ma60_dist_pct", "vol_ratio", "foreign_net", "trust_net", "dealer_net"]


@query("pan03_panel_summary", "SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM panel UNION ALL "
       "SELECT 'stocks', count(DISTINCT entity)::DOUBLE FROM panel UNION ALL "
       "SELECT 'trading_days', count(DISTINCT date)::DOUBLE FROM panel UNION ALL "
       + " UNION ALL ".join(f"SELECT 'coverage_{c}', round(avg(({c} IS NOT NULL)::INT),6) FROM panel" for c in _cov))
def pan03(t):
    return P.panel_summary(panel_of(t), _cov).select("metric", r6("value").alias("value"))


@query("pan03_coverage_by_year", " UNION ALL ".join(
    f"SELECT CAST(year(date) AS INTEGER) AS year, '{c}' AS \"column\", round(avg(({c} IS NOT NULL)::INT),6) AS coverage "
    "FROM panel GROUP BY 1" for c in _cov))
def pan03b(t):
    return P.coverage_by_year(panel_of(t), _cov).select("year", "column", r6("coverage").alias("coverage"))


@query("pan04_reconcile_close", """
SELECT strftime(p.date,'%Y-%m-%d') AS date, p.entity, p.close AS close_panel, r.close_ref,
  round(abs(p.close-r.close_ref)/r.close_ref*100,6)+0.0 AS diff_pct,
  CAST(abs(p.close-r.close_ref)/r.close_ref*100 < 0.5 AS INTEGER) AS within_tol
FROM prices p JOIN (SELECT date, entity, raw::DOUBLE AS close_ref FROM daily WHERE raw>0) r USING (date, entity) WHERE p.close>0""")
def pan04(t):
    ref = t.daily.where("raw > 0").select("date", "entity", F.col("raw").cast("double").alias("close_ref"))
    return P.reconcile_close(P.clean_prices(t.prices), ref).select(
        iso("date").alias("date"), "entity", "close_panel", "close_ref", r6("diff_pct").alias("diff_pct"),
        F.col("within_tol").cast("int").alias("within_tol"))


view("adj_events", """
SELECT entity, ex_date, CASE WHEN before_price>0 AND after_price>0 THEN before_price/after_price END AS adj FROM dividends
""")
view("tr_levels", """
SELECT p.date, p.entity, p.close, exp(sum(coalesce(a.l,0.0::DOUBLE)) OVER w) AS fac, sum(coalesce(a.b,0)) OVER w AS bad
FROM prices p LEFT JOIN (
  SELECT entity, date, sum(ln(coalesce(adj,1.0::DOUBLE))) AS l, count(*) FILTER (WHERE adj IS NULL) AS b FROM (
    SELECT e.entity, e.adj, (SELECT min(p.date) FROM prices p WHERE p.entity=e.entity AND p.date>=e.ex_date) AS date
    FROM adj_events e) WHERE date IS NOT NULL GROUP BY 1,2) a ON a.entity=p.entity AND a.date=p.date
WINDOW w AS (PARTITION BY p.entity ORDER BY p.date)
""")
view("tr_targets", "SELECT date, entity, " + ", ".join(
    f"CASE WHEN lead(bad,{1 + h}) OVER w - lead(bad,1) OVER w = 0 THEN (lead(close,{1 + h}) OVER w/lead(close,1) OVER w"
    f"*(lead(fac,{1 + h}) OVER w/lead(fac,1) OVER w)-1)*100 END AS r{h}, "
    f"lead(bad,{1 + h}) OVER w - lead(bad,1) OVER w > 0 AS bad_evt_{h}" for h in (5, 20))
    + " FROM tr_levels WINDOW w AS (PARTITION BY entity ORDER BY date)")


@query("pan05_total_return", "SELECT strftime(date,'%Y-%m-%d') AS date, entity, round(r5,6)+0.0 AS r5, round(r20,6)+0.0 AS r20, "
       "CAST(bad_evt_5 AS INTEGER) AS bad_evt_5, CAST(bad_evt_20 AS INTEGER) AS bad_evt_20 FROM tr_targets")
def pan05(t):
    return tr_targets(t).select(
        iso("date").alias("date"), "entity", r6("r5").alias("r5"), r6("r20").alias("r20"),
        F.col("bad_evt_5").cast("int").alias("bad_evt_5"), F.col("bad_evt_20").cast("int").alias("bad_evt_20"))


def tr_targets(t, horizons=(5, 20)):
    return P.total_return_targets(t.prices, P.adjustment_events(t.dividends), horizons)


@query("pan06_member_tr_panel", """
SELECT strftime(p.date,'%Y-%m-%d') AS date, p.entity, round(p.ma20_dist_pct,6)+0.0 AS ma20_dist_pct, round(t.r20,6)+0.0 AS r20,
  CAST(m.entity IS NOT NULL AS INTEGER) AS covered
FROM fwd_levels p JOIN tr_targets t USING (date, entity)
LEFT JOIN (SELECT DISTINCT entity FROM dividends) m ON m.entity=p.entity""")
def pan06(t):
    px = P.with_cumulative_dividends(P.clean_prices(t.prices), t.dividends)
    levels = P.forward_levels(px, ()).select("date", "entity", "ma20_dist_pct")
    cov = t.dividends.select("entity").distinct().withColumn("covered", F.lit(1))
    return levels.join(tr_targets(t, (20,)), ["date", "entity"]).join(cov, "entity", "left").select(
        iso("date").alias("date"), "entity", r6("ma20_dist_pct").alias("ma20_dist_pct"), r6("r20").alias("r20"),
        F.coalesce("covered", F.lit(0)).alias("covered"))


view("calendar", """
SELECT date, n_names, row_number() OVER (ORDER BY date) - 1 AS day_idx
FROM (SELECT date, count(DISTINCT entity) AS n_names FROM prices WHERE close>0 GROUP BY 1) WHERE n_names >= 5
""")


@query("pan07_market_calendar", "SELECT strftime(date,'%Y-%m-%d') AS date, n_names, CAST(day_idx AS BIGINT) AS day_idx FROM calendar")
def pan07(t):
    return P.market_calendar(t.prices, 5).select(iso("date").alias("date"), "n_names", F.col("day_idx").cast("bigint").alias("day_idx"))


view("spans", """
SELECT r.date, r.entity, b.day_idx - a.day_idx AS span FROM (
  SELECT date, entity, lead(date,1) OVER w AS ed, lead(date,6) OVER w AS xd FROM prices
  WINDOW w AS (PARTITION BY entity ORDER BY date)) r
LEFT JOIN calendar a ON a.date=ed LEFT JOIN calendar b ON b.date=xd
""")
view("span_month", """
SELECT strftime(date,'%Y-%m') AS ym, count(*) AS n_windows, avg((span=5)::INT) AS share_eq, avg((span>5)::INT) AS share_gt
FROM spans WHERE span IS NOT NULL GROUP BY 1
""")


@query("pan08_window_spans", """
SELECT ym, n_windows, round(share_eq,6) AS share_eq, round(share_gt,6) AS share_gt,
  CAST(share_eq < (SELECT min(share_eq)-0.0001::DOUBLE FROM span_month WHERE ym LIKE '1996-%') AS INTEGER) AS below
FROM span_month WHERE ym >= '1997-01'""")
def pan08(t):
    m = P.span_share_by_month(P.window_spans(t.prices, P.market_calendar(t.prices, 5), 5), 5)
    return P.span_check(m, 1996, 0.01, "1997-01").select(
        "ym", "n_windows", r6("share_eq").alias("share_eq"), r6("share_gt").alias("share_gt"),
        F.col("below").cast("int").alias("below"))


@query("pan09_row_match", """
SELECT strftime(n.date,'%Y-%m') AS ym, count(*) AS n_new, count(o.entity) AS n_matched,
  round(count(o.entity)/count(*),6) AS match_rate
FROM prices n LEFT JOIN flows o ON o.date=n.date AND o.entity=n.entity GROUP BY 1""")
def pan09(t):
    return P.row_match_by_month(t.prices, t.flows).withColumn("match_rate", r6("match_rate"))


@query("pan09_target_diff", """
SELECT strftime(n.date,'%Y-%m') AS period, count(n.r20-o.r20) AS n_both,
  count(*) FILTER (WHERE n.r20 IS NOT NULL AND o.r20 IS NULL) AS n_new_only,
  count(*) FILTER (WHERE n.r20 IS NULL AND o.r20 IS NOT NULL) AS n_old_only,
  round(max(abs(n.r20-o.r20)),6) AS abs_max,
  count(*) FILTER (WHERE abs(n.r20-o.r20)>1) AS n_gt_1pp, count(*) FILTER (WHERE abs(n.r20-o.r20)>5) AS n_gt_5pp,
  round(median(n.r20-o.r20),6)+0.0 AS diff_median,
  round(quantile_cont(abs(n.r20-o.r20),0.5),6) AS abs_p50, round(quantile_cont(abs(n.r20-o.r20),0.9),6) AS abs_p90,
  round(quantile_cont(abs(n.r20-o.r20),0.99),6) AS abs_p99
FROM tr_targets n LEFT JOIN fwd_levels o USING (date, entity) GROUP BY 1""")
def pan09b(t):
    px = P.with_cumulative_dividends(P.clean_prices(t.prices), t.dividends)
    d = P.target_diff_by_period(tr_targets(t, (20,)), P.forward_levels(px, (20,)), "r20")
    q = ["abs_max", "diff_median", "abs_p50", "abs_p90", "abs_p99"]
    return d.select("period", "n_both", "n_new_only", "n_old_only", "n_gt_1pp", "n_gt_5pp", *[r6(x).alias(x) for x in q])


@query("pan15_weekly_dates", """
SELECT CAST(isoyear(date) AS BIGINT) AS iso_year, CAST(weekofyear(date) AS BIGINT) AS iso_week, strftime(max(date),'%Y-%m-%d') AS date,
  isoyear(date)||'-W'||lpad(weekofyear(date)::VARCHAR,2,'0') AS week_tag
FROM prices GROUP BY isoyear(date), weekofyear(date)""")
def pan15(t):
    from tidewater.functions.exprs import week_tag

    return P.weekly_dates(t.prices).select(
        F.col("iso_year").cast("bigint").alias("iso_year"), F.col("iso_week").cast("bigint").alias("iso_week"),
        iso("date").alias("date"), week_tag("date").alias("week_tag"))


@query("pan16_monthly_anchors", """
SELECT strftime(date,'%Y-%m') AS month, strftime(min(date),'%Y-%m-%d') AS anchor FROM calendar GROUP BY 1""")
def pan16(t):
    return P.monthly_anchors(t.prices, 5).select("month", iso("anchor").alias("anchor"))


# ------------------------------------------------------------ first statistics

view("ic_rows", """
SELECT date, ma20_dist_pct AS x, alpha5 AS y FROM panel0 WHERE ma20_dist_pct IS NOT NULL AND alpha5 IS NOT NULL
""")
view("ic_ranked", """
SELECT date, count(*) OVER (PARTITION BY date) AS n,
  rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x)-1)/2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y)-1)/2.0::DOUBLE AS ry FROM ic_rows
""")
view("ic_daily", """
SELECT date, max(n) AS n, corr(rx, ry) AS ic FROM ic_ranked WHERE n >= 10 GROUP BY date
HAVING stddev_pop(rx)*stddev_pop(ry) > 1e-12
""")


@query("sta02_daily_ic", "SELECT strftime(date,'%Y-%m-%d') AS date, n, round(ic,6)+0.0 AS ic FROM ic_daily")
def sta02(t):
    return S.daily_ic(panel_of(t), [], "ma20_dist_pct", "alpha5").select(iso("date").alias("date"), "n", r6("ic").alias("ic"))
