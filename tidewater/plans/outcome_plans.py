"""Outcome, ledger and pick-ranking queries."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions.exprs import iso, own_rows, r6, week_tag, with_scalar
from tidewater.operators import outcome as O
from tidewater.operators import panel as P
from tidewater.operators import ranking as K
from tidewater.operators.order import exact_quantiles
from tidewater.plans.flow_plans import single_q, trend_of
from tidewater.plans.momentum_plans import index_of
from tidewater.plans.panel_plans import panel_of
from tidewater.plans.registry import query, view
from tidewater.plans.valuation_plans import fin_q
from tidewater.sources.staging import staged

_TAG = "isoyear({0})||'-W'||lpad(weekofyear({0})::VARCHAR,2,'0')"
view("picks", f"""
SELECT {_TAG.format('date')} AS week, date AS data_date, entity, close, k, CASE WHEN k<=2 THEN 'core' WHEN k<=3 THEN 'analyst' WHEN k<=4 THEN 'opportunity' ELSE 'pool' END AS layer, CASE WHEN k>4 THEN 'r'||(entity%3) END AS reason,
  CASE WHEN k=6 THEN '未定' ELSE '收盤確認跌破 MA60 '||CAST(floor(close*0.97::DOUBLE) AS BIGINT)||'、隔日未收復出場' END AS stop, m.grp
FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY vol_ratio DESC, entity) AS k FROM panel0 WHERE date IN (SELECT date FROM weekly) AND vol_ratio IS NOT NULL) LEFT JOIN membership m USING (entity) WHERE k<=6
""")


def _layer():
    return F.when(F.col("k") <= 2, "core").when(F.col("k") <= 3, "analyst").when(F.col("k") <= 4, "opportunity").otherwise("pool")


def ranked_names(t):
    """All names of every week, the busiest first."""
    d = panel_of(t).where(F.col("vol_ratio").isNotNull()).join(F.broadcast(P.weekly_dates(t.prices).select("date")), "date", "left_semi")
    return d.withColumn("k", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("vol_ratio"), "entity")))


def picks_of(t):
    """The six busiest names of every week; the row limit per date is applied before the shuffle."""
    def build():
        d = ranked_names(t).where(F.col("k") <= 6)
        stop = F.when(F.col("k") == 6, "未定").otherwise(F.concat(F.lit("收盤確認跌破 MA60 "), F.floor(F.col("close") * 0.97).cast("string"), F.lit("、隔日未收復出場")))
        reason = F.when(F.col("k") > 4, F.concat(F.lit("r"), (F.col("entity") % 3).cast("string")))
        d = d.select(week_tag("date").alias("week"), F.col("date").alias("data_date"), "entity", "close", "k", _layer().alias("layer"), reason.alias("reason"), stop.alias("stop"))
        return d.join(t.membership, "entity", "left")

    return staged(t.spark, t.root, "picks", build)


view("entry", "SELECT p.*, (SELECT min(x.date) FROM prices x WHERE x.entity=p.entity AND x.date>p.data_date) AS entry_date FROM picks p")
view("fwdp", "SELECT entity, date AS entry_date, close AS entry_price, " + ", ".join(f"lead(date,{h}) OVER w AS x{h}, lead(close,{h}) OVER w AS c{h}, lead(cum_div,{h}) OVER w-cum_div AS d{h}" for h in (5, 20)) + " FROM px_div WINDOW w AS (PARTITION BY entity ORDER BY date)")
view("mk_k", "SELECT date, market_index, count(*) OVER ()-row_number() OVER (ORDER BY date)+1 AS after FROM mkt_index")
view("fret", " UNION ALL ".join(f"""SELECT week, e.entity, layer, reason, {h} AS hold, e.entry_date, x{h} AS exit_date, CASE WHEN x{h} IS NULL THEN 'delisted' ELSE 'matured' END AS status, (c{h}-entry_price)/entry_price*100+d{h}/entry_price*100 AS return_pct,
  (m1.market_index-m0.market_index)/m0.market_index*100 AS market_pct FROM entry e JOIN fwdp f ON f.entity=e.entity AND f.entry_date=e.entry_date JOIN mk_k m0 ON m0.date=e.entry_date AND m0.after>{h} LEFT JOIN mkt_index m1 ON m1.date=x{h}""" for h in (5, 20)))


def fret_of(t):
    s = picks_of(t).select("week", "entity", "layer", "reason", F.col("data_date").alias("screened_at"))
    return staged(t.spark, t.root, "fret", lambda: O.forward_returns(s, t.prices, t.dividends, index_of(t), (5, 20)))


@query("out01_forward_returns", "SELECT week, entity, hold, strftime(entry_date,'%Y-%m-%d') AS entry_date, status, round(return_pct,6)+0.0 AS return_pct, round(market_pct,6)+0.0 AS market_pct, round(return_pct-market_pct,6)+0.0 AS excess_pct FROM fret")
def out01(t):
    return fret_of(t).select("week", "entity", "hold", iso("entry_date").alias("entry_date"), "status", *[r6(x).alias(x) for x in ("return_pct", "market_pct", "excess_pct")])


@query("out02_strategy_summary", """
SELECT layer, hold, count(*) FILTER (WHERE status='matured') AS sample_count, count(*) FILTER (WHERE status='delisted') AS n_delisted, round(avg((return_pct>0)::INT),6) AS win_rate, round(avg(return_pct),6)+0.0 AS avg_return_pct, round(median(return_pct),6)+0.0 AS median_return_pct,
  round(min(return_pct),6)+0.0 AS worst_pct, round(avg(return_pct-market_pct),6)+0.0 AS avg_excess_pct, round(median(return_pct-market_pct),6)+0.0 AS median_excess_pct FROM fret GROUP BY 1,2""")
def out02(t):
    d = O.strategy_summary(fret_of(t), ["layer", "hold"])
    return d.select("layer", "hold", "sample_count", "n_delisted", *[r6(x).alias(x) for x in ("win_rate", "avg_return_pct", "median_return_pct", "worst_pct", "avg_excess_pct", "median_excess_pct")])


view("suffix", "SELECT entity, date AS entry_date, close AS entry_price, min(close) OVER w AS path_min, last_value(date) OVER w AS exit_date, last_value(close) OVER w AS exit_price, last_value(cum_div) OVER w-cum_div AS cash FROM px_div WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
view("winr", "SELECT p.entity, p.date AS entry_date, (z.close/p.close-1)*100 AS v FROM prices p JOIN (SELECT entity, close FROM prices WHERE date=(SELECT max(date) FROM prices)) z USING (entity) WHERE p.date IN (SELECT entry_date FROM entry)")
view("todate", """
SELECT e.*, s.entry_price, CASE WHEN e.entry_date IS NULL THEN 'no_entry' WHEN s.exit_date<=e.entry_date THEN 'no_window' ELSE 'matured' END AS status, (exit_price-entry_price)/entry_price*100+cash/entry_price*100 AS ret, (path_min-entry_price)/entry_price*100 AS pm, m.v AS mk,
  CASE WHEN g.n>=3 THEN g.v END AS sb
FROM entry e LEFT JOIN suffix s ON s.entity=e.entity AND s.entry_date=e.entry_date LEFT JOIN (SELECT entry_date, median(v) AS v FROM winr GROUP BY 1) m ON m.entry_date=e.entry_date
LEFT JOIN (SELECT grp, entry_date, median(v) AS v, count(*) AS n FROM membership JOIN winr USING (entity) GROUP BY 1,2) g ON g.grp=e.grp AND g.entry_date=e.entry_date
""")
view("todate_m", "SELECT *, CASE WHEN status='matured' THEN ret END AS return_pct, CASE WHEN status='matured' THEN pm END AS path_min_pct, CASE WHEN status='matured' THEN ret-mk END AS alpha_market, CASE WHEN status='matured' THEN ret-sb END AS alpha_subind FROM todate")


def todate_of(t):
    return staged(t.spark, t.root, "todate", lambda: O.todate_returns(picks_of(t), t.prices, t.dividends, t.membership))


@query("out03_todate_returns", "SELECT week, entity, status, " + ", ".join(f"round({x},6)+0.0 AS {x}" for x in ("return_pct", "path_min_pct", "alpha_market", "alpha_subind")) + " FROM todate_m")
def out03(t):
    return todate_of(t).select("week", "entity", "status", *[r6(x).alias(x) for x in ("return_pct", "path_min_pct", "alpha_market", "alpha_subind")])


def _sum_sql(k):
    return f"""SELECT {k}, count(*) AS n, round(avg((return_pct>0)::INT),6) AS win_rate, round(avg(return_pct),6)+0.0 AS avg_return_pct, round(median(return_pct),6)+0.0 AS median_return_pct, round(avg(alpha_market),6)+0.0 AS avg_alpha_market,
  count(alpha_subind) AS n_subind, round(min(path_min_pct),6)+0.0 AS worst_path_pct, first(entity ORDER BY return_pct DESC, entity) AS best_entity FROM todate_m WHERE status='matured' AND {k} IS NOT NULL GROUP BY 1"""


for _k, _nm in (("layer", "layer"), ("week", "weekly"), ("reason", "counterfactual")):
    def _reg(k=_k, nm=_nm):
        @query(f"out04_{nm}_summary", _sum_sql(k))
        def q(t):
            d = O.layer_summary(todate_of(t).where(F.col(k).isNotNull()), [k])
            return d.select(k, "n", *[r6(x).alias(x) for x in ("win_rate", "avg_return_pct", "median_return_pct", "avg_alpha_market")], "n_subind", r6("worst_path_pct").alias("worst_path_pct"), "best_entity")

    _reg()


@query("out05_stop_price", "SELECT week, entity, CASE WHEN k=6 THEN NULL ELSE floor(close*0.97::DOUBLE) END AS stop_price FROM picks")
def out05(t):
    return picks_of(t).select("week", "entity", O.stop_price(F.col("stop")).alias("stop_price"))


view("stopl", """
WITH a AS (SELECT p.*, CASE WHEN k=6 THEN NULL ELSE floor(p.close*0.97::DOUBLE) END AS sp0, n.date AS ed, n.close AS ep, n.i AS i0 FROM picks p LEFT JOIN pxi n ON n.entity=p.entity AND n.date=(SELECT min(date) FROM pxi x WHERE x.entity=p.entity AND x.date>p.data_date)),
b AS (SELECT *, CASE WHEN sp0<=ep*1.02::DOUBLE THEN sp0 END AS sp FROM a),
c AS (SELECT b.*, (SELECT min(i) FROM pxi x WHERE x.entity=b.entity AND x.i>=b.i0 AND x.close<b.sp) AS si FROM b),
d AS (SELECT c.*, s.date AS sd, q.i AS ci, q.close AS cp FROM c LEFT JOIN pxi s ON s.entity=c.entity AND s.i=c.si LEFT JOIN pxi q ON q.entity=c.entity AND q.i=c.si+1),
e AS (SELECT d.*, (SELECT min(data_date) FROM picks z WHERE z.data_date>d.sd) AS rv FROM d),
f AS (SELECT e.*, CASE WHEN ci IS NOT NULL THEN (SELECT min(i) FROM pxi x WHERE x.entity=e.entity AND x.date>e.rv) END AS wi FROM e)
SELECT f.week, f.entity, CASE WHEN i0 IS NULL THEN 'no_price' WHEN sp IS NULL THEN 'unparsed' WHEN si IS NULL THEN 'not_triggered' WHEN wi IS NULL THEN 'pending_review' ELSE 'measured' END AS status, sd AS signal_date, rv AS review_date, CAST(wi-ci AS BIGINT) AS delay_td,
  (w.close/cp-1)*100 AS delay_cost_pct, (r5.close/cp-1)*100 AS fwd_r5_pct, (r20.close/cp-1)*100 AS fwd_r20_pct
FROM f LEFT JOIN pxi w ON w.entity=f.entity AND w.i=wi LEFT JOIN pxi r5 ON r5.entity=f.entity AND r5.i=ci+5 LEFT JOIN pxi r20 ON r20.entity=f.entity AND r20.i=ci+20
""")
view("pxi", "SELECT entity, date, close, row_number() OVER (PARTITION BY entity ORDER BY date) AS i FROM prices WHERE close>0")


def stop_of(t):
    return staged(t.spark, t.root, "stop_ledger", lambda: O.stop_ledger(picks_of(t), t.prices))


@query("out06_stop_delay", "SELECT week, entity, status, strftime(signal_date,'%Y-%m-%d') AS signal_date, strftime(review_date,'%Y-%m-%d') AS review_date, delay_td, round(delay_cost_pct,6)+0.0 AS delay_cost_pct, round(fwd_r5_pct,6)+0.0 AS fwd_r5_pct, round(fwd_r20_pct,6)+0.0 AS fwd_r20_pct FROM stopl")
def out06(t):
    return stop_of(t).select("week", "entity", "status", iso("signal_date").alias("signal_date"), iso("review_date").alias("review_date"), F.col("delay_td").cast("bigint").alias("delay_td"),
                             *[r6(x).alias(x) for x in ("delay_cost_pct", "fwd_r5_pct", "fwd_r20_pct")])


@query("out06_stop_summary", "SELECT status, count(*) AS n, round(avg(delay_cost_pct),6)+0.0 AS mean_cost, round(median(delay_cost_pct),6)+0.0 AS median_cost FROM stopl GROUP BY 1")
def out06b(t):
    g = stop_of(t).groupBy("status").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("delay_cost_pct")).alias("mean_cost"))
    return g.join(exact_quantiles(stop_of(t), ["status"], "delay_cost_pct", {"median_cost": 0.5}).withColumn("median_cost", r6("median_cost")), "status", "left")


@query("out07_week_over_week", """
SELECT p.week AS from_week, w.nw AS to_week, p.entity, p.layer AS from_layer, coalesce(n.layer,'absent') AS to_layer FROM picks p JOIN (SELECT week, lead(week) OVER (ORDER BY week) AS nw FROM (SELECT DISTINCT week FROM picks)) w USING (week)
LEFT JOIN picks n ON n.week=w.nw AND n.entity=p.entity WHERE w.nw IS NOT NULL AND coalesce(CASE n.layer WHEN 'core' THEN 0 WHEN 'analyst' THEN 1 WHEN 'opportunity' THEN 1 WHEN 'pool' THEN 2 END,3) > CASE p.layer WHEN 'core' THEN 0 WHEN 'analyst' THEN 1 WHEN 'opportunity' THEN 1 WHEN 'pool' THEN 2 ELSE 9 END""")
def out07(t):
    return O.week_over_week(picks_of(t))


view("bled", "SELECT reason, hold, count(*) AS n, count(*) FILTER (WHERE return_pct-market_pct>0) AS n_beat_market, avg(return_pct) AS a, max(p.m) AS m FROM fret JOIN (SELECT hold, avg(return_pct) AS m FROM fret WHERE status='matured' AND reason IS NULL GROUP BY 1) p USING (hold) WHERE status='matured' AND reason IS NOT NULL GROUP BY 1,2")


@query("out08_exclusion_buckets", "SELECT reason, hold, n, n_beat_market, round(a,6)+0.0 AS avg_return_pct, round(m,6)+0.0 AS picks_avg, round(a-m,6)+0.0 AS gap_pp, (row_number() OVER (PARTITION BY hold ORDER BY a-m DESC)=1)::INT AS worst FROM bled")
def out08(t):
    d = O.bucket_ledger(fret_of(t))
    worst = F.row_number().over(Window.partitionBy("hold").orderBy(F.desc("gap_pp"))) == 1
    return d.select("reason", "hold", "n", "n_beat_market", r6("avg_return_pct").alias("avg_return_pct"), r6("picks_avg").alias("picks_avg"), r6("gap_pp").alias("gap_pp"), worst.cast("int").alias("worst"))


view("fwdp10", "SELECT entity, date AS entry_date, close AS entry_price, " + ", ".join(f"lead(date,{h}) OVER w AS x{h}, lead(close,{h}) OVER w AS c{h}, lead(cum_div,{h}) OVER w-cum_div AS d{h}" for h in (10, 20)) + " FROM px_div WINDOW w AS (PARTITION BY entity ORDER BY date)")
view("fret10", " UNION ALL ".join(f"""SELECT week, e.entity, layer, {h} AS hold, (c{h}-entry_price)/entry_price*100+d{h}/entry_price*100 AS ret, (c{h}-entry_price)/entry_price*100+d{h}/entry_price*100-(m1.market_index-m0.market_index)/m0.market_index*100 AS excess
  FROM entry e JOIN fwdp10 f ON f.entity=e.entity AND f.entry_date=e.entry_date JOIN mk_k m0 ON m0.date=e.entry_date AND m0.after>{h} LEFT JOIN mkt_index m1 ON m1.date=x{h} WHERE x{h} IS NOT NULL""" for h in (10, 20)))
view("rchk", """SELECT hold, count(*) FILTER (WHERE entity%3=0) AS n_left, avg(excess) FILTER (WHERE entity%3=0) AS alpha_left, avg((ret>0)::INT) FILTER (WHERE entity%3=0) AS win_left,
  count(*) FILTER (WHERE entity%3<>0) AS n_other, avg(excess) FILTER (WHERE entity%3<>0) AS alpha_other, avg((ret>0)::INT) FILTER (WHERE entity%3<>0) AS win_other FROM fret10 WHERE layer='opportunity' AND ret IS NOT NULL GROUP BY 1""")
view("rchk_h", """SELECT count(*) FILTER (WHERE entity%3=0 AND layer='opportunity') AS n_tagged, CAST(floor(date_diff('day', min(data_date) FILTER (WHERE entity%3=0 AND layer='opportunity'), max(data_date))/7) AS BIGINT) AS weeks_elapsed FROM picks""")


@query("out08_recall_check", f"""
SELECT hold AS horizon_td, n_tagged, weeks_elapsed, n_left, round(alpha_left,6)+0.0 AS alpha_left, round(win_left,6)+0.0 AS win_left, n_other, round(alpha_other,6)+0.0 AS alpha_other, round(win_other,6)+0.0 AS win_other, (n_tagged>=10 OR weeks_elapsed>=12)::INT AS eligible,
  ((n_tagged>=10 OR weeks_elapsed>=12) AND (SELECT count(*)>0 AND bool_and(alpha_left<alpha_other AND win_left<win_other) FROM rchk WHERE alpha_left IS NOT NULL AND alpha_other IS NOT NULL))::INT AS warn FROM rchk JOIN rchk_h ON true""")
def out08_recall(t):
    """Every third name of the opportunity layer bears the tag."""
    tag = F.when(F.col("entity") % 3 == 0, F.lit("左側M-BR1 頂底")).otherwise("一般")
    p = picks_of(t).withColumn("thesis_tag", tag)
    s = p.select("week", "entity", "layer", F.col("data_date").alias("screened_at"))
    d = O.recall_check(O.forward_returns(s, t.prices, t.dividends, index_of(t), (10, 20)), p, "左側M-BR1")
    return d.select(F.col("hold").alias("horizon_td"), "n_tagged", "weeks_elapsed", "n_left", *[r6(x).alias(x) for x in ("alpha_left", "win_left")], "n_other", *[r6(x).alias(x) for x in ("alpha_other", "win_other")],
                    F.col("eligible").cast("int").alias("eligible"), F.col("warn").cast("int").alias("warn"))


view("ectx", """
SELECT date, entity, (close/lag(close,10) OVER w-1)*100 AS rp, CASE WHEN count(*) OVER w60>=60 THEN (close/avg(close) OVER w60-1)*100 END AS md, close*volume/1e6 AS amount_m FROM prices WHERE close>0
WINDOW w AS (PARTITION BY entity ORDER BY date), w60 AS (PARTITION BY entity ORDER BY date ROWS 59 PRECEDING)
""")


@query("out09_entry_context", "SELECT strftime(date,'%Y-%m-%d') AS date, entity, round(rp,6)+0.0 AS ret_pullback_pct, round(md,6)+0.0 AS ma_dist_pct, round(amount_m,6) AS amount_m FROM ectx WHERE date IN (SELECT date FROM weekly)")
def out09(t):
    return O.entry_context(t.prices, P.weekly_dates(t.prices)).select(iso("date").alias("date"), "entity", *[r6(x).alias(x) for x in ("ret_pullback_pct", "ma_dist_pct", "amount_m")])


view("launch", f"""
SELECT {_TAG.format('c.date')} AS week, c.entity, c.amount_m, CASE WHEN s.s_acctbal>8500 THEN 'held' WHEN p.layer='core' THEN 'acted' WHEN p.entity IS NOT NULL THEN 'considered' WHEN s.s_acctbal<1500 THEN 'watchlisted' ELSE 'never_surfaced' END AS status
FROM ectx c JOIN (SELECT entity, date, (lead(close,11) OVER w-lead(close,1) OVER w+lead(cum_div,11) OVER w-lead(cum_div,1) OVER w)/lead(close,1) OVER w*100 AS r FROM px_div WINDOW w AS (PARTITION BY entity ORDER BY date)) f USING (entity, date)
LEFT JOIN picks p ON p.data_date=c.date AND p.entity=c.entity LEFT JOIN supplier s ON s.s_suppkey=c.entity WHERE c.date IN (SELECT date FROM weekly) AND r>=8 AND rp<=0 AND md<=10
""")


@query("out10_missed_launches", "SELECT week, " + ", ".join(f"count(*) FILTER (WHERE b='{x}') AS {x}" for x in O.LAUNCH_BUCKETS) + ", count(*) AS total FROM (SELECT week, CASE WHEN status<>'never_surfaced' THEN status WHEN amount_m>=0.8 THEN 'never_liquid' ELSE 'never_illiquid' END AS b FROM launch) GROUP BY 1")
def out10(t):
    ctx = O.entry_context(t.prices, P.weekly_dates(t.prices))
    w = own_rows()
    px = P.with_cumulative_dividends(P.clean_prices(t.prices), t.dividends)
    e = F.lead("close", 1).over(w)
    f = px.select("date", "entity", ((F.lead("close", 11).over(w) - e + F.lead("cum_div", 11).over(w) - F.lead("cum_div", 1).over(w)) / e * 100).alias("r"))
    la = ctx.join(f, ["date", "entity"]).where((F.col("r") >= 8) & (F.col("ret_pullback_pct") <= 0) & (F.col("ma_dist_pct") <= 10)).withColumn("week", week_tag("date"))
    ents = t.raw("supplier").select(F.col("s_suppkey").alias("entity"), "s_acctbal")
    p = picks_of(t)
    x = O.launch_status(la, ents.where("s_acctbal > 8500"), p.where("layer = 'core'"), p, ents.where("s_acctbal < 1500"))
    return O.launch_summary(x, 0.8)


@query("out11_keyed_ledger", "SELECT week, entity, layer FROM picks")
def out11(t):
    """Writes all weeks, rewrites the same weeks again: partitions are replaced, never doubled."""
    from tidewater.sources.staging import stage_dir

    path = f"{stage_dir(t.spark)}/ledger-{uuid.uuid4().hex}"
    rows = picks_of(t).select("entity", "layer", "week")
    O.upsert_partitions(rows, path, "week")
    O.upsert_partitions(rows.where(F.col("week") >= "1998"), path, "week")
    return t.spark.read.schema(rows.schema).parquet(path).select("week", "entity", "layer")


@query("out12_write_window", "SELECT week, entity FROM picks WHERE DATE '2001-06-30' <= data_date + 14")
def out12(t):
    return O.on_time(picks_of(t), F.to_date(F.lit("2001-06-30")), 14).select("week", "entity")


@query("out12_week_summary", "SELECT week, count(*) AS n_rows, count(*) FILTER (WHERE layer='core') AS n_main, count(DISTINCT grp) AS n_groups, round(avg((reason IS NOT NULL)::INT),6) AS coverage FROM picks GROUP BY 1")
def out12b(t):
    return picks_of(t).groupBy("week").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("layer") == "core", 1)).alias("n_main"), F.countDistinct("grp").alias("n_groups"), r6(F.avg(F.col("reason").isNotNull().cast("double"))).alias("coverage"))


_KQ = "CASE WHEN month({0})*100+day({0})>=1114 THEN year({0})*4+2 WHEN month({0})*100+day({0})>=814 THEN year({0})*4+1 WHEN month({0})*100+day({0})>=515 THEN year({0})*4 WHEN month({0})*100+day({0})>=331 THEN year({0})*4-1 ELSE year({0})*4-2 END"


@query("out13_period_labels", f"SELECT strftime(date,'%Y-%m-%d') AS date, CAST({_KQ.format('date')} AS BIGINT) AS quarter_index, CAST(year(date)*12+month(date)-1-CASE WHEN day(date)>=11 THEN 1 ELSE 2 END AS BIGINT) AS month_index, (({_KQ.format('date')}) > (SELECT max(year*4+quarter-1) FROM fin_q))::INT AS stale FROM weekly")
def out13(t):
    d = P.weekly_dates(t.prices).select("date")
    have = fin_q(t).agg(F.max(F.col("year") * 4 + F.col("quarter") - 1).alias("_h"))
    q = O.known_quarter(F.col("date"))
    return with_scalar(d, have).select(iso("date").alias("date"), q.cast("bigint").alias("quarter_index"), O.known_month(F.col("date")).cast("bigint").alias("month_index"), (q > F.col("_h")).cast("int").alias("stale"))


@query("out14_top_groups", "SELECT t.grp, t.trend_score, m.entity FROM (SELECT grp, trend_score, rank() OVER (ORDER BY trend_score DESC) AS k FROM trend WHERE date=(SELECT max(date) FROM trend) AND trend_score IS NOT NULL) t JOIN membership m USING (grp) WHERE k<=5")
def out14(t):
    d = with_scalar(trend_of(t), trend_of(t).agg(F.max("date").alias("_m"))).where(F.col("date") == F.col("_m"))
    top = K.trend_buckets(d, [], 5).where(F.col("trend_rank") <= 5).select("grp", "trend_score")
    return top.join(t.membership, "grp")


@query("out15_missing_weeks", f"SELECT w.week, CASE WHEN c IS NULL THEN 'missing' ELSE 'coverage' END AS issue FROM (SELECT {_TAG.format('date')} AS week FROM weekly) w LEFT JOIN (SELECT week, avg((reason IS NOT NULL)::INT) AS c FROM picks GROUP BY 1) p USING (week) WHERE c IS NULL OR c<0.3")
def out15(t):
    led = picks_of(t).select("week", F.col("reason").alias("value"))
    return O.missing_weeks(P.weekly_dates(t.prices).select(week_tag("date").alias("week")), led, 0.3).select("week", "issue")


# ------------------------------------------------------------- pick ranking

view("pool", f"""
SELECT {_TAG.format('s.date')} AS week, s.date, s.entity, s.grp, CASE WHEN u.s_acctbal<300 THEN 'holding' ELSE 'candidate' END AS source, s.ma60_dist_pct, s.trend_score, p.close, p.close*p.volume/1e6 AS amount_million, p.ma20_dist_pct,
  CASE WHEN p.vol_ratio>3 THEN '過熱' ELSE '' END AS flags, abs(p.close/nullif(lc,0)-1)*100>9 AS price_discontinuity, l60
FROM srows s JOIN (SELECT *, lag(close) OVER (PARTITION BY entity ORDER BY date) AS lc, min(close) OVER (PARTITION BY entity ORDER BY date ROWS 59 PRECEDING) AS l60 FROM panel0) p ON p.date=s.date AND p.entity=s.entity JOIN supplier u ON u.s_suppkey=s.entity
""")
view("tbk", "SELECT grp, date, trend_rank, trend_n, (trend_rank*4+trend_n-1)//trend_n AS trend_bucket FROM (SELECT grp, date, rank() OVER (PARTITION BY date ORDER BY trend_score DESC) AS trend_rank, count(*) OVER (PARTITION BY date) AS trend_n FROM (SELECT DISTINCT grp, date, trend_score FROM srows WHERE trend_score IS NOT NULL))")
view("gated", """
SELECT p.*, t.trend_rank, t.trend_n, t.trend_bucket, CASE WHEN source='holding' THEN 'held' WHEN price_discontinuity THEN 'price_discontinuity' WHEN flags='過熱' THEN 'flag:過熱' WHEN amount_million<0.3 THEN 'flag:低流動' WHEN ma60_dist_pct IS NULL THEN 'ext_unknown' WHEN ma60_dist_pct<-4 THEN 'ext_below'
  WHEN ma60_dist_pct>4 THEN 'ext_above' WHEN trend_score IS NULL THEN 'no_trend_score' WHEN trend_bucket>3 THEN 'bucket' END AS gate_reason FROM pool p LEFT JOIN tbk t USING (grp, date)
""")


def pool_of(t):
    from tidewater.plans.cell_plans import srows_of

    def build():
        w = own_rows()
        # only closes are needed of every day; the other columns are empty and the rows gone where no week ends
        p = panel_of(t).join(F.broadcast(P.weekly_dates(t.prices).select("date", F.lit(True).alias("_wk"))), "date", "left")
        p = p.select("date", "entity", "close", "_wk", *[F.when(F.col("_wk"), F.col(x)).alias(x) for x in ("volume", "ma20_dist_pct", "vol_ratio")])
        p = p.withColumns({"lc": F.lag("close").over(w), "low_60d": F.min("close").over(w.rowsBetween(-59, 0))}).where("_wk").drop("_wk")
        d = srows_of(t).select("date", "entity", "grp", "ma60_dist_pct", "trend_score").join(p, ["date", "entity"])
        d = d.select(
            week_tag("date").alias("week"), "date", "entity", "grp", "ma60_dist_pct", "ma20_dist_pct", "trend_score", "close", "low_60d", (F.col("close") * F.col("volume") / 1e6).alias("amount_million"),
            F.when(F.col("vol_ratio") > 3, "過熱").otherwise("").alias("flags"), (F.abs(F.col("close") / F.nullif(F.col("lc"), F.lit(0.0)) - 1) * 100 > 9).alias("price_discontinuity"))
        owned = t.raw("supplier").where("s_acctbal < 300").select(F.col("s_suppkey").alias("entity"))
        hold = d.join(owned, "entity", "left_semi").withColumn("source", F.lit("holding"))
        pool = K.build_pool(hold, d.withColumn("source", F.lit("candidate")))
        tb = K.trend_buckets(srows_of(t).select("grp", "date", "trend_score").distinct(), ["date"], 4).drop("trend_score")
        g = pool.join(tb, ["grp", "date"], "left")
        return g.withColumn("gate_reason", K.gate_reason(-4.0, 4.0, 0.3, 3)).withColumn("band_dist", K.band_distance(-1.0, 1.0))

    return staged(t.spark, t.root, "pool", build)


@query("pck01_pool", "SELECT week, entity, grp, source FROM pool")
def pck01(t):
    return pool_of(t).select("week", "entity", "grp", "source")


@query("pck02_primary_tag", "SELECT entity, min(grp) AS sub_industry FROM themes GROUP BY 1")
def pck02(t):
    return P.first_tag(t.themes)


@query("pck03_trend_buckets", "SELECT grp, strftime(date,'%Y-%m-%d') AS date, trend_rank, trend_n, CAST(trend_bucket AS BIGINT) AS trend_bucket FROM tbk")
def pck03(t):
    from tidewater.plans.cell_plans import weekly_trend

    d = K.trend_buckets(weekly_trend(t), ["date"], 4)
    return d.select("grp", iso("date").alias("date"), "trend_rank", "trend_n", F.col("trend_bucket").cast("bigint").alias("trend_bucket"))


@query("pck04_gates", "SELECT week, entity, gate_reason FROM gated")
def pck04(t):
    return pool_of(t).select("week", "entity", "gate_reason")


view("elig", """
SELECT *, CASE WHEN ma60_dist_pct < -1 THEN -1-ma60_dist_pct WHEN ma60_dist_pct>1 THEN ma60_dist_pct-1 ELSE 0 END AS band_dist, 'c'||(entity%4) AS cl,
  row_number() OVER (PARTITION BY week ORDER BY trend_bucket, CASE WHEN ma60_dist_pct < -1 THEN -1-ma60_dist_pct WHEN ma60_dist_pct>1 THEN ma60_dist_pct-1 ELSE 0 END, trend_score DESC, amount_million DESC, entity) AS o FROM gated WHERE gate_reason IS NULL
""")


@query("pck05_capped_selection", """
WITH RECURSIVE r AS (SELECT week, o, entity, true AS ok, MAP {grp: 1} AS g, MAP {cl: 1} AS c, 1 AS n, NULL::VARCHAR AS why FROM elig WHERE o=1
UNION ALL SELECT e.week, e.o, e.entity, w.why IS NULL, CASE WHEN w.why IS NULL THEN map_concat(r.g, MAP {e.grp: coalesce(r.g[e.grp],0)+1}) ELSE r.g END, CASE WHEN w.why IS NULL THEN map_concat(r.c, MAP {e.cl: coalesce(r.c[e.cl],0)+1}) ELSE r.c END, r.n+(w.why IS NULL)::INT, w.why
FROM r JOIN elig e ON e.week=r.week AND e.o=r.o+1 JOIN LATERAL (SELECT CASE WHEN coalesce(r.g[e.grp],0)>=2 THEN 'cap_sub_industry' WHEN coalesce(r.c[e.cl],0)>=2 THEN 'cap_cluster' WHEN r.n>=6 THEN 'beyond_n' END AS why) w ON true)
SELECT week, entity, CAST(CASE WHEN ok THEN n END AS BIGINT) AS rank, why AS cap_reason FROM r""")
def pck05(t):
    e = pool_of(t).where(F.col("gate_reason").isNull()).withColumn("clusters", F.array(F.concat(F.lit("c"), (F.col("entity") % 4).cast("string"))))
    return K.capped_selection(e, 2, 2, 6).select("week", "entity", F.col("rank").cast("bigint").alias("rank"), "cap_reason")


view("lvls", "SELECT *, close/(1+ma20_dist_pct/100) AS m20, close/(1+ma60_dist_pct/100) AS m60 FROM gated")


@query("pck06_entry_stop", f"""
SELECT week, entity, CASE WHEN h>=l THEN round(round(l,9),2)+0.0 END AS entry_low, CASE WHEN h>=l THEN round(round(h,9),2)+0.0 END AS entry_high, round(round(CASE WHEN tg THEN l60 ELSE m60 END,9),2)+0.0 AS stop_price, CASE WHEN m60 IS NULL THEN NULL WHEN NOT tg THEN 'MA60' WHEN ma60_dist_pct<0 THEN 'low_60d_below' ELSE 'low_60d' END AS stop_basis
FROM (SELECT *, least(m20,m60) AS l, least(close, greatest(m20,m60)) AS h, coalesce(abs(m20-m60)/m60*100<=1,false) OR coalesce(ma60_dist_pct<=1,false) AS tg FROM lvls WHERE m20 IS NOT NULL AND m60 IS NOT NULL)""")
def pck06(t):
    d = pool_of(t).withColumns({"ma20_price": F.col("close") / (1 + F.col("ma20_dist_pct") / 100), "ma60_price": F.col("close") / (1 + F.col("ma60_dist_pct") / 100)})
    d = d.where(F.col("ma20_price").isNotNull() & F.col("ma60_price").isNotNull())
    return K.entry_stop(d, 1.0).select("week", "entity", "entry_low", "entry_high", "stop_price", "stop_basis")


@query("pck07_evidence", """
SELECT week, entity, concat_ws('；', CASE WHEN trend_rank IS NOT NULL THEN '趨勢 '||trend_rank||'/'||trend_n END, CASE WHEN ma60_dist_pct IS NOT NULL THEN '距季線 '||printf('%.1f', round(round(ma60_dist_pct,9),1)+0.0) END) AS evidence, concat_ws('；', CASE WHEN trend_bucket>=3 THEN '族群偏弱' END, CASE WHEN ma60_dist_pct>3 THEN '乖離偏高' END) AS bear_hints FROM gated""")
def pck07(t):
    return K.evidence(pool_of(t).withColumn("stop_price", F.lit(None).cast("double"))).select("week", "entity", "evidence", "bear_hints")


@query("pck08_universe", "SELECT week, entity, (gate_reason IS NULL OR gate_reason='held')::INT AS in_all, coalesce(trend_bucket<=2,false)::INT AS in_main, round(ln(amount_million),6)+0.0 AS log_amount FROM gated")
def pck08(t):
    d = pool_of(t)
    return d.select("week", "entity", (F.col("gate_reason").isNull() | (F.col("gate_reason") == "held")).cast("int").alias("in_all"), F.coalesce(F.col("trend_bucket") <= 2, F.lit(False)).cast("int").alias("in_main"), r6(F.ln("amount_million")).alias("log_amount"))


view("cfac", """
SELECT date, entity, close*volume/1e6 AS am, coalesce(cum-coalesce(lag(cum,60) OVER w,0)>0,false) AS gd, CASE WHEN ci-lag(ci,6) OVER w<=60 AND lag(cum,1) OVER w=lag(cum,6) OVER w THEN lag(close,1) OVER w/lag(close,6) OVER w-1 END AS z, coalesce(lead(cum,21) OVER w-lead(cum,1) OVER w>0,false) AS fd,
  CASE WHEN ci-lag(ci,1) OVER w=1 AND cum=lag(cum,1) OVER w THEN close/greatest(close, lag(close,1) OVER w) END AS hn, CASE WHEN ci-lag(ci,2) OVER w=2 AND lag(cum,1) OVER w=lag(cum,2) OVER w THEN lag(close,1) OVER w/lag(close,2) OVER w-1 END AS mo
FROM (SELECT *, sum(d) OVER (PARTITION BY entity ORDER BY date) AS cum FROM (SELECT p.date, p.entity, p.close, p.volume, c.day_idx AS ci, coalesce(abs(p.close/lag(p.close) OVER (PARTITION BY p.entity ORDER BY p.date)-1)*100>9,false)::INT AS d FROM prices p JOIN calendar c USING (date) WHERE p.close>0))
WINDOW w AS (PARTITION BY entity ORDER BY date)
""")


@query("pck09_calendar_factors", "SELECT strftime(date,'%Y-%m-%d') AS date, entity, round(am,6) AS amount_million, gd::INT AS gate_disc, round(mo,6)+0.0 AS mom_6_1, round(hn,6)+0.0 AS high52_near, fd::INT AS fwd_disc_20 FROM cfac")
def pck09(t):
    """Short windows here: with these dates few entities trade on two market days in a row."""
    d = K.calendar_factors(t.prices, P.market_calendar(t.prices, 5), 9.0, (2, 1), 2, 60, (20,))
    return d.select(iso("date").alias("date"), "entity", r6("amount_million").alias("amount_million"), F.col("gate_disc").cast("int").alias("gate_disc"), r6("mom_6_1").alias("mom_6_1"), r6("high52_near").alias("high52_near"), F.col("fwd_disc_20").cast("int").alias("fwd_disc_20"))


view("eacc", """
SELECT a.entity, a.year*4+a.quarter-1 AS qi, ((a.eps-e4.eps)-(e1.eps-e5.eps))/q.p AS eps_accel FROM single_q a LEFT JOIN single_q e1 ON e1.entity=a.entity AND e1.year*4+e1.quarter=a.year*4+a.quarter-1 LEFT JOIN single_q e4 ON e4.entity=a.entity AND e4.year*4+e4.quarter=a.year*4+a.quarter-4
LEFT JOIN single_q e5 ON e5.entity=a.entity AND e5.year*4+e5.quarter=a.year*4+a.quarter-5 LEFT JOIN (SELECT entity, year(date)*4+quarter(date)-1 AS qi, arg_max(close, date) AS p FROM prices GROUP BY 1,2) q ON q.entity=a.entity AND q.qi=a.year*4+a.quarter-1
""")


@query("pck10_eps_acceleration_asof", f"SELECT strftime(w.date,'%Y-%m-%d') AS date, e.entity, round(e.eps_accel,9)+0.0 AS eps_accel FROM weekly w JOIN eacc e ON e.qi={_KQ.format('w.date')}")
def pck10(t):
    acc = K.eps_acceleration(single_q(t), K.quarter_end_close(t.prices))
    d = P.weekly_dates(t.prices).select("date", O.known_quarter(F.col("date")).alias("qi"))
    return F.broadcast(d).join(acc, "qi").select(iso("date").alias("date"), "entity", r6("eps_accel", 9).alias("eps_accel"))


view("racc", """
WITH r3 AS (SELECT a.entity, a.m, a.revenue+b.revenue+c.revenue AS r3 FROM rev_m a LEFT JOIN rev_m b ON b.entity=a.entity AND b.m=a.m-1 LEFT JOIN rev_m c ON c.entity=a.entity AND c.m=a.m-2),
y AS (SELECT a.entity, a.m, CASE WHEN b.r3>0 THEN a.r3/b.r3-1 END AS y3 FROM r3 a LEFT JOIN r3 b ON b.entity=a.entity AND b.m=a.m-12)
SELECT a.entity, a.m, a.y3-b.y3 AS rev_accel FROM y a LEFT JOIN y b ON b.entity=a.entity AND b.m=a.m-3
""")


@query("pck11_revenue_acceleration_asof", "SELECT strftime(w.date,'%Y-%m-%d') AS date, r.entity, round(r.rev_accel,6)+0.0 AS rev_accel FROM weekly w JOIN racc r ON r.m=year(w.date)*12+month(w.date)-1-CASE WHEN day(w.date)>=11 THEN 1 ELSE 2 END")
def pck11(t):
    d = P.weekly_dates(t.prices).select("date", O.known_month(F.col("date")).alias("m"))
    return F.broadcast(d).join(K.revenue_acceleration(t.revenue), "m").select(iso("date").alias("date"), "entity", r6("rev_accel").alias("rev_accel"))


view("ff_arr", f"""
SELECT {_TAG.format('date')} AS week, entity, date AS data_date, CAST(weekofyear(date) AS INTEGER) AS wn FROM panel0 LEFT JOIN membership m USING (entity) WHERE date IN (SELECT date FROM weekly) AND vol_ratio IS NOT NULL
""")
view("ff_led", """
SELECT week, entity, data_date, CASE WHEN day(data_date)%2=0 THEN 'second' ELSE 'first' END AS delivery FROM ff_arr WHERE day(data_date)%2=0 OR wn%5<>0
""")
view("cfac_long", """
SELECT date, entity, CASE WHEN ci-lag(ci,126) OVER w=126 AND lag(cum,21) OVER w=lag(cum,126) OVER w THEN lag(close,21) OVER w/lag(close,126) OVER w-1 END AS mo,
  CASE WHEN ci-lag(ci,249) OVER w=249 AND cum=lag(cum,249) OVER w THEN close/max(close) OVER (PARTITION BY entity ORDER BY date ROWS 249 PRECEDING) END AS hn
FROM (SELECT *, sum(d) OVER (PARTITION BY entity ORDER BY date) AS cum FROM (SELECT p.date, p.entity, p.close, c.day_idx AS ci, coalesce(abs(p.close/lag(p.close) OVER (PARTITION BY p.entity ORDER BY p.date)-1)*100>9,false)::INT AS d FROM prices p JOIN calendar c USING (date) WHERE p.close>0))
WINDOW w AS (PARTITION BY entity ORDER BY date)
""")


@query("out12_frozen_ledger", """
SELECT l.week, l.entity, l.delivery, round(f.mo,6)+0.0 AS mom_6_1, round(f.hn,6)+0.0 AS high52_near, round(c.mo,6)+0.0 AS mom_2_1, round(c.hn,6)+0.0 AS high2_near, round(e.eps_accel,9)+0.0 AS eps_accel, round(r.rev_accel,6)+0.0 AS rev_accel FROM ff_led l
LEFT JOIN cfac_long f ON f.entity=l.entity AND f.date=l.data_date LEFT JOIN cfac c ON c.entity=l.entity AND c.date=l.data_date
LEFT JOIN (SELECT w.date, e.entity, e.eps_accel FROM weekly w JOIN eacc e ON e.qi=""" + _KQ.format("w.date") + """) e ON e.entity=l.entity AND e.date=l.data_date
LEFT JOIN (SELECT w.date, r.entity, r.rev_accel FROM weekly w JOIN racc r ON r.m=year(w.date)*12+month(w.date)-1-CASE WHEN day(w.date)>=11 THEN 1 ELSE 2 END) r ON r.entity=l.entity AND r.date=l.data_date""")
def out12_frozen(t):
    """Two deliveries of all names of all weeks as streams of files.  Every fifth week comes too late at first; the
    second delivery replaces the weeks whose date is even and comes too late for the others.

    Momentum over 126 days but the last 21 and the high of 250 days need a name that trades on each of them;
    mom_2_1 and high2_near are the same over two rows.
    """
    from tidewater.sources.staging import stage_dir
    from tidewater.streaming import forms as T

    base = f"{stage_dir(t.spark)}/frozen-{uuid.uuid4().hex}"
    p = staged(t.spark, t.root, "frozen_names", lambda: ranked_names(t).select(week_tag("date").alias("week"), F.col("date").alias("data_date"), "entity", _layer().alias("layer")).join(t.membership.select("entity"), "entity", "left"))
    late = F.substring("week", -2, 2).cast("int") % 5 == 0
    even = F.dayofmonth("data_date") % 2 == 0
    d = P.weekly_dates(t.prices).select("date")
    cal = P.market_calendar(t.prices, 5)

    def moves():
        """Factors of a name's prices on the dates a ledger can ask for; one row a name and date, as in the prices."""
        long, short = (K.calendar_factors(t.prices, cal, 9.0, mom, high, 60, (20,)).join(F.broadcast(d), "date", "left_semi") for mom, high in (((126, 21), 250), ((2, 1), 2)))
        return long.select("entity", "date", "mom_6_1", "high52_near").join(short.select("entity", "date", F.col("mom_6_1").alias("mom_2_1"), F.col("high52_near").alias("high2_near")), ["entity", "date"])

    px = staged(t.spark, t.root, "frozen_moves", moves)
    eps = F.broadcast(d.withColumn("qi", O.known_quarter(F.col("date")))).join(K.eps_acceleration(single_q(t), K.quarter_end_close(t.prices)), "qi")
    rev = F.broadcast(d.withColumn("m", O.known_month(F.col("date")))).join(K.revenue_acceleration(t.revenue), "m")
    factors = {n: px.select("entity", "date", n) for n in ("mom_6_1", "high52_near", "mom_2_1", "high2_near")}
    factors |= {n: staged(t.spark, t.root, f"frozen_{n}", lambda x=x, n=n: x.select("entity", "date", n)) for n, x in (("eps_accel", eps), ("rev_accel", rev))}
    for name, days in (("first", F.when(late, 30).otherwise(3)), ("second", F.when(even, 10).otherwise(20))):
        rows = p.withColumns({"delivery": F.lit(name), "now": F.date_add("data_date", days)})
        rows.repartition("week").write.parquet(f"{base}/{name}")
        came = t.spark.readStream.schema(rows.schema).parquet(f"{base}/{name}")
        work = T.frozen_batch(f"{base}/ledger", f"{base}/refused/{name}", factors, 14)
        came.writeStream.foreachBatch(work).option("checkpointLocation", f"{base}/c-{name}").trigger(availableNow=True).start().awaitTermination()
    d = t.spark.read.schema(T.ledger_schema(rows, factors)).parquet(f"{base}/ledger")
    return d.select("week", "entity", "delivery", *[r6(x).alias(x) for x in ("mom_6_1", "high52_near", "mom_2_1", "high2_near")], r6("eps_accel", 9).alias("eps_accel"), r6("rev_accel").alias("rev_accel"))
