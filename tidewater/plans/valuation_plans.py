"""Valuation queries."""

from pyspark.sql import functions as F

from tidewater.functions import labels as L
from tidewater.functions.exprs import iso, r6
from tidewater.operators import panel as P
from tidewater.operators import valuation as V
from tidewater.plans.flow_plans import health_of, inflect, latest_q, single_q
from tidewater.plans.panel_plans import panel_of
from tidewater.plans.registry import query, view
from tidewater.sources.staging import staged

MINP = 3


def latest_ratios(t):
    cols = ("pe", "pbr", "dividend_yield", "date")
    return staged(t.spark, t.root, "latest_ratios", lambda: t.ratios.groupBy("entity").agg(F.max_by(F.struct(*cols), "date").alias("r")).select("entity", "r.*"))


view("rat_now", "SELECT entity, arg_max({'pe': pe, 'pbr': pbr, 'dy': dividend_yield, 'date': date}, date) AS r FROM ratios GROUP BY 1")
view("rat1", "SELECT entity, r.date AS date, round(r.pe,2) AS pe, round(r.pbr,2) AS pbr, round(r.dy,2) AS dividend_yield FROM rat_now")


def rel_sql(src, mem, col, keys=""):
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}entity, round(round(avg(med),9),2)+0.0 AS subind_median, round(round(avg(rel),9),1)+0.0 AS vs_subind_pct, round(round(avg(p),9),1)+0.0 AS subind_pctile, max(n) AS peer_n FROM (
  SELECT {k}entity, n, med, (v/med-1)*100 AS rel, CASE WHEN n>1 THEN (rk-1)/(n-1)*100 END AS p FROM (SELECT {k}entity, grp, {col} AS v, count(*) OVER g AS n, median({col}) OVER g AS med,
    rank() OVER (PARTITION BY {k}grp ORDER BY {col})+(count(*) OVER (PARTITION BY {k}grp, {col})-1)/2.0::DOUBLE AS rk FROM {mem} JOIN {src} USING (entity) WHERE {col}>0 WINDOW g AS (PARTITION BY {k}grp)) WHERE n>={MINP}) GROUP BY {k}entity"""


def fill_sql(fine, broad, keys=()):
    u = ", ".join([*keys, "entity"])
    cols = ", ".join(f"coalesce(a.{x}, b.{x}) AS {x}" for x in V.REL)
    return f"SELECT {u}, {cols}, a.subind_pctile IS NULL AND b.subind_pctile IS NOT NULL AS used_broad FROM {fine} a FULL JOIN {broad} b USING ({u})"


for _c in ("pe", "pbr", "dividend_yield"):
    view(f"rel_{_c}_f", rel_sql("rat1", "membership", _c))
    view(f"rel_{_c}_b", rel_sql("rat1", "broad", _c))
    view(f"rel_{_c}", fill_sql(f"rel_{_c}_f", f"rel_{_c}_b"))


@query("val01_peer_relative", "SELECT * FROM rel_pe_f")
def val01(t):
    return V.peer_relative(latest_ratios(t), t.membership, "pe", (), MINP)


@query("val02_broad_fallback", "SELECT entity, subind_median, vs_subind_pct, subind_pctile, peer_n, used_broad::INT AS used_broad FROM rel_pe")
def val02(t):
    r = latest_ratios(t)
    d = V.fill_from_broad(V.peer_relative(r, t.membership, "pe", (), MINP), V.peer_relative(r, t.broad, "pe", (), MINP))
    return d.withColumn("used_broad", F.col("used_broad").cast("int"))


view("valtab", """
SELECT r.entity, r.date, r.pe, r.pbr, r.dividend_yield, CASE WHEN r.pe>0 THEN 'ok' ELSE '無本益比' END AS pe_status, CASE WHEN p.subind_pctile IS NOT NULL THEN 'PE' WHEN b.subind_pctile IS NOT NULL THEN 'PB' END AS val_metric,
  CASE WHEN p.subind_pctile IS NOT NULL THEN p.subind_median ELSE b.subind_median END AS val_median, coalesce(p.subind_pctile, b.subind_pctile) AS val_pctile, CASE WHEN p.subind_pctile IS NOT NULL THEN p.peer_n ELSE b.peer_n END AS val_peer_n,
  b.subind_median AS pb_peer_median
FROM rat1 r LEFT JOIN rel_pe p USING (entity) LEFT JOIN rel_pbr b USING (entity)
""")


@query("val03_valuation_table", """
SELECT entity, pe, pbr, dividend_yield, pe_status, val_metric, val_median, val_pctile, val_peer_n, CASE WHEN val_pctile<=30 THEN CASE WHEN val_metric='PB' THEN '相對便宜(PB)' ELSE '相對便宜' END ELSE '' END AS cheap_flag FROM valtab""")
def val03(t):
    d = V.build_valuation(latest_ratios(t), t.membership, t.broad, (), MINP)
    return d.select("entity", "pe", "pbr", "dividend_yield", "pe_status", "val_metric", "val_median", "val_pctile", "val_peer_n", "cheap_flag")


@query("val04_self_percentile", """
SELECT entity, round(round(CASE WHEN n>1 THEN (rk-1)/(n-1)*100 ELSE 50 END,9),1)+0.0 AS pe_self_pctile, n AS pe_self_n FROM (
  SELECT entity, date, count(*) OVER (PARTITION BY entity) AS n, max(date) OVER (PARTITION BY entity) AS last, rank() OVER (PARTITION BY entity ORDER BY pe)+(count(*) OVER (PARTITION BY entity, pe)-1)/2.0::DOUBLE AS rk FROM ratios WHERE pe>0)
WHERE date=last AND n>=8""")
def val04(t):
    return V.self_percentile(t.ratios)


view("selfmed", "SELECT entity, " + ", ".join(f"CASE WHEN count(CASE WHEN {c}>0 THEN 1 END)>=8 THEN round(round(median(CASE WHEN {c}>0 THEN {c} END),9),2)+0.0 END AS {o}" for c, o in
     (("pe", "pe_self_median"), ("pbr", "pb_self_median"), ("dividend_yield", "yield_self_median"))) + " FROM ratios GROUP BY 1")


@query("val05_self_medians", "SELECT * FROM selfmed")
def val05(t):
    return V.self_medians(t.ratios)


@query("val06_implied_prices", """
SELECT s.entity, p.close, round(round(p.close*(pe_self_median/pe),9),2)+0.0 AS implied_pe, CASE WHEN dividend_yield>0 AND yield_self_median>0 THEN round(round(p.close*(dividend_yield/yield_self_median),9),2)+0.0 END AS implied_yield,
  round(round((round(round(p.close*(pe_self_median/pe),9),2)/p.close-1)*100,9),1)+0.0 AS gap_pe, CASE WHEN pe>0 AND r.yoy_pct>0 THEN round(round(pe/r.yoy_pct,9),2)+0.0 END AS peg
FROM rat1 s JOIN selfmed USING (entity) JOIN prices p ON p.entity=s.entity AND p.date=s.date LEFT JOIN revenue r ON r.entity=s.entity AND r.m=year(s.date)*12+month(s.date)-1""")
def val06(t):
    m = F.year("date") * 12 + F.month("date") - 1
    d = latest_ratios(t).select("entity", "date", F.round("pe", 2).alias("pe"), F.round("dividend_yield", 2).alias("dividend_yield")).join(V.self_medians(t.ratios), "entity")
    d = d.join(t.prices.select("entity", "date", "close"), ["entity", "date"]).withColumn("m", m).join(t.revenue.select("entity", "m", "yoy_pct"), ["entity", "m"], "left")
    imp = V.implied_price(F.col("close"), F.col("pe"), F.col("pe_self_median"))
    return d.select("entity", "close", imp.alias("implied_pe"), V.implied_price_yield(F.col("close"), F.col("dividend_yield"), F.col("yield_self_median")).alias("implied_yield"),
                    V.gap_pct(imp, F.col("close")).alias("gap_pe"), V.peg_like(F.col("pe"), F.col("yoy_pct")).alias("peg"))


_LEG = ["gap_peer", "gap_self", "gap_pb_peer", "gap_pb_self", "gap_yield_peer", "gap_yield_self"]


def _gap(ratio, ref):
    return f"CASE WHEN {ratio}>0 THEN round(round((round(round(close*({ref}/{ratio}),9),2)/close-1)*100,9),1)+0.0 END"


def _gapy(y, ref):
    return f"CASE WHEN {y}>0 AND {ref}>0 THEN round(round((round(round(close*({y}/{ref}),9),2)/close-1)*100,9),1)+0.0 END"


def legs_sql(src, keys):
    pr = "(CASE val_metric WHEN 'PE' THEN pe WHEN 'PB' THEN pbr END)"
    return f"""SELECT *, len(a) AS n_legs, CASE WHEN len(a)=0 THEN NULL WHEN len(a)%2=1 THEN round(round(a[len(a)//2+1],9),1)+0.0 ELSE round(round((a[len(a)//2]+a[len(a)//2+1])/2,9),1)+0.0 END AS composite
FROM (SELECT *, list_sort(list_filter([{', '.join(_LEG)}], lambda x: x IS NOT NULL)) AS a FROM (SELECT {keys}, {_gap(pr, 'val_median')} AS gap_peer, {_gap('pe', 'pe_self_median')} AS gap_self, {_gap('pbr', 'pb_peer_median')} AS gap_pb_peer,
  {_gap('pbr', 'pb_self_median')} AS gap_pb_self, {_gapy('dividend_yield', 'yield_peer_median')} AS gap_yield_peer, {_gapy('dividend_yield', 'yield_self_median')} AS gap_yield_self FROM {src}))"""


view("legs_in", "SELECT v.*, p.close, y.subind_median AS yield_peer_median, s.pe_self_median, s.pb_self_median, s.yield_self_median FROM valtab v JOIN prices p ON p.entity=v.entity AND p.date=v.date LEFT JOIN rel_dividend_yield y ON y.entity=v.entity LEFT JOIN selfmed s ON s.entity=v.entity")


@query("val07_gap_legs", "SELECT entity, " + ", ".join(_LEG) + ", composite, CAST(n_legs AS BIGINT) AS n_legs FROM (" + legs_sql("legs_in", "entity") + ")")
def val07(t):
    r = latest_ratios(t)
    v = V.build_valuation(r, t.membership, t.broad, (), MINP).select("entity", "val_metric", "val_median", "pe", "pbr", "dividend_yield", F.col("pb_subind_median").alias("pb_peer_median"))
    y = V.fill_from_broad(V.peer_relative(r, t.membership, "dividend_yield", (), MINP), V.peer_relative(r, t.broad, "dividend_yield", (), MINP)).select("entity", F.col("subind_median").alias("yield_peer_median"))
    d = r.select("entity", "date").join(t.prices.select("entity", "date", "close"), ["entity", "date"]).join(v, "entity").join(y, "entity", "left").join(V.self_medians(t.ratios), "entity", "left")
    return V.gap_legs(d).select("entity", *_LEG, "composite", F.col("n_legs").cast("bigint").alias("n_legs"))


view("ratw", "SELECT r.date, r.entity, round(pe,2) AS pe, round(pbr,2) AS pbr, round(dividend_yield,2) AS dividend_yield, p.close FROM ratios r JOIN prices p USING (date, entity) WHERE r.date IN (SELECT date FROM weekly)")
for _c in ("pe", "pbr", "dividend_yield"):
    view(f"relw_{_c}_f", rel_sql("ratw", "membership", _c, "date"))
    view(f"relw_{_c}_b", rel_sql("ratw", "broad", _c, "date"))
    view(f"relw_{_c}", fill_sql(f"relw_{_c}_f", f"relw_{_c}_b", ("date",)))
view("selfw", "SELECT date, entity, " + ", ".join(f"CASE WHEN count(CASE WHEN {c}>0 THEN 1 END) OVER w>=8 THEN round(round(median(CASE WHEN {c}>0 THEN {c} END) OVER w,9),2)+0.0 END AS {o}" for c, o in
     (("pe", "pe_self_median"), ("pbr", "pb_self_median"), ("dividend_yield", "yield_self_median"))) + " FROM ratios WINDOW w AS (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING)")
view("legsw_in", """
SELECT r.*, CASE WHEN p.subind_pctile IS NOT NULL THEN 'PE' WHEN b.subind_pctile IS NOT NULL THEN 'PB' END AS val_metric, CASE WHEN p.subind_pctile IS NOT NULL THEN p.subind_median ELSE b.subind_median END AS val_median, b.subind_median AS pb_peer_median,
  y.subind_median AS yield_peer_median, s.pe_self_median, s.pb_self_median, s.yield_self_median
FROM ratw r LEFT JOIN relw_pe p USING (date, entity) LEFT JOIN relw_pbr b USING (date, entity) LEFT JOIN relw_dividend_yield y USING (date, entity) LEFT JOIN selfw s USING (date, entity)
""")


@query("val08_weekly_gap_panel", "SELECT strftime(date,'%Y-%m-%d') AS date, entity, " + ", ".join(_LEG) + ", composite, CAST(n_legs AS BIGINT) AS n_legs FROM (" + legs_sql("legsw_in", "date, entity") + ")")
def val08(t):
    d = V.gap_panel(t.ratios, t.prices, P.weekly_dates(t.prices), t.membership, t.broad, MINP)
    return d.select(iso("date").alias("date"), "entity", *_LEG, "composite", F.col("n_legs").cast("bigint").alias("n_legs"))


@query("val09_deep_value_growth", """
SELECT v.entity, (coalesce(val_pctile<=40,false) AND coalesce(h.yoy_pct>=0,false) AND coalesce(q.gross_margin_pct>=10,false) AND (coalesce(m.ma60<0,false)))::INT AS deep_value_growth
FROM valtab v LEFT JOIN health h ON h.entity=v.entity AND h.m=year(v.date)*12+month(v.date)-1 LEFT JOIN latest_q q ON q.entity=v.entity LEFT JOIN ent m ON m.entity=v.entity AND m.date=v.date""")
def val09(t):
    v = V.build_valuation(latest_ratios(t), t.membership, t.broad, (), MINP).select("entity", "val_pctile").join(latest_ratios(t).select("entity", "date"), "entity")
    v = v.withColumn("m", F.year("date") * 12 + F.month("date") - 1).join(health_of(t).select("entity", "m", "yoy_pct"), ["entity", "m"], "left")
    v = v.join(latest_q(t).select("entity", "gross_margin_pct"), "entity", "left").join(inflect(t).select("entity", "date", "ma60"), ["entity", "date"], "left")
    tag = L.deep_value_growth(F.col("val_pctile"), F.col("yoy_pct"), F.col("gross_margin_pct"), F.col("ma60"), F.lit(None).cast("string"), 40.0, 0.0, 10.0)
    return v.select("entity", tag.cast("int").alias("deep_value_growth"))


@query("val10_daily_medians", "SELECT strftime(date,'%Y-%m-%d') AS date, " + ", ".join(f"round(median({c}),6) AS median_{c}, count({c}) AS n_{c}" for c in ("pe", "pbr", "dividend_yield")) + " FROM ratios GROUP BY date")
def val10(t):
    d = V.daily_medians(t.ratios)
    return d.select(iso("date").alias("date"), *[e for c in ("pe", "pbr", "dividend_yield") for e in (r6(f"median_{c}").alias(f"median_{c}"), f"n_{c}")])


# income and cash flow per single quarter: derived whole numbers
view("fin_q", "SELECT entity, year, quarter, revenue, floor(eps*1000) AS income, eps, floor(revenue*0.05::DOUBLE+eps*400) AS fcf FROM single_q WHERE revenue IS NOT NULL")


def fin_q(t):
    return staged(t.spark, t.root, "fin_q", lambda: single_q(t).where(F.col("revenue").isNotNull()).select(
        "entity", "year", "quarter", "revenue", F.floor(F.col("eps") * 1000).cast("double").alias("income"), "eps", F.floor(F.col("revenue") * 0.05 + F.col("eps") * 400).cast("double").alias("fcf")))


view("ann", "SELECT entity, year, CASE WHEN count(*)>=4 THEN sum(revenue) END AS revenue, CASE WHEN count(*)>=4 THEN sum(fcf) END AS fcf, count(*) AS n_q FROM fin_q GROUP BY 1,2")
view("lossf", "SELECT entity, CASE WHEN count(*)>=4 THEN bool_or(income<0) END AS any_quarterly_loss FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year DESC, quarter DESC) AS b FROM fin_q WHERE income IS NOT NULL) WHERE b<=4 GROUP BY 1")


@query("val11_annual_totals", "SELECT a.entity, a.year, a.revenue, a.n_q, l.any_quarterly_loss::INT AS any_quarterly_loss FROM ann a LEFT JOIN lossf l USING (entity)")
def val11(t):
    lf = V.loss_flags(fin_q(t), "income").withColumn("any_quarterly_loss", F.col("any_quarterly_loss").cast("int"))
    return V.annual_totals(fin_q(t), "revenue").join(lf, "entity", "left").select("entity", "year", "revenue", "n_q", "any_quarterly_loss")


view("arrs", "SELECT entity, list(revenue ORDER BY year) FILTER (WHERE revenue IS NOT NULL) AS rv, list(fcf ORDER BY year) FILTER (WHERE fcf IS NOT NULL) AS fc FROM ann GROUP BY 1")
view("gsf", """
SELECT entity, CASE WHEN len(rv)>=3 THEN greatest(0.0::DOUBLE, least(15.0::DOUBLE, (pow(rv[-1]/rv[greatest(len(rv)-4,1)], 1.0::DOUBLE/(least(len(rv),5)-1))-1)*100*0.7::DOUBLE)) END AS growth,
  CASE WHEN len(rv)>=4 THEN list_max(y)-list_min(y) END AS swing, CASE WHEN len(fc)>=3 THEN least((fc[-1]+fc[-2]+fc[-3])/3, fc[-1]) WHEN len(fc)>=1 THEN fc[-1] END AS fcf0
FROM (SELECT *, [(rv[-1]/rv[-2]-1)*100, (rv[-2]/rv[-3]-1)*100, (rv[-3]/rv[-4]-1)*100] AS y FROM arrs)
""")


def growth_inputs(t):
    rev = V.ordered_values(V.annual_totals(fin_q(t), "revenue"), "revenue", "rv")
    fcf = V.ordered_values(V.annual_totals(fin_q(t), "fcf"), "fcf", "fc")
    j = fin_q(t).select("entity").distinct().join(rev, "entity", "left").join(fcf, "entity", "left")
    return j.select("entity", V.conservative_growth(F.col("rv")).alias("growth"), V.yoy_swing(F.col("rv")).alias("swing"), V.fcf_base(F.col("fc")).alias("fcf0"))


@query("val12_growth_swing_fcf", "SELECT entity, round(growth,6)+0.0 AS growth, round(swing,6)+0.0 AS swing, round(fcf0,6)+0.0 AS fcf0 FROM gsf")
def val12(t):
    return growth_inputs(t).select("entity", *[r6(c).alias(c) for c in ("growth", "swing", "fcf0")])




def _dcf(r, gt, mult=1.0):
    return f"round(CASE WHEN ok THEN (list_sum(list_transform(range(1,11), lambda t: fcf0*pow(1+growth*{mult}/100,t)/pow(1+{r}/100,t)))+fcf0*pow(1+growth*{mult}/100,10)*(1+{gt}/100)/({r}/100-{gt}/100)/pow(1+{r}/100,10)-nd)/sh END,4)+0.0"


@query("val13_dcf", f"""
SELECT entity, reason AS dcf_exclude_reason, {_dcf('9.0::DOUBLE', '2.0::DOUBLE')} AS dcf_value, {_dcf('8.0::DOUBLE', '1.0::DOUBLE')} AS s_dn_dn, {_dcf('8.0::DOUBLE', '3.0::DOUBLE')} AS s_dn_up, {_dcf('10.0::DOUBLE', '1.0::DOUBLE')} AS s_up_dn,
  {_dcf('10.0::DOUBLE', '3.0::DOUBLE')} AS s_up_up, {_dcf('9.0::DOUBLE', '2.0::DOUBLE', '0.5::DOUBLE')} AS s_g050, {_dcf('9.0::DOUBLE', '2.0::DOUBLE', '0.75::DOUBLE')} AS s_g075
FROM (SELECT *, reason IS NULL AS ok FROM (SELECT g.entity, g.growth, g.fcf0, s.s_acctbal AS nd, CAST(s.s_suppkey%50+10 AS DOUBLE) AS sh,
  CASE WHEN m.grp IS NULL THEN '排除：產業別未知' WHEN m.grp='NATION_3' THEN '排除：產業不適用' WHEN l.any_quarterly_loss THEN '排除：近 4 季有單季虧損' WHEN g.swing>40 THEN '排除：營收極端週期' WHEN g.fcf0 IS NULL OR g.growth IS NULL THEN '排除：資料不足'
    WHEN g.fcf0<=0 THEN '排除：自由現金流為負／零' END AS reason FROM gsf g JOIN supplier s ON s.s_suppkey=g.entity LEFT JOIN membership m ON m.entity=g.entity LEFT JOIN lossf l ON l.entity=g.entity))""")
def val13(t):
    s = t.raw("supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_acctbal").alias("net_debt"), (F.col("s_suppkey") % 50 + 10).alias("shares"))
    inp = growth_inputs(t).join(s, "entity").join(t.membership.withColumnRenamed("grp", "industry"), "entity", "left").join(V.loss_flags(fin_q(t), "income"), "entity", "left")
    d = V.dcf_table(inp, 9.0, exclude=["NATION_3"])
    return d.select("entity", "dcf_exclude_reason", *[r6(c, 4).alias(c) for c in ("dcf_value", "s_dn_dn", "s_dn_up", "s_up_dn", "s_up_up", "s_g050", "s_g075")])


view("anchors", "SELECT min(date) AS anchor FROM calendar GROUP BY strftime(date,'%Y-%m')")
view("asof_q", """
SELECT a.anchor, q.entity, arg_max(q, q.qi) AS q FROM anchors a JOIN (
  SELECT *, year*4+quarter-1 AS qi, CASE quarter WHEN 1 THEN make_date(year,5,15) WHEN 2 THEN make_date(year,8,14) WHEN 3 THEN make_date(year,11,14) ELSE make_date(year+1,3,31) END AS known,
    year*4+quarter-1-lag(year*4+quarter-1,3) OVER w=3 AS fl, sum(revenue) OVER w4 AS rt, sum(income) OVER w4 AS it, sum(eps) OVER w4 AS et, count(income) OVER w4 AS ci, count(eps) OVER w4 AS ce, max((income<0)::INT) OVER w4 AS ls
  FROM fin_q WINDOW w AS (PARTITION BY entity ORDER BY year, quarter), w4 AS (PARTITION BY entity ORDER BY year, quarter ROWS 3 PRECEDING)) q ON q.known<a.anchor GROUP BY 1,2
""")


def asof_q(t):
    return staged(t.spark, t.root, "asof_q", lambda: V.statements_asof(fin_q(t), P.monthly_anchors(t.prices, 5)))


@query("val14_statements_asof", "SELECT strftime(anchor,'%Y-%m-%d') AS anchor, entity, CAST(q.qi AS BIGINT) AS qi, CASE WHEN q.fl THEN q.rt END AS revenue_ttm, CASE WHEN q.fl AND q.ci=4 THEN q.it END AS income_ttm, round(CASE WHEN q.fl AND q.ce=4 THEN q.et END,6)+0.0 AS eps_ttm FROM asof_q")
def val14(t):
    return asof_q(t).select(iso("anchor").alias("anchor"), "entity", F.col("qi").cast("bigint").alias("qi"), "revenue_ttm", "income_ttm", r6("eps_ttm").alias("eps_ttm"))


@query("val15_leave_self_out_median", f"""
SELECT r.entity, b.grp, round(r.pe,2) AS pe, CASE WHEN count(o.pe)>={MINP} THEN round(median(o.pe),6) END AS peer_median
FROM rat1 r JOIN broad b USING (entity) JOIN broad c ON c.grp=b.grp AND c.entity<>r.entity JOIN rat1 o ON o.entity=c.entity AND o.pe>0 WHERE r.pe>0 GROUP BY 1,2,3""")
def val15(t):
    d = t.broad.join(latest_ratios(t).select("entity", F.round("pe", 2).alias("pe")), "entity")
    return V.leave_self_out_median(d, ["grp"], "pe", "peer_median", MINP).select("entity", "grp", "pe", r6("peer_median").alias("peer_median"))


@query("val18_calendar_medians", "SELECT strftime(date,'%Y-%m-%d') AS date, entity, " + ", ".join(f"round(CASE WHEN count(pbr) OVER w>=10 THEN median({c}) OVER w END,6) AS {o}" for c, o in
       (("pe", "pe_self_med"), ("pbr", "pb_self_med"), ("nullif(dividend_yield,0)", "dy_self_med"))) + " FROM ratios WINDOW w AS (PARTITION BY entity ORDER BY date RANGE BETWEEN INTERVAL 364 DAYS PRECEDING AND CURRENT ROW)")
def val18(t):
    d = V.calendar_medians(t.ratios, 365, 10)
    return d.select(iso("date").alias("date"), "entity", *[r6(c).alias(c) for c in ("pe_self_med", "pb_self_med", "dy_self_med")])


