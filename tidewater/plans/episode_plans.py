"""Feature panel, episode and signal-calibration queries."""

from pyspark.sql import functions as F

from tidewater.functions.exprs import iso, own_rows, r6, with_scalar
from tidewater.operators import episodes as E
from tidewater.operators import features as X
from tidewater.operators import flows as W
from tidewater.operators import stats as S
from tidewater.operators.order import exact_quantiles
from tidewater.plans.flow_plans import gflows_of
from tidewater.plans.momentum_plans import baskets_of, index_of
from tidewater.plans.registry import query, view
from tidewater.sources.staging import staged

_FL = [f"{W.FLOW[x]}_{n}d" for x in W.NETS for n in (5, 20)]
_W = "WINDOW w AS (PARTITION BY entity ORDER BY date)" + "".join(
    f", w{n} AS (PARTITION BY entity ORDER BY date ROWS {n - 1} PRECEDING)" for n in (5, 20, 60, 240))
view("sp0", "SELECT p.date, p.entity, close, volume, coalesce(total_net,0) AS total_net, coalesce(foreign_net,0) AS foreign_net, coalesce(trust_net,0) AS trust_net "
     "FROM prices p LEFT JOIN flows f USING (date, entity)")
view("sp1", "SELECT date, entity, close, volume, " + ", ".join(f"CAST(sum({x}) OVER w{n} AS BIGINT) AS {W.FLOW[x]}_{n}d" for x in W.NETS for n in (5, 20))
     + ", (close/min(close) OVER w60-1)*100 AS above_low_60d_pct, (close/max(close) OVER w60-1)*100 AS above_high_60d_pct, "
     + ", ".join(f"CASE WHEN count(*) OVER w{n}>={n} THEN (close/avg(close) OVER w{n}-1)*100 END AS above_ma{n}_pct" for n in (20, 60, 240))
     + ", avg(volume) OVER w5 AS av, (close/lag(close,5) OVER w-1)*100 AS ret_5d, (close/lag(close,20) OVER w-1)*100 AS ret_20d FROM sp0 " + _W)


def _z(x):
    return f"CASE WHEN count({x}) OVER w60>=30 AND stddev_samp({x}) OVER w60>0 THEN ({x}-avg({x}) OVER w60)/stddev_samp({x}) OVER w60 END"


view("sp2", "SELECT *, " + ", ".join(f"{_z(x)} AS {x}_z" for x in _FL) + f", {_z('av')} AS volume_z_5d, "
     + ", ".join(f"{W.FLOW[x]}_{n}d-lag({W.FLOW[x]}_{n}d,{n}) OVER w AS {W.MOM[x]}_momentum_{n}d" for x in W.NETS for n in (5, 20))
     + ", CASE WHEN abs(foreign_flow_20d)+abs(trust_flow_20d)>0 THEN (foreign_flow_20d+trust_flow_20d)/(abs(foreign_flow_20d)+abs(trust_flow_20d))::DOUBLE END AS dom_20d FROM sp1 " + _W)
view("sp3", "SELECT *, flow_momentum_5d-lag(flow_momentum_5d,5) OVER w AS flow_decel, " + ", ".join(
    f"ret_{n}d-(net_flow_{n}d_z-lag(net_flow_{n}d_z,{n}) OVER w) AS price_flow_div_{n}d" for n in (5, 20)) + " FROM sp2 " + _W)
view("spanel", """
SELECT s.*, ret_20d-m.mr AS rs_market_20d, ret_20d-g.sr AS rs_subind_20d FROM sp3 s
LEFT JOIN (SELECT date, (market_index/lag(market_index,20) OVER (ORDER BY date)-1)*100 AS mr FROM mkt_index) m USING (date)
LEFT JOIN (SELECT entity, date, avg(b) AS sr FROM membership JOIN (SELECT grp, date, (basket_index/lag(basket_index,20) OVER (PARTITION BY grp ORDER BY date)-1)*100 AS b FROM baskets) USING (grp) GROUP BY 1,2) g USING (entity, date)
""")


def _spanel(t):
    return X.build_stock_panel(t.prices, t.flows, t.membership, baskets_of(t), index_of(t))


def spanel_of(t):
    return staged(t.spark, t.root, "stock_panel", lambda: _spanel(t))


def latest_of(t):
    """The latest row of every entity, for queries that read no other row: the panel is not written."""
    return staged(t.spark, t.root, "stock_latest", lambda: X.latest_rows(_spanel(t)))


_SPD = [f"{x}_z" for x in _FL] + ["volume_z_5d", "dom_20d", "above_low_60d_pct", "above_high_60d_pct", "above_ma20_pct", "above_ma60_pct", "above_ma240_pct",
                                  "ret_5d", "ret_20d", "price_flow_div_5d", "price_flow_div_20d", "rs_market_20d", "rs_subind_20d"]
_SPI = [*_FL, *[f"{W.MOM[x]}_momentum_{n}d" for x in W.NETS for n in (5, 20)], "flow_decel"]


@query("pan11_stock_panel", "SELECT strftime(date,'%Y-%m-%d') AS date, entity, close, volume, " + ", ".join(f"CAST({x} AS DOUBLE) AS {x}" for x in _SPI) + ", "
       + ", ".join(f"round({x},6)+0.0 AS {x}" for x in _SPD) + " FROM spanel")
def pan11(t):
    return spanel_of(t).select(iso("date").alias("date"), "entity", "close", "volume", *[F.col(x).cast("double").alias(x) for x in _SPI], *[r6(x).alias(x) for x in _SPD])


@query("pan12_rolling_z", "SELECT strftime(date,'%Y-%m-%d') AS date, entity, round(CASE WHEN abs(total_net)>=10 THEN " + _z("total_net") + " END,6)+0.0 AS z FROM sp0 " + _W)
def pan12(t):
    from tidewater.functions.exprs import roll_z

    p = t.prices.join(t.flows, ["date", "entity"], "left").withColumn("total_net", F.coalesce("total_net", F.lit(0)))
    return p.select(iso("date").alias("date"), "entity", r6(roll_z("total_net", own_rows(), 60, 30, 10.0)).alias("z"))


@query("pan13_coverage_meta", """
SELECT count(DISTINCT p.entity) AS n_stocks, count(DISTINCT p.date) AS n_trading_days, count(*) AS n_stock_days, round(100.0*avg((f.entity IS NOT NULL)::INT),2) AS inst_coverage_pct,
  count(DISTINCT CASE WHEN t.entity IS NOT NULL THEN p.entity END) AS n_tagged
FROM prices p LEFT JOIN flows f ON f.date=p.date AND f.entity=p.entity LEFT JOIN (SELECT DISTINCT entity FROM themes) t ON t.entity=p.entity""")
def pan13(t):
    return X.coverage_meta(t.prices, t.flows, t.themes)


# ------------------------------------------------------------- episodes


def _cooled(view_name, key, cooldown):
    return f"""WITH RECURSIVE c AS (SELECT {key}, i, base, fwd, date, row_number() OVER (PARTITION BY {key} ORDER BY i) AS k FROM {view_name}),
r AS (SELECT {key}, k, i, i AS last, true AS pick FROM c WHERE k=1 UNION ALL
  SELECT c.{key}, c.k, c.i, CASE WHEN c.i > r.last+{cooldown} THEN c.i ELSE r.last END, c.i > r.last+{cooldown} FROM r JOIN c ON c.{key}=r.{key} AND c.k=r.k+1)
SELECT c.{key}, strftime(c.date,'%Y-%m-%d') AS start_date, round(c.base,6) AS base, round(c.fwd*100,6)+0.0 AS fwd_return_pct FROM c JOIN r USING ({key}, k) WHERE r.pick"""


view("brk_c", """
SELECT * FROM (SELECT grp, date, basket_index AS base, CAST(row_number() OVER w-1 AS INTEGER) AS i, max(basket_index) OVER (PARTITION BY grp ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING)/basket_index-1 AS fwd,
  count(*) OVER w60>=60 AND basket_index <= min(basket_index) OVER w60*1.03::DOUBLE AS ctx FROM baskets
  WINDOW w AS (PARTITION BY grp ORDER BY date), w60 AS (PARTITION BY grp ORDER BY date ROWS 59 PRECEDING)) WHERE ctx AND fwd>=0.1
""")


@query("cal01_group_breakouts", _cooled("brk_c", "grp", 15))
def cal01(t):
    return E.group_breakouts(baskets_of(t)).select("grp", iso("start_date").alias("start_date"), r6("base").alias("base"), r6("fwd_return_pct").alias("fwd_return_pct"))


_CTX = {"ambush": "close <= lo*1.05::DOUBLE", "breakout": "(close/lo-1)*100 >= 3 AND (close/lo-1)*100 <= 8", "reversal": "(close/hi-1)*100 <= -10", "top": "close >= hi*(1-0.08::DOUBLE)"}
_EP = {"ambush": (6.0, 20, 20, 0.0, 5.0), "breakout": (6.0, 10, 15, 3.0, 8.0), "reversal": (6.0, 15, 15, 10.0, 0.0), "top": (6.0, 10, 15, 0.0, 8.0)}
for _k, (_x, _n, _cd, _lo, _hi) in _EP.items():
    _agg, _cmp = ("min", f"fwd <= -{_x}/100") if _k == "top" else ("max", f"fwd >= {_x}/100")
    view(f"ep_{_k}_c", f"""
SELECT * FROM (SELECT entity, date, close AS base, CAST(row_number() OVER w-1 AS INTEGER) AS i, {_agg}(close) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {_n} FOLLOWING)/close-1 AS fwd,
  lo IS NOT NULL AND {_CTX[_k]} AS ctx FROM (SELECT *, CASE WHEN count(*) OVER w60>=60 THEN min(close) OVER w60 END AS lo, CASE WHEN count(*) OVER w60>=60 THEN max(close) OVER w60 END AS hi FROM prices
    WINDOW w60 AS (PARTITION BY entity ORDER BY date ROWS 59 PRECEDING)) WINDOW w AS (PARTITION BY entity ORDER BY date)) WHERE ctx AND {_cmp.replace(f'{_x}/100', f'{_x / 100}::DOUBLE')}
""")


def episodes_of(t, kind):
    x, n, cd, lo, hi = _EP[kind]
    return staged(t.spark, t.root, f"ep_{kind}", lambda: E.entity_episodes(t.prices, kind, x, n, cd, 60, lo, hi))


def _register(kind):
    @query(f"cal02_{kind}_episodes", _cooled(f"ep_{kind}_c", "entity", _EP[kind][2]))
    def q(t):
        return episodes_of(t, kind).select("entity", iso("start_date").alias("start_date"), r6("base").alias("base"), r6("fwd_return_pct").alias("fwd_return_pct"))


for _k in _EP:
    _register(_k)


@query("cal03_standardize_signals", "SELECT grp, strftime(date,'%Y-%m-%d') AS date, " + ", ".join(f"round({x}_z,6)+0.0 AS {x}_z" for x in W.SIGNALS) + " FROM gflows_z")
def cal03(t):
    return W.standardize(gflows_of(t)).select("grp", iso("date").alias("date"), *[r6(f"{x}_z").alias(f"{x}_z") for x in W.SIGNALS])


# jobs of the entity scan: name -> condition
def entity_jobs(zs=(0.5, 1.0, 1.5, 2.0), low=3.0):
    out = {}
    for x in W.NETS:
        for n in (5, 20):
            z, m = f"{W.FLOW[x]}_{n}d_z", f"{W.MOM[x]}_momentum_{n}d"
            for th in zs:
                out[f"{z} (z>{th})"] = f"{z}>{th}"
                out[f"{z} (z>{th}) +mom"] = f"{z}>{th} AND {m}>0"
                out[f"{z} (z>{th}) +low"] = f"{z}>{th} AND above_low_60d_pct<={low}"
                if n == 5:
                    out[f"{z} (z>{th}) +early"] = f"{z}>{th} AND flow_decel>=0 AND {W.FLOW[x]}_20d_z<0.5"
                    out[f"{z} (z>{th}) +nodiv"] = f"{z}>{th} AND price_flow_div_5d<=0"
        out[f"{W.MOM[x]}_momentum (>0)"] = f"{W.MOM[x]}_momentum_5d>0"
    out |= {f"volume_z_5d (z>{th})": f"volume_z_5d>{th}" for th in (1.0, 1.5, 2.0)}
    return out


def top_jobs():
    high, slow, div, dry = "above_high_60d_pct>=-8", "flow_decel<0", "price_flow_div_5d>0", "volume_z_5d<0"
    out = {
        "near_high": high, "div": div, "vol": dry, "decel": slow, "high+decel": f"{high} AND {slow}", "high+decel+div": f"{high} AND {slow} AND {div}",
        "high+decel+vol": f"{high} AND {slow} AND {dry}", "overheat": f"{high} AND {slow} AND ({div} OR {dry})",
    }
    for p in ("foreign_flow", "net_flow"):
        for th in (1.0, 1.5):
            out[f"{p}_5d_z<-{th}"] = f"{p}_5d_z<-{th}"
            out[f"{p}_5d_z<-{th} +high"] = f"{p}_5d_z<-{th} AND {high}"
    return out


def _trig_sql(jobs, table, key):
    return " UNION ALL ".join(
        f"SELECT {key}, date, '{n}' AS job FROM (SELECT {key}, date, coalesce({s},false) AS h, lag(coalesce({s},false),1,false) OVER (PARTITION BY {key} ORDER BY date) AS p FROM {table}) WHERE h AND NOT p"
        for n, s in jobs.items())


view("scan_trig", _trig_sql(entity_jobs(), "spanel_m", "entity"))
view("spanel_m", "SELECT *, flow_momentum_5d AS fm5 FROM spanel")
view("top_trig", _trig_sql(top_jobs(), "spanel_m", "entity"))
view("cal_days", "SELECT date, row_number() OVER (ORDER BY date)-1 AS p FROM (SELECT DISTINCT date FROM prices)")
for _k, _lead in (("ambush", 15), ("top", 10)):
    view(f"{_k}_starts", _cooled(f"ep_{_k}_c", "entity", _EP[_k][2]).replace("WITH RECURSIVE ", "WITH RECURSIVE "))


def _judge_views(pre, starts, lead, occ, warm=30):
    view(f"{pre}_e", f"SELECT s.entity, d.p AS e FROM {starts} s JOIN cal_days d ON d.date=CAST(s.start_date AS DATE)")
    view(f"{pre}_spine", f"""SELECT k.entity, d.p, bool_or(e.e < d.p AND d.p <= e.e+{occ}) AS occ, min(CASE WHEN e.e>=d.p AND e.e-d.p<={lead} THEN e.e END) AS nxt
FROM (SELECT DISTINCT entity FROM prices) k JOIN cal_days d ON true LEFT JOIN {pre}_e e ON e.entity=k.entity AND e.e BETWEEN d.p-{occ} AND d.p+{lead}
WHERE d.p>={warm} AND d.p<=(SELECT max(p) FROM cal_days)-{lead} GROUP BY 1,2""")
    view(f"{pre}_base", f"SELECT count(*) FILTER (WHERE NOT coalesce(occ,false) AND nxt IS NOT NULL)::DOUBLE/count(*) FILTER (WHERE NOT coalesce(occ,false)) AS b FROM {pre}_spine")


_judge_views("amb", "ambush_starts", 15, 15)
_judge_views("topj", "top_starts", 10, 15)


def _eval_sql(trig, pre, by="job"):
    return f"""SELECT {by}, count(*) AS n_triggers, count(nxt) AS hits, count(*)-count(nxt) AS false_positives, round(count(nxt)/count(*),6) AS hit_rate,
  round(count(DISTINCT CASE WHEN nxt IS NOT NULL THEN (s.entity, nxt) END)/(SELECT count(*) FROM {pre}_e),6) AS recall, round(count(nxt)/count(*)/(SELECT b FROM {pre}_base),6) AS lift,
  (list_sort(list(nxt-s.p) FILTER (WHERE nxt IS NOT NULL)))[count(nxt)//2+1] AS median_lead_days
FROM {trig} t JOIN cal_days d USING (date) JOIN {pre}_spine s ON s.entity=t.entity AND s.p=d.p WHERE NOT coalesce(occ,false) GROUP BY {by}"""


def _eval_out(df, by=("job",)):
    return df.select(*by, "n_triggers", "hits", "false_positives", r6("hit_rate").alias("hit_rate"), r6("recall").alias("recall"), r6("lift").alias("lift"),
                     F.col("median_lead_days").cast("bigint").alias("median_lead_days"))


def judge_of(t, kind, lead, occ=15, warm=30):
    return E.Judge(episodes_of(t, kind), W.numbered_days(t.prices), t.prices.select("entity").distinct(), "entity", lead, occ, warm)


def triggers_of(t, name, jobs):
    return staged(t.spark, t.root, name, lambda: E.fired_jobs(spanel_of(t), "entity", {k: F.expr(v) for k, v in jobs.items()}))


@query("cal04_crossing_triggers", "SELECT entity, strftime(date,'%Y-%m-%d') AS date, job FROM scan_trig")
def cal04(t):
    return triggers_of(t, "scan_trig", entity_jobs()).select("entity", iso("date").alias("date"), "job")


@query("cal05_base_rate", "SELECT round(b,9) AS base_rate, (SELECT count(*) FROM amb_spine WHERE NOT coalesce(occ,false)) AS n_eligible FROM amb_base")
def cal05(t):
    return judge_of(t, "ambush", 15).base.select(r6("base_rate", 9).alias("base_rate"), F.col("n_eligible").cast("bigint").alias("n_eligible"))


@query("cal06_trigger_outcomes", "SELECT t.entity, strftime(t.date,'%Y-%m-%d') AS date, job, (nxt IS NOT NULL)::INT AS hit, CAST(nxt-s.p AS BIGINT) AS dist FROM scan_trig t JOIN cal_days d USING (date) "
       "JOIN amb_spine s ON s.entity=t.entity AND s.p=d.p WHERE NOT coalesce(occ,false)")
def cal06(t):
    o = judge_of(t, "ambush", 15).outcomes(triggers_of(t, "scan_trig", entity_jobs()))
    return o.select("entity", iso("date").alias("date"), "job", F.col("hit").cast("int").alias("hit"), F.col("dist").cast("bigint").alias("dist"))


@query("cal07_signal_scan", _eval_sql("scan_trig", "amb"))
def cal07(t):
    return _eval_out(judge_of(t, "ambush", 15).evaluate(triggers_of(t, "scan_trig", entity_jobs())))


@query("cal08_top_signal_scan", _eval_sql("top_trig", "topj"))
def cal08(t):
    return _eval_out(judge_of(t, "top", 10).evaluate(triggers_of(t, "top_trig", top_jobs())))


view("quad", """
SELECT b.*, m.market_index, m.m20 FROM (SELECT grp, date, net_flow_20d, members, bl, lead(basket_index,10) OVER w/basket_index-1 AS f10, lead(basket_index,20) OVER w/basket_index-1 AS f20,
    CASE WHEN net_flow_20d>0 AND NOT bl>10 THEN '下一棒' WHEN net_flow_20d>0 THEN '主升續勢' WHEN bl>10 THEN '出貨警訊' ELSE '退潮觀察' END AS quadrant
  FROM (SELECT b.grp, b.date, basket_index, g.net_flow_20d, g.members, (basket_index/lo-1)*100 AS bl FROM (SELECT *, CASE WHEN count(*) OVER w60>=60 THEN min(basket_index) OVER w60 END AS lo FROM baskets
      WINDOW w60 AS (PARTITION BY grp ORDER BY date ROWS 59 PRECEDING)) b JOIN gflows g USING (grp, date) WHERE lo IS NOT NULL AND g.members>=3)
  WINDOW w AS (PARTITION BY grp ORDER BY date)) b
LEFT JOIN (SELECT date, market_index, lead(market_index,20) OVER (ORDER BY date)/market_index-1 AS m20 FROM mkt_index) m USING (date)
""")


@query("cal09_quadrants", """
SELECT quadrant, count(*) AS n, round(median(f10)*100,6)+0.0 AS fwd10_med_pct, round(median(f20)*100,6)+0.0 AS fwd20_med_pct, round(avg((f20>0)::INT)*100,6) AS win20_pct,
  round(avg((f20>=0.1)::INT)*100,6) AS hit10_20d_pct, round(median(f20-m20)*100,6)+0.0 AS excess20_med_pct, round(avg((f20>m20)::INT)*100,6) AS beat_mkt20_pct
FROM quad WHERE f20 IS NOT NULL GROUP BY 1""")
def cal09(t):
    from pyspark.sql import Window

    from tidewater.operators.momentum import basket_position

    w = own_rows("grp")
    pos = basket_position(baskets_of(t), 60, 60).where(F.col("above_low_pct").isNotNull())
    p = pos.join(gflows_of(t).select("grp", "date", "members", "net_flow_20d"), ["grp", "date"]).where(F.col("members") >= 3)
    p = p.withColumns({f"f{n}": F.lead("basket_index", n).over(w) / F.col("basket_index") - 1 for n in (10, 20)})
    m = index_of(t).select("date", (F.lead("market_index", 20).over(Window.orderBy("date")) / F.col("market_index") - 1).alias("m20"))
    p = p.withColumn("quadrant", W.quadrant(F.col("net_flow_20d"), F.col("above_low_pct"), 10.0)).join(F.broadcast(m), "date", "left")
    p = p.where(F.col("f20").isNotNull()).withColumn("x20", F.col("f20") - F.col("m20"))
    g = p.groupBy("quadrant").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("f20") > 0).cast("double")) * 100).alias("win20_pct"),
        r6(F.avg((F.col("f20") >= 0.1).cast("double")) * 100).alias("hit10_20d_pct"), r6(F.avg((F.col("f20") > F.col("m20")).cast("double")) * 100).alias("beat_mkt20_pct"))
    for v, o in (("f10", "fwd10_med_pct"), ("f20", "fwd20_med_pct"), ("x20", "excess20_med_pct")):
        g = g.join(exact_quantiles(p, ["quadrant"], v, {o: 0.5}).withColumn(o, r6(F.col(o) * 100)), "quadrant")
    return g


_PAIRS = [(f"{W.FLOW[x]}_5d_z", f"{W.FLOW[x]}_20d_z") for x in W.NETS]


@query("cal10_cross_window_lead", " UNION ALL ".join(f"""
SELECT '{s}' AS short_signal, '{g}' AS long_signal, count(s) AS n_short_fired, count(CASE WHEN s IS NOT NULL THEN l-s END) AS n_paired, count(*) FILTER (WHERE s IS NOT NULL AND l IS NULL) AS short_only,
  round(coalesce(count(*) FILTER (WHERE l-s>0)/nullif(count(l-s),0),0),6) AS pct_short_leads, round(coalesce(count(*) FILTER (WHERE l-s>=2)/nullif(count(l-s),0),0),6) AS pct_lead_ge,
  CAST((list_sort(list(l-s) FILTER (WHERE l-s IS NOT NULL)))[count(l-s)//2+1] AS BIGINT) AS median_lead_days
FROM (SELECT e.entity, e.e, min(CASE WHEN {s}>=1 THEN d.p END) AS s, min(CASE WHEN {g}>=1 THEN d.p END) AS l FROM amb_e e JOIN spanel_m x ON x.entity=e.entity JOIN cal_days d ON d.date=x.date AND d.p>=e.e-30 AND d.p<e.e GROUP BY 1,2)
HAVING count(s)>0""" for s, g in _PAIRS))
def cal10(t):
    d = E.cross_window_lead(spanel_of(t), episodes_of(t, "ambush"), W.numbered_days(t.prices), _PAIRS)
    return d.select("short_signal", "long_signal", "n_short_fired", "n_paired", "short_only", r6("pct_short_leads").alias("pct_short_leads"),
                    r6("pct_lead_ge").alias("pct_lead_ge"), F.col("median_lead_days").cast("bigint").alias("median_lead_days"))


view("fwd_same", "SELECT entity, date, " + ", ".join(f"(lead(close,{h}) OVER w/close-1)*100 AS fwd{h}" for h in (5, 10, 20, 40)) + " FROM prices WINDOW w AS (PARTITION BY entity ORDER BY date)")


@query("cal11_payoff_decay", " UNION ALL ".join(f"""
SELECT job, {h} AS horizon_d, count(v) AS n, round(avg(v),6)+0.0 AS mean_ret_pct, round(median(v),6)+0.0 AS median_ret_pct, round(avg((v>0)::INT),6) AS win_rate, round(avg(v) FILTER (WHERE v>0),6) AS avg_win_pct,
  round(avg(v) FILTER (WHERE v<0),6) AS avg_loss_pct, round((avg(v) FILTER (WHERE v>0))/abs(avg(v) FILTER (WHERE v<0)),6) AS payoff_ratio, round(median(v)-(SELECT median(fwd{h}) FROM fwd_same),6)+0.0 AS excess_median_pct
FROM (SELECT job, fwd{h} AS v FROM scan_trig JOIN fwd_same USING (entity, date)) WHERE v IS NOT NULL GROUP BY job""" for h in (5, 10, 20, 40)))
def cal11(t):
    d = E.payoff_table(triggers_of(t, "scan_trig", entity_jobs()), spanel_of(t))
    return d.select("job", "horizon_d", "n", *[r6(x).alias(x) for x in ("mean_ret_pct", "median_ret_pct", "win_rate", "avg_win_pct", "avg_loss_pct", "payoff_ratio", "excess_median_pct")])


view("adv", "SELECT entity, date, avg(close*volume) OVER (PARTITION BY entity ORDER BY date ROWS 19 PRECEDING) AS adv FROM prices")
view("hard_trig", "SELECT t.* FROM scan_trig t JOIN adv USING (entity, date) WHERE adv>=900000")


@query("cal13_liquidity", "SELECT job, r.n_triggers AS n_raw, r.lift AS lift_raw, h.n_triggers AS n_hardened, h.lift AS lift_hardened FROM ("
       + _eval_sql("scan_trig", "amb") + ") r LEFT JOIN (" + _eval_sql("hard_trig", "amb") + ") h USING (job)")
def cal13(t):
    from tidewater.functions.exprs import roll_avg

    j = judge_of(t, "ambush", 15)
    tr = triggers_of(t, "scan_trig", entity_jobs())
    adv = spanel_of(t).select("entity", "date", roll_avg(F.col("close") * F.col("volume"), own_rows(), 20, 1).alias("adv"))
    raw = j.evaluate(tr).select("job", F.col("n_triggers").alias("n_raw"), r6("lift").alias("lift_raw"))
    hard = j.evaluate(tr.join(adv.where(F.col("adv") >= 900000), ["entity", "date"], "left_semi"))
    return raw.join(hard.select("job", F.col("n_triggers").alias("n_hardened"), r6("lift").alias("lift_hardened")), "job", "left")


view("strata", """
SELECT s.entity, s.date, dom_20d AS v, fwd20, st FROM spanel_m s JOIN fwd_same USING (entity, date), unnest(['全體', CASE WHEN above_low_60d_pct<=3 THEN '貼低' WHEN above_low_60d_pct>3 THEN '非貼低' END]) AS u(st)
WHERE dom_20d IS NOT NULL AND st IS NOT NULL
""")
view("strata_b", "SELECT *, CAST((row_number() OVER (PARTITION BY st ORDER BY v, entity, date)-1)*5//count(*) OVER (PARTITION BY st)+1 AS INTEGER) AS bucket FROM strata")


def strata_of(t):
    low = F.col("above_low_60d_pct")
    st = F.explode(F.array_compact(F.array(F.lit("全體"), F.when(low <= 3, F.lit("貼低")).when(low > 3, F.lit("非貼低")))))
    p = spanel_of(t).where(F.col("dom_20d").isNotNull())
    return p.select("entity", "date", F.col("dom_20d").alias("v"), st.alias("st")).join(E.forward_same_day(spanel_of(t), (20,)), ["entity", "date"])


@query("cal14_factor_monotonicity", """
SELECT c.*, e.n_eval, e.hits, round(e.hits/e.n_eval,6) AS hit_rate, round(e.hits/e.n_eval/(SELECT b FROM amb_base),6) AS lift FROM (
  SELECT st, bucket, count(*) AS n_stock_days, round(min(v),6)+0.0 AS factor_min, round(median(v),6)+0.0 AS factor_median, round(max(v),6)+0.0 AS factor_max, round(median(fwd20),6)+0.0 AS median_fwd_ret_pct FROM strata_b GROUP BY 1,2) c
LEFT JOIN (SELECT st, bucket, count(*) AS n_eval, count(nxt) AS hits FROM strata_b b JOIN cal_days d USING (date) JOIN amb_spine s ON s.entity=b.entity AND s.p=d.p WHERE NOT coalesce(occ,false) GROUP BY 1,2) e USING (st, bucket)""")
def cal14(t):
    d = staged(t.spark, t.root, "strata", lambda: E.pooled_buckets(strata_of(t), ["st"], "v", ["entity", "date"], 5))
    k = ["st", "bucket"]
    g = d.groupBy(*k).agg(F.count(F.lit(1)).alias("n_stock_days"), r6(F.min("v")).alias("factor_min"), r6(F.max("v")).alias("factor_max"))
    for v, o in (("v", "factor_median"), ("fwd20", "median_fwd_ret_pct")):
        g = g.join(exact_quantiles(d, k, v, {o: 0.5}).withColumn(o, r6(o)), k, "left")
    ev = judge_of(t, "ambush", 15).evaluate(d.select("entity", "date", *k), k)
    return g.join(ev.select(*k, F.col("n_triggers").alias("n_eval"), "hits", r6("hit_rate").alias("hit_rate"), r6("lift").alias("lift")), k, "left")


@query("cal14_spearman_by_stratum", """
SELECT st, count(*) AS n, round(corr(rx,ry),6)+0.0 AS rho, round(corr(rx,ry)*sqrt(count(*)-1),6)+0.0 AS z FROM (
  SELECT st, rank() OVER (PARTITION BY st ORDER BY v)+(count(*) OVER (PARTITION BY st, v)-1)/2.0::DOUBLE AS rx, rank() OVER (PARTITION BY st ORDER BY fwd20)+(count(*) OVER (PARTITION BY st, fwd20)-1)/2.0::DOUBLE AS ry
  FROM strata WHERE fwd20 IS NOT NULL) GROUP BY 1""")
def cal14b(t):
    s = S.spearman(strata_of(t), ["st"], "v", "fwd20")
    return s.select("st", "n", r6("ic").alias("rho"), r6(F.col("ic") * F.sqrt(F.col("n") - 1)).alias("z"))


view("inter", "SELECT entity, date, foreign_flow_20d_z>0.5 AND above_low_60d_pct<=3 AS s, rs_subind_20d>0 AS g FROM spanel_m WHERE foreign_flow_20d_z IS NOT NULL AND above_low_60d_pct IS NOT NULL AND rs_subind_20d IS NOT NULL")
view("inter_c", "SELECT i.s, i.g, count(*) AS n, count(nxt) AS h FROM inter i JOIN cal_days d USING (date) JOIN amb_spine x ON x.entity=i.entity AND x.p=d.p WHERE NOT coalesce(occ,false) GROUP BY 1,2")


@query("cal15_interaction_2x2", """
SELECT 'S'||CASE WHEN s THEN '+' ELSE '−' END||'G'||CASE WHEN g THEN '+' ELSE '−' END AS cell, n AS n_eval, h AS hits, round(h/n,6) AS hit_rate, round(h/n/(SELECT b FROM amb_base),6) AS lift,
  round((h/n-oh/os)/nullif(sqrt((h+oh)/(n+os)*(1-(h+oh)/(n+os))*(1/n+1/os)),0),6)+0.0 AS z_vs_rest
FROM (SELECT *, sum(n) OVER ()-n AS os, sum(h) OVER ()-h AS oh FROM (SELECT s, g, n::DOUBLE AS n, h::DOUBLE AS h FROM inter_c))""")
def cal15(t):
    p = spanel_of(t).dropna(subset=["foreign_flow_20d_z", "above_low_60d_pct", "rs_subind_20d"])
    s = (F.col("foreign_flow_20d_z") > 0.5) & (F.col("above_low_60d_pct") <= 3)
    g = F.col("rs_subind_20d") > 0
    cell = F.concat(F.lit("S"), F.when(s, "+").otherwise("−"), F.lit("G"), F.when(g, "+").otherwise("−"))
    ev = judge_of(t, "ambush", 15).evaluate(p.select("entity", "date", cell.alias("cell")), ["cell"])
    tot = ev.agg(F.sum("n_triggers").alias("_n"), F.sum("hits").alias("_h"))
    ev = with_scalar(ev, tot)
    n, h = F.col("n_triggers"), F.col("hits")
    z = E.two_prop_z(h, n, F.col("_h") - h, F.col("_n") - n)
    return ev.select("cell", n.cast("double").alias("n_eval"), h.cast("double").alias("hits"), r6("hit_rate").alias("hit_rate"), r6("lift").alias("lift"), r6(z).alias("z_vs_rest"))


view("lag_trig", """
SELECT entity, date, u.job FROM (SELECT entity, date, rs_subind_20d, coalesce(foreign_flow_20d_z>0.5 AND above_low_60d_pct<=3,false) AS h, lag(coalesce(foreign_flow_20d_z>0.5 AND above_low_60d_pct<=3,false),1,false) OVER (PARTITION BY entity ORDER BY date) AS p FROM spanel_m),
unnest(['S+全體', CASE WHEN rs_subind_20d<0 THEN 'S+且落後' WHEN rs_subind_20d>=0 THEN 'S+且領先' END]) AS u(job) WHERE h AND NOT p AND u.job IS NOT NULL
""")


@query("cal16_laggard_precision", _eval_sql("lag_trig", "amb"))
def cal16(t):
    p = spanel_of(t)
    tr = E.fired_jobs(p, "entity", {"s": (F.col("foreign_flow_20d_z") > 0.5) & (F.col("above_low_60d_pct") <= 3)}).drop("job")
    rs = F.col("rs_subind_20d")
    tags = F.explode(F.array_compact(F.array(F.lit("S+全體"), F.when(rs < 0, F.lit("S+且落後")).when(rs >= 0, F.lit("S+且領先")))))
    tr = tr.join(p.select("entity", "date", "rs_subind_20d"), ["entity", "date"]).select("entity", "date", tags.alias("job"))
    return _eval_out(judge_of(t, "ambush", 15).evaluate(tr))
