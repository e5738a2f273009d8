"""Holdouts, regime slices, candidates, panel audits, history appends and streams."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions.exprs import iso, own_rows, r6, week_tag, with_scalar
from tidewater.operators import candidates as D
from tidewater.operators import episodes as E
from tidewater.operators import features as X
from tidewater.operators import flows as W
from tidewater.operators import outcome as O
from tidewater.operators import panel as P
from tidewater.operators import stats as S
from tidewater.operators import valuation as V
from tidewater.operators.asof import roll_forward
from tidewater.operators.resample import block_bootstrap
from tidewater.plans.episode_plans import entity_jobs, episodes_of, judge_of, latest_of, spanel_of, triggers_of
from tidewater.plans.flow_plans import rotation_of
from tidewater.plans.outcome_plans import picks_of
from tidewater.plans.panel_plans import panel_of, tr_targets
from tidewater.plans.regime_plans import regime_of
from tidewater.plans.registry import query, view
from tidewater.plans.stats_plans import boot_views
from tidewater.plans.fair_value_plans import fair_value_panel
from tidewater.plans.valuation_plans import MINP, latest_ratios
from tidewater.sources.staging import cut as staging_cut
from tidewater.sources.staging import stage_dir
from tidewater.streaming import forms as T

# ------------------------------------------------------------- calibration holdout and slices

view("cut70", "SELECT max(date) AS d FROM (SELECT date, p FROM cal_days) WHERE p=CAST(floor((SELECT count(*) FROM cal_days)*0.7::DOUBLE) AS BIGINT)")
for _s, _op in (("tr", "<"), ("te", ">=")):
    view(f"hd_{_s}", f"SELECT date, row_number() OVER (ORDER BY date)-1 AS p FROM (SELECT date FROM cal_days WHERE date{_op}(SELECT d FROM cut70))")
    view(f"hs_{_s}", f"SELECT * FROM ambush_starts WHERE CAST(start_date AS DATE){_op}(SELECT d FROM cut70)")
    view(f"hdt_{_s}", f"SELECT entity, date, job FROM hold_trig WHERE date{_op}(SELECT d FROM cut70)")
    view(f"hk_{_s}", f"SELECT DISTINCT entity FROM prices WHERE date{_op}(SELECT d FROM cut70)")
    view(f"he_{_s}", f"SELECT s.entity, d.p AS e FROM hs_{_s} s JOIN hd_{_s} d ON d.date=CAST(s.start_date AS DATE)")
    view(f"hsp_{_s}", f"""SELECT k.entity, d.p, bool_or(e.e < d.p AND d.p <= e.e+15) AS occ, min(CASE WHEN e.e>=d.p AND e.e-d.p<=15 THEN e.e END) AS nxt FROM hk_{_s} k JOIN hd_{_s} d ON true
LEFT JOIN he_{_s} e ON e.entity=k.entity AND e.e BETWEEN d.p-15 AND d.p+15 WHERE d.p>=30 AND d.p<=(SELECT max(p) FROM hd_{_s})-15 GROUP BY 1,2""")
    view(f"hb_{_s}", f"SELECT count(*) FILTER (WHERE NOT coalesce(occ,false) AND nxt IS NOT NULL)::DOUBLE/count(*) FILTER (WHERE NOT coalesce(occ,false)) AS b FROM hsp_{_s}")
    view(f"hv_{_s}", f"SELECT job, count(*) AS n, count(nxt)/count(*)/(SELECT b FROM hb_{_s}) AS lift FROM hdt_{_s} t JOIN hd_{_s} d USING (date) JOIN hsp_{_s} s ON s.entity=t.entity AND s.p=d.p WHERE NOT coalesce(occ,false) GROUP BY 1")
_HJ = entity_jobs()
view("hold_trig", " UNION ALL ".join(
    f"SELECT entity, date, '{n}' AS job FROM (SELECT entity, date, coalesce({c},false) AS h, lag(coalesce({c},false),1,false) OVER (PARTITION BY entity, date>=(SELECT d FROM cut70) ORDER BY date) AS p FROM spanel_m) WHERE h AND NOT p" for n, c in _HJ.items()))


@query("cal12_holdout", "SELECT job, a.n AS n_train, round(a.lift,6) AS lift_train, coalesce(b.n,0) AS n_test, round(b.lift,6) AS lift_test FROM hv_tr a LEFT JOIN hv_te b USING (job)")
def cal12(t):
    """The scan before and after the 70% date, each against its own base rate."""
    cal = W.numbered_days(t.prices)
    at = cal.agg((F.floor(F.count(F.lit(1)) * 0.7)).alias("_k"))
    cut = with_scalar(cal, at).where(F.col("idx") == F.col("_k")).select(F.col("date").alias("_cut"))
    out = None
    for name, later in (("train", False), ("test", True)):
        def side(df, col="date"):
            d = with_scalar(df, cut)
            return d.where((F.col(col) >= F.col("_cut")) if later else (F.col(col) < F.col("_cut"))).drop("_cut")

        days = W.numbered_days(side(t.prices.select("date").distinct()))
        j = E.Judge(side(episodes_of(t, "ambush"), "start_date"), days, side(t.prices.select("entity", "date")).select("entity").distinct(), "entity", 15, 15, 30)
        tr = E.fired_jobs(side(spanel_of(t)), "entity", {k: F.expr(v) for k, v in _HJ.items()})
        r = j.evaluate(tr).select("job", F.col("n_triggers").alias(f"n_{name}"), r6("lift").alias(f"lift_{name}"))
        out = r if out is None else out.join(r, "job", "left")
    return out.withColumn("n_test", F.coalesce("n_test", F.lit(0)))


view("rs_o", "SELECT t.entity, t.date, (nxt IS NOT NULL)::INT::DOUBLE AS hit, coalesce(r.regime_label,'未標') AS label FROM scan_trig t JOIN cal_days d USING (date) JOIN amb_spine s ON s.entity=t.entity AND s.p=d.p LEFT JOIN regime r ON r.date=t.date WHERE t.job='net_flow_20d_z (z>1.0)' AND NOT coalesce(occ,false)")
view("rs_d", "SELECT label, date, avg(hit) AS v FROM rs_o GROUP BY 1,2")
boot_views("rsb", "rs_d", ["label"], "16")
view("rs_base", "SELECT coalesce(r.regime_label,'未標') AS label, count(*) FILTER (WHERE nxt IS NOT NULL)::DOUBLE/count(*) AS b FROM amb_spine s JOIN cal_days d USING (p) LEFT JOIN regime r ON r.date=d.date WHERE NOT coalesce(occ,false) GROUP BY 1")


@query("cal17_regime_slices", "SELECT c.label AS regime, (SELECT count(*) FROM rs_o o WHERE o.label=c.label) AS n_events, c.n_obs AS n_dates, round(c.mean,6) AS hit_rate, round(b.b,6) AS base_rate, round(c.mean/b.b,6) AS lift, round(c.ci_lo/b.b,6) AS ci_lo, round(c.ci_hi/b.b,6) AS ci_hi FROM rsb_ci c JOIN rs_base b USING (label)")
def cal17(t):
    j = judge_of(t, "ambush", 15)
    lab = regime_of(t).select("date", F.col("regime_label").alias("label"))
    o = j.outcomes(triggers_of(t, "scan_trig", entity_jobs()).where(F.col("job") == "net_flow_20d_z (z>1.0)"))
    o = o.join(F.broadcast(lab), "date", "left").withColumn("label", F.coalesce("label", F.lit("未標")))
    d = o.groupBy("label", "date").agg(F.avg(F.col("hit").cast("double")).alias("v"))
    n = o.groupBy("label").agg(F.count(F.lit(1)).alias("n_events"))
    x = block_bootstrap(d, ["label"], "date", "v", 16).join(n, "label").join(j.base_by(lab), "label")
    b = F.col("base_rate")
    return x.select(F.col("label").alias("regime"), "n_events", F.col("n_obs").alias("n_dates"), r6("mean").alias("hit_rate"), r6(b).alias("base_rate"), r6(F.col("mean") / b).alias("lift"), r6(F.col("ci_lo") / b).alias("ci_lo"), r6(F.col("ci_hi") / b).alias("ci_hi"))


# fixed values: the labels that a verdict across regimes looks at
_QUALIFIED = ("進攻", "中性", "防禦")
_MIN_TRIGGERS, _MIN_LIFT, _MIN_EVENTS = 8, 1.3, 30
view("rs_sel", f"SELECT job FROM (SELECT t.job, count(*) AS n, count(nxt)/count(*)/(SELECT b FROM amb_base) AS lift FROM scan_trig t JOIN cal_days d USING (date) JOIN amb_spine s ON s.entity=t.entity AND s.p=d.p WHERE NOT coalesce(occ,false) GROUP BY 1) WHERE n>={_MIN_TRIGGERS} AND round(lift,9)>={_MIN_LIFT}")
view("rsa_o", "SELECT t.job, t.date, (nxt IS NOT NULL)::INT::DOUBLE AS hit, coalesce(r.regime_label,'未標') AS label FROM scan_trig t JOIN cal_days d USING (date) JOIN amb_spine s ON s.entity=t.entity AND s.p=d.p LEFT JOIN regime r ON r.date=t.date WHERE NOT coalesce(occ,false) AND t.job IN (SELECT job FROM rs_sel)")
view("rsa_d", "SELECT job, label, date, avg(hit) AS v FROM rsa_o GROUP BY 1,2,3")
boot_views("rsab", "rsa_d", ["job", "label"], "16")
view("rsa_t", "SELECT c.job, c.label, o.n_events, o.hits, c.n_obs, c.mean, b.b, o.hits/o.n_events/nullif(b.b,0) AS lift, c.ci_lo/nullif(b.b,0) AS lo, c.ci_hi/nullif(b.b,0) AS hi FROM rsab_ci c JOIN (SELECT job, label, count(*) AS n_events, sum(hit) AS hits FROM rsa_o GROUP BY 1,2) o USING (job, label) JOIN rs_base b USING (label)")


@query("cal17_regime_slices_all", f"""
SELECT job, label AS regime, n_events, n_obs AS n_dates, round(hits/n_events,6) AS hit_rate, round(b,6) AS base_rate, round(lift,6) AS lift, round(lo,6) AS ci_lo, round(hi,6) AS ci_hi, up AS n_above, down AS n_below, CASE WHEN up>=2 THEN '跨 regime 穩健（lift>1 同向）' WHEN down>=2 THEN '跨 regime 穩健（lift<1 同向＝跨 regime 否證）' WHEN bull AND up=1 THEN 'bull-only' WHEN nq=0 THEN '樣本不足' WHEN up=1 THEN '單一 regime 有效' ELSE '無 regime 桶 lift>1（方向未成立）' END AS verdict FROM rsa_t JOIN (
  SELECT job, count(*) FILTER (WHERE q AND round(lift,9)>1) AS up, count(*) FILTER (WHERE q AND round(lift,9)<1) AS down, bool_or(q AND round(lift,9)>1 AND label='進攻') AS bull, count(*) FILTER (WHERE q) AS nq FROM (SELECT *, label IN {_QUALIFIED} AND n_events>={_MIN_EVENTS} AND lift IS NOT NULL AS q FROM rsa_t) GROUP BY 1) USING (job)""")
def cal17_all(t):
    """Every job of the scan with enough triggers and lift, by regime: hit rate of its events, lift against the regime's own base rate,
    interval over date means, and in how many regimes with enough events the lift is above and below one."""
    j = judge_of(t, "ambush", 15)
    lab = regime_of(t).select("date", F.col("regime_label").alias("label"))
    o = j.outcomes(triggers_of(t, "scan_trig", entity_jobs())).select("job", "date", "hit")
    s = with_scalar(o.groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("h")), j.base.select("base_rate"))
    jobs = s.where((F.col("n") >= _MIN_TRIGGERS) & (F.round(F.col("h") / F.nullif(F.col("base_rate"), F.lit(0.0)), 9) >= _MIN_LIFT)).select("job")
    o = o.join(F.broadcast(jobs), "job", "left_semi").join(F.broadcast(lab), "date", "left").withColumn("label", F.coalesce("label", F.lit("未標")))
    # One row a job, label and date: the only rows that the statistics read.
    d = staging_cut(o.groupBy("job", "label", "date").agg(F.avg(F.col("hit").cast("double")).alias("v"), F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("bigint")).alias("hits")))
    n = d.groupBy("job", "label").agg(F.sum("n").alias("n_events"), F.sum("hits").alias("hits"))
    x = block_bootstrap(d.select("job", "label", "date", "v"), ["job", "label"], "date", "v", 16).join(n, ["job", "label"]).join(j.base_by(lab), "label")
    b = F.nullif(F.col("base_rate"), F.lit(0.0))
    x = x.withColumn("lift", F.col("hits") / F.col("n_events") / b)
    w = Window.partitionBy("job")
    fit = F.col("label").isin(*_QUALIFIED) & (F.col("n_events") >= _MIN_EVENTS) & F.col("lift").isNotNull()
    side = lambda c: F.count(F.when(fit & c, 1)).over(w)
    above = F.round("lift", 9) > 1
    up, down = side(above), side(F.round("lift", 9) < 1)
    verdict = (
        F.when(up >= 2, "跨 regime 穩健（lift>1 同向）").when(down >= 2, "跨 regime 穩健（lift<1 同向＝跨 regime 否證）").when((up == 1) & (side(above & (F.col("label") == "進攻")) == 1), "bull-only")
        .when(side(F.lit(True)) == 0, "樣本不足").when(up == 1, "單一 regime 有效").otherwise("無 regime 桶 lift>1（方向未成立）"))
    return x.select(
        "job", F.col("label").alias("regime"), "n_events", F.col("n_obs").alias("n_dates"), r6(F.col("hits") / F.col("n_events")).alias("hit_rate"), r6("base_rate").alias("base_rate"), r6("lift").alias("lift"),
        r6(F.col("ci_lo") / b).alias("ci_lo"), r6(F.col("ci_hi") / b).alias("ci_hi"), up.alias("n_above"), down.alias("n_below"), verdict.alias("verdict"))


# ------------------------------------------------------------- candidates

_RULES = [("net20", "ambush", "net_flow_20d_z", 0.3, "low"), ("for5", "breakout", "foreign_flow_5d_z", 0.3, "foreign_momentum_5d>0"), ("tru20", "reversal", "trust_flow_20d_z", 0.3, "above_high_60d_pct<=-5"), ("net5", "ambush", "net_flow_5d_z", 0.3, "")]
view("snap", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS bk FROM spanel_m) WHERE bk=1")
_room = "greatest(least(1-above_low_60d_pct/60,1.0::DOUBLE),0.0::DOUBLE)"
view("cand_h", " UNION ALL ".join(
    f"SELECT entity, {i} AS o, '{n}' AS name, '{lb}' AS label, {z} AS z, round(round({z}*{_room},9),3)+0.0 AS score FROM snap WHERE {z}>{th}" + (" AND above_low_60d_pct<=5" if ex == "low" else f" AND {ex}" if ex else "")
    for i, (n, lb, z, th, ex) in enumerate(_RULES)))
view("cand", """
SELECT entity, label AS primary_label, rules, score AS cp_score, round(round(z,9),2)+0.0 AS flow_z FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC NULLS LAST, round(round(z,9),2) DESC, entity) AS k FROM (
  SELECT *, string_agg(name,'/' ORDER BY o) OVER (PARTITION BY entity ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rules, row_number() OVER (PARTITION BY entity ORDER BY score DESC NULLS LAST, o) AS b FROM cand_h) WHERE b=1) WHERE k<=40
""")


def cand_of(t):
    return D.rule_candidates(latest_of(t), _RULES, 5.0, 60.0, 40)


_FULL = [
    {"name": "net20_low", "label": "ambush", "flow_z_col": "net_flow_20d_z", "z_threshold": 0.3, "modifier": "low"},
    {"name": "for5_mom", "label": "breakout", "flow_z_col": "foreign_flow_5d_z", "z_threshold": 0.3, "modifier": "mom", "mom": "foreign_momentum_5d"},
    {"name": "tru20_rev", "label": "reversal", "flow_z_col": "trust_flow_20d_z", "z_threshold": 0.0, "modifier": "none", "require_confirm": False},
    {"name": "net5_rev", "label": "reversal", "flow_z_col": "net_flow_5d_z", "z_threshold": 0.0, "modifier": "none"},
    {"name": "net5", "label": "ambush", "flow_z_col": "net_flow_5d_z", "z_threshold": 0.5, "modifier": "none"},
]
_FULL_LOW, _FULL_DROP, _FULL_BOOST, _FULL_LAG = 5.0, 5.0, 0.1, 0.0


def _full_sql(i, r):
    cond = [f"{r['flow_z_col']}>{r['z_threshold']}"]
    cond += [f"above_low_60d_pct<={_FULL_LOW}"] if r["modifier"] == "low" else [f"{r['mom']}>0"] if r["modifier"] == "mom" else []
    cond += [f"above_high_60d_pct<=-{_FULL_DROP}"] if r["label"] == "reversal" else []
    cond += ["coalesce(confirm_buy,false)"] if r["label"] == "reversal" and r.get("require_confirm", True) else []
    return f"SELECT s.entity, s.date, {i} AS o, '{r['name']}' AS name, '{r['label']}' AS label, '{D.LABELS[r['label']]}' AS shown, '{r['flow_z_col']}' AS col, {r['flow_z_col']} AS z, round(round({r['flow_z_col']}*{_room},9),3)+0.0 AS score, flow_momentum_20d AS mom, above_low_60d_pct AS lo, above_high_60d_pct AS hi, rs_subind_20d AS rs, coalesce(confirm_buy,false) AS confirm_buy FROM snap s LEFT JOIN confirm USING (entity) WHERE " + " AND ".join(cond)


view("full_h", " UNION ALL ".join(_full_sql(i, r) for i, r in enumerate(_FULL)))
view("full_l", "SELECT entity, string_agg(shown,'/' ORDER BY o) AS labels FROM (SELECT entity, shown, min(o) AS o FROM full_h GROUP BY 1,2) GROUP BY 1")
view("full_r", "SELECT entity, string_agg(name,'/' ORDER BY o) AS rules FROM full_h GROUP BY 1")
view("full_b", f"SELECT *, coalesce(score IS NOT NULL AND rs<{_FULL_LAG} AND label='ambush', false) AS boosted FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC NULLS LAST, o) AS k FROM full_h) WHERE k=1")


@query("cal18_candidate_table", f"""
SELECT entity, strftime(date,'%Y-%m-%d') AS date, label AS primary_label, shown AS primary_name, labels, rules, cp_score, col AS flow_z_col, flow_z, freshness, above_low_pct, above_high_pct, confirm_buy::INT AS confirm_buy, rs_subind, boosted::INT AS cp_boosted FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY cp_score DESC NULLS LAST, flow_z DESC NULLS LAST, entity) AS kk FROM (SELECT b.*, l.labels, r.rules, CASE WHEN boosted THEN round(round(score*{1 + _FULL_BOOST}::DOUBLE,9),3)+0.0 ELSE score END AS cp_score, round(round(z,9),2)+0.0 AS flow_z,
    CASE WHEN coalesce(mom,0)>0 THEN '加速' WHEN coalesce(mom,0)<0 THEN '放緩' END AS freshness, round(round(lo,9),1)+0.0 AS above_low_pct, round(round(hi,9),1)+0.0 AS above_high_pct, round(round(rs,9),2)+0.0 AS rs_subind
    FROM full_b b JOIN full_l l USING (entity) JOIN full_r r USING (entity))) WHERE kk<=40""")
def cal18_full(t):
    """Candidates with the laggard boost, the drop from the high and the confirmed purchase."""
    confirm = W.recent_buy_confirm(t.prices, t.flows)
    d = D.candidate_table(latest_of(t), confirm, _FULL, _FULL_LOW, _FULL_DROP, 60.0, 40, ("ambush",), _FULL_BOOST, _FULL_LAG)
    return d.withColumns({"date": iso("date"), "confirm_buy": F.col("confirm_buy").cast("int"), "cp_boosted": F.col("cp_boosted").cast("int")})


@query("cal18_rule_candidates", "SELECT * FROM cand")
def cal18(t):
    return cand_of(t).select("entity", "primary_label", "rules", "cp_score", "flow_z")


@query("cal19_overlays", """
SELECT c.entity, coalesce(q.s,'未標次產業') AS subind_quadrant, CASE WHEN v.val_pctile IS NULL THEN '估值缺' WHEN v.val_pctile<=30 THEN '✓三重' ELSE '—' END AS triple_filter,
  concat_ws('/', CASE WHEN c.entity IN (SELECT s_suppkey FROM supplier WHERE s_acctbal>8500) THEN '庫存' END, CASE WHEN c.entity IN (SELECT s_suppkey FROM supplier WHERE s_acctbal<1500) THEN '觀察' END, CASE WHEN c.entity IN (SELECT entity FROM picks WHERE week=(SELECT max(week) FROM picks)) THEN '本週命中' END) AS watch_status
FROM cand c LEFT JOIN valtab v USING (entity) LEFT JOIN (SELECT m.entity, string_agg(m.grp||'('||CASE WHEN r.grp IS NULL THEN '榜外' ELSE coalesce(r.quadrant,'None') END||')','; ' ORDER BY m.grp) AS s FROM membership m LEFT JOIN rotation r USING (grp) GROUP BY 1) q ON q.entity=c.entity""")
def cal19(t):
    s = t.raw("supplier").select(F.col("s_suppkey").alias("entity"), "s_acctbal")
    p = picks_of(t)
    now = with_scalar(p, p.agg(F.max("week").alias("_w"))).where(F.col("week") == F.col("_w"))
    c = D.quadrant_text(cand_of(t).select("entity"), t.membership, rotation_of(t))
    v = V.build_valuation(latest_ratios(t), t.membership, t.broad, (), MINP).select("entity", "val_pctile")
    c = c.join(v, "entity", "left").withColumn("triple_filter", D.triple_filter(F.col("val_pctile"))).drop("val_pctile")
    return D.status_tags(c, s.where("s_acctbal > 8500"), s.where("s_acctbal < 1500"), now)


_EP2 = [("foreign_flow_5d_z", "foreign_flow_20d_z"), ("net_flow_5d_z", "net_flow_20d_z")]


@query("cal20_early_inflow", """
SELECT entity, sig AS early_signal, round(round(z,9),2)+0.0 AS short_z, round(round(lz,9),2)+0.0 AS long_z FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY z DESC) AS k FROM (
  SELECT entity, 'foreign_flow_5d_z' AS sig, foreign_flow_5d_z AS z, foreign_flow_20d_z AS lz, flow_decel FROM snap UNION ALL SELECT entity, 'net_flow_5d_z', net_flow_5d_z, net_flow_20d_z, flow_decel FROM snap) WHERE z>0.5 AND lz<0.8 AND flow_decel>=0) WHERE k=1""")
def cal20(t):
    return D.early_inflow(latest_of(t), _EP2, 0.5, 0.8)


@query("cal20_overheat", "SELECT entity, round(round(above_high_60d_pct,9),1)+0.0 AS above_high_pct, concat_ws('＋','短窗減速',CASE WHEN price_flow_div_5d>0 THEN '量價背離' END,CASE WHEN volume_z_5d<0 THEN '量縮' END) AS reasons FROM snap WHERE above_high_60d_pct>=-8 AND flow_decel<0 AND (price_flow_div_5d>0 OR volume_z_5d<0)")
def cal20b(t):
    return D.overheat(latest_of(t))


# ------------------------------------------------------------- panel audits


@query("pan10_window_audit", """
SELECT entity, strftime(date,'%Y-%m-%d') AS date, strftime(ed,'%Y-%m-%d') AS entry_date, ec AS entry_close, strftime(xd,'%Y-%m-%d') AS exit_date, xc AS exit_close, (SELECT count(*) FROM adj_al a WHERE a.entity=q.entity AND a.al>ed AND a.al<=xd) AS n_events, round((xc/ec-1)*100,6)+0.0 AS price_ret_pct
FROM (SELECT entity, date, lead(date,1) OVER w AS ed, lead(close,1) OVER w AS ec, lead(date,6) OVER w AS xd, lead(close,6) OVER w AS xc FROM prices WINDOW w AS (PARTITION BY entity ORDER BY date)) q WHERE xd IS NOT NULL""")
def pan10(t):
    """Entry, exit and the number of events inside the window of every start day: a difference of running counts, no join of windows and events."""
    w = own_rows()
    hit = roll_forward(t.dividends.select("entity", "ex_date"), t.prices, "entity", "ex_date", "date", "al").where("al is not null").groupBy("entity", F.col("al").alias("date")).agg(F.count(F.lit(1)).alias("c"))
    p = t.prices.select("entity", "date", "close").join(hit, ["entity", "date"], "left")
    p = p.withColumn("ev", F.sum(F.coalesce("c", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    q = p.select("entity", "date", *[F.lead(c, n).over(w).alias(f"{k}{c}") for k, n in (("e_", 1), ("x_", 6)) for c in ("date", "close", "ev")]).where("x_date is not null")
    return q.select(
        "entity", iso("date").alias("date"), iso("e_date").alias("entry_date"), F.col("e_close").alias("entry_close"), iso("x_date").alias("exit_date"), F.col("x_close").alias("exit_close"),
        (F.col("x_ev") - F.col("e_ev")).alias("n_events"), r6((F.col("x_close") / F.col("e_close") - 1) * 100).alias("price_ret_pct"))


view("adj_al", "SELECT entity, (SELECT min(date) FROM prices p WHERE p.entity=d.entity AND p.date>=d.ex_date) AS al FROM dividends d")


@query("pan14_basket_forward", """
SELECT grp, strftime(date,'%Y-%m-%d') AS date, count(r20) AS n_ret20, round(CASE WHEN count(r20)>=2 THEN avg(r20) END,6)+0.0 AS basket_r20, round(CASE WHEN count(r20)>=2 THEN avg(alpha20) END,6)+0.0 AS basket_alpha20 FROM membership JOIN panel0 USING (entity) GROUP BY grp, date""")
def pan14(t):
    j = t.membership.join(panel_of(t).select("entity", "date", "r20", "alpha20"), "entity")
    n = F.count("r20")
    return j.groupBy("grp", iso("date").alias("date")).agg(n.alias("n_ret20"), r6(F.when(n >= 2, F.avg("r20"))).alias("basket_r20"), r6(F.when(n >= 2, F.avg("alpha20"))).alias("basket_alpha20"))


@query("pan17_stock_weeks", "SELECT strftime(s.date,'%Y-%m-%d') AS date, s.entity, s.grp, round(s.ma60_dist_pct,6)+0.0 AS ma60_dist_pct, s.trend_score, s.regime, round(t.r20,6)+0.0 AS r20 FROM srows s JOIN tr_targets t ON t.date=s.date AND t.entity=s.entity")
def pan17(t):
    from tidewater.plans.cell_plans import srows_of

    return srows_of(t).join(tr_targets(t, (20,)), ["date", "entity"]).select(iso("date").alias("date"), "entity", "grp", r6("ma60_dist_pct").alias("ma60_dist_pct"), "trend_score", "regime", r6("r20").alias("r20"))


@query("pan18_null_causes", """
SELECT cause, count(*) AS n FROM (SELECT CASE WHEN t.r20 IS NOT NULL THEN 'known' WHEN x.c IS NULL THEN 'unmatured' WHEN t.bad_evt_20 THEN 'bad_event' ELSE 'other' END AS cause
FROM tr_targets t JOIN (SELECT date, entity, lead(close,21) OVER (PARTITION BY entity ORDER BY date) AS c FROM prices) x USING (date, entity)) GROUP BY 1""")
def pan18(t):
    m = t.prices.select("date", "entity", F.lead("close", 21).over(own_rows()).alias("c"))
    cause = F.when(F.col("r20").isNotNull(), "known").when(F.col("c").isNull(), "unmatured").when(F.col("bad_evt_20"), "bad_event").otherwise("other")
    return tr_targets(t, (20,)).join(m, ["date", "entity"]).groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


@query("pan19_week_tag", "SELECT isoyear(d)||'-W'||lpad(weekofyear(d)::VARCHAR,2,'0') AS week FROM (SELECT max(date) AS d FROM prices)")
def pan19(t):
    return t.prices.agg(F.max("date").alias("d")).select(week_tag("d").alias("week"))


# ------------------------------------------------------------- histories and studies


@query("reg08_history_append", "SELECT strftime(date,'%Y-%m-%d') AS as_of, regime_label FROM regime")
def reg08(t):
    """Appends the regime history twice; rows of a year replace, never double."""
    path = f"{stage_dir(t.spark)}/history-{uuid.uuid4().hex}"
    rows = regime_of(t).select(iso("date").alias("as_of"), "regime_label", F.year("date").alias("y"))
    O.upsert_partitions(rows, path, "y")
    O.upsert_partitions(rows.where(F.col("y") >= 1999), path, "y")
    return t.spark.read.schema(rows.schema).parquet(path).select("as_of", "regime_label")


view("cvd", "SELECT grp, strftime(date,'%Y-%m') AS m, date, avg(alpha20) AS v FROM membership JOIN panel0 USING (entity) WHERE alpha20 IS NOT NULL AND date IN (SELECT date FROM weekly) GROUP BY 1,2,3")
boot_views("cvb", "cvd", ["grp"], "5")


@query("sta22_series_ci", "SELECT grp, n_obs AS t, round(mean,6)+0.0 AS mean, round(ci_lo,6)+0.0 AS lo, round(ci_hi,6)+0.0 AS hi, coalesce(ci_lo>0 OR ci_hi<0,false)::INT AS excludes_zero FROM cvb_ci")
def sta22(t):
    d = t.membership.join(panel_of(t).where(F.col("alpha20").isNotNull()).join(F.broadcast(P.weekly_dates(t.prices).select("date")), "date", "left_semi"), "entity")
    s = block_bootstrap(d.groupBy("grp", "date").agg(F.avg("alpha20").alias("v")), ["grp"], "date", "v", 5)
    return s.select("grp", F.col("n_obs").alias("t"), r6("mean").alias("mean"), r6("ci_lo").alias("lo"), r6("ci_hi").alias("hi"), F.coalesce((F.col("ci_lo") > 0) | (F.col("ci_hi") < 0), F.lit(False)).cast("int").alias("excludes_zero"))


view("fvs", "SELECT date, entity, fv_upside_pct AS up, alpha20 AS y FROM fv_panel WHERE fv_upside_pct IS NOT NULL AND alpha20 IS NOT NULL")
view("fvic", "SELECT date, corr(rx,ry) AS v FROM (SELECT date, count(*) OVER (PARTITION BY date) AS n, rank() OVER (PARTITION BY date ORDER BY up)+(count(*) OVER (PARTITION BY date, up)-1)/2.0::DOUBLE AS rx, rank() OVER (PARTITION BY date ORDER BY y)+(count(*) OVER (PARTITION BY date, y)-1)/2.0::DOUBLE AS ry FROM fvs) WHERE n>=10 GROUP BY 1 HAVING stddev_pop(rx)*stddev_pop(ry)>1e-12")


@query("sta23_fair_value_study", "SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n_anchors, round(avg(v),6)+0.0 AS mean_ic FROM fvic GROUP BY 1")
def sta23(t):
    d = fair_value_panel(t).select("entity", "date", F.col("fv_upside_pct").alias("up"), "alpha20")
    ic = S.daily_ic(d, [], "up", "alpha20")
    return ic.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n_anchors"), r6(F.avg("ic")).alias("mean_ic"))


@query("out16_pick_history", "SELECT week, entity, layer, reason FROM picks")
def out16(t):
    """Weeks written with an older and a newer schema, read as one table."""
    root = f"{stage_dir(t.spark)}/picks-{uuid.uuid4().hex}"
    p = picks_of(t)
    p.where(F.col("reason").isNull()).select("week", "entity", "layer").write.parquet(f"{root}/part=a")
    p.where(F.col("reason").isNotNull()).select("week", "entity", "layer", "reason").write.parquet(f"{root}/part=b")
    return t.spark.read.option("mergeSchema", True).parquet(root).select("week", "entity", "layer", "reason")


@query("out17_gap_ledger", "SELECT isoyear(r.date)||'-W'||lpad(weekofyear(r.date)::VARCHAR,2,'0') AS week, r.entity, val_metric, val_median, val_pctile FROM valtab v JOIN rat1 r USING (entity)")
def out17(t):
    v = V.build_valuation(latest_ratios(t), t.membership, t.broad, (), MINP).select("entity", "val_metric", "val_median", "val_pctile")
    return v.join(latest_ratios(t).select("entity", "date"), "entity").select(week_tag("date").alias("week"), "entity", "val_metric", "val_median", "val_pctile")


# ------------------------------------------------------------- streams

view("ev_o", "SELECT event_type AS series_id, event_id AS seq, least(value*4,100) AS s, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events")


@query("str01_light_stream", """
WITH RECURSIVE r AS (SELECT series_id, n, seq, CASE WHEN s<60 THEN 'green' WHEN s>=80 THEN 'red' ELSE 'yellow' END AS color FROM ev_o WHERE n=1
UNION ALL SELECT o.series_id, o.n, o.seq, CASE r.color WHEN 'green' THEN CASE WHEN s>=83 THEN 'red' WHEN s>=63 THEN 'yellow' ELSE 'green' END WHEN 'red' THEN CASE WHEN s>=77 THEN 'red' WHEN s<57 THEN 'green' ELSE 'yellow' END
  ELSE CASE WHEN s>=83 THEN 'red' WHEN s<57 THEN 'green' ELSE 'yellow' END END FROM r JOIN ev_o o ON o.series_id=r.series_id AND o.n=r.n+1) SELECT series_id, seq, color FROM r""")
def str01(t):
    ev = T.file_stream(t.spark, t.root, "events").select(F.col("event_type").alias("series_id"), "ts", F.col("event_id").alias("seq"), F.least(F.col("value") * 4, F.lit(100.0)).alias("score"))
    base = f"{stage_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    return T.run_lights(ev, t.spark, base, 60, 80, 3).select("series_id", "seq", "color")


@query("str02_keyed_append", "SELECT strftime(ts,'%Y-%m-%d') AS day, user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1,2,3")
def str02(t):
    """The same stream delivered twice ends in one row per key."""
    base = f"{stage_dir(t.spark)}/upsert-{uuid.uuid4().hex}"
    ev = T.file_stream(t.spark, t.root, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id", "event_type", "event_id")

    def latest(batch, batch_id):
        one = batch.groupBy("day", "user_id", "event_type").agg(F.max("event_id").alias("event_id")).select("user_id", "event_type", "event_id", "day")
        T.upsert_batch(f"{base}/out", "day", ["day", "user_id", "event_type"], ["event_id"])(one, batch_id)

    for i in (1, 2):
        ev.writeStream.foreachBatch(latest).option("checkpointLocation", f"{base}/c{i}").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("user_id bigint, event_type string, event_id bigint, day string").parquet(f"{base}/out").select("day", "user_id", "event_type", "event_id")


@query("str03_late_rows", "SELECT event_id FROM events WHERE DATE '2024-01-20' <= CAST(ts AS TIMESTAMP) + INTERVAL 10 DAYS")
def str03(t):
    ev = T.file_stream(t.spark, t.root, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("now", F.to_timestamp(F.lit("2024-01-20")))
    base = f"{stage_dir(t.spark)}/late-{uuid.uuid4().hex}"
    return T.run_to_table(T.on_time_stream(ev, "ts", "now", 10), t.spark, f"{base}/out", f"{base}/ckpt").select("event_id")


