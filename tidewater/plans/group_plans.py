"""Screen, membership, grouping and reconciliation queries."""

from pyspark.sql import functions as F

from tidewater.functions.exprs import iso, r6
from tidewater.operators import groups as G
from tidewater.operators import momentum as M
from tidewater.operators import panel as P
from tidewater.operators import reconcile as R
from tidewater.operators import valuation as V
from tidewater.operators import flows as W
from tidewater.plans.flow_plans import health_of, inflect, latest_q, rotation_of
from tidewater.plans.panel_plans import panel_of, tr_targets
from tidewater.plans.registry import query, view
from tidewater.plans.valuation_plans import MINP, latest_ratios, rel_sql
from tidewater.sources.staging import staged

# one row per entity: the universe every screen starts from
view("uni", """
SELECT b.entity, b.close, b.date, b.close*b.volume/1e6 AS amount_million, (b.entity%50+10)*1000::DOUBLE*b.close/1e8 AS market_cap, r.pe, r.pbr, v.val_pctile, q.net_margin_pct, q.gross_margin_pct, q.roe_q_pct, q.delta_net_margin_pct,
  g.subind_median AS gross_peer_median, h.yoy_pct, h.d AS delta, h.dp AS delta_prev, e.ma60 AS ma60_dist_pct, e.t5 AS trust_5d, h.m
FROM backs b LEFT JOIN rat1 r USING (entity) LEFT JOIN valtab v ON v.entity=b.entity LEFT JOIN latest_q q ON q.entity=b.entity LEFT JOIN gross_rel g ON g.entity=b.entity
LEFT JOIN health h ON h.entity=b.entity AND h.m=year(b.date)*12+month(b.date)-2 LEFT JOIN ent e ON e.entity=b.entity AND e.date=b.date WHERE b.back=1
""")
view("gross_src", "SELECT entity, gross_margin_pct FROM latest_q")
view("gross_rel", rel_sql("gross_src", "membership", "gross_margin_pct"))


def universe_of(t):
    def build():
        last = M.newest_first(t.prices).where(F.col("back") == 1).select("entity", "close", "date", (F.col("close") * F.col("volume") / 1e6).alias("amount_million"))
        cap = G.market_cap_billion((F.col("entity") % 50 + 10) * F.lit(1000.0), F.col("close"))
        r = latest_ratios(t)
        v = V.build_valuation(r, t.membership, t.broad, (), MINP).select("entity", "pe", "pbr", "val_pctile")
        q = latest_q(t).select("entity", "net_margin_pct", "gross_margin_pct", "roe_q_pct", "delta_net_margin_pct")
        g = V.peer_relative(q, t.membership, "gross_margin_pct", (), MINP).select("entity", F.col("subind_median").alias("gross_peer_median"))
        h = health_of(t).select("entity", "m", "yoy_pct", F.col("d").alias("delta"), F.col("dp").alias("delta_prev"))
        e = inflect(t).select("entity", "date", F.col("ma60").alias("ma60_dist_pct"), F.col("t5").alias("trust_5d"))
        u = last.withColumn("market_cap", cap).withColumn("m", F.year("date") * 12 + F.month("date") - 2)
        return u.join(v, "entity", "left").join(q, "entity", "left").join(g, "entity", "left").join(h, ["entity", "m"], "left").join(e, ["entity", "date"], "left")

    return staged(t.spark, t.root, "universe", build)


@query("rel01_threshold_filter", "SELECT entity, pe, pbr FROM uni WHERE pe BETWEEN 10 AND 18 AND pbr>=3.0")
def rel01(t):
    rules = [("pe", 10.0, 18.0), ("pb", 3.0, None)]
    return G.threshold_filter(universe_of(t), rules, {"pe": "pe", "pb": "pbr"}).select("entity", "pe", "pbr")


@query("rel02_universe", "SELECT entity, close, strftime(date,'%Y-%m-%d') AS date, pe, pbr, round(yoy_pct,6)+0.0 AS yoy_pct, round(market_cap,6) AS market_cap FROM uni")
def rel02(t):
    return universe_of(t).select("entity", "close", iso("date").alias("date"), "pe", "pbr", r6("yoy_pct").alias("yoy_pct"), r6("market_cap").alias("market_cap"))


@query("rel03_market_cap", "SELECT p.entity, count(*) AS n_days, round(max((p.entity%50+10)*1000::DOUBLE*close/1e8),6) AS max_cap FROM prices p GROUP BY 1")
def rel03(t):
    cap = G.market_cap_billion((F.col("entity") % 50 + 10) * F.lit(1000.0), F.col("close"))
    return t.prices.groupBy("entity").agg(F.count(F.lit(1)).alias("n_days"), r6(F.max(cap)).alias("max_cap"))


_G = ("coalesce(delta_net_margin_pct>=1.5 AND yoy_pct>=0 AND ma60_dist_pct<=15,false) AS g1, coalesce(roe_q_pct>=3.5 AND market_cap>=0.5,false) AS g2, coalesce(val_pctile<=40 AND gross_margin_pct>=gross_peer_median AND amount_million>=0.5,false) AS g5, "
      "coalesce(pe BETWEEN 15 AND 30 AND gross_margin_pct>gross_peer_median AND market_cap>=0.5,false) AS f2")
view("qs", f"SELECT * FROM (SELECT *, {_G} FROM uni) WHERE g1 OR g2 OR g5 OR f2")


def qs_of(t):
    return G.quality_screens(universe_of(t).withColumn("cum_yoy_pct", F.col("yoy_pct")))


def flags(*names):
    return [F.col(n).cast("int").alias(n) for n in names]


@query("rel04_quality_screens", "SELECT entity, g1::INT AS g1, g2::INT AS g2, g5::INT AS g5, f2::INT AS f2 FROM qs")
def rel04(t):
    return qs_of(t).select("entity", *flags("g1", "g2", "g5", "f2"))


_D = "make_date((m+1)//12, (m+1)%12+1, 10)"


@query("rel05_divergence_screens", f"""SELECT entity, coalesce(yoy_pct>=20 AND pe<=25,false)::INT AS l6_2cond, coalesce(yoy_pct>=20 AND pe<=25 AND market_cap>=0.5 AND trust_5d>0,false)::INT AS l6_4cond, coalesce(yoy_pct>0 AND delta>0 AND delta_prev<0,false)::INT AS g4,
  ({_D}>date)::INT AS look_ahead, strftime({_D},'%Y-%m-%d') AS disclosed FROM (SELECT * REPLACE (year(date)*12+month(date)-2 AS m) FROM uni)""")
def rel05(t):
    d = G.divergence_screens(universe_of(t).withColumn("disclosed", G.disclosure_date(F.col("m"))).withColumn("data_date", F.col("date")))
    return d.select("entity", *flags("l6_2cond", "l6_4cond", "g4", "look_ahead"), iso("disclosed").alias("disclosed"))


@query("rel06_candidate_selectors", "SELECT 'g2_large' AS selector, entity FROM qs WHERE g2 AND market_cap>=0.6 UNION ALL SELECT 'g5', entity FROM qs WHERE g5 UNION ALL SELECT 'f2', entity FROM qs WHERE f2")
def rel06(t):
    d = qs_of(t)
    sel = F.explode(F.array_compact(F.array(F.when(F.col("g2") & (F.col("market_cap") >= 0.6), F.lit("g2_large")), F.when(F.col("g5"), F.lit("g5")), F.when(F.col("f2"), F.lit("f2")))))
    return d.select(sel.alias("selector"), "entity").distinct()


view("distress", """
SELECT entity, mad, lod, rt FROM (SELECT date, entity, CASE WHEN count(*) OVER w60>=60 THEN (close/avg(close) OVER w60-1)*100 END AS mad, CASE WHEN count(*) OVER w60>=60 THEN (close/min(close) OVER w60-1)*100 END AS lod, (close/lag(close,40) OVER w-1)*100 AS rt
  FROM prices WHERE close>0 WINDOW w AS (PARTITION BY entity ORDER BY date), w60 AS (PARTITION BY entity ORDER BY date ROWS 59 PRECEDING)) WHERE date=(SELECT max(date) FROM prices)
""")


@query("rel07_distress_gate", "SELECT d.entity, round(mad,6)+0.0 AS ma60_dist_pct, round(lod,6)+0.0 AS low60_dist_pct, round(rt,6)+0.0 AS ret_pct FROM distress d JOIN uni USING (entity) WHERE mad<=0 AND lod<=15 AND market_cap>=0.1")
def rel07(t):
    d = G.distress_snapshot(t.prices).where((F.col("ma60_dist_pct") <= 0) & (F.col("low60_dist_pct") <= 15))
    d = d.join(universe_of(t).where(F.col("market_cap") >= 0.1).select("entity"), "entity")
    return d.select("entity", *[r6(x).alias(x) for x in ("ma60_dist_pct", "low60_dist_pct", "ret_pct")])


@query("rel08_missing_members", "SELECT c_custkey AS entity, 'no_price' AS issue FROM customer WHERE c_custkey NOT IN (SELECT entity FROM prices) UNION ALL SELECT entity, 'no_tag' FROM broad WHERE entity NOT IN (SELECT entity FROM themes WHERE grp='Brand#1')")
def rel08(t):
    a = t.raw("customer").select(F.col("c_custkey").alias("entity")).join(t.prices.select("entity").distinct(), "entity", "left_anti").withColumn("issue", F.lit("no_price"))
    b = t.broad.select("entity").join(t.themes.where(F.col("grp") == "Brand#1").select("entity"), "entity", "left_anti").withColumn("issue", F.lit("no_tag"))
    return a.unionByName(b)


@query("rel09_event_horizon", "SELECT entity, strftime(ex_date,'%Y-%m-%d') AS ex_date, cash FROM dividends WHERE ex_date BETWEEN DATE '2000-01-01' AND DATE '2000-01-31' AND entity IN (SELECT entity FROM broad WHERE grp='ASIA')")
def rel09(t):
    d0 = F.to_date(F.lit("2000-01-01"))
    return t.dividends.where(F.col("ex_date").between(d0, F.date_add(d0, 30))).join(t.broad.where(F.col("grp") == "ASIA"), "entity", "left_semi").select("entity", iso("ex_date").alias("ex_date"), "cash")


@query("rel10_listing_flag", "SELECT p.entity, count(*) AS n, (s.s_suppkey IS NOT NULL)::INT AS delisted FROM prices p LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal<0) s ON s.s_suppkey=p.entity GROUP BY p.entity, s.s_suppkey")
def rel10(t):
    gone = t.raw("supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("entity")).withColumn("_d", F.lit(1))
    return t.prices.join(gone, "entity", "left").groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("_d", F.lit(0))).alias("delisted"))


_SID = "lpad(CAST(o_custkey AS VARCHAR),4,'0')"


@query("rel11_ordinary_share", f"SELECT o_custkey AS entity, count(*) AS n, (regexp_matches({_SID},'^[0-9]{{4}}$') AND NOT starts_with({_SID},'00'))::INT AS ordinary FROM orders GROUP BY 1")
def rel11(t):
    sid = F.lpad(F.col("o_custkey").cast("string"), 4, "0")
    return t.raw("orders").groupBy(F.col("o_custkey").alias("entity"), (sid.rlike("^[0-9]{4}$") & ~sid.startswith("00")).cast("int").alias("ordinary")).agg(F.count(F.lit(1)).alias("n"))


view("purity", "SELECT grp, n_total, official AS dominant_official, n_match, n_match/n_total AS purity FROM (SELECT a.grp, b.grp AS official, count(*) AS n_match, sum(count(*)) OVER (PARTITION BY a.grp) AS n_total, row_number() OVER (PARTITION BY a.grp ORDER BY count(*) DESC, b.grp) AS k FROM themes a JOIN broad b USING (entity) GROUP BY 1,2) WHERE k=1")


@query("rel12_group_purity", "SELECT grp, CAST(n_total AS BIGINT) AS n_total, dominant_official, n_match, round(purity,6) AS purity FROM purity")
def rel12(t):
    return G.group_purity(t.themes, t.broad).withColumn("purity", r6("purity"))


@query("rel13_pure_membership", "SELECT m.grp, m.entity FROM themes m JOIN purity p USING (grp) WHERE purity>=0.25")
def rel13(t):
    ok = G.group_purity(t.themes, t.broad).where(F.col("purity") >= 0.25).select("grp")
    return t.themes.join(ok, "grp", "left_semi").select("grp", "entity")


@query("rel13_index_baskets", "SELECT strftime(date,'%Y-%m-%d') AS date, 'mix' AS grp, coalesce(max(v) FILTER (WHERE s='1-URGENT'), max(v) FILTER (WHERE s='2-HIGH')) AS basket_index FROM (SELECT date, series_id AS s, value AS v FROM series WHERE series_id IN ('1-URGENT','2-HIGH')) GROUP BY date")
def rel13b(t):
    al = t.spark.createDataFrame([("1-URGENT", "mix", 0), ("2-HIGH", "mix", 1)], "index_name string, grp string, pref int")
    ix = t.series.select("date", F.col("series_id").alias("index_name"), F.col("value").alias("close_index"))
    return G.index_baskets(ix, al).select(iso("date").alias("date"), "grp", "basket_index")


@query("rel14_screen_inputs", "SELECT entity, round(gross_peer_median,6) AS gross_peer_median, round(delta_net_margin_pct,6)+0.0 AS delta_net_margin_pct, val_pctile, round(amount_million,6) AS amount_million FROM uni")
def rel14(t):
    return universe_of(t).select("entity", r6("gross_peer_median").alias("gross_peer_median"), r6("delta_net_margin_pct").alias("delta_net_margin_pct"), "val_pctile", r6("amount_million").alias("amount_million"))


@query("rel15_extension_rule", "SELECT entity, (ma60_dist_pct>2)::INT AS violates FROM uni WHERE ma60_dist_pct IS NOT NULL")
def rel15(t):
    return universe_of(t).where(F.col("ma60_dist_pct").isNotNull()).select("entity", (F.col("ma60_dist_pct") > 2).cast("int").alias("violates"))


# ------------------------------------------------------------- grouping

view("mem", """
SELECT u.entity, n.ret_pct AS momentum, coalesce(f.n,0) AS inst_net, coalesce(f.f,0) AS foreign_net, p.vol_ratio, u.amount_million, (u.pe<=15)::INT+(u.pbr>=3)::INT+1 AS strategy_count
FROM uni u JOIN ndr n USING (entity) LEFT JOIN (SELECT entity, CAST(sum(total_net) AS BIGINT) AS n, CAST(sum(foreign_net) AS BIGINT) AS f FROM flows WHERE date IN (SELECT DISTINCT date FROM flows ORDER BY date DESC LIMIT 20) GROUP BY 1) f USING (entity)
LEFT JOIN panel0 p ON p.entity=u.entity AND p.date=u.date WHERE u.pe IS NOT NULL
""")


def members_of(t):
    def build():
        d20 = F.broadcast(t.flows.select("date").distinct().orderBy(F.desc("date")).limit(20))
        f = t.flows.join(d20, "date", "left_semi").groupBy("entity").agg(F.sum("total_net").alias("inst_net"), F.sum("foreign_net").alias("foreign_net"))
        u = universe_of(t).where(F.col("pe").isNotNull())
        d = u.join(M.n_day_return(t.prices).select("entity", F.col("ret_pct").alias("momentum")), "entity").join(f, "entity", "left").join(panel_of(t).select("entity", "date", "vol_ratio"), ["entity", "date"], "left")
        sc = (F.col("pe") <= 15).cast("int") + (F.col("pbr") >= 3).cast("int") + 1
        return d.select("entity", "momentum", F.coalesce("inst_net", F.lit(0)).alias("inst_net"), F.coalesce("foreign_net", F.lit(0)).alias("foreign_net"), "vol_ratio", "amount_million", sc.alias("strategy_count"))

    return staged(t.spark, t.root, "members", build)


def _score_sql(bridge, total, w, mins):
    return f"""SELECT grp, n AS members_count, up AS up_count, round(md,6)+0.0 AS momentum_med, round(lead,6) AS lead_score, round({w[0]}*100*sg+{w[1]}*100*(n/tt)+{w[2]}*100*(ib/n)+{w[3]}*100*(ln(n+1)/ln(1+mx)),6) AS score FROM (
  SELECT g.*, {total} AS tt, max(n) OVER () AS mx, 1/(1+exp(-(md/5.0::DOUBLE))) AS sg, 45.0*fb/n+30.0*vs/n+25.0*(1/(1+exp(-(md/5.0::DOUBLE)))) AS lead FROM (SELECT grp, count(*)::DOUBLE AS nd, count(*) AS n, count(*) FILTER (WHERE momentum>0) AS up, median(momentum) AS md, count(*) FILTER (WHERE inst_net>0) AS ib,
    count(*) FILTER (WHERE foreign_net>0) AS fb, count(*) FILTER (WHERE vol_ratio>=1.5) AS vs FROM mem JOIN {bridge} USING (entity) GROUP BY 1) g LEFT JOIN (SELECT grp, count(*) AS c FROM {bridge} GROUP BY 1) z USING (grp)) WHERE n>={mins}"""


@query("grp01_group_scores", _score_sql("membership", "z.c", ("0.4::DOUBLE", "0.3::DOUBLE", "0.2::DOUBLE", "0.1::DOUBLE"), 2))
def grp01(t):
    sizes = t.membership.groupBy("grp").agg(F.count(F.lit(1)).alias("total"))
    d = G.group_scores(members_of(t).join(t.membership, "entity"), ["grp"], sizes, (0.4, 0.3, 0.2, 0.1), 2)
    return d.select("grp", "members_count", "up_count", *[r6(x).alias(x) for x in ("momentum_med", "lead_score", "score")])


@query("grp02_theme_strength", _score_sql("themes", "n", ("0.7::DOUBLE", "0.0::DOUBLE", "0.15::DOUBLE", "0.15::DOUBLE"), 3))
def grp02(t):
    d = G.group_scores(members_of(t).join(t.themes, "entity"), ["grp"], None, (0.7, 0.0, 0.15, 0.15), 3)
    return d.select("grp", "members_count", "up_count", *[r6(x).alias(x) for x in ("momentum_med", "lead_score", "score")])


def _rk(c):
    return f"(1-((rank() OVER (PARTITION BY grp ORDER BY {c} DESC)+(count(*) OVER (PARTITION BY grp, {c})-1)/2.0::DOUBLE)-1)/greatest(count(*) OVER (PARTITION BY grp)-1,1))"


view("lead4", f"SELECT *, round(0.5::DOUBLE*{_rk('momentum')}+0.25::DOUBLE*{_rk('amount_million')}+0.15::DOUBLE*{_rk('inst_net')}+0.1::DOUBLE*{_rk('strategy_count')},9) AS leader_score FROM mem JOIN broad USING (entity)")


@query("grp03_leader_ranks", "SELECT grp, entity, round(leader_score,6) AS leader_score, row_number() OVER (PARTITION BY grp ORDER BY leader_score DESC, entity) AS rank_in_group FROM lead4")
def grp03(t):
    return G.leader_ranks(members_of(t).join(t.broad, "entity")).select("grp", "entity", r6("leader_score").alias("leader_score"), "rank_in_group")


_FLG = "concat_ws(';', CASE WHEN ma60_dist_pct>1 THEN '過熱' END, CASE WHEN momentum>1 THEN '強勢領頭' END, CASE WHEN u.amount_million<0.5 THEN '低流動' END, CASE WHEN pe>20 THEN '高PE' END)"
view("enriched", f"SELECT u.entity, t.grp, u.close, u.pe, u.val_pctile, u.ma60_dist_pct, m.momentum, round(u.close/(1+u.ma60_dist_pct/100),2) AS ma60_price, round(m.inst_net/1000.0::DOUBLE,3) AS inst_lots, {_FLG} AS flags FROM uni u JOIN mem m USING (entity) LEFT JOIN (SELECT entity, min(grp) AS grp FROM membership GROUP BY 1) t USING (entity)")


def enriched_of(t):
    d = universe_of(t).join(members_of(t).select("entity", "momentum", "inst_net"), "entity").join(t.membership.groupBy("entity").agg(F.min("grp").alias("grp")), "entity", "left")
    c = F.col
    return d.select("entity", "grp", "close", "pe", "val_pctile", "ma60_dist_pct", "momentum", F.round(c("close") / (1 + c("ma60_dist_pct") / 100), 2).alias("ma60_price"), F.round(c("inst_net") / 1000, 3).alias("inst_lots"),
                    G.join_flags(**{"過熱": c("ma60_dist_pct") > 1, "強勢領頭": c("momentum") > 1, "低流動": c("amount_million") < 0.5, "高PE": c("pe") > 20}).alias("flags"))


@query("grp04_enriched_candidates", "SELECT entity, grp, close, pe, val_pctile, round(ma60_dist_pct,6)+0.0 AS ma60_dist_pct, round(momentum,6)+0.0 AS momentum, ma60_price, inst_lots, flags FROM enriched")
def grp04(t):
    return enriched_of(t).withColumns({x: r6(x) for x in ("ma60_dist_pct", "momentum")})


@query("grp05_flag_coverage", """
SELECT entity, e.grp, flags, CASE WHEN list_contains(string_split(flags,';'),'低流動') AND n>=2 AND f*100.0/n>=40 THEN f||'/'||n END AS note FROM enriched e JOIN (SELECT grp, count(*) AS n, count(*) FILTER (WHERE list_contains(string_split(flags,';'),'低流動')) AS f FROM enriched GROUP BY 1) g ON g.grp=e.grp""")
def grp05(t):
    return G.flag_coverage(enriched_of(t), "低流動", 40.0, 2).select("entity", "grp", "flags", "note")


@query("grp06_rotation_axis", """
SELECT r.grp, trend_score, quadrant, coalesce(c.n,0) AS n_candidates, (radar_rank<=5)::INT AS in_top, (quadrant='下一棒')::INT AS next_up FROM rotation r LEFT JOIN (SELECT grp, count(*) AS n FROM mem JOIN membership USING (entity) GROUP BY 1) c USING (grp) WHERE radar_rank<=5 OR quadrant='下一棒'""")
def grp06(t):
    c = members_of(t).join(t.membership, "entity").groupBy("grp").agg(F.count(F.lit(1)).alias("n_candidates"))
    d = rotation_of(t).where((F.col("radar_rank") <= 5) | (F.col("quadrant") == W.Q_NEXT)).join(c, "grp", "left")
    return d.select("grp", "trend_score", "quadrant", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), (F.col("radar_rank") <= 5).cast("int").alias("in_top"), (F.col("quadrant") == W.Q_NEXT).cast("int").alias("next_up"))


@query("grp07_named_list", "SELECT e.entity, flags, round(momentum,6)+0.0 AS momentum FROM enriched e WHERE entity IN (SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment='BUILDING')")
def grp07(t):
    names = t.raw("customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("entity")).distinct()
    return enriched_of(t).join(names, "entity", "left_semi").select("entity", "flags", r6("momentum").alias("momentum"))


@query("grp08_label_concentration", "SELECT grp AS label, count(DISTINCT entity) AS n_held, round(count(DISTINCT entity)/(SELECT count(DISTINCT entity) FROM themes),3) AS share, (count(DISTINCT entity)>=90 OR count(DISTINCT entity)/(SELECT count(DISTINCT entity) FROM themes)>=0.8)::INT AS flagged FROM themes GROUP BY 1")
def grp08(t):
    return G.label_concentration(t.themes.withColumnRenamed("grp", "label"), 90, 0.8).withColumn("flagged", F.col("flagged").cast("int"))


view("held", "SELECT DISTINCT entity FROM picks")
view("held_ret", "SELECT entity, date, ret FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS b FROM clipped WHERE entity IN (SELECT entity FROM held)) WHERE b<=250")
view("edges", "SELECT a.entity AS a, b.entity AS b, count(*) AS n, corr(a.ret, b.ret) AS rho FROM held_ret a JOIN held_ret b ON a.date=b.date AND a.entity<b.entity GROUP BY 1,2 HAVING count(*)>=15 AND stddev_pop(a.ret)*stddev_pop(b.ret)>1e-12 AND abs(corr(a.ret,b.ret))>=0.3")


def held_of(t):
    from tidewater.plans.outcome_plans import picks_of

    return picks_of(t).select("entity").distinct()


@query("grp09_correlation_edges", "SELECT a, b, n, round(rho,6)+0.0 AS rho FROM edges")
def grp09(t):
    return G.correlation_edges(t.prices, held_of(t), 250, 15, 0.3).select("a", "b", "n", r6("rho").alias("rho"))


@query("grp09_correlation_clusters", """
WITH RECURSIVE e AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a=r.reach) SELECT node AS entity, min(reach) AS component FROM r GROUP BY 1""")
def grp09b(t):
    return G.connected_components(G.correlation_edges(t.prices, held_of(t), 250, 15, 0.3)).select(F.col("node").alias("entity"), "component")


@query("grp10_cluster_exposure", "SELECT c AS cluster, count(DISTINCT entity) AS n_held, round(count(DISTINCT entity)/(SELECT count(DISTINCT entity) FROM themes),3) AS share FROM (SELECT entity, CASE WHEN grp IN ('Brand#1','Brand#2') THEN 'low' WHEN grp IN ('Brand#24','Brand#25') THEN 'high' END AS c FROM themes) WHERE c IS NOT NULL GROUP BY 1")
def grp10(t):
    cl = t.spark.createDataFrame([(x, c, 50, 0.5) for c, ls in (("low", ("Brand#1", "Brand#2")), ("high", ("Brand#24", "Brand#25"))) for x in ls], "label string, cluster string, max_count int, max_share double")
    return G.cluster_exposure(t.themes.withColumnRenamed("grp", "label"), cl).select("cluster", "n_held", "share")


@query("grp11_latest_screen_hits", "SELECT layer AS strategy, entity FROM picks WHERE week=(SELECT max(week) FROM picks)")
def grp11(t):
    from tidewater.functions.exprs import with_scalar
    from tidewater.plans.outcome_plans import picks_of

    p = picks_of(t)
    return with_scalar(p, p.agg(F.max("week").alias("_w"))).where(F.col("week") == F.col("_w")).select(F.col("layer").alias("strategy"), "entity")


# ------------------------------------------------------------- reconciliation

view("rat_b", "SELECT date, entity, pe*(1+(entity%7)/40.0::DOUBLE) AS pe FROM ratios WHERE dividend_yield IS NOT NULL")
view("rat_j", "SELECT a.entity, a.pe AS x, b.pe AS y FROM ratios a JOIN rat_b b USING (date, entity)")


@query("rec01_ratio_agreement", """
SELECT count(*) AS n, round(median(r),6) AS median, round((list_sort(list(r)))[count(*)//4+1],6) AS q1, round((list_sort(list(r)))[count(*)*3//4+1],6) AS q3, count(*) FILTER (WHERE abs(r-1)>0.1) AS n_pair_outlier,
  (SELECT count(*) FROM (SELECT entity, median(x/y) AS m FROM rat_j WHERE x IS NOT NULL AND y>0 GROUP BY 1) WHERE abs(m-1)>0.1) AS n_stock_outlier, (SELECT count(*) FROM rat_j WHERE x IS NULL AND y>0) AS only_b, (median(r) BETWEEN 0.9 AND 1.1)::INT AS passed
FROM (SELECT x/y AS r FROM rat_j WHERE x IS NOT NULL AND y>0)""")
def rec01(t):
    b = t.ratios.where(F.col("dividend_yield").isNotNull()).select("date", "entity", (F.col("pe") * (1 + (F.col("entity") % 7) / 40.0)).alias("pe"))
    d = R.ratio_criteria(R.ratio_agreement(t.ratios, b, ["date", "entity"], "pe"), 0.9, 1.1, 2.0)
    return d.select("n", *[r6(x).alias(x) for x in ("median", "q1", "q3")], "n_pair_outlier", "n_stock_outlier", "only_b", F.col("passed").cast("int").alias("passed"))


@query("rec02_statement_agreement", """
SELECT count(*) AS n, round(median(a.revenue/b.q),6) AS revenue_median, round(avg((abs(a.revenue/b.q-1)>0.1)::INT),6) AS outlier_share FROM single_q a
JOIN (SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(quarter(l_shipdate) AS INTEGER) AS quarter, sum(floor(l_extendedprice)) AS q FROM lineitem GROUP BY 1,2,3) b USING (entity, year, quarter) WHERE a.revenue IS NOT NULL AND b.q>0""")
def rec02(t):
    from tidewater.functions.exprs import with_scalar
    from tidewater.operators.order import exact_quantiles
    from tidewater.plans.flow_plans import single_q

    d = F.to_date("l_shipdate")
    b = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.year(d).alias("year"), F.quarter(d).alias("quarter")).agg(F.sum(F.floor("l_extendedprice")).alias("q"))
    j = single_q(t).where(F.col("revenue").isNotNull()).join(b.where(F.col("q") > 0), ["entity", "year", "quarter"]).withColumn("r", F.col("revenue") / F.col("q"))
    s = j.agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.abs(F.col("r") - 1) > 0.1).cast("double"))).alias("outlier_share"))
    return with_scalar(s, exact_quantiles(j, [], "r", {"revenue_median": 0.5}).withColumn("revenue_median", r6("revenue_median")))


view("ev_a", "SELECT entity, ex_date, cash FROM dividends WHERE after_price IS NOT NULL")
view("ev_b", "SELECT entity, ex_date+CASE WHEN cash<600 THEN 2 ELSE 0 END AS ex_date, max(cash) AS cash FROM dividends WHERE before_price>=15000 GROUP BY 1,2")


@query("rec03_event_match", """
SELECT strftime(coalesce(a.ex_date,b.ex_date),'%Y-%m-%d') AS ex_date, coalesce(a.entity,b.entity) AS entity, a.cash AS cash_a, b.cash AS cash_b, CASE WHEN a.entity IS NOT NULL AND b.entity IS NOT NULL THEN 'matched' WHEN b.entity IS NULL THEN
  CASE WHEN EXISTS (SELECT 1 FROM ev_b x WHERE x.entity=a.entity AND abs(x.ex_date-a.ex_date)<=3 AND NOT EXISTS (SELECT 1 FROM ev_a y WHERE y.entity=x.entity AND y.ex_date=x.ex_date)) THEN 'a_only_near' ELSE 'a_only' END ELSE 'b_only' END AS kind
FROM ev_a a FULL JOIN ev_b b ON a.entity=b.entity AND a.ex_date=b.ex_date""")
def rec03(t):
    d = t.dividends
    a = d.where(F.col("after_price").isNotNull()).select("entity", "ex_date", "cash")
    b = d.where(F.col("before_price") >= 15000).groupBy("entity", F.when(F.col("cash") < 600, F.date_add("ex_date", 2)).otherwise(F.col("ex_date")).alias("ex_date")).agg(F.max("cash").alias("cash"))
    return R.event_match(a, b).select(iso("ex_date").alias("ex_date"), "entity", "cash_a", "cash_b", "kind")


@query("rec04_before_price", """
SELECT count(*) AS n_events, count(*) FILTER (WHERE before_price IS NOT NULL AND pc IS NULL) AS n_no_prev, count(*) FILTER (WHERE before_price IS NOT NULL AND pc IS NOT NULL) AS n_checked, count(*) FILTER (WHERE abs(before_price-pc)/pc*100<=50) AS n_ok, count(*) FILTER (WHERE rd<>ex_date) AS n_realigned
FROM (SELECT e.*, p.pc FROM (SELECT d.*, (SELECT min(date) FROM prices p WHERE p.entity=d.entity AND p.date>=d.ex_date) AS rd FROM dividends d) e LEFT JOIN (SELECT entity, date, lag(close) OVER (PARTITION BY entity ORDER BY date) AS pc FROM prices) p ON p.entity=e.entity AND p.date=e.rd)""")
def rec04(t):
    return R.before_price_check(t.dividends, t.prices, 50.0)


@query("rec04_ratio_rounding", """
SELECT count(*) AS n_checked, round(max(abs(e)),6) AS err_abs_max, count(*) FILTER (WHERE abs(e)>0.2) AS n_flagged, round(median(e),6)+0.0 AS err_median, round(quantile_cont(abs(e),0.99),6) AS err_abs_p99
FROM (SELECT ((before_price-cash)/nullif(after_price,0)-1)*100 AS e FROM dividends WHERE cash>0 AND after_price IS NOT NULL AND before_price>cash)""")
def rec04b(t):
    return R.ratio_rounding(t.dividends, 0.2).select("n_checked", "n_flagged", *[r6(x).alias(x) for x in ("err_abs_max", "err_median", "err_abs_p99")])


view("raw5", "SELECT date, entity, (lead(close,6) OVER w/lead(close,1) OVER w-1)*100 AS r5 FROM prices WHERE close>0 WINDOW w AS (PARTITION BY entity ORDER BY date)")


@query("rec05_return_agreement", """
SELECT cls, count(*) AS n, round(max(abs(d)),6) AS diff_abs_max, round(median(d),6)+0.0 AS diff_median, round(quantile_cont(abs(d),0.99),6) AS diff_abs_p99 FROM (SELECT a.r5-f.r5 AS d, CASE WHEN abs(a.r5-r.r5)>1e-6 AND abs(f.r5-r.r5)>1e-6 THEN 'both' WHEN abs(a.r5-r.r5)>1e-6 THEN 'adjusted_only' WHEN abs(f.r5-r.r5)>1e-6 THEN 'reference_only' ELSE 'none' END AS cls
FROM tr_targets a JOIN raw5 r USING (date, entity) JOIN fwd_levels f USING (date, entity) WHERE a.r5 IS NOT NULL AND r.r5 IS NOT NULL AND f.r5 IS NOT NULL) GROUP BY 1""")
def rec05(t):
    from tidewater.functions.exprs import own_rows

    w = own_rows()
    raw = P.clean_prices(t.prices).select("date", "entity", ((F.lead("close", 6).over(w) / F.lead("close", 1).over(w) - 1) * 100).alias("r5"))
    d = R.return_agreement(tr_targets(t, (5,)), raw, panel_of(t).select("date", "entity", "r5"), "r5", 1e-6)
    return d.select("cls", "n", *[r6(x).alias(x) for x in ("diff_abs_max", "diff_median", "diff_abs_p99")])


@query("rec06_sampled_frames", """
SELECT CAST(year(coalesce(a.date,b.date)) AS INTEGER) AS period, count(CASE WHEN a.close IS NOT NULL AND b.close IS NOT NULL THEN 1 END) AS n_both, count(*) FILTER (WHERE abs(a.close-b.close)/b.close*100<=5) AS n_close_ok, count(*) FILTER (WHERE a.volume=b.volume) AS n_volume_ok, count(*) FILTER (WHERE a.close IS NULL) AS n_missing_a, count(*) FILTER (WHERE b.close IS NULL) AS n_missing_b
FROM (SELECT p.* FROM prices p JOIN flows f USING (date, entity) WHERE date IN (SELECT date FROM smp)) a FULL JOIN (SELECT date, entity, raw::DOUBLE AS close, qty::DOUBLE AS volume FROM daily WHERE date IN (SELECT date FROM smp)) b ON a.date=b.date AND a.entity=b.entity GROUP BY 1""")
def rec06(t):
    a = t.prices.join(t.flows.select("date", "entity"), ["date", "entity"], "left_semi")
    b = t.daily.select("date", "entity", F.col("raw").cast("double").alias("close"), F.col("qty").cast("double").alias("volume"))
    days = R.sample_dates(P.market_calendar(t.prices, 5), 12, 7)
    return R.frame_agreement(a, b, days, 5.0, F.year("date"))


view("smp", "SELECT date FROM (SELECT date, row_number() OVER (PARTITION BY year(date) ORDER BY md5('7:'||strftime(date,'%Y-%m-%d'))) AS k FROM calendar) WHERE k<=12")
