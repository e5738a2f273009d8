"""Factor statistics queries."""

from pyspark.sql import functions as F

from tidewater.functions.exprs import iso, r6, with_scalar
from tidewater.operators import cells as C
from tidewater.operators import panel as P
from tidewater.operators import stats as S
from tidewater.operators import study as U
from tidewater.operators.order import average_ranks, exact_quantiles
from tidewater.operators.resample import POISSON, PRIME, STEPS, block_bootstrap, poisson_interval
from tidewater.plans.panel_plans import panel_of
from tidewater.plans.regime_plans import regime_of
from tidewater.plans.registry import query, view
from tidewater.sources.staging import cut, staged

FACTORS = ["ma20_dist_pct", "ma60_dist_pct", "vol_ratio"]


def avg_rank_sql(col, part):
    p = f"PARTITION BY {part} " if part else ""
    q = f"PARTITION BY {part}, {col}" if part else f"PARTITION BY {col}"
    return f"(rank() OVER ({p}ORDER BY {col})+(count(*) OVER ({q})-1)/2.0::DOUBLE)"


def boot_views(pre, series, keys, blk, seed=42, n_boot=1000, alpha=0.05):
    """SQL twin of the block bootstrap over view ``series`` (keys, date, v)."""
    k = ", ".join(keys)
    on = " AND ".join(f"d.{x} IS NOT DISTINCT FROM {{0}}.{x}" for x in keys) or "true"
    part = f"PARTITION BY {k} " if keys else ""
    kk = k + ", " if keys else ""
    view(f"{pre}_pts", f"SELECT {kk}v, row_number() OVER ({part}ORDER BY date)-1 AS i, count(*) OVER ({part}) AS t, sum(v) OVER ({part}ORDER BY date) AS s, CAST({blk} AS BIGINT) AS blk FROM {series} WHERE v IS NOT NULL")
    view(f"{pre}_head", f"SELECT {kk}max(t) AS t, avg(v) AS mean, greatest(1,least(max(blk),max(t))) AS l FROM {pre}_pts " + (f"GROUP BY {k}" if keys else ""))
    dk = ", ".join(f"d.{x}" for x in keys)
    dkk = dk + ", " if keys else ""
    view(f"{pre}_draw", f"""SELECT {kk}t, r, CASE WHEN c<nb-1 THEN l ELSE t-l*(nb-1) END AS take, (('0x'||substr(md5('{seed}:'||r||':'||c),1,8))::BIGINT) % (t-l+1) AS st
FROM (SELECT *, CAST(ceil(t/l::DOUBLE) AS BIGINT) AS nb FROM {pre}_head WHERE t>=10), range({n_boot}) a(r), range(nb) b(c)""")
    view(f"{pre}_stat", f"""SELECT {dkk}d.r, sum(h.s-coalesce(g.s,0))/max(d.t) AS m FROM {pre}_draw d JOIN {pre}_pts h ON {on.format('h')} AND h.i=d.st+d.take-1
LEFT JOIN {pre}_pts g ON {on.format('g')} AND g.i=d.st-1 GROUP BY {dkk}d.r""")
    lo, hi = int(n_boot * alpha / 2), int(n_boot * (1 - alpha / 2)) - 1
    view(f"{pre}_q", f"SELECT *, row_number() OVER ({part}ORDER BY m)-1 AS q FROM {pre}_stat")
    view(f"{pre}_ci", f"""SELECT {dkk}d.t AS n_obs, d.mean, c.lo AS ci_lo, c.hi AS ci_hi FROM {pre}_head d LEFT JOIN (
SELECT {kk}max(CASE WHEN q={lo} THEN m END) AS lo, max(CASE WHEN q={hi} THEN m END) AS hi FROM {pre}_q {f'GROUP BY {k}' if keys else ''}) c ON {on.format('c')}""")


#: A whole number that names a row of an entity and a date, in SQL and as a column.
IDENT = "(entity::BIGINT*100003+(date-DATE '1970-01-01'))"


def ident():
    return F.col("entity").cast("long") * 100_003 + F.unix_date("date")


def poisson_views(pre, rows, keys, n_boot=1000, seed=20260710, alpha=0.05):
    """SQL twin of the Poisson interval over view ``rows`` (keys, y, ident)."""
    k = ", ".join(keys)
    u = "u"
    steps = f"SELECT {k}, y, r, ((ident%{PRIME})*48271+(r+{seed})*69621+1)%{PRIME} AS u FROM (SELECT {k}, y, CAST(ident AS BIGINT) AS ident FROM {rows} WHERE y IS NOT NULL), range({n_boot}) q(r)"
    for odd, one in STEPS:
        steps = f"SELECT {k}, y, r, ({u}*{u}+{u}*{odd}+{one})%{PRIME} AS u FROM ({steps})"
    w = "+".join(f"(u>={x})::INT" for x in POISSON)
    view(f"{pre}_m", f"SELECT {k}, r, sum(w*y)/nullif(sum(w),0) AS m FROM (SELECT *, {w} AS w FROM ({steps})) WHERE w>0 GROUP BY {k}, r")
    lo, hi = int(n_boot * (alpha / 2)), int(n_boot * (1 - alpha / 2)) - 1
    view(f"{pre}_q", f"SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY m)-1 AS q FROM {pre}_m")
    view(f"{pre}_ci", f"SELECT {k}, CASE WHEN n>=10 THEN lo END AS ci_lo, CASE WHEN n>=10 THEN hi END AS ci_hi FROM (SELECT {k}, max(CASE WHEN q={lo} THEN m END) AS lo, max(CASE WHEN q={hi} THEN m END) AS hi FROM {pre}_q GROUP BY {k}) JOIN (SELECT {k}, count(y) AS n FROM {rows} GROUP BY {k}) USING ({k})")


def fisher_sql(ic, n):
    out = []
    for nm, sg in (("ci_lo", "-"), ("ci_hi", "+")):
        out.append(f"round(CASE WHEN {n}>=11 AND abs({ic})<0.999 THEN tanh(atanh(CASE WHEN abs({ic})<0.999 THEN {ic} ELSE 0 END){sg}1.96/sqrt(greatest({n},11)-3.0::DOUBLE)) END,6)+0.0 AS {nm}")
    return ", ".join(out)


def long_of(t, targets=("alpha5", "alpha20"), by_date=False):
    """One row per factor and target; with ``by_date`` the wide rows are dealt by date before, so that work within dates shuffles no long rows."""
    p = panel_of(t).select("date", "entity", *FACTORS, *targets)
    p = p.repartition("date") if by_date else p
    return S.long_pairs(p, ["date", "entity"], FACTORS, list(targets)).where(F.col("x").isNotNull() & F.col("y").isNotNull())


view("fl", " UNION ALL ".join(f"SELECT date, entity, '{f}' AS factor, {f} AS x, '{y}' AS target, {y} AS y FROM panel0 WHERE {f} IS NOT NULL AND {y} IS NOT NULL" for f in FACTORS for y in ("alpha5", "alpha20")))


@query("sta01_pooled_spearman", "SELECT factor, target, n, round(ic,6)+0.0 AS ic, " + fisher_sql("ic", "n") + " FROM (SELECT factor, target, count(*) AS n, corr(rx,ry) AS ic FROM (SELECT factor, target, "
       + avg_rank_sql("x", "factor, target") + " AS rx, " + avg_rank_sql("y", "factor, target") + " AS ry FROM fl) GROUP BY 1,2)")
def sta01(t):
    d = S.spearman(long_of(t), ["factor", "target"], "x", "y")
    return d.select("factor", "target", "n", *[r6(c).alias(c) for c in ("ic", "ci_lo", "ci_hi")])


view("flr", "SELECT *, count(*) OVER (PARTITION BY factor, target, date) AS n, " + avg_rank_sql("x", "factor, target, date") + " AS rx, " + avg_rank_sql("y", "factor, target, date") + " AS ry FROM fl")
view("fic", "SELECT factor, target, date, max(n) AS n, corr(rx,ry) AS v FROM flr WHERE n>=10 GROUP BY 1,2,3 HAVING stddev_pop(rx)*stddev_pop(ry)>1e-12")


def fic_of(t):
    return staged(t.spark, t.root, "daily_ic", lambda: S.daily_ic(long_of(t, by_date=True), ["factor", "target"], "x", "y"))


@query("sta02_daily_ic_many", "SELECT factor, target, strftime(date,'%Y-%m-%d') AS date, n, round(v,6)+0.0 AS ic FROM fic")
def sta02b(t):
    return fic_of(t).select("factor", "target", iso("date").alias("date"), "n", r6("ic").alias("ic"))


@query("sta03_bucket_table", """
SELECT bucket, count(*) AS n, round(median(y),6)+0.0 AS median, round(avg(y),6)+0.0 AS mean, round(avg((y>0)::INT),6) AS win_rate FROM (
  SELECT y, CAST(least(greatest(ceil(rx/n*5),1),5) AS BIGINT) AS bucket FROM icb WHERE n>=5) GROUP BY 1""")
def sta03(t):
    d = S.bucket_table(panel_of(t), "ma20_dist_pct", "alpha5", 5)
    return d.select("bucket", "n", *[r6(c).alias(c) for c in ("median", "mean", "win_rate")])


view("icb", "SELECT date, y, count(*) OVER (PARTITION BY date) AS n, " + avg_rank_sql("x", "date") + " AS rx FROM ic_rows")
view("prk", "SELECT date, n, rx/n AS x, ry/n AS y, rc/n AS c, rd/n AS d FROM (SELECT date, count(*) OVER (PARTITION BY date) AS n, "
     + ", ".join(f"{avg_rank_sql(c, 'date')} AS {a}" for c, a in (("ma20_dist_pct", "rx"), ("alpha20", "ry"), ("vol_ratio", "rc"), ("ma60_dist_pct", "rd")))
     + " FROM panel0 WHERE ma20_dist_pct IS NOT NULL AND alpha20 IS NOT NULL AND vol_ratio IS NOT NULL AND ma60_dist_pct IS NOT NULL)")


def _pc(a, b, c):
    return f"({a}-{b}*{c})/nullif(sqrt((1-{b}*{b})*(1-{c}*{c})),0)"


_PAIR = "corr(x,y) AS xy, corr(x,c) AS xc, corr(x,d) AS xd, corr(y,c) AS yc, corr(y,d) AS yd, corr(c,d) AS cd, count(*) AS n"
_PART = f"SELECT *, {_pc('xy', 'xc', 'yc')} AS p1, {_pc('xd', 'xc', 'cd')} AS p2, {_pc('yd', 'yc', 'cd')} AS p3"


@query("sta04_residual_ic", f"SELECT n, round({_pc('p1', 'p2', 'p3')},6)+0.0 AS ic FROM ({_PART} FROM (SELECT {_PAIR} FROM prk)) WHERE n>=30")
def sta04(t):
    return S.residual_ic(panel_of(t), "ma20_dist_pct", "alpha20", ["vol_ratio", "ma60_dist_pct"]).select("n", r6("ic").alias("ic"))


@query("sta04_daily_partial_ic", f"""SELECT strftime(date,'%Y-%m-%d') AS date, n, round(ic,6)+0.0 AS ic FROM (SELECT date, n, {_pc('p1', 'p2', 'p3')} AS ic FROM ({_PART} FROM (SELECT date, {_PAIR} FROM prk GROUP BY date HAVING count(*)>=30
  AND least(stddev_pop(x),stddev_pop(y),stddev_pop(c),stddev_pop(d))>0))) WHERE ic IS NOT NULL""")
def sta04b(t):
    d = S.residual_ic(panel_of(t), "ma20_dist_pct", "alpha20", ["vol_ratio", "ma60_dist_pct"], ["date"], 30)
    return d.where(F.col("ic").isNotNull()).select(iso("date").alias("date"), "n", r6("ic").alias("ic"))


view("stride", "SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date)-1 AS i FROM (SELECT DISTINCT date FROM ic20)) WHERE i%20=0")
view("ic20", "SELECT date, ma20_dist_pct AS x, alpha20 AS y FROM panel0 WHERE ma20_dist_pct IS NOT NULL AND alpha20 IS NOT NULL")


@query("sta05_nonoverlap_ic", "SELECT round(ic,6)+0.0 AS ic, n_dates, " + fisher_sql("ic", "n") + " FROM (SELECT corr(rx,ry) AS ic, count(*) AS n, (SELECT count(*) FROM stride) AS n_dates FROM (SELECT "
       + avg_rank_sql("x", "") + " AS rx, " + avg_rank_sql("y", "") + " AS ry FROM ic20 WHERE date IN (SELECT date FROM stride)))")
def sta05(t):
    p = panel_of(t).where(F.col("ma20_dist_pct").isNotNull() & F.col("alpha20").isNotNull())
    return S.nonoverlap_ic(p, "ma20_dist_pct", "alpha20", 20).select("n_dates", *[r6(c).alias(c) for c in ("ic", "ci_lo", "ci_hi")])


boot_views("bic", "fic", ["factor", "target"], "CASE target WHEN 'alpha5' THEN 6 ELSE 21 END")


def block_of_target():
    return F.when(F.col("target") == "alpha5", 6).otherwise(21)


@query("sta06_block_bootstrap", "SELECT factor, target, n_obs AS n_dates, round(mean,6)+0.0 AS mean_ic, round(ci_lo,6)+0.0 AS ci_lo, round(ci_hi,6)+0.0 AS ci_hi FROM bic_ci")
def sta06(t):
    d = S.ic_summary(fic_of(t).withColumn("blk", block_of_target()), ["factor", "target"], "blk")
    return d.select("factor", "target", "n_dates", *[r6(c).alias(c) for c in ("mean_ic", "ci_lo", "ci_hi")])


boot_views("iid", "fic", ["factor", "target"], "1", 20260710)


@query("sta07_iid_bootstrap", "SELECT factor, target, n_obs AS n, round(mean,6)+0.0 AS mean, round(ci_lo,6)+0.0 AS ci_lo, round(ci_hi,6)+0.0 AS ci_hi FROM iid_ci")
def sta07(t):
    d = block_bootstrap(fic_of(t), ["factor", "target"], "date", "ic", 1, 1000, 20260710)
    return d.select("factor", "target", F.col("n_obs").alias("n"), *[r6(c).alias(c) for c in ("mean", "ci_lo", "ci_hi")])


def split_views(pre, dates, emb):
    view(f"{pre}_d", f"SELECT date, row_number() OVER (ORDER BY date)-1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM {dates})")
    view(pre, f"""SELECT k+1 AS split_id, a.date AS train_end, b.date AS test_start, c.date AS test_end FROM (
  SELECT k, t0+k*blk AS s, CASE WHEN k<3 THEN t0+k*blk+blk-1 ELSE n-1 END AS e, t0+k*blk-1-{emb} AS t FROM (SELECT n, greatest(CAST(floor(n*0.4::DOUBLE) AS BIGINT),1) AS t0, (n-greatest(CAST(floor(n*0.4::DOUBLE) AS BIGINT),1))//4 AS blk FROM (SELECT max(n) AS n FROM {pre}_d)), range(4) r(k) WHERE n>=20 AND blk>=5) x
JOIN {pre}_d a ON a.i=x.t JOIN {pre}_d b ON b.i=x.s JOIN {pre}_d c ON c.i=x.e WHERE x.t>=1""")


split_views("wf20", "ic20", 21)


@query("sta08_walk_forward_splits", "SELECT CAST(split_id AS BIGINT) AS split_id, strftime(train_end,'%Y-%m-%d') AS train_end, strftime(test_start,'%Y-%m-%d') AS test_start, strftime(test_end,'%Y-%m-%d') AS test_end FROM wf20")
def sta08(t):
    p = panel_of(t).where(F.col("ma20_dist_pct").isNotNull() & F.col("alpha20").isNotNull())
    return S.walk_forward_splits(p, embargo=21).select(F.col("split_id").cast("bigint").alias("split_id"), *[iso(c).alias(c) for c in ("train_end", "test_start", "test_end")])


_IC1 = "SELECT factor, {s} AS split_id, corr(rx,ry) AS ic, count(*) AS n FROM (SELECT factor, {s2} " + avg_rank_sql("x", "factor{p}") + " AS rx, " + avg_rank_sql("y", "factor{p}") + " AS ry FROM {f}) GROUP BY 1,2"
view("fl20", "SELECT * FROM fl WHERE target='alpha20'")
view("fl20d", "SELECT factor, date, i, n FROM (SELECT factor, date, row_number() OVER (PARTITION BY factor ORDER BY date)-1 AS i, count(*) OVER (PARTITION BY factor) AS n FROM (SELECT DISTINCT factor, date FROM fl20))")
view("fl20s", """
SELECT x.factor, k+1 AS split_id, a.date AS train_end, b.date AS test_start, c.date AS test_end FROM (
  SELECT factor, k, t0+k*blk AS s, CASE WHEN k<3 THEN t0+k*blk+blk-1 ELSE n-1 END AS e, t0+k*blk-22 AS t FROM (SELECT factor, n, greatest(CAST(floor(n*0.4::DOUBLE) AS BIGINT),1) AS t0, (n-greatest(CAST(floor(n*0.4::DOUBLE) AS BIGINT),1))//4 AS blk FROM (SELECT factor, max(n) AS n FROM fl20d GROUP BY 1)), range(4) r(k)) x
JOIN fl20d a ON a.factor=x.factor AND a.i=x.t JOIN fl20d b ON b.factor=x.factor AND b.i=x.s JOIN fl20d c ON c.factor=x.factor AND c.i=x.e
""")
view("fl20t", "SELECT f.factor, s.split_id, f.x, f.y FROM fl20 f JOIN fl20s s ON s.factor=f.factor AND f.date BETWEEN s.test_start AND s.test_end")
view("fl20tr", "SELECT f.factor, s.split_id, f.x, f.y FROM fl20 f JOIN fl20s s ON s.factor=f.factor AND f.date<=s.train_end")
view("ic_test", _IC1.format(s="split_id", s2="split_id,", p=", split_id", f="fl20t"))
view("ic_train", _IC1.format(s="split_id", s2="split_id,", p=", split_id", f="fl20tr"))
view("ic_pool", _IC1.format(s="0", s2="", p="", f="fl20"))


@query("sta09_factor_evaluation", """
SELECT p.factor, p.n, round(p.ic,6)+0.0 AS pooled_ic, round(b.mean,6)+0.0 AS mean_daily_ic, round(b.ci_lo,6)+0.0 AS ci_lo, round(b.ci_hi,6)+0.0 AS ci_hi, s.n_splits, round(s.lo,6)+0.0 AS min_split_ic, round(s.hi,6)+0.0 AS max_split_ic, (s.lo>0 OR s.hi<0)::INT AS consistent_sign
FROM ic_pool p JOIN bic_ci b ON b.factor=p.factor AND b.target='alpha20' JOIN (SELECT factor, count(*) AS n_splits, min(ic) AS lo, max(ic) AS hi FROM ic_test GROUP BY 1) s ON s.factor=p.factor""")
def sta09(t):
    rows = long_of(t, ("alpha20",))
    pooled = S.spearman(rows, ["factor"], "x", "y").select("factor", "n", r6("ic").alias("pooled_ic"))
    ci = S.ic_summary(fic_of(t).where(F.col("target") == "alpha20"), ["factor"], 21)
    sp = S.walk_forward_splits(rows, ["factor"], embargo=21)
    tests = S.spearman(S.in_test_block(rows, sp, ["factor"]), ["factor", "split_id"], "x", "y")
    g = tests.groupBy("factor").agg(F.count("ic").alias("n_splits"), F.min("ic").alias("lo"), F.max("ic").alias("hi"))
    return pooled.join(ci, "factor").join(g, "factor").select(
        "factor", "n", "pooled_ic", r6("mean_ic").alias("mean_daily_ic"), r6("ci_lo").alias("ci_lo"), r6("ci_hi").alias("ci_hi"), "n_splits",
        r6("lo").alias("min_split_ic"), r6("hi").alias("max_split_ic"), ((F.col("lo") > 0) | (F.col("hi") < 0)).cast("int").alias("consistent_sign"))


view("fic_r", "SELECT factor, target, regime_label AS regime, f.date, v FROM fic f JOIN regime r USING (date)")
boot_views("ric", "fic_r", ["factor", "target", "regime"], "CASE target WHEN 'alpha5' THEN 6 ELSE 21 END")


@query("sta10_regime_ic_slices", "SELECT factor, target, regime, n_obs AS n_dates, round(mean,6)+0.0 AS mean_ic, round(ci_lo,6)+0.0 AS ci_lo, round(ci_hi,6)+0.0 AS ci_hi, (n_obs<30)::INT AS thin FROM ric_ci")
def sta10(t):
    r = regime_of(t).select("date", F.col("regime_label").alias("regime"))
    s = fic_of(t).join(F.broadcast(r), "date").withColumn("blk", block_of_target())
    d = S.ic_summary(s, ["factor", "target", "regime"], "blk")
    return d.select("factor", "target", "regime", "n_dates", *[r6(c).alias(c) for c in ("mean_ic", "ci_lo", "ci_hi")], (F.col("n_dates") < 30).cast("int").alias("thin"))


@query("sta11_grid_scan", """
WITH c AS (SELECT factor, avg(abs(ic)) AS m FROM ic_train GROUP BY 1)
SELECT r.factor, CAST(r.split_id AS BIGINT) AS split_id, round(r.ic,6)+0.0 AS train_ic, r.n AS train_n, round(e.ic,6)+0.0 AS test_ic, e.n AS test_n, (c.m=(SELECT max(m) FROM c))::INT AS selected
FROM ic_train r JOIN ic_test e USING (factor, split_id) JOIN c USING (factor)""")
def sta11(t):
    rows = long_of(t, ("alpha20",))
    sp = S.walk_forward_splits(rows, ["factor"], embargo=21)
    te = S.spearman(S.in_test_block(rows, sp, ["factor"]), ["factor", "split_id"], "x", "y").select("factor", "split_id", F.col("ic").alias("test_ic"), F.col("n").alias("test_n"))
    days = rows.select("factor", "date").distinct().join(F.broadcast(sp.select("factor", "split_id", "train_end")), "factor").where(F.col("date") <= F.col("train_end"))
    tr = rows.join(F.broadcast(days.select("factor", "date", "split_id")), ["factor", "date"])
    tr = S.spearman(tr, ["factor", "split_id"], "x", "y").select("factor", "split_id", F.col("ic").alias("train_ic"), F.col("n").alias("train_n"))
    best = tr.groupBy("factor").agg(F.avg(F.abs("train_ic")).alias("_m"))
    best = best.agg(F.max_by("factor", "_m").alias("_best"))
    d = with_scalar(tr.join(te, ["factor", "split_id"]), best)
    return d.select("factor", F.col("split_id").cast("bigint").alias("split_id"), r6("train_ic").alias("train_ic"), "train_n", r6("test_ic").alias("test_ic"), "test_n",
                    (F.col("factor") == F.col("_best")).cast("int").alias("selected"))


view("lift12", f"SELECT coalesce(sub_industry,'none') AS category, alpha20 AS y, {IDENT} AS ident FROM panel WHERE alpha20 IS NOT NULL UNION ALL SELECT '（全體）', alpha20, {IDENT} FROM panel WHERE alpha20 IS NOT NULL")
poisson_views("ci12", "lift12", ["category"])


@query("sta12_category_lift", """
SELECT category, n, mean, median, win_rate, round(ci_lo,6)+0.0 AS ci_lo, round(ci_hi,6)+0.0 AS ci_hi FROM (
  SELECT category, count(*) AS n, round(avg(y),6)+0.0 AS mean, round(median(y),6)+0.0 AS median, round(avg((y>0)::INT),6) AS win_rate FROM lift12 GROUP BY 1) JOIN ci12_ci USING (category)""")
def sta12(t):
    p = panel_of(t).where(F.col("alpha20").isNotNull()).select(F.coalesce("sub_industry", F.lit("none")).alias("category"), F.col("alpha20").alias("y"), "date", ident().alias("ident"))
    rows = cut(C.with_total(p, ["category"]))
    d = C.pooled_table(rows, ["category"], "y").join(poisson_interval(rows, ["category"], "y", "ident"), "category")
    return d.select("category", "n", *[r6(c).alias(c) for c in ("mean", "median", "win_rate", "ci_lo", "ci_hi")])


_ED, _LB = (-3.0, -1.0, 0.0, 1.0, 3.0), ("<=-3", "-3..-1", "-1..0", "0..1", "1..3", ">3")


@query("sta13_extension_curve", " UNION ALL ".join(f"""SELECT {h} AS horizon_td, b AS bucket, count(*) AS n, round(median(y),6)+0.0 AS median, round(avg(y),6)+0.0 AS mean, round(avg((y>0)::INT),6) AS win_rate
FROM (SELECT alpha{h} AS y, CASE WHEN ma60_dist_pct<=-3 THEN '<=-3' WHEN ma60_dist_pct<=-1 THEN '-3..-1' WHEN ma60_dist_pct<=0 THEN '-1..0' WHEN ma60_dist_pct<=1 THEN '0..1' WHEN ma60_dist_pct<=3 THEN '1..3' ELSE '>3' END AS b
  FROM panel0 WHERE ma60_dist_pct IS NOT NULL AND alpha{h} IS NOT NULL) GROUP BY b""" for h in (5, 20)))
def sta13(t):
    p = panel_of(t).where(F.col("ma60_dist_pct").isNotNull())
    p = p.withColumn("cell", C.right_closed(F.col("ma60_dist_pct"), _ED, _LB))
    d = C.pooled_table(C.by_horizon(p, (5, 20), ["date", "cell"]), ["horizon", "cell"], "y")
    return d.select(F.col("horizon").alias("horizon_td"), F.col("cell").alias("bucket"), "n", *[r6(c).alias(c) for c in ("median", "mean", "win_rate")])


view("rkic", "SELECT date, sub_industry, corr(rx,ry) AS ic FROM (SELECT date, sub_industry, count(*) OVER (PARTITION BY date, sub_industry) AS n, " + avg_rank_sql("ma20_dist_pct", "date, sub_industry") + " AS rx, "
     + avg_rank_sql("alpha5", "date, sub_industry") + " AS ry FROM panel WHERE ma20_dist_pct IS NOT NULL AND alpha5 IS NOT NULL) WHERE n>=3 GROUP BY 1,2 HAVING stddev_pop(rx)*stddev_pop(ry)>1e-12")


@query("sta14_in_group_rank_skill", "SELECT count(*) AS n_groups, round(avg(-ic),6)+0.0 AS mean_skill, round(sqrt(sum((ic-m)*(ic-m))/(count(*)-1)/count(*)),6) AS se FROM (SELECT ic, avg(ic) OVER () AS m FROM rkic)")
def sta14(t):
    ic = S.spearman(panel_of(t), ["date", "sub_industry"], "ma20_dist_pct", "alpha5").where((F.col("n") >= 3) & F.col("ic").isNotNull())
    return ic.agg(F.count(F.lit(1)).alias("n_groups"), r6(F.avg(-F.col("ic"))).alias("mean_skill"), r6(F.stddev_samp("ic") / F.sqrt(F.count(F.lit(1)))).alias("se"))


def verdict(sign, mean, lo, hi, pos, neg, n_valid, n_dates, min_effect=0.03):
    """Pre-registered ordered decision on one statistics row."""
    ci_ok = F.coalesce(~((lo < 0) & (hi > 0)), F.lit(False))
    wf_ok = (n_valid >= 3) & (F.greatest(pos, neg) >= F.ceil(n_valid * 0.8))
    wf_sign = F.when(pos > neg, 1).when(neg > pos, -1).otherwise(0)
    m_sign = F.when(mean > 0, 1).otherwise(-1)
    good = (F.abs(mean) >= min_effect) & ci_ok & wf_ok & (wf_sign == m_sign)
    return F.when(n_dates < 30, "樣本不足不可判").when(mean.isNull(), "無證據").when(good, F.when(m_sign == sign, "方向成立").otherwise("反向顯著")).otherwise("無證據")


@query("sta15_verdicts", """
SELECT b.factor, CASE WHEN b.n_obs<30 THEN '樣本不足不可判' WHEN abs(b.mean)>=0.03 AND NOT (b.ci_lo<0 AND b.ci_hi>0) AND nv>=3 AND greatest(p,g)>=ceil(nv*0.8::DOUBLE) AND (CASE WHEN p>g THEN 1 WHEN g>p THEN -1 ELSE 0 END)=(CASE WHEN b.mean>0 THEN 1 ELSE -1 END)
  THEN CASE WHEN b.mean>0 THEN '方向成立' ELSE '反向顯著' END ELSE '無證據' END AS verdict
FROM bic_ci b JOIN (SELECT factor, count(*) FILTER (WHERE ic>0) AS p, count(*) FILTER (WHERE ic<0) AS g, count(ic) AS nv FROM ic_test GROUP BY 1) s ON s.factor=b.factor WHERE b.target='alpha20'""")
def sta15(t):
    rows = long_of(t, ("alpha20",))
    ci = S.ic_summary(fic_of(t).where(F.col("target") == "alpha20"), ["factor"], 21)
    sp = S.walk_forward_splits(rows, ["factor"], embargo=21)
    te = S.spearman(S.in_test_block(rows, sp, ["factor"]), ["factor", "split_id"], "x", "y")
    g = te.groupBy("factor").agg(F.count(F.when(F.col("ic") > 0, 1)).alias("p"), F.count(F.when(F.col("ic") < 0, 1)).alias("g"), F.count("ic").alias("nv"))
    c = F.col
    return ci.join(g, "factor").select("factor", verdict(1, c("mean_ic"), c("ci_lo"), c("ci_hi"), c("p"), c("g"), c("nv"), c("n_dates")).alias("verdict"))


# ------------------------------------------------------------- neutral weekly statistics


def weekly_groups(t, factor="ma20_dist_pct", target="alpha20", min_group=3):
    """Weekly rows of groups with enough members, with the group size."""
    d = panel_of(t).join(F.broadcast(P.weekly_dates(t.prices).select("date")), "date", "left_semi")
    d = d.where(F.col(factor).isNotNull() & F.col(target).isNotNull() & F.col("sub_industry").isNotNull())
    n = d.groupBy("date", "sub_industry").agg(F.count(F.lit(1)).alias("ng"))
    return d.join(n, ["date", "sub_industry"]).where(F.col("ng") >= min_group)


view("wkg", "SELECT * FROM (SELECT date, entity, sub_industry, ma20_dist_pct AS f, alpha20 AS y, vol_ratio, volume, count(*) OVER (PARTITION BY date, sub_industry) AS ng FROM panel WHERE date IN (SELECT date FROM weekly) AND ma20_dist_pct IS NOT NULL AND alpha20 IS NOT NULL) WHERE ng>=3")
view("wkc", "SELECT date, sub_industry, ng, (" + avg_rank_sql("f", "date, sub_industry") + "-(ng+1)/2.0::DOUBLE)/ng AS cx, (" + avg_rank_sql("y", "date, sub_industry") + "-(ng+1)/2.0::DOUBLE)/ng AS cy FROM wkg")
view("wkic", "SELECT date, sum(cx*cy)/sqrt(sum(cx*cx)*sum(cy*cy)) AS v, count(*) AS n_names, count(DISTINCT sub_industry) AS n_groups FROM wkc GROUP BY 1 HAVING count(*)>=6 AND sum(cx*cx)*sum(cy*cy)>0")


def weekly_ic_of(t):
    def build():
        k = ["date", "sub_industry"]
        d = average_ranks(weekly_groups(t).select(*k, "ng", "ma20_dist_pct", "alpha20"), k, {"ma20_dist_pct": "rx", "alpha20": "ry"})
        half = (F.col("ng") + 1) / F.lit(2.0)
        d = d.select("date", "sub_industry", ((F.col("rx") - half) / F.col("ng")).alias("cx"), ((F.col("ry") - half) / F.col("ng")).alias("cy"))
        den = F.sqrt(F.sum(F.col("cx") * F.col("cx")) * F.sum(F.col("cy") * F.col("cy")))
        g = d.groupBy("date").agg((F.sum(F.col("cx") * F.col("cy")) / F.nullif(den, F.lit(0.0))).alias("ic"), F.count(F.lit(1)).alias("n_names"), F.countDistinct("sub_industry").alias("n_groups"))
        return g.where((F.col("n_names") >= 6) & F.col("ic").isNotNull())

    return staged(t.spark, t.root, "weekly_ic", build)


@query("sta16_neutral_weekly_ic", "SELECT strftime(date,'%Y-%m-%d') AS date, round(v,6)+0.0 AS ic, n_names, n_groups FROM wkic")
def sta16(t):
    return weekly_ic_of(t).select(iso("date").alias("date"), r6("ic").alias("ic"), "n_names", "n_groups")


view("wpick", """
SELECT g.date, g.sub_industry, f.entity AS pick, b.entity AS base_pick, f.y-g.m AS m2, f.y-b.y AS m3 FROM (SELECT date, sub_industry, avg(y) AS m FROM wkg GROUP BY 1,2) g
JOIN (SELECT *, row_number() OVER (PARTITION BY date, sub_industry ORDER BY f DESC, volume DESC, entity) AS k FROM wkg) f ON f.date=g.date AND f.sub_industry=g.sub_industry AND f.k=1
JOIN (SELECT *, row_number() OVER (PARTITION BY date, sub_industry ORDER BY abs(f), volume DESC, entity) AS k FROM wkg) b ON b.date=g.date AND b.sub_industry=g.sub_industry AND b.k=1
""")


def picks_of(t):
    """Factor-best and baseline-best of each (week, group): max_by keeps one row per group, map-side."""
    d = weekly_groups(t)
    best = F.max_by(F.struct("entity", "alpha20"), F.struct("ma20_dist_pct", "volume", -F.col("entity")))
    base = F.max_by(F.struct("entity", "alpha20"), F.struct(-F.abs("ma20_dist_pct"), F.col("volume"), -F.col("entity")))
    g = d.groupBy("date", "sub_industry").agg(best.alias("f"), base.alias("b"), F.avg("alpha20").alias("m"))
    return g.select("date", "sub_industry", F.col("f.entity").alias("pick"), F.col("b.entity").alias("base_pick"), (F.col("f.alpha20") - F.col("m")).alias("m2"), (F.col("f.alpha20") - F.col("b.alpha20")).alias("m3"))


@query("sta17_pick_table", "SELECT strftime(date,'%Y-%m-%d') AS date, sub_industry, pick, base_pick, round(m2,6)+0.0 AS m2, round(m3,6)+0.0 AS m3 FROM wpick")
def sta17(t):
    return picks_of(t).select(iso("date").alias("date"), "sub_industry", "pick", "base_pick", r6("m2").alias("m2"), r6("m3").alias("m3"))


@query("sta17_weekly_pick", "SELECT strftime(date,'%Y-%m-%d') AS date, round(avg(m2),6)+0.0 AS m2, round(avg(m3),6)+0.0 AS m3, count(*) AS n_groups, round(avg((pick=base_pick)::INT),6) AS same_pick_rate FROM wpick GROUP BY date")
def sta17b(t):
    return picks_of(t).groupBy(iso("date").alias("date")).agg(r6(F.avg("m2")).alias("m2"), r6(F.avg("m3")).alias("m3"), F.count(F.lit(1)).alias("n_groups"),
                                                           r6(F.avg((F.col("pick") == F.col("base_pick")).cast("double"))).alias("same_pick_rate"))


view("wkic1", "SELECT 1 AS g, date, v FROM wkic")
boot_views("wsum", "wkic1", ["g"], "5")
boot_views("wsumb", "wkic1", ["g"], "5", 42, 1000, 0.0125)


@query("sta18_series_summary", """
SELECT a.n_obs AS n, round(a.mean,6)+0.0 AS mean, round(a.ci_lo,6)+0.0 AS ci_lo, round(a.ci_hi,6)+0.0 AS ci_hi, round(b.ci_lo,6)+0.0 AS bonf_lo, round(b.ci_hi,6)+0.0 AS bonf_hi, round(s1,6)+0.0 AS s1, round(s2,6)+0.0 AS s2, round(s3,6)+0.0 AS s3
FROM wsum_ci a JOIN wsumb_ci b ON true JOIN (SELECT avg(v) FILTER (WHERE i<b1) AS s1, avg(v) FILTER (WHERE i>=b1 AND i<b2) AS s2, avg(v) FILTER (WHERE i>=b2) AS s3
  FROM (SELECT v, row_number() OVER (ORDER BY date)-1 AS i, round_even(count(*) OVER ()/3.0,0) AS b1, round_even(2*count(*) OVER ()/3.0,0) AS b2 FROM wkic)) ON true""")
def sta18(t):
    from pyspark.sql import Window

    s = weekly_ic_of(t).withColumn("g", F.lit(1))
    a = block_bootstrap(s, ["g"], "date", "ic", 5)
    b = block_bootstrap(s, ["g"], "date", "ic", 5, alpha=0.0125, lo="bonf_lo", hi="bonf_hi").drop("mean", "n_obs")
    n = F.count(F.lit(1)).over(Window.partitionBy("g"))
    d = s.select("g", "ic", (F.row_number().over(Window.partitionBy("g").orderBy("date")) - 1).alias("i"), F.bround(n / 3.0).alias("b1"), F.bround(2 * n / 3.0).alias("b2"))
    seg = d.groupBy("g").agg(F.avg(F.when(F.col("i") < F.col("b1"), F.col("ic"))).alias("s1"), F.avg(F.when((F.col("i") >= F.col("b1")) & (F.col("i") < F.col("b2")), F.col("ic"))).alias("s2"),
                             F.avg(F.when(F.col("i") >= F.col("b2"), F.col("ic"))).alias("s3"))
    return a.join(b, "g").join(seg, "g").select(F.col("n_obs").alias("n"), *[r6(c).alias(c) for c in ("mean", "ci_lo", "ci_hi", "bonf_lo", "bonf_hi", "s1", "s2", "s3")])


@query("sta18_yearly_ic", "SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n_weeks, round(avg(v),6)+0.0 AS mean_ic FROM wkic GROUP BY 1")
def sta18b(t):
    return weekly_ic_of(t).groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n_weeks"), r6(F.avg("ic")).alias("mean_ic"))


@query("sta19_feasibility", """
SELECT strftime(date,'%Y-%m-%d') AS date, count(*) AS n_names, count(ma60_dist_pct) AS n_factor, count(DISTINCT sub_industry) AS n_groups, count(*) FILTER (WHERE coalesce(vol_ratio>=0.5,false)) AS n_liquid FROM panel WHERE date IN (SELECT date FROM weekly) GROUP BY date""")
def sta19(t):
    d = panel_of(t).join(F.broadcast(P.weekly_dates(t.prices).select("date")), "date", "left_semi")
    return d.groupBy(iso("date").alias("date")).agg(F.count(F.lit(1)).alias("n_names"), F.count("ma60_dist_pct").alias("n_factor"), F.countDistinct("sub_industry").alias("n_groups"),
                                                    F.count(F.when(F.col("vol_ratio") >= 0.5, 1)).alias("n_liquid"))


# permutation null: f is dealt within the date by a keyed bijection of its places
N_PERM = 200


def convergence_views(pre, rows, keys, abs_min):
    """SQL twin of ``study.convergence`` over view ``rows`` (keys, date, entity, f, r, a)."""
    ks = ", ".join([*keys, "date"])
    kk = "".join(f"{k}, " for k in keys)
    rnd = lambda v, r, m: f"((((({v})*48271+key*69621+{r}*16807+12345)%2147483647)*48271%2147483647)//1024%{m})"
    even = lambda x, r: f"((({x}//sb)+{rnd(f'{x}%sb', r, 'sa')})%sa)*sb+{x}%sb"
    odd = lambda x, r: f"({x}//sb)*sb+({x}%sb+{rnd(f'{x}//sb', r, 'sb')})%sb"
    view(f"{pre}_at", f"""SELECT *, CAST(ceil(n/sa::DOUBLE) AS BIGINT) AS sb FROM (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS sa FROM (SELECT {ks}, f, r, a, row_number() OVER (PARTITION BY {ks} ORDER BY entity)-1 AS k, count(*) OVER (PARTITION BY {ks}) AS n
  FROM {rows} WHERE f IS NOT NULL AND r IS NOT NULL AND a IS NOT NULL))""")
    view(f"{pre}_x4", f"""SELECT *, {odd('x3', 3)} AS x4 FROM (SELECT *, {even('x2', 2)} AS x3 FROM (SELECT *, {odd('x1', 1)} AS x2 FROM (SELECT *, {even('k', 0)} AS x1 FROM (
  SELECT *, CAST(p AS BIGINT)*1000003+(date-DATE '1970-01-01') AS key FROM {pre}_at, range({N_PERM}) q(p) WHERE abs(f)>={abs_min}))))""")
    step = f"CASE WHEN i%2=0 THEN {even('s', '(i%4)')} ELSE {odd('s', '(i%4)')} END"
    view(f"{pre}_to", f"""SELECT {ks}, p, f, CASE WHEN x4<n THEN x4 ELSE -list_reduce(list_prepend(x4, range(0, 4*(sa*sb-n)+4)), lambda s, i: CASE WHEN s<0 THEN s WHEN i%4=3 AND ({step})<n THEN -({step})-1 ELSE {step} END)-1 END AS k FROM {pre}_x4""")
    on = " AND ".join(f"x.{k}=y.{k}" for k in [*keys, "date"])
    view(f"{pre}_s", f"SELECT {''.join(f'x.{k}, ' for k in keys)}p, avg(((y.r>0)=(x.f>0))::INT) AS hr, avg(((y.a>0)=(x.f>0))::INT) AS ha FROM {pre}_to x JOIN {pre}_at y ON {on} AND x.k=y.k GROUP BY {''.join(f'x.{k}, ' for k in keys)}p")
    lo, hi = int(0.025 * N_PERM) + 1, min(N_PERM - 1, int(0.975 * N_PERM)) + 1
    band = ", ".join(f"round(avg(h{v}),6) AS perm_{v}_mean, round(list_sort(list(h{v}))[{lo}],6) AS perm_{v}_lo, round(list_sort(list(h{v}))[{hi}],6) AS perm_{v}_hi" for v in "ra")
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    view(f"{pre}_null", f"SELECT {kk}{band} FROM {pre}_s {group}")
    view(f"{pre}_real", f"SELECT {kk}count(*) AS n, round(avg(((r>0)=(f>0))::INT),6) AS hit_r, round(avg(((a>0)=(f>0))::INT),6) AS hit_a FROM {pre}_at WHERE abs(f)>={abs_min} {group}")
    return f"SELECT * FROM {pre}_real " + (f"JOIN {pre}_null USING ({', '.join(keys)})" if keys else f"CROSS JOIN {pre}_null")


view("cv", "SELECT date, entity, ma20_dist_pct AS f, r20 AS r, alpha20 AS a FROM panel0 WHERE date IN (SELECT date FROM weekly)")
PERM_COLS = ["hit_r", "hit_a", *[f"perm_{v}_{x}" for v in "ra" for x in ("mean", "lo", "hi")]]


@query("sta20_convergence", convergence_views("cvp", "cv", [], 1))
def sta20(t):
    """Sign agreement against 200 within-date permutations, with bands for return and alpha."""
    d = panel_of(t).join(F.broadcast(P.weekly_dates(t.prices).select("date")), "date", "left_semi")
    d = d.select("date", "entity", F.col("ma20_dist_pct").alias("f"), F.col("r20").alias("r"), F.col("alpha20").alias("a"))
    return U.convergence(d, [], 1.0, N_PERM).select("n", *[r6(c).alias(c) for c in PERM_COLS])


view("lev", "SELECT date, close AS price, ma60_dist_pct, r20, close/(1+ma60_dist_pct/100) AS fv FROM panel0 WHERE date IN (SELECT date FROM weekly) AND ma60_dist_pct IS NOT NULL AND r20 IS NOT NULL AND r20>-100")


@query("sta21_level_error", """
SELECT half, count(*) AS n, round(median(abs(ln(price*(1+r20/100)/fv))),6) AS err_fv, round(median(abs(ln(price*(1+r20/100)/price))),6) AS err_naive, round(avg((abs(ln(price*(1+r20/100)/fv))<abs(ln(price*(1+r20/100)/price)))::INT),6) AS share_fv_better
FROM (SELECT *, CASE WHEN date < (SELECT d[len(d)//2+1] FROM (SELECT list_sort(list(DISTINCT date)) AS d FROM lev)) THEN 'first' ELSE 'second' END AS half FROM lev) GROUP BY 1""")
def sta21(t):
    d = panel_of(t).join(F.broadcast(P.weekly_dates(t.prices).select("date")), "date", "left_semi").where(F.col("ma60_dist_pct").isNotNull() & (F.col("r20") > -100))
    fut = F.col("close") * (1 + F.col("r20") / 100)
    d = d.select("date", F.abs(F.ln(fut / (F.col("close") / (1 + F.col("ma60_dist_pct") / 100)))).alias("e1"), F.abs(F.ln(fut / F.col("close"))).alias("e2"))
    days = S.date_index(d)
    mid = days.where(F.col("i") == F.floor(F.col("n_dates") / 2)).select(F.col("date").alias("_mid"))
    d = with_scalar(d, mid).withColumn("half", F.when(F.col("date") < F.col("_mid"), "first").otherwise("second"))
    g = d.groupBy("half").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("e1") < F.col("e2")).cast("double"))).alias("share_fv_better"))
    q1 = exact_quantiles(d, ["half"], "e1", {"err_fv": 0.5}).withColumn("err_fv", r6("err_fv"))
    q2 = exact_quantiles(d, ["half"], "e2", {"err_naive": 0.5}).withColumn("err_naive", r6("err_naive"))
    return g.join(q1, "half").join(q2, "half")
