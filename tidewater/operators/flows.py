"""Group fund flows, rotation board, and flow-derived labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.exprs import clip, count_if, own_rows, rn, roll_avg, roll_z, running, share, with_scalar, with_whole_z
from tidewater.operators.momentum import basket_position, window_return_vs_median
from tidewater.operators.order import group_median
from tidewater.operators.panel import clean_prices
from tidewater.sources.staging import cut

NETS = ("total_net", "foreign_net", "trust_net")
FLOW = {"total_net": "net_flow", "foreign_net": "foreign_flow", "trust_net": "trust_flow"}
MOM = {"total_net": "flow", "foreign_net": "foreign", "trust_net": "trust"}
# fixed label values
Q_NEXT, Q_TREND, Q_DISTRIBUTE, Q_COOL = "下一棒", "主升續勢", "出貨警訊", "退潮觀察"
FASTER, SLOWER = "加速", "放緩"
TURN_IN, TURN_OUT = "資金回流", "退潮"
TREND_WEIGHTS = {"basket_ma": 0.40, "member_breadth": 0.35, "leader_rs": 0.25}


def numbered_days(df: DataFrame) -> DataFrame:
    """date, idx from 0: one row per distinct date."""
    return df.select("date").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("idx"))


def _breadth(flows_i: DataFrame, membership: DataFrame, n_days: DataFrame) -> DataFrame:
    """Change points of "rolling sum > 0" per member, summed per (grp, idx).

    A rolling sum over the last w market days only changes on a day with a row
    and w days later, so members are never expanded to every day.
    """
    spec = {"flow_breadth_5d": ("total_net", 5), "flow_breadth_20d": ("total_net", 20), "foreign_breadth_5d": ("foreign_net", 5)}
    pts = flows_i.select("entity", "total_net", "foreign_net", "idx").repartition("entity").select(  # shuffled once, before each row becomes three
        "entity", "total_net", "foreign_net", F.explode(F.array(F.lit(0), F.lit(5), F.lit(20))).alias("_k"), "idx"
    )
    pts = pts.select(
        "entity", (F.col("idx") + F.col("_k")).alias("idx"),
        *[F.when(F.col("_k") == 0, F.col(x)).otherwise(F.lit(0)).alias(x) for x in ("total_net", "foreign_net")],
    ).groupBy("entity", "idx").agg(F.sum("total_net").alias("total_net"), F.sum("foreign_net").alias("foreign_net"))
    w = Window.partitionBy("entity").orderBy("idx")
    on = {k: (F.sum(col).over(w.rangeBetween(-(n - 1), 0)) > 0).cast("int").alias(k) for k, (col, n) in spec.items()}
    st = pts.select("entity", "idx", *on.values())
    st = st.select("entity", "idx", *[(F.col(k) - F.lag(k, 1, 0).over(w)).alias(k) for k in spec])
    st = st.where(F.expr(" or ".join(f"{k} <> 0" for k in spec)))
    return membership.join(st, "entity").groupBy("grp", "idx").agg(*[F.sum(k).alias(f"d_{k}") for k in spec])


def group_fund_flows(membership: DataFrame, flows: DataFrame, prices: DataFrame | None = None,
                     short: int = 5, long: int = 20) -> DataFrame:
    """Per (group, market day): rolling flows, momentum, breadth and concentration.

    The sum over members of rolling sums is the rolling sum of the group's
    daily sum, so only group-day totals enter the windows.
    """
    days = numbered_days(flows)
    days = cut(days)
    fi = cut(flows.join(F.broadcast(days), "date"))
    n_days = days.agg(F.count(F.lit(1)).alias("n_days"))
    vol = prices.select("date", "entity", F.col("volume").cast("bigint").alias("volume")) if prices is not None else None
    member_day = membership.join(fi.select("entity", "idx", *NETS), "entity")
    daily = member_day.groupBy("grp", "idx").agg(*[F.sum(x).alias(x) for x in NETS])
    sizes = membership.groupBy("grp").agg(F.countDistinct("entity").alias("members"))
    grid = with_scalar(sizes, n_days).select(
        "grp", "members", F.explode(F.sequence(F.lit(0), (F.col("n_days") - 1).cast("int"))).alias("idx")
    )
    g = grid.join(daily, ["grp", "idx"], "left").join(_breadth(fi, membership, n_days), ["grp", "idx"], "left")
    if vol is not None:
        vd = membership.join(vol.join(F.broadcast(days), "date"), "entity").groupBy("grp", "idx").agg(F.sum("volume").alias("_vol"))
        g = g.join(vd, ["grp", "idx"], "left")
    w = Window.partitionBy("grp").orderBy("idx")

    def total(x: str, n: int) -> Column:
        return F.sum(F.coalesce(x, F.lit(0))).over(w.rowsBetween(-(n - 1), 0))

    cols = {f"{FLOW[x]}_{n}d": total(x, n) for x in NETS for n in (short, long)}
    breadth = ["flow_breadth_5d", "flow_breadth_20d", "foreign_breadth_5d"]
    cols |= {k: F.sum(F.coalesce(f"d_{k}", F.lit(0))).over(running(w)) / F.col("members") for k in breadth}
    if vol is not None:
        cols |= {f"_v{n}": total("_vol", n) for n in (short, long)}
    g = g.withColumns(cols)
    mom = {
        f"{MOM[x]}_momentum": F.coalesce(
            F.col(f"{FLOW[x]}_{short}d") - F.lag(f"{FLOW[x]}_{short}d", short).over(w), F.lit(0)
        ) for x in NETS
    }
    g = g.withColumns(mom)
    conc = []
    for n in (short, long):
        e = F.when(F.col(f"_v{n}") > 0, F.col(f"net_flow_{n}d") / F.col(f"_v{n}")) if vol is not None else F.lit(None).cast("double")
        conc.append(e.alias(f"flow_concentration_{n}d"))
    keep = [f"{FLOW[x]}_{n}d" for x in NETS for n in (short, long)] + list(mom) + breadth
    return g.join(F.broadcast(days), "idx").select("grp", "date", "members", *keep, *conc)


SIGNALS = [f"{FLOW[x]}_{n}d" for x in NETS for n in (5, 20)] + [f"{MOM[x]}_momentum" for x in NETS] + [
    "flow_concentration_5d", "flow_concentration_20d"]


def standardize(flows: DataFrame, cols: Sequence[str] = SIGNALS, window: int = 60, min_n: int = 30) -> DataFrame:
    """{c}_z: own-history z of every signal of a group; one sort for all columns."""
    w = own_rows("grp")
    ratio = [x for x in cols if "concentration" in x]
    whole = [x for x in cols if x not in ratio]
    return with_whole_z(flows, w, whole, window, min_n).withColumns({f"{x}_z": roll_z(x, w, window, min_n) for x in ratio})


def rank_flows(flows: DataFrame, by: str = "net_flow_20d", prev: DataFrame | None = None, min_members: int = 1) -> DataFrame:
    """Latest date, groups with enough members, ordinal rank and week-over-week delta."""
    d = with_scalar(flows, flows.agg(F.max("date").alias("_last")))
    d = d.where((F.col("date") == F.col("_last")) & (F.col("members") >= min_members)).drop("_last")
    d = d.withColumn("radar_rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(by), "grp")))
    if prev is None:
        return d.withColumn("rank_delta", F.lit(None).cast("int"))
    p = prev.groupBy("grp").agg(F.min("radar_rank").alias("_p"))
    return d.join(p, "grp", "left").withColumn("rank_delta", F.col("_p") - F.col("radar_rank")).drop("_p")


def member_trend_inputs(prices: DataFrame, ma_long: int = 60, rs_window: int = 20) -> DataFrame:
    w = own_rows()
    return clean_prices(prices).select(
        "date", "entity", (F.col("close") > roll_avg("close", w, ma_long, 1)).alias("above"),
        (F.col("close") / F.lag("close", rs_window).over(w) - 1.0).alias("ret_w"),
    )


def trend_score_series(prices: DataFrame, membership: DataFrame, baskets: DataFrame) -> DataFrame:
    """Daily 0-100 trend score per group; absent parts count as 0."""
    w = own_rows("grp")
    i = F.col("basket_index")
    ma = baskets.select(
        "grp", "date",
        ((i > roll_avg(i, w, 20, 1)).cast("double") * 0.5 + (i > roll_avg(i, w, 60, 1)).cast("double") * 0.5).alias("c_ma"),
    )
    px = cut(member_trend_inputs(prices))
    mem = membership.join(px, "entity")
    med = group_median(px, ["date"], "ret_w", "_med")
    agg = mem.groupBy("grp", "date").agg(share(F.col("above")).alias("breadth"), F.max("ret_w").alias("_lead"))
    lead = agg.where(F.col("_lead").isNotNull()).join(med, "date").withColumn("leader_rs", F.col("_lead") - F.col("_med"))
    d = Window.partitionBy("date")
    ties = F.count(F.lit(1)).over(Window.partitionBy("date", "leader_rs"))
    rank = F.rank().over(d.orderBy("leader_rs")) + (ties - 1) / F.lit(2.0)
    n = F.count(F.lit(1)).over(d)
    lead = lead.select("grp", "date", F.when(n > 1, (rank - 1) / (n - 1)).otherwise(F.lit(0.5)).alias("c_rs"))
    k = ["grp", "date"]
    t = ma.join(agg.select(*k, "breadth"), k, "left").join(lead, k, "left")
    z = F.lit(0.0)
    score = (
        F.coalesce("c_ma", z) * TREND_WEIGHTS["basket_ma"] + F.coalesce("breadth", z) * TREND_WEIGHTS["member_breadth"]
        + F.coalesce("c_rs", z) * TREND_WEIGHTS["leader_rs"]
    )
    return t.select(*k, rn(score * 100, 1).alias("trend_score"))


MA_STATES = ("雙線上", "月線上", "季線上", "雙線下")


def trend_scores_asof(baskets: DataFrame, membership: DataFrame, prices: DataFrame) -> DataFrame:
    """Trend score, MA state, breadth and leader of each group at its latest date."""
    w = own_rows("grp")
    i = F.col("basket_index")
    b = baskets.select(
        "grp", "date", (i > roll_avg(i, w, 20, 1)).alias("s"), (i > roll_avg(i, w, 60, 1)).alias("l"))
    ma = b.groupBy("grp").agg(F.max_by("s", "date").alias("s"), F.max_by("l", "date").alias("l"))
    state = (
        F.when(F.col("s") & F.col("l"), MA_STATES[0]).when(F.col("s"), MA_STATES[1])
        .when(F.col("l"), MA_STATES[2]).otherwise(MA_STATES[3])
    )
    ma = ma.select("grp", (F.col("s").cast("double") * 0.5 + F.col("l").cast("double") * 0.5).alias("c_ma"), state.alias("trend_ma_state"))
    px = member_trend_inputs(prices)
    snap = with_scalar(px, px.agg(F.max("date").alias("_last"))).where(F.col("date") == F.col("_last"))
    breadth = membership.join(snap, "entity").groupBy("grp").agg(share(F.col("above")).alias("above_ma60_breadth"))
    rs = window_return_vs_median(prices, 20)
    lead = membership.join(rs, "entity").groupBy("grp").agg(
        F.max_by("entity", F.struct("rs_pct", -F.col("entity"))).alias("leader_entity"), F.max("rs_pct").alias("_rs"))
    ties = F.count(F.lit(1)).over(Window.partitionBy("_rs"))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rank = F.rank().over(Window.orderBy("_rs")) + (ties - 1) / F.lit(2.0)
    lead = lead.withColumn("c_rs", F.when(n > 1, (rank - 1) / (n - 1)).otherwise(F.lit(0.5)))
    z = F.lit(0.0)
    score = (
        F.coalesce("c_ma", z) * TREND_WEIGHTS["basket_ma"] + F.coalesce("above_ma60_breadth", z) * TREND_WEIGHTS["member_breadth"]
        + F.coalesce("c_rs", z) * TREND_WEIGHTS["leader_rs"]
    )
    return ma.join(breadth, "grp", "full").join(lead, "grp", "full").select(
        "grp", rn(score * 100, 1).alias("trend_score"), "trend_ma_state", "above_ma60_breadth", "leader_entity",
        rn("_rs", 1).alias("leader_rs_pct"))


OVERHEAT, OPPOSED = "過熱", "土洋對作"


def trend_leaders(membership: DataFrame, prices: DataFrame, flows: DataFrame, top_n: int = 15, min_amount: float = 1e8,
                  overheat_pct: float = 40.0, cross_shares: float = 5e6, cross_rel_pct: float = 4.0) -> DataFrame:
    """Top n by relative strength above a liquidity floor, with overheat and opposed-flow flags."""
    w = own_rows()
    px = clean_prices(prices).select(
        "date", "entity", "close", roll_avg("close", w, 60, 1).alias("ma"),
        roll_avg(F.col("close") * F.col("volume"), w, 20, 1).alias("amt"), F.sum("volume").over(w.rowsBetween(-19, 0)).alias("vol20"))
    snap = with_scalar(px, px.agg(F.max("date").alias("_last"))).where(F.col("date") == F.col("_last"))
    board = (
        snap.join(window_return_vs_median(prices, 20), "entity").where(F.col("amt") >= min_amount)
        .withColumn("dist", (F.col("close") / F.col("ma") - 1) * 100)
        .orderBy(F.desc("rs_pct"), "entity").limit(top_n)
    )
    recent = flows.select("date").distinct().orderBy(F.desc("date")).limit(20)
    f20 = flows.join(F.broadcast(recent), "date", "left_semi").groupBy("entity").agg(
        F.sum("foreign_net").alias("f20"), F.sum("trust_net").alias("t20"))
    b = board.join(f20, "entity", "left")
    weak = F.least(F.abs("f20"), F.abs("t20"))
    cross = F.coalesce((F.col("f20") * F.col("t20") < 0) & (weak >= cross_shares) & (weak >= F.col("vol20") * cross_rel_pct / 100), F.lit(False))
    hot = F.coalesce(F.col("dist") > overheat_pct, F.lit(False))
    flags = F.concat_ws(";", F.when(hot, OVERHEAT), F.when(cross, OPPOSED))
    tags = membership.join(F.broadcast(board.select("entity")), "entity", "left_semi").groupBy("entity").agg(
        F.concat_ws("、", F.array_sort(F.collect_list("grp"))).alias("sub_industry"))
    return b.join(tags, "entity", "left").select(
        "entity", F.coalesce("sub_industry", F.lit("")).alias("sub_industry"), rn("ret_pct", 1).alias("ret_pct"),
        rn("rs_pct", 1).alias("rs_pct"), rn("dist", 1).alias("dist_ma60_pct"), flags.alias("flags"))


def quadrant(flow: Column, above_low: Column, low_pct: float, null_if_unknown: bool = True) -> Column:
    inflow, risen = flow > 0, above_low > low_pct
    e = F.when(inflow & ~risen, Q_NEXT).when(inflow & risen, Q_TREND).when(~inflow & risen, Q_DISTRIBUTE).otherwise(Q_COOL)
    return F.when(above_low.isNotNull(), e) if null_if_unknown else e


def freshness(m: Column) -> Column:
    return F.when(m > 0, FASTER).when(m < 0, SLOWER)


def flow_turn(long: Column, short: Column) -> Column:
    return F.when((long < 0) & (short > 0), TURN_IN).when((long > 0) & (short < 0), TURN_OUT)


def rotation_table(flows: DataFrame, baskets: DataFrame, trend: DataFrame, prev: DataFrame | None = None,
                   signal: str = "trust_flow_20d", threshold: float = 1.0, min_members: int = 3,
                   low_pct: float = 10.0, ceiling: float = 60.0, precise_pct: float = 5.0) -> DataFrame:
    """Weekly board of groups: rank, quadrant, entry trigger, room-weighted score, freshness."""
    fz = standardize(flows).withColumn("entry_triggered", F.coalesce(F.col(f"{signal}_z") > threshold, F.lit(False)))
    fz = fz.withColumn("confirm_triggered", F.coalesce(F.col("flow_breadth_5d") > 0.6, F.lit(False)))
    t = rank_flows(fz.join(trend, "grp", "left"), "trend_score", prev, min_members)
    pos = basket_position(baskets).groupBy("grp").agg(
        F.max_by("above_low_pct", "date").alias("above_low_pct"), F.max_by("basket_ret_5d", "date").alias("basket_ret_5d"))
    t = t.join(pos, "grp", "left")
    long, short, al = F.col("net_flow_20d"), F.col("net_flow_5d"), F.col("above_low_pct")
    room = clip(1 - al / ceiling, 0.0, 1.0)
    t = t.withColumn("quadrant", quadrant(long, al, low_pct))
    return t.withColumns({
        "next_precision": F.coalesce((F.col("quadrant") == Q_NEXT) & (al <= precise_pct), F.lit(False)),
        "net_flow_20d_lots": F.round(long / 1000, 0), "net_flow_5d_lots": F.round(short / 1000, 0),
        "flow_momentum_lots": F.round(F.col("flow_momentum") / 1000, 0),
        "cp_score": rn(F.col("net_flow_20d_z") * room, 2),
        "freshness": freshness(F.col("flow_momentum")), "flow_turn": flow_turn(long, short),
    })


def rotation_signal_panel(flows_z: DataFrame, position: DataFrame, trend: DataFrame, snapshots: DataFrame,
                          entry_col: str = "trust_flow_20d_z", threshold: float = 1.0, min_members: int = 5,
                          low_pct: float = 10.0) -> DataFrame:
    """The same labels point-in-time for each weekly snapshot, with rank deltas."""
    k = ["grp", "date"]
    s = flows_z.join(F.broadcast(snapshots.select("date")), "date", "left_semi")
    s = s.join(position.select(*k, "above_low_pct"), k, "left").join(trend, k, "left")
    long, short = F.col("net_flow_20d"), F.col("net_flow_5d")
    s = s.withColumns({
        "quadrant": quadrant(long, F.col("above_low_pct"), low_pct), "freshness": freshness(F.col("flow_momentum")),
        "flow_turn": flow_turn(long, short), "entry_triggered": F.coalesce(F.col(entry_col) > threshold, F.lit(False)),
        "on_board": F.col("members") >= min_members,
    })
    ranked = F.col("on_board") & F.col("trend_score").isNotNull()
    w = Window.partitionBy("date", "on_board").orderBy(F.desc_nulls_last("trend_score"), "grp")
    s = s.withColumn("radar_rank", F.when(ranked, F.row_number().over(w)))
    return s.withColumn("rank_delta", F.lag("radar_rank").over(own_rows("grp")) - F.col("radar_rank"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per date: mean abs score difference and null-safe label match rates of two boards."""
    k = ["date", "grp"]
    labels = ["quadrant", "freshness", "flow_turn"]
    p = b.select(*k, F.col("trend_score").alias("_p"), *[F.col(x).alias(f"_p_{x}") for x in labels])
    j = a.select(*k, "trend_score", *labels).join(p, k)
    return j.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("trend_score") - F.col("_p"))).alias("trend_mad"),
        *[share(F.col(x).eqNullSafe(F.col(f"_p_{x}"))).alias(f"{x}_match") for x in labels])


UNKNOWN_POSITION, UNTAGGED, OFF_BOARD = "位階未取得", "未標次產業", "榜外"


def participation(sources: DataFrame, membership: DataFrame, table: DataFrame) -> DataFrame:
    """source, n_total, n_inflow, n_warning, n_untagged over the entities of each list."""
    info = table.select("grp", F.coalesce("quadrant", F.lit(UNKNOWN_POSITION)).alias("quadrant"),
                        (F.coalesce("net_flow_20d", F.lit(0)) > 0).alias("inflow"))
    tags = membership.join(info, "grp", "left")
    j = sources.select("source", "entity").distinct().join(tags, "entity", "left")
    per = j.groupBy("source", "entity").agg(
        F.count("grp").alias("n_tags"), F.max(F.coalesce("inflow", F.lit(False))).alias("any_in"),
        F.max(F.coalesce(F.col("quadrant") == Q_DISTRIBUTE, F.lit(False))).alias("any_warn"))
    return per.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_total"), count_if(F.col("any_in")).alias("n_inflow"),
        count_if(F.col("any_warn")).alias("n_warning"), count_if(F.col("n_tags") == 0).alias("n_untagged"))


def source_lag_days(a: DataFrame, b: DataFrame) -> DataFrame:
    """Number of dates in ``a`` after the last date of ``b``."""
    d = with_scalar(a.select("date").distinct(), b.agg(F.max("date").alias("_m")))
    return d.agg(count_if(F.col("date") > F.col("_m")).alias("lag_days"))


def recent_buy_confirm(prices: DataFrame, flows: DataFrame, k: int = 2) -> DataFrame:
    """True when the net of each of the latest k own rows is positive."""
    n = prices.select("date", "entity").join(flows.select("date", "entity", "total_net"), ["date", "entity"], "left")
    w = own_rows().rowsBetween(-(k - 1), 0)
    v = F.coalesce("total_net", F.lit(0))
    n = n.withColumn("_m", F.when(F.count(F.lit(1)).over(w) >= k, F.min(v).over(w)))
    return n.groupBy("entity").agg(F.coalesce(F.max_by(F.col("_m") > 0, "date"), F.lit(False)).alias("confirm_buy"))


def net_flow_z(panel: DataFrame, flow_window: int = 20, z_window: int = 60, min_n: int = 30) -> DataFrame:
    w = own_rows()
    z = F.lit(0)
    tot = F.coalesce("foreign_net", z) + F.coalesce("trust_net", z) + F.coalesce("dealer_net", z)
    f = w.rowsBetween(-(flow_window - 1), 0)
    d = panel.select("date", "entity", F.when(F.count(F.lit(1)).over(f) >= flow_window, F.sum(tot).over(f)).alias("_s"))
    return d.select("date", "entity", roll_z("_s", w, z_window, min_n).alias("net_flow_z"))


def flow_factors(panel: DataFrame) -> DataFrame:
    """Pace difference, acceleration and z-change of flows over mean volume.

    A date without any flow row is unknown (null), an entity without a flow on
    a covered date is zero.
    """
    seen = panel.groupBy("date").agg(F.max(F.col("foreign_net").isNotNull()).alias("_cov"))
    p = panel.select("date", "entity", "volume", "foreign_net", "trust_net", "dealer_net").join(F.broadcast(seen), "date")
    nets = {x: F.when(F.col("_cov"), F.coalesce(x, F.lit(0))) for x in ("foreign_net", "trust_net", "dealer_net")}
    p = p.withColumns(nets).withColumn("total_net", F.col("foreign_net") + F.col("trust_net") + F.col("dealer_net"))
    w = own_rows()

    def s(x: str, n: int) -> Column:
        f = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count(x).over(f) >= n, F.sum(x).over(f))

    p = p.select(
        "date", "entity", roll_avg("volume", w, 20).alias("v20"), s("total_net", 5).alias("s5"), s("total_net", 20).alias("s20"),
        s("foreign_net", 5).alias("f5"), s("foreign_net", 20).alias("f20"), s("trust_net", 5).alias("t5"), s("trust_net", 20).alias("t20"))

    def norm(e: Column) -> Column:
        return F.when(F.col("v20") > 0, e / F.col("v20"))

    p = p.withColumns({
        "f_dif_rate": norm(F.col("s5") / 5 - F.col("s20") / 20), "f_accel": norm(F.col("s5") - F.lag("s5", 5).over(w)),
        "f_foreign_dif": norm(F.col("f5") / 5 - F.col("f20") / 20), "f_trust_dif": norm(F.col("t5") / 5 - F.col("t20") / 20),
        "ref_level20": norm(F.col("s20") / 20), "_z": roll_z("s20", w, 60, 30),
    })
    p = p.withColumn("_zc", F.col("_z") - F.lag("_z", 5).over(w))
    return p.select("date", "entity", "f_dif_rate", "f_accel", "f_foreign_dif", "f_trust_dif", "ref_level20",
                    roll_z("_zc", w, 60, 30).alias("f_zz"))


def margin_factors(panel: DataFrame, lookback: int = 20, max_gap_days: int = 10) -> DataFrame:
    """margin_slim, margin_to_vol and holder week-over-week (only over a short enough gap)."""
    w = own_rows()
    prev = F.lag("margin_balance", lookback).over(w)
    vol = roll_avg("volume", w, lookback)
    d = panel.select(
        "date", "entity", F.when(prev != 0, -1 * (F.col("margin_balance") - prev) / prev).alias("margin_slim"),
        F.when((vol > 0) & F.col("margin_balance").isNotNull(), F.col("margin_balance") * 1000 / vol).alias("margin_to_vol"))
    obs = panel.where(F.col("big_holder_pct").isNotNull())
    gap = F.datediff("date", F.lag("date").over(w))
    wow = obs.select("date", "entity", F.when(gap <= max_gap_days, F.col("big_holder_pct") - F.lag("big_holder_pct").over(w)).alias("big_holder_wow"))
    return d.join(wow, ["date", "entity"], "left")


def big_holders(dist: DataFrame, big: Sequence[int], very_big: Sequence[int], total_level: int) -> DataFrame:
    """Share of large holders per (date, entity): one conditional aggregate."""
    def s(levels: Sequence[int]) -> Column:
        return F.coalesce(F.sum(F.when(F.col("level").isin(list(levels)), F.col("shares"))), F.lit(0))

    tot = F.sum(F.when(F.col("level") == total_level, F.col("shares")))
    g = dist.groupBy("data_date", "entity").agg(tot.alias("_t"), s(big).alias("_b"), s(very_big).alias("_v")).where(F.col("_t").isNotNull())
    return g.select("data_date", "entity", *[
        F.when(F.col("_t") > 0, rn(100.0 * F.col(a) / F.nullif(F.col("_t"), F.lit(0)), 2)).alias(o)
        for a, o in (("_b", "big_holder_pct"), ("_v", "big_holder_1000_pct"))])


def newest_dates(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k newest distinct dates, numbered 1.. (a k-row table)."""
    d = df.select(col).distinct().orderBy(F.desc(col)).limit(k)
    return d.withColumn("_nth", F.row_number().over(Window.orderBy(F.desc(col))))


def latest_vs_nth(df: DataFrame, date_col: str, cols: Sequence[str], nth: int, suffix: str) -> DataFrame:
    """Rows of the latest date with the change since the nth newest date."""
    d = df.join(F.broadcast(newest_dates(df, date_col, nth)), date_col).where(F.col("_nth").isin(1, nth))
    now = d.where(F.col("_nth") == 1).select("entity", date_col, *cols)
    old = d.where(F.col("_nth") == nth).select("entity", *[F.col(x).alias(f"_o_{x}") for x in cols])
    return now.join(old, "entity", "left").select(
        "entity", date_col, *cols, *[(F.col(x) - F.col(f"_o_{x}")).alias(f"{x}{suffix}") for x in cols])


def second_difference(monthly: DataFrame, value: str = "yoy_pct", order: str = "year_month") -> DataFrame:
    """delta = v0 - v1 and delta_prev = v1 - v2 over the three newest periods."""
    w = Window.partitionBy("entity").orderBy(F.desc(order))
    d = monthly.withColumn("_b", F.row_number().over(w)).where(F.col("_b") <= 3)
    v = [F.max(F.when(F.col("_b") == i, F.col(value))) for i in (1, 2, 3)]
    return d.groupBy("entity").agg((v[0] - v[1]).alias("delta"), (v[1] - v[2]).alias("delta_prev"))


def decumulate(ytd: DataFrame, margins: Sequence[str]) -> DataFrame:
    """Single-quarter figures from year-to-date ones, joined on the exact previous quarter."""
    prev = ytd.select("entity", "year", (F.col("quarter") + 1).alias("quarter"),
                      *[F.col(x).alias(f"_p_{x}") for x in ("revenue", "eps", *margins)])
    d = ytd.join(prev, ["entity", "year", "quarter"], "left")
    first = F.col("quarter") == 1
    dr = F.col("revenue") - F.col("_p_revenue")
    cols = [
        F.when(first, F.col(m)).when(
            dr > 0, (F.col(m) * F.col("revenue") - F.col(f"_p_{m}") * F.col("_p_revenue")) / F.nullif(dr, F.lit(0.0))
        ).alias(m) for m in margins
    ]
    eps = F.when(first, F.col("eps")).otherwise(F.col("eps") - F.col("_p_eps"))
    return d.select(
        "entity", "year", "quarter", F.when(first, F.col("revenue")).otherwise(dr).alias("revenue"), *cols, eps.alias("eps"), "bvps",
        F.when(F.col("bvps") > 0, eps / F.nullif(F.col("bvps"), F.lit(0.0)) * 100).alias("roe_q_pct"))


def latest_quarter_with_deltas(single: DataFrame, cols: Sequence[str], deltas: Sequence[str]) -> DataFrame:
    w = Window.partitionBy("entity").orderBy(F.desc("year"), F.desc("quarter"))
    d = single.withColumn("_b", F.row_number().over(w)).where(F.col("_b") <= 2)

    def at(x: str, i: int) -> Column:
        return F.max(F.when(F.col("_b") == i, F.col(x)))

    return d.groupBy("entity").agg(
        F.concat(at("year", 1).cast("string"), F.lit("Q"), at("quarter", 1).cast("string")).alias("quarter_label"),
        *[at(x, 1).alias(x) for x in cols], *[(at(x, 1) - at(x, 2)).alias(f"delta_{x}") for x in deltas])
