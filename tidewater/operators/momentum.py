"""Returns, indices, baskets, streaks and latest-value features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.exprs import clip, own_rows, rn, roll_avg, running, share, with_scalar
from tidewater.operators.order import exact_quantiles
from tidewater.operators.panel import clean_prices

# fixed label values
PULLBACK_BROKEN, PULLBACK_CALM, PULLBACK_WATCH = "破線", "止穩", "觀察"


def newest_first(df: DataFrame, key: str = "entity") -> DataFrame:
    """Adds ``back`` (1 = latest own row) and ``n_rows``."""
    w = Window.partitionBy(key)
    return df.withColumn("back", F.row_number().over(w.orderBy(F.desc("date")))).withColumn(
        "n_rows", F.count(F.lit(1)).over(w)
    )


def _at(col: str, back) -> Column:
    return F.max(F.when(F.col("back") == back, F.col(col)))


def n_day_return(prices: DataFrame, n: int = 5) -> DataFrame:
    """Latest row against n rows back, clamped to the first row; gap is the true distance."""
    d = newest_first(prices).where(F.col("n_rows") >= 2)
    target = F.least(F.lit(n + 1), F.col("n_rows"))
    g = d.groupBy("entity").agg(
        _at("close", 1).alias("now"), _at("close", target).alias("base"),
        _at("date", 1).alias("now_date"), _at("date", target).alias("base_date"), F.max("n_rows").alias("n_rows"),
    )
    return g.where(F.col("now").isNotNull() & (F.col("base") != 0)).select(
        "entity", ((F.col("now") - F.col("base")) / F.col("base") * 100).alias("ret_pct"),
        F.least(F.lit(n), F.col("n_rows") - 1).alias("gap"), "now", "base", "now_date", "base_date",
    )


def trailing_extrema(prices: DataFrame, windows: Sequence[int] = (20, 60)) -> DataFrame:
    d = newest_first(prices.where(F.col("close").isNotNull()))
    aggs = []
    for w in windows:
        v = F.when(F.col("back") <= w, F.col("close"))
        aggs += [F.min(v).alias(f"min_{w}"), F.max(v).alias(f"max_{w}")]
    return d.groupBy("entity").agg(*aggs)


def dividend_addback(prices: DataFrame, dividends: DataFrame, n: int = 5) -> DataFrame:
    """Cash and stock dividends inside (base date, latest date] as percent of the base close."""
    win = n_day_return(prices, n)
    ev = dividends.where(F.col("ex_date").isNotNull() & ((F.col("cash") > 0) | (F.col("ratio") > 0)))
    hit = win.join(ev, "entity").where(
        (F.col("base_date") < F.col("ex_date")) & (F.col("ex_date") <= F.col("now_date"))
    )
    g = hit.groupBy("entity").agg(
        F.sum(F.coalesce("cash", F.lit(0.0))).alias("cash"), F.sum(F.coalesce("ratio", F.lit(0.0))).alias("ratio"),
        F.first("base").alias("base"), F.first("now").alias("now"),
    ).where((F.col("cash") > 0) | (F.col("ratio") > 0))
    stock = F.when(F.col("ratio") > 0, F.col("ratio") * F.col("now")).otherwise(F.lit(0.0))
    return g.select("entity", ((stock + F.col("cash")) / F.col("base") * 100).alias("addback_pct"), "cash", "ratio")


def price_discontinuity(prices: DataFrame, lookback: int = 10, threshold_pct: float = 15.0) -> DataFrame:
    """Worst jump whose reported change does not explain it, per entity."""
    d = newest_first(prices).where(F.col("back") <= lookback + 1).withColumn("prev", F.lag("close").over(own_rows()))
    d = d.where(F.col("prev").isNotNull() & (F.col("prev") != 0) & F.col("close").isNotNull())
    ret = (F.col("close") - F.col("prev")) / F.col("prev") * 100
    move = F.abs(F.col("close") - F.col("prev"))
    d = d.withColumn("ret1d", ret).where(
        (F.abs("ret1d") > threshold_pct) & (F.col("change").isNull() | (F.abs("change") < 0.5 * move))
    )
    return d.groupBy("entity").agg(
        F.max_by(F.struct("ret1d", "date"), F.struct(F.abs("ret1d"), -F.unix_date("date"))).alias("w")
    ).select("entity", F.col("w.ret1d").alias("ret1d"), F.col("w.date").alias("date"))


def group_mean_return(membership: DataFrame, returns: DataFrame) -> DataFrame:
    """Mean return and smallest gap per group; 0 where no member has one."""
    j = membership.join(returns.select("entity", "ret_pct", "gap"), "entity", "left")
    return j.groupBy("grp").agg(
        F.coalesce(F.avg("ret_pct"), F.lit(0.0)).alias("mean_ret"), F.coalesce(F.min("gap"), F.lit(0)).alias("min_gap")
    )


def clipped_returns(prices: DataFrame, clip_pct: float = 10.0) -> DataFrame:
    b = clip_pct / 100
    r = F.col("close") / F.lag("close").over(own_rows()) - 1.0
    return clean_prices(prices).select("date", "entity", clip(r, -b, b).alias("ret")).where(F.col("ret").isNotNull())


def compound(df: DataFrame, keys: Sequence[str], r: str, out: str) -> DataFrame:
    """100 x running product of (1 + r) in date order within keys, to nine decimals.

    The rounding makes later threshold tests independent of summation order.
    """
    w = running(Window.partitionBy(*keys).orderBy("date"))
    return df.withColumn(out, F.round(F.exp(F.sum(F.log1p(r)).over(w)) * 100, 9))


def market_index(prices: DataFrame, clip_pct: float = 10.0) -> DataFrame:
    """Equal-weight clipped-return index; the final window runs over one row per date."""
    d = clipped_returns(prices, clip_pct).groupBy("date").agg(F.avg("ret").alias("mkt_ret"))
    return compound(d, [], "mkt_ret", "market_index")


def group_baskets(membership: DataFrame, prices: DataFrame, clip_pct: float = 10.0) -> DataFrame:
    j = membership.join(clipped_returns(prices, clip_pct), "entity")
    d = j.groupBy("grp", "date").agg(
        (F.avg("ret") * 100).alias("basket_return_pct"), F.countDistinct("entity").alias("members_priced")
    )
    return compound(d.withColumn("_r", F.col("basket_return_pct") / 100), ["grp"], "_r", "basket_index").drop("_r")


def basket_position(baskets: DataFrame, window: int = 60, min_n: int = 1) -> DataFrame:
    w = own_rows("grp")
    f = w.rowsBetween(-(window - 1), 0)
    low = F.when(F.count("basket_index").over(f) >= min_n, F.min("basket_index").over(f))
    return baskets.select(
        "grp", "date", "basket_index", ((F.col("basket_index") / low - 1) * 100).alias("above_low_pct"),
        ((F.col("basket_index") / F.lag("basket_index", 5).over(w) - 1) * 100).alias("basket_ret_5d"),
    )


def trajectory(prices: DataFrame, ma_window: int = 20, min_days: int = 25, pull: int = 5, base: int = 20,
               danger_streak: int = 4, danger_ratio: float = 1.5, calm_ratio: float = 0.8) -> DataFrame:
    """Down-day streak, signed days beyond the MA, pullback volume ratio and label.

    Streaks are islands: the newest row that breaks the condition bounds them.
    """
    w = own_rows()
    d = newest_first(clean_prices(prices))
    d = d.withColumn("down", F.col("close") < F.lag("close").over(w)).withColumn("ma", roll_avg("close", w, ma_window))
    d = d.withColumn("side", F.col("close") > F.col("ma"))
    last = Window.partitionBy("entity").orderBy("back")
    d = d.withColumn("side0", F.first("side").over(last))
    first_not_down = F.min(F.when(~F.coalesce("down", F.lit(False)), F.col("back")))
    first_off_side = F.min(F.when(F.col("side").isNull() | (F.col("side") != F.col("side0")), F.col("back")))
    vols = newest_first(prices.where(F.col("volume") > 0)).groupBy("entity").agg(
        F.avg(F.when(F.col("back") <= pull, F.col("volume"))).alias("v_near"),
        F.avg(F.when((F.col("back") > pull) & (F.col("back") <= pull + base), F.col("volume"))).alias("v_base"),
        F.count(F.lit(1)).alias("n_vol"),
    )
    g = d.groupBy("entity").agg(
        (first_not_down - 1).alias("down_days_streak"),
        F.coalesce(first_off_side - 1, F.max("n_rows")).alias("run"),
        F.first(F.when(F.col("back") == 1, F.col("side")), ignorenulls=True).alias("on_top"),
        F.max("n_rows").alias("n_rows"),
    ).where(F.col("n_rows") >= min_days).join(vols, "entity", "left")
    ratio = F.when((F.col("n_vol") >= pull + base) & (F.col("v_base") > 0), rn(F.col("v_near") / F.col("v_base"), 2))
    g = g.withColumn("above_ma20_days", F.when(F.col("on_top"), F.col("run")).when(~F.col("on_top"), -F.col("run")))
    g = g.withColumn("pullback_vol_ratio", ratio)
    a, s, v = F.col("above_ma20_days"), F.col("down_days_streak"), F.col("pullback_vol_ratio")
    label = F.when(
        a.isNotNull(),
        F.when((a < 0) & ((s >= danger_streak) | F.coalesce(v >= danger_ratio, F.lit(False))), PULLBACK_BROKEN)
        .when((a > 0) & (s <= 1) & F.coalesce(v <= calm_ratio, F.lit(False)), PULLBACK_CALM)
        .otherwise(PULLBACK_WATCH),
    )
    return g.select("entity", "down_days_streak", "above_ma20_days", "pullback_vol_ratio", label.alias("pullback_quality"))


def buy_streak(flows: DataFrame, col: str) -> DataFrame:
    """Consecutive latest rows with a positive net; null or non-positive breaks it."""
    d = newest_first(flows)
    brk = F.min(F.when(F.col(col).isNull() | (F.col(col) <= 0), F.col("back")))
    return d.groupBy("entity").agg(F.coalesce(brk - 1, F.max("n_rows")).alias("streak"))


def ma_distance(prices: DataFrame, windows: Sequence[int] = (20, 60), slope_window: int = 10, slope_for: int = 60) -> DataFrame:
    """Latest close, change, amount, MA distances and MA slope with full-window guards."""
    d = newest_first(prices.where(F.col("close").isNotNull()))
    aggs = [
        _at("close", 1).alias("close"), _at("close", 2).alias("_prev"), _at("date", 1).alias("date"),
        _at("volume", 1).alias("volume"), F.max("n_rows").alias("n_rows"),
        F.avg(F.when((F.col("back") > slope_window) & (F.col("back") <= slope_for + slope_window), F.col("close"))).alias("_old"),
    ]
    aggs += [F.avg(F.when(F.col("back") <= w, F.col("close"))).alias(f"_ma{w}") for w in windows]
    g = d.groupBy("entity").agg(*aggs)
    cols = [
        F.when((F.col("n_rows") >= w) & (F.col("close") > 0), (F.col("close") - F.col(f"_ma{w}")) / F.col(f"_ma{w}") * 100.0)
        .alias(f"ma{w}_dist_pct") for w in windows
    ]
    slope = F.when(
        F.col("n_rows") >= slope_for + slope_window, (F.col(f"_ma{slope_for}") - F.col("_old")) / F.col("_old") * 100.0
    ).alias(f"ma{slope_for}_slope_pct")
    return g.select(
        "entity", "date", "close", (F.col("close") - F.col("_prev")).alias("change"),
        rn(F.col("volume") * F.col("close") / 1e6, 2).alias("amount_million"), *cols, slope,
    )


def window_return_vs_median(prices: DataFrame, n: int = 20) -> DataFrame:
    """n-row return at the market's last date, minus the cross-section median."""
    px = clean_prices(prices)
    r = F.col("close") / F.lag("close", n).over(own_rows()) - 1.0
    snap = with_scalar(px.withColumn("_ret", r), px.agg(F.max("date").alias("_last")))
    snap = snap.where((F.col("date") == F.col("_last")) & F.col("_ret").isNotNull()).select("entity", "_ret")
    return with_scalar(snap, exact_quantiles(snap, [], "_ret", {"_med": 0.5})).select(
        "entity", (F.col("_ret") * 100).alias("ret_pct"), ((F.col("_ret") - F.col("_med")) * 100).alias("rs_pct")
    )


def rs_vs_group(prices: DataFrame, membership: DataFrame, n: int = 20, days: DataFrame | None = None) -> DataFrame:
    """n-row return minus the mean of the group's members that day, in pp; on ``days`` only, if given."""
    r = F.col("close") / F.lag("close", n).over(own_rows()) - 1
    px = prices.select("date", "entity", r.alias("_r")).where(F.col("_r").isNotNull())
    if days is not None:
        px = px.join(F.broadcast(days.select("date")), "date", "left_semi")
    rows = membership.join(px, "entity")
    mean = rows.groupBy("grp", "date").agg(F.avg("_r").alias("_m"))
    return rows.join(mean, ["grp", "date"]).select(
        "date", "entity", "grp", ((F.col("_r") - F.col("_m")) * 100).alias("rs_subind")
    )


def above_ma_share(prices: DataFrame, ma: int) -> DataFrame:
    px = clean_prices(prices).withColumn("_ma", roll_avg("close", own_rows(), ma))
    return px.where(F.col("_ma").isNotNull()).groupBy("date").agg(
        share(F.col("close") > F.col("_ma")).alias("frac_above_ma"), F.count(F.lit(1)).alias("n_priced")
    )
