"""Entity feature panel: flows, z-scores, positions, returns and relative strength."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.exprs import own_rows, roll_avg, roll_z, share, with_whole_z
from tidewater.operators.flows import FLOW, MOM, NETS
from tidewater.operators.momentum import market_index
from tidewater.sources.staging import cut

WINDOWS = (5, 20)


def group_returns(baskets: DataFrame, membership: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(entity, grps), (grps, date, subind_ret): mean basket return over the groups of an entity.

    Entities with the same groups share one series, so there is no row per
    entity and calendar day.
    """
    w = own_rows("grp")
    b = baskets.select("grp", "date", ((F.col("basket_index") / F.lag("basket_index", n).over(w) - 1) * 100).alias("_b"))
    of = membership.groupBy("entity").agg(F.array_sort(F.collect_list("grp")).alias("grps"))
    sets = of.select("grps").distinct().select("grps", F.explode("grps").alias("grp"))
    return of, cut(sets.join(b, "grp").groupBy("grps", "date").agg(F.avg("_b").alias("subind_ret")))


def market_returns(index: DataFrame, n: int) -> DataFrame:
    from pyspark.sql import Window

    w = Window.orderBy("date")
    return index.select("date", ((F.col("market_index") / F.lag("market_index", n).over(w) - 1) * 100).alias("market_ret"))


def build_stock_panel(prices: DataFrame, flows: DataFrame, membership: DataFrame, baskets: DataFrame, index: DataFrame | None = None,
                      short: int = 5, long: int = 20, ma_windows: Sequence[int] = (20, 60, 240), pos: int = 60, rs: int = 20) -> DataFrame:
    """One shuffle on entity for every frame; market and groups come by small tables, which move no row.

    Windows of windows are staged selects; all share one partitioning and order.
    """
    w = own_rows()
    wins = (short, long)
    p = prices.select("date", "entity", "close", "volume").join(flows.select("date", "entity", *NETS), ["date", "entity"], "left")
    p = p.select("date", "entity", "close", "volume", *[F.coalesce(x, F.lit(0)).alias(x) for x in NETS])
    f = w.rowsBetween(-(pos - 1), 0)
    ret = [((F.col("close") / F.lag("close", n).over(w) - 1) * 100).alias(f"ret_{n}d") for n in sorted({rs, *wins})]
    p = p.select(
        "date", "entity", "close", "volume",
        *[F.sum(x).over(w.rowsBetween(-(n - 1), 0)).alias(f"{FLOW[x]}_{n}d") for x in NETS for n in wins],
        ((F.col("close") / F.min("close").over(f) - 1) * 100).alias(f"above_low_{pos}d_pct"),
        ((F.col("close") / F.max("close").over(f) - 1) * 100).alias(f"above_high_{pos}d_pct"),
        *[((F.col("close") / roll_avg("close", w, n) - 1) * 100).alias(f"above_ma{n}_pct") for n in ma_windows],
        roll_avg("volume", w, short, 1).alias("_av"), *ret,
    )
    z_cols = [f"{FLOW[x]}_{n}d" for x in NETS for n in wins]
    ff, tt = F.col(f"foreign_flow_{long}d"), F.col(f"trust_flow_{long}d")
    den = F.abs(ff) + F.abs(tt)
    p = with_whole_z(p, w, z_cols, 60, 30).select(
        "*", roll_z("_av", w, 60, 30).alias(f"volume_z_{short}d"),
        *[(F.col(f"{FLOW[x]}_{n}d") - F.lag(f"{FLOW[x]}_{n}d", n).over(w)).alias(f"{MOM[x]}_momentum_{n}d") for x in NETS for n in wins],
        F.when(den > 0, (ff + tt) / F.nullif(den.cast("double"), F.lit(0.0))).alias(f"dom_{long}d"),
    ).drop("_av")
    p = p.withColumns({f"{MOM[x]}_momentum": F.col(f"{MOM[x]}_momentum_{short}d") for x in NETS})
    p = p.select(
        "*", (F.col("flow_momentum") - F.lag("flow_momentum", short).over(w)).alias("flow_decel"),
        *[(F.col(f"ret_{n}d") - (F.col(f"net_flow_{n}d_z") - F.lag(f"net_flow_{n}d_z", n).over(w))).alias(f"price_flow_div_{n}d") for n in wins],
    )
    idx = market_index(prices) if index is None else index
    of, grouped = group_returns(baskets, membership, rs)
    p = p.join(F.broadcast(market_returns(idx, rs)), "date", "left").join(of, "entity", "left").join(grouped, ["grps", "date"], "left")
    r = F.col(f"ret_{rs}d")
    return p.withColumns({f"rs_market_{rs}d": r - F.col("market_ret"), f"rs_subind_{rs}d": r - F.col("subind_ret")}).drop("market_ret", "subind_ret", "grps")


def coverage_meta(panel: DataFrame, flows: DataFrame, membership: DataFrame) -> DataFrame:
    """Counts of entities and entity-days with price, flow and tag, in one pass."""
    fl = flows.select("date", "entity").distinct().withColumn("_f", F.lit(1))
    tg = membership.select("entity").distinct().withColumn("_t", F.lit(1))
    j = panel.select("date", "entity").join(fl, ["date", "entity"], "left").join(tg, "entity", "left")
    return j.agg(
        F.countDistinct("entity").alias("n_stocks"), F.countDistinct("date").alias("n_trading_days"), F.count(F.lit(1)).alias("n_stock_days"),
        F.round(100 * share(F.col("_f").isNotNull()), 2).alias("inst_coverage_pct"),
        F.countDistinct(F.when(F.col("_t").isNotNull(), F.col("entity"))).alias("n_tagged"),
    )


def latest_rows(panel: DataFrame) -> DataFrame:
    """Each entity's latest row, by an aggregate instead of a sort."""
    cols = [x for x in panel.columns if x != "entity"]
    g = panel.groupBy("entity").agg(F.max_by(F.struct(*cols), "date").alias("_r"))
    return g.select("entity", "_r.*")
