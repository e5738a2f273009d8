"""Condition cells against forward returns: one evaluation for every grid."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.exprs import own_rows, share, with_scalar
from tidewater.operators.order import average_ranks, exact_quantiles, nearest_position
from tidewater.operators.resample import block_bootstrap
from tidewater.operators.stats import in_test_block, walk_forward_splits
from tidewater.sources.staging import cut


def block_snapshots(horizon: int, gap: int = 5) -> int:
    return max(1, math.ceil((horizon + 1) / gap))


def by_horizon(cells: DataFrame, horizons: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """One row per (row, horizon) with its target; rows without a target drop out."""
    arr = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"alpha{h}").alias("y"), F.lit(block_snapshots(h)).alias("blk"), F.lit(h + 1).alias("emb")) for h in horizons])
    return cells.select(*keep, F.explode(arr).alias("x")).select(*keep, "x.*").where(F.col("y").isNotNull())


def mid_date(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Median row date (linear) per key, as a day number."""
    return exact_quantiles(df.select(*keys, F.unix_date("date").alias("_d")), keys, "_d", {"_mid": 0.5})


def evaluate_cells(cells: DataFrame, horizons: Sequence[int], by: Sequence[str] = (), n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Per horizon x cell (x by): n, mean, median, win, date-mean delta against that
    date's population with a block interval, and the two half means."""
    keep = [*by, "date", "cell"]
    cells = cut(cells.select(*keep, *[f"alpha{h}" for h in horizons]))
    pop_keys = [*by, "horizon", "date"]
    long = by_horizon(cells, horizons, keep)
    pop = long.groupBy(*pop_keys).agg(F.avg("y").alias("_pop"))
    d = with_scalar(long, mid_date(cells)) if not by else long.join(F.broadcast(mid_date(cells, by)), list(by))
    k = [*by, "horizon", "cell"]
    half = F.unix_date("date") <= F.col("_mid")
    base = d.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), share(F.col("y") > 0).alias("win_rate"),
        F.avg(F.when(half, F.col("y"))).alias("mean_h1"), F.avg(F.when(~half, F.col("y"))).alias("mean_h2"))
    daily = long.groupBy(*k, "date").agg(F.avg("y").alias("_m"), F.max("blk").alias("blk"))
    daily = daily.join(pop, pop_keys).withColumn("_delta", F.col("_m") - F.col("_pop"))
    ci = block_bootstrap(daily, k, "date", "_delta", "blk", n_boot, seed)
    ci = ci.withColumnsRenamed({"mean": "delta_mean", "n_obs": "n_dates"})
    return base.join(exact_quantiles(long, k, "y", {"median": 0.5}), k).join(ci, k)


def evaluate_cells_by_regime(cells: DataFrame, horizons: Sequence[int], n_boot: int = 1000, seed: int = 42, min_dates: int = 30) -> DataFrame:
    """Delta against the date population, averaged by date within each regime."""
    cells = cut(cells.select("date", "cell", "regime", *[f"alpha{h}" for h in horizons]))
    long = by_horizon(cells, horizons, ["date", "cell", "regime"])
    pop = long.groupBy("horizon", "date").agg(F.avg("y").alias("_pop"))
    k = ["horizon", "regime", "cell"]
    daily = long.where(F.col("regime").isNotNull()).groupBy(*k, "date").agg(F.avg("y").alias("_m"), F.count(F.lit(1)).alias("_c"), F.max("blk").alias("blk"))
    daily = daily.join(pop, ["horizon", "date"]).withColumn("_delta", F.col("_m") - F.col("_pop"))
    ci = block_bootstrap(daily, k, "date", "_delta", "blk", n_boot, seed)
    n = daily.groupBy(*k).agg(F.sum("_c").alias("n"))
    return ci.join(n, k).withColumnsRenamed({"mean": "delta_mean", "n_obs": "n_dates"}).withColumn("thin", F.col("n_dates") < min_dates)


def walk_forward_cells(cells: DataFrame, horizons: Sequence[int], n_splits: int = 4, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """The cell evaluation on every test block of every horizon, in one job."""
    cells = cut(cells.select("date", "cell", *[f"alpha{h}" for h in horizons]))
    arr = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(h + 1).alias("emb")) for h in horizons]))
    days = cells.select("date").distinct().select("date", arr.alias("x")).select("date", "x.*")
    splits = walk_forward_splits(days, ["horizon"], n_splits, 0.4, "emb")
    long = in_test_block(by_horizon(cells, horizons, ["date", "cell"]), splits, ["horizon"])
    k = ["horizon", "split_id", "cell"]
    pop = long.groupBy("horizon", "split_id", "date").agg(F.avg("y").alias("_pop"))
    daily = long.groupBy(*k, "date").agg(F.avg("y").alias("_m"), F.count(F.lit(1)).alias("_c"), F.max("blk").alias("blk"))
    daily = daily.join(pop, ["horizon", "split_id", "date"]).withColumn("_delta", F.col("_m") - F.col("_pop"))
    ci = block_bootstrap(daily, k, "date", "_delta", "blk", n_boot, seed)
    n = daily.groupBy(*k).agg(F.sum("_c").alias("test_n"))
    out = ci.join(n, k).withColumnsRenamed({"mean": "test_delta_mean", "n_obs": "test_n_dates", "ci_lo": "test_ci_lo", "ci_hi": "test_ci_hi"})
    return out.join(F.broadcast(splits), ["horizon", "split_id"])


# ------------------------------------------------------------- cell builders


def top_share(df: DataFrame, value: str, share_top: float = 0.2) -> DataFrame:
    """cell = hit for the top ceil(n x share) of the date by min rank, ties included."""
    d = average_ranks(df.where(F.col(value).isNotNull()), ["date"], {value: "_rank"}, "_n", "min", True)
    return d.withColumn("cell", F.when(F.col("_rank") <= F.ceil(F.col("_n") * share_top), "hit").otherwise("miss")).drop("_rank", "_n")


def two_tails(df: DataFrame, value: str, share_tail: float = 0.2) -> DataFrame:
    d = df.where(F.col(value).isNotNull())
    d = average_ranks(d, ["date"], {value: "_hi"}, "_n", "min", True)
    d = average_ranks(d, ["date"], {value: "_lo"}, None, "min", False)
    cut = F.ceil(F.col("_n") * share_tail)
    return d.withColumn("cell", F.when(F.col("_hi") <= cut, "cheap").when(F.col("_lo") <= cut, "rich")).where(F.col("cell").isNotNull()).drop("_hi", "_lo", "_n")


def group_ranks(trend: DataFrame) -> DataFrame:
    """grp, date, grp_rank, n_groups: min rank by score within the date (group-level table)."""
    w = Window.partitionBy("date")
    t = trend.where(F.col("trend_score").isNotNull()).select("grp", "date", "trend_score").dropDuplicates(["grp", "date"])
    return t.select("grp", "date", "trend_score", F.rank().over(w.orderBy(F.desc("trend_score"))).alias("grp_rank"), F.count(F.lit(1)).over(w).alias("n_groups"))


def rotation_cells(rows: DataFrame, trend: DataFrame, share_top: float = 0.2) -> DataFrame:
    g = group_ranks(trend)
    cell = F.when(F.col("grp_rank") <= F.ceil(F.col("n_groups") * share_top), "hit").otherwise("miss")
    return rows.join(g.select("grp", "date", cell.alias("cell")), ["grp", "date"])


def recently_triggered(days: DataFrame, triggers: DataFrame, calendar: DataFrame, lookback: int) -> DataFrame:
    """grp, date, recent: a trigger at most ``lookback`` market days before."""
    cal = F.broadcast(calendar.select("date", "idx"))
    d = days.select("grp", "date").distinct().join(cal, "date", "left").withColumn("t", F.lit(None).cast("int")).withColumn("k", F.lit(1))
    tr = triggers.select("grp", "date").join(cal, "date").select("grp", F.lit(None).cast("date").alias("date"), "idx", F.col("idx").alias("t"), F.lit(0).alias("k"))
    w = Window.partitionBy("grp").orderBy("idx", "k").rowsBetween(Window.unboundedPreceding, 0)
    u = d.unionByName(tr).withColumn("last", F.max("t").over(w)).where(F.col("k") == 1)
    return u.select("grp", "date", F.coalesce(F.col("idx") - F.col("last") <= lookback, F.lit(False)).alias("recent"))


def rank_velocity(trend: DataFrame, lag_snapshots: int = 2) -> DataFrame:
    """rank(lag snapshots ago) - rank now, joined on the exact earlier snapshot."""
    g = group_ranks(trend)
    w = Window.orderBy("date")
    days = g.select("date").distinct().select("date", F.lag("date", lag_snapshots).over(w).alias("prev"))
    old = g.select("grp", F.col("date").alias("prev"), F.col("grp_rank").alias("old"))
    return g.join(F.broadcast(days), "date").join(old, ["grp", "prev"]).select("grp", "date", F.col("grp_rank").alias("rank_now"), (F.col("old") - F.col("grp_rank")).alias("rank_velocity"))


def velocity_cells(rows: DataFrame, trend: DataFrame, top_n: int = 5, fast: float = 0.9, lag_snapshots: int = 2) -> DataFrame:
    """top5, or fast / slow by a per-date nearest quantile of the velocity outside the top."""
    r = rows.join(group_ranks(trend).select("grp", "date", "grp_rank"), ["grp", "date"])
    v = rank_velocity(trend, lag_snapshots).select("grp", "date", "rank_velocity")
    r = r.join(v, ["grp", "date"], "left")
    out = r.where((F.col("grp_rank") > top_n) & F.col("rank_velocity").isNotNull())
    thr = exact_quantiles(out, ["date"], "rank_velocity", {"_thr": nearest_position(fast)})
    r = r.join(F.broadcast(thr), "date", "left")
    cell = F.when(F.col("grp_rank") <= top_n, "top5").when(F.col("rank_velocity") >= F.col("_thr"), "not_top5_fast").when(F.col("rank_velocity").isNotNull(), "not_top5_slow")
    return r.withColumn("cell", cell).where(F.col("cell").isNotNull()).drop("_thr")


def pct_change_rows(panel: DataFrame, value: str, n: int, floor: float) -> DataFrame:
    prev = F.lag(value, n).over(own_rows())
    return panel.withColumn("chg", F.when(prev >= floor, (F.col(value) - prev) / F.nullif(prev, F.lit(0.0)) * 100))


def point_change_rows(panel: DataFrame, value: str, n: int, floor: float) -> DataFrame:
    d = panel.where(F.col(value).isNotNull())
    prev = F.lag(value, n).over(own_rows())
    return d.withColumn("chg", F.when(prev >= floor, F.col(value) - prev)).where(F.col("chg").isNotNull())


def combine_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    j = a.select("date", "entity", F.col("cell").alias("_a")).join(b.withColumnRenamed("cell", "_b"), ["date", "entity"])
    ha, hb = F.col("_a") == "hit", F.col("_b") == "hit"
    return j.withColumn("cell", F.when(ha & hb, "both_hit").when(ha, "a_only_hit").when(hb, "b_only_hit").otherwise("neither")).drop("_a", "_b")


# ------------------------------------------------------------- pooled tables


def pooled_table(rows: DataFrame, keys: Sequence[str], y: str, mid: DataFrame | None = None) -> DataFrame:
    """n, mean, median, win rate (and half means) per key."""
    d = rows.where(F.col(y).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), share(F.col(y) > 0).alias("win_rate")]
    if mid is not None:
        d = with_scalar(d, mid)
        h = F.unix_date("date") <= F.col("_mid")
        aggs += [F.avg(F.when(h, F.col(y))).alias("mean_h1"), F.avg(F.when(~h, F.col(y))).alias("mean_h2")]
    return d.groupBy(*keys).agg(*aggs).join(exact_quantiles(d, keys, y, {"median": 0.5}), list(keys))


def with_total(rows: DataFrame, label_cols: Sequence[str], total: str = "（全體）") -> DataFrame:
    """Every row once under its labels and once under the total, so one aggregate gives both."""
    arr = F.array(
        F.struct(*[F.col(x).alias(x) for x in label_cols]), F.struct(*[F.lit(total if i == 0 else "—").alias(x) for i, x in enumerate(label_cols)]))
    rest = [x for x in rows.columns if x not in label_cols]
    return rows.select(*rest, F.explode(arr).alias("_x")).select(*rest, "_x.*")


def laggard_labels(rows: DataFrame, lo: float = 10.0, hi: float = 15.0) -> DataFrame:
    """group_strength by the date median score, stock_pos by sign, tier by MA60 distance."""
    d = rows.where(F.col("rs_subind").isNotNull() & F.col("trend_score").isNotNull() & F.col("ma60_dist_pct").isNotNull())
    d = d.join(F.broadcast(exact_quantiles(d, ["date"], "trend_score", {"_med": 0.5})), "date")
    x = F.col("ma60_dist_pct")
    return d.withColumns({
        "group_strength": F.when(F.col("trend_score") >= F.col("_med"), "族群強").otherwise("族群弱"),
        "stock_pos": F.when(F.col("rs_subind") < 0.0, "落後").otherwise("領先"),
        "tier": F.when(x <= lo, f"貼低≤{lo:.0f}").when(x <= hi, f"中段{lo:.0f}–{hi:.0f}").otherwise(f"延伸>{hi:.0f}"),
    }).drop("_med")


def four_way_labels(rows: DataFrame, trend: DataFrame, rs: tuple[float, float] = (-15.0, 0.0), ma: tuple[float, float] = (-10.0, 10.0), top_n: int = 5) -> DataFrame:
    d = rows.join(group_ranks(trend).select("grp", "date", "grp_rank"), ["grp", "date"])
    d = d.where(F.col("rs_subind").isNotNull() & F.col("ma60_dist_pct").isNotNull() & F.col("net_flow_z").isNotNull())
    return d.withColumns({
        "group_strength": F.when(F.col("grp_rank") <= top_n, "族群前5").otherwise("族群非前5"),
        "stock_pos": F.when(F.col("rs_subind").between(*rs), "貼落後").otherwise("非貼落後"),
        "tier": F.when(F.col("ma60_dist_pct").between(*ma), "位階中段").otherwise("破線或延伸"),
        "flow": F.when(F.col("net_flow_z") >= 0, "資金非負").otherwise("資金為負"),
    })


def right_closed(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins: the first edge at or above x names the bin."""
    e = F.when(x <= edges[0], labels[0])
    for edge, lab in zip(edges[1:], labels[1:]):
        e = e.when(x <= edge, lab)
    return F.when(x.isNotNull(), e.otherwise(labels[len(edges)]))
