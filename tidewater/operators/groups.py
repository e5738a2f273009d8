"""Screens, grouping, theme strength, leaders, concentration and correlation clusters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.exprs import count_if, own_rows, rn, with_scalar
from tidewater.operators.momentum import clipped_returns
from tidewater.operators.order import average_ranks, exact_quantiles
from tidewater.sources.staging import cut

#: Names in a block and dates in a stretch of the Gram products: 4 MB a matrix.
GRAM_NAMES = 512
GRAM_DAYS = 1024


def threshold_filter(df: DataFrame, rules: Sequence[tuple[str, float | None, float | None]], columns: Mapping[str, str]) -> DataFrame:
    """Conjunction of inclusive bounds from a rule list; an unmapped item is an error."""
    cond = F.lit(True)
    for item, lo, hi in rules:
        if item not in columns:
            raise KeyError(f"unmapped filter item: {item}")
        c = F.col(columns[item])
        cond = cond & c.isNotNull()
        if lo is not None:
            cond = cond & (c >= lo)
        if hi is not None:
            cond = cond & (c <= hi)
    return df.where(cond)


def market_cap_billion(shares: Column, close: Column) -> Column:
    return shares * close / 1e8


def known(*conds: Column) -> Column:
    """AND of conditions; a null leg counts as false."""
    out = F.lit(True)
    for c in conds:
        out = out & F.coalesce(c, F.lit(False))
    return out


def quality_screens(d: DataFrame) -> DataFrame:
    """g1 margin expansion, g2 quality, g5 value gap, f2 growth quality; rows hit by at least one."""
    c = F.col
    d = d.withColumns({
        "g1": known(c("delta_net_margin_pct") >= 1.5, c("cum_yoy_pct") >= 0, c("ma60_dist_pct") <= 15.0),
        "g2": known(c("roe_q_pct") >= 3.5, c("market_cap") >= 0.5),
        "g5": known(c("val_pctile") <= 40.0, c("gross_margin_pct") >= c("gross_peer_median"), c("amount_million") >= 0.5),
        "f2": known(c("pe").between(15.0, 30.0), c("gross_margin_pct") > c("gross_peer_median"), c("market_cap") >= 0.5),
    })
    return d.where(c("g1") | c("g2") | c("g5") | c("f2"))


def disclosure_date(month_index: Column) -> Column:
    """Tenth of the month after a (0-based) month index."""
    m = month_index + 1
    return F.make_date(F.floor(m / 12).cast("int"), (m % 12 + 1).cast("int"), F.lit(10))


def divergence_screens(d: DataFrame) -> DataFrame:
    c = F.col
    return d.withColumns({
        "l6_2cond": known(c("yoy_pct") >= 20.0, c("pe") <= 25.0), "l6_4cond": known(c("yoy_pct") >= 20.0, c("pe") <= 25.0, c("market_cap") >= 0.5, c("trust_5d") > 0),
        "g4": known(c("yoy_pct") > 0, c("delta") > 0, c("delta_prev") < 0), "look_ahead": c("disclosed") > c("data_date")})


def distress_snapshot(prices: DataFrame, ma: int = 60, low: int = 60, ret: int = 40) -> DataFrame:
    """MA distance, low distance and return at the market's last date, full windows only."""
    w = own_rows()
    fm, fl = w.rowsBetween(-(ma - 1), 0), w.rowsBetween(-(low - 1), 0)
    c = F.col("close")
    d = prices.where(c > 0).select(
        "date", "entity", F.when(F.count(c).over(fm) >= ma, (c / F.avg(c).over(fm) - 1) * 100).alias("ma60_dist_pct"),
        F.when(F.count(c).over(fl) >= low, (c / F.min(c).over(fl) - 1) * 100).alias("low60_dist_pct"), ((c / F.lag(c, ret).over(w) - 1) * 100).alias("ret_pct"))
    return with_scalar(d, d.agg(F.max("date").alias("_z"))).where(F.col("date") == F.col("_z")).drop("_z")


def group_purity(fine: DataFrame, official: DataFrame) -> DataFrame:
    """Dominant official class of every fine group and its share of members; ties by class name."""
    j = fine.join(official.select("entity", F.col("grp").alias("official")), "entity", "left")
    n = j.groupBy("grp").agg(F.count(F.lit(1)).alias("n_total"))
    m = j.where(F.col("official").isNotNull()).groupBy("grp", "official").agg(F.count(F.lit(1)).alias("n_match"))
    w = Window.partitionBy("grp").orderBy(F.desc("n_match"), "official")
    top = m.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == 1).drop("_k")
    return n.join(top, "grp", "left").select("grp", "n_total", F.col("official").alias("dominant_official"), F.coalesce("n_match", F.lit(0)).alias("n_match"),
                                             (F.coalesce("n_match", F.lit(0)) / F.col("n_total")).alias("purity"))


def index_baskets(index: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per canonical name and date the first candidate index present, in preference order."""
    return index.join(F.broadcast(aliases), "index_name").groupBy("grp", "date").agg(F.min_by("close_index", "pref").alias("basket_index"))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def group_scores(members: DataFrame, keys: Sequence[str], sizes: DataFrame | None, weights: tuple[float, float, float, float], min_size: int) -> DataFrame:
    """Median momentum, entry rate, share bought and size, combined into a 0-100 score."""
    k = list(keys)
    g = members.groupBy(*k).agg(
        F.count(F.lit(1)).alias("members_count"), count_if(F.col("momentum") > 0).alias("up_count"), count_if(F.col("inst_net") > 0).alias("inst_buy_count"),
        count_if(F.col("foreign_net") > 0).alias("foreign_buy_count"), count_if(F.col("vol_ratio") >= 1.5).alias("vol_surge_count"))
    g = g.join(exact_quantiles(members, k, "momentum", {"momentum_med": 0.5}), k, "left")
    g = g.join(sizes, k, "left") if sizes is not None else g.withColumn("total", F.col("members_count"))
    g = with_scalar(g, g.agg(F.max("members_count").alias("_max")))
    n = F.col("members_count")
    parts = (sigmoid(F.col("momentum_med") / 5.0), n / F.coalesce("total", n), F.col("inst_buy_count") / n, F.ln(n + 1.0) / F.log1p(F.col("_max")))
    score = sum((w * 100.0 * p for w, p in zip(weights[1:], parts[1:])), weights[0] * 100.0 * parts[0])
    lead = 45.0 * F.col("foreign_buy_count") / n + 30.0 * F.col("vol_surge_count") / n + 25.0 * parts[0]
    return g.withColumns({"score": score, "lead_score": lead, "entry_rate": parts[1], "inst_score": parts[2]}).where(n >= min_size).drop("_max")


def leader_ranks(members: DataFrame, group: str = "grp") -> DataFrame:
    """Four normalised average ranks weighted 0.5/0.25/0.15/0.1 and the ordinal rank in the group."""
    w = {"momentum": 0.5, "amount_million": 0.25, "inst_net": 0.15, "strategy_count": 0.1}
    d = average_ranks(members, [group], {c: f"_r_{c}" for c in w}, None, "average", True)
    n = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(n, group)
    den = F.greatest((F.col("_n") - 1).cast("double"), F.lit(1.0))
    score = sum((wt * (1.0 - (F.col(f"_r_{c}") - 1.0) / den) for c, wt in list(w.items())[1:]), 0.5 * (1.0 - (F.col("_r_momentum") - 1.0) / den))
    d = d.withColumn("leader_score", rn(score, 9))
    return average_ranks(d, [group], {"leader_score": "_m"}, None, "min", True).withColumn(
        "rank_in_group", (F.col("_m") + F.row_number().over(Window.partitionBy(group, "leader_score").orderBy("entity")) - 1).cast("bigint")).drop("_m", "_n", *[f"_r_{c}" for c in w])


def join_flags(**conds: Column) -> Column:
    return F.concat_ws(";", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conds.items()])))


def flag_coverage(rows: DataFrame, flag: str, pct: float, min_members: int) -> DataFrame:
    """Marks rows of groups where at least pct% of the members carry the flag."""
    on = F.array_contains(F.split("flags", ";"), flag)
    g = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"), count_if(on).alias("_f"))
    share = F.col("_f") * 100.0 / F.col("_n")
    return rows.join(g, "grp").withColumn("note", F.when(on & (F.col("_n") >= min_members) & (share >= pct), F.format_string("%d/%d", "_f", "_n")))


def label_concentration(holdings: DataFrame, min_count: int, min_share: float) -> DataFrame:
    """Holdings per label and their share of all holdings."""
    n = holdings.agg(F.countDistinct("entity").alias("_n"))
    g = holdings.groupBy("label").agg(F.countDistinct("entity").alias("n_held"))
    g = with_scalar(g, n).withColumn("share", F.round(F.col("n_held") / F.col("_n"), 3))
    return g.withColumn("flagged", (F.col("n_held") >= min_count) | (F.col("n_held") / F.col("_n") >= min_share)).drop("_n")


def cluster_exposure(holdings: DataFrame, clusters: DataFrame) -> DataFrame:
    """Distinct holdings carrying any label of a cluster against its limits."""
    n = holdings.agg(F.countDistinct("entity").alias("_n"))
    g = holdings.join(F.broadcast(clusters), "label").groupBy("cluster", "max_count", "max_share").agg(F.countDistinct("entity").alias("n_held"))
    sh = F.col("n_held") / F.col("_n")
    return with_scalar(g, n).withColumn("share", F.round(sh, 3)).withColumn("flagged", (F.col("n_held") > F.col("max_count")) | (sh > F.col("max_share"))).drop("_n")


def _gram_edges(min_overlap: int, threshold: float):
    """Two blocks of names with their returns -> the pairs across them that correlate at the threshold."""

    def pairs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["block"] == key[0]], rows[rows["block"] == key[1]]
        days = np.unique(np.concatenate([np.concatenate(part["days"].to_list()) for part in (left, right) if len(part)]))

        def dense(part: pd.DataFrame, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
            x, there = np.zeros((len(part), hi - lo)), np.zeros((len(part), hi - lo))
            for i, (d, v) in enumerate(zip(part["days"], part["rets"])):
                at = np.searchsorted(days, d) - lo
                ok = (at >= 0) & (at < hi - lo)
                x[i, at[ok]], there[i, at[ok]] = v[ok], 1.0
            return x, there

        n, sx, sy, sxx, syy, sxy = (np.zeros((len(left), len(right))) for _ in range(6))
        for lo in range(0, len(days), GRAM_DAYS):
            hi = min(lo + GRAM_DAYS, len(days))
            (x, mx), (y, my) = dense(left, lo, hi), dense(right, lo, hi)
            for total, (u, v) in zip((n, sx, sy, sxx, syy, sxy), ((mx, my), (x, my), (mx, y), (x * x, my), (mx, y * y), (x, y))):
                total += u @ v.T
        m = np.maximum(n, 1.0)
        spread = np.sqrt(np.maximum(sxx / m - (sx / m) ** 2, 0.0) * np.maximum(syy / m - (sy / m) ** 2, 0.0))
        rho = (sxy / m - sx * sy / m**2) / np.where(spread > 1e-12, spread, np.nan)
        a, b = left["entity"].to_numpy(), right["entity"].to_numpy()
        i, j = np.nonzero((n >= min_overlap) & (np.abs(rho) >= threshold) & ((a[:, None] < b[None, :]) if key[0] == key[1] else True))
        swap = a[i] > b[j]
        return pd.DataFrame({"a": np.where(swap, b[j], a[i]), "b": np.where(swap, a[i], b[j]), "n": n[i, j].astype("int64"), "rho": rho[i, j]})

    return pairs


def correlation_edges(prices: DataFrame, holdings: DataFrame, window: int, min_overlap: int, threshold: float) -> DataFrame:
    """Pairs of *held* names whose last-window returns correlate at least at the threshold.

    Blocked Gram products: names are dealt to blocks of ``GRAM_NAMES``, each
    name is one row (its last ``window`` returns) that goes to every pair of
    blocks it belongs to, and a pair of blocks is six matrix products over
    stretches of ``GRAM_DAYS`` dates.  Only pairs at the threshold leave a
    task; what moves is one row per name and block, not one per pair and date,
    and a task holds two blocks.  Every pair is looked at, since names share
    only part of their dates and no bound on the common part holds without it.
    Names are integers; returns are taken from each name's own mean, which
    changes no correlation and keeps the sums small.
    """
    held = cut(holdings.select("entity").where("entity is not null").distinct())
    r = clipped_returns(prices.join(held, "entity", "left_semi"))
    w = Window.partitionBy("entity").orderBy(F.desc("date"))
    r = r.withColumn("_b", F.row_number().over(w)).where(F.col("_b") <= window)
    names = r.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct(F.unix_date("date").alias("d"), "ret"))).alias("x"), F.avg("ret").alias("mean"))
    blocks = held.agg(F.ceil(F.count(F.lit(1)) / GRAM_NAMES).alias("_blocks"))
    block = F.pmod(F.xxhash64("entity"), F.col("_blocks")).cast("int")
    names = cut(with_scalar(names, blocks).select(
        "entity", block.alias("block"), F.transform("x", lambda v: v["d"]).alias("days"), F.transform("x", lambda v: v["ret"] - F.col("mean")).alias("rets"), "_blocks"))
    dealt = names.withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col("_blocks") - 1).cast("int"))))
    dealt = dealt.withColumns({"_lo": F.least("block", "_other"), "_hi": F.greatest("block", "_other")}).drop("_other", "_blocks")
    kind = prices.schema["entity"].dataType.simpleString()
    return dealt.groupBy("_lo", "_hi").applyInPandas(_gram_edges(min_overlap, threshold), f"a {kind}, b {kind}, n bigint, rho double")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reached): min-label rounds, written out each round."""
    e = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    lab = cut(e.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:  # labels only fall, so this ends
        near = e.join(lab, e.b == lab.node).groupBy("a").agg(F.min("component").alias("_m"))
        nxt = lab.join(near, lab.node == near.a, "left").select("node", F.least("component", F.coalesce("_m", "component")).alias("component"))
        nxt = nxt.join(nxt.select(F.col("node").alias("_n"), F.col("component").alias("_c")), F.col("component") == F.col("_n"), "left").select(
            "node", F.least("component", F.coalesce("_c", "component")).alias("component"))
        nxt = cut(nxt)
        if nxt.exceptAll(lab).isEmpty():
            return nxt
        lab = nxt
