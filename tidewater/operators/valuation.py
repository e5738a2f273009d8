"""Peer-relative and self-history valuation, gap legs, statements as of, DCF and models."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.exprs import own_rows, rn, with_scalar
from tidewater.operators.order import average_ranks, exact_quantiles
from tidewater.sources.staging import cut

REL = ("subind_median", "vs_subind_pct", "subind_pctile", "peer_n")
# fixed label values
NO_PE, CHEAP, CHEAP_PB = "無本益比", "相對便宜", "相對便宜(PB)"


def peer_relative(values: DataFrame, membership: DataFrame, col: str, keys: Sequence[str] = (), min_peers: int = 5) -> DataFrame:
    """Group median, % against it and rank percentile of positive values, averaged over an entity's groups.

    ``keys`` (for example a week) lets one job value every snapshot at once.
    """
    k = [*keys, "grp"]
    v = values.where(F.col(col) > 0).select(*keys, "entity", F.col(col).alias("_v"))
    pairs = cut(membership.select("grp", "entity").join(v, "entity"))
    med = exact_quantiles(pairs, k, "_v", {"_median": 0.5})
    d = average_ranks(pairs, k, {"_v": "_rank"}, "_n").where(F.col("_n") >= min_peers).join(med, k)
    d = d.withColumns({
        "_rel": (F.col("_v") / F.col("_median") - 1) * 100,
        "_p": F.when(F.col("_n") > 1, (F.col("_rank") - 1) / F.nullif(F.col("_n") - 1, F.lit(0)) * 100),
    })
    return d.groupBy(*keys, "entity").agg(
        rn(F.avg("_median"), 2).alias("subind_median"), rn(F.avg("_rel"), 1).alias("vs_subind_pct"),
        rn(F.avg("_p"), 1).alias("subind_pctile"), F.max("_n").alias("peer_n"))


def fill_from_broad(fine: DataFrame, broad: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    b = broad.withColumnsRenamed({x: f"_b_{x}" for x in REL})
    j = fine.join(b, [*keys, "entity"], "full")
    used = F.col("subind_pctile").isNull() & F.col("_b_subind_pctile").isNotNull()
    return j.select(*keys, "entity", *[F.coalesce(x, f"_b_{x}").alias(x) for x in REL], used.alias("used_broad"))


def build_valuation(ratios: DataFrame, membership: DataFrame, broad: DataFrame, keys: Sequence[str] = (), min_peers: int = 5, cheap: float = 30.0) -> DataFrame:
    """PE against peers, PB where there is no PE, with fallback to the broad group."""
    base = ratios.select(*keys, "entity", rn("pe", 2).alias("pe"), rn("pbr", 2).alias("pbr"), rn("dividend_yield", 2).alias("dividend_yield"))
    k = [*keys, "entity"]
    out = base
    for col, pre in (("pe", "pe"), ("pbr", "pb")):
        rel = fill_from_broad(peer_relative(base, membership, col, keys, min_peers), peer_relative(base, broad, col, keys, min_peers), keys)
        out = out.join(rel.withColumnsRenamed({x: f"{pre}_{x}" for x in (*REL, "used_broad")}), k, "left")
    has = F.col("pe_subind_pctile").isNotNull()

    def pick(x: str) -> Column:
        return F.when(has, F.col(f"pe_{x}")).otherwise(F.col(f"pb_{x}"))

    out = out.withColumns({
        "pe_status": F.when(F.col("pe") > 0, "ok").otherwise(NO_PE),
        "val_metric": F.when(has, "PE").when(F.col("pb_subind_pctile").isNotNull(), "PB"),
        "val_median": pick("subind_median"), "val_vs_subind_pct": pick("vs_subind_pct"),
        "val_pctile": F.coalesce("pe_subind_pctile", "pb_subind_pctile"), "val_peer_n": pick("peer_n"), "used_broad": F.coalesce(pick("used_broad"), F.lit(False)),
    })
    flag = F.when(F.col("val_pctile") <= cheap, F.when(F.col("val_metric") == "PB", CHEAP_PB).otherwise(CHEAP)).otherwise("")
    return out.withColumn("cheap_flag", flag)


def self_percentile(history: DataFrame, min_n: int = 8) -> DataFrame:
    """Rank percentile of the latest positive PE within the entity's own history (calendar-bounded)."""
    v = history.where(F.col("pe") > 0)
    w = Window.partitionBy("entity")
    ties = F.count(F.lit(1)).over(Window.partitionBy("entity", "pe"))
    d = v.select(
        "entity", "date", (F.rank().over(w.orderBy("pe")) + (ties - 1) / F.lit(2.0)).alias("_r"), F.count(F.lit(1)).over(w).alias("n"),
        F.max("date").over(w).alias("_last")).where((F.col("date") == F.col("_last")) & (F.col("n") >= min_n))
    p = F.when(F.col("n") > 1, (F.col("_r") - 1) / F.nullif(F.col("n") - 1, F.lit(0)) * 100).otherwise(F.lit(50.0))
    return d.select("entity", rn(p, 1).alias("pe_self_pctile"), F.col("n").alias("pe_self_n"))


def self_medians(history: DataFrame, min_n: int = 8) -> DataFrame:
    """Medians of the entity's own positive PE, PB and yield (one row per day at most, so bounded)."""
    cols = {"pe": "pe_self_median", "pbr": "pb_self_median", "dividend_yield": "yield_self_median"}
    aggs = []
    for c, o in cols.items():
        v = F.when(F.col(c) > 0, F.col(c))
        aggs.append(F.when(F.count(v) >= min_n, rn(F.percentile(v, 0.5), 2)).alias(o))
    return history.groupBy("entity").agg(*aggs)


def history_medians(history: DataFrame, cols: dict[str, str], days: int | None = None) -> DataFrame:
    """entity, date, each output and n_<output>: median and number of an entity's values up to the date, or in a trailing range of calendar days.

    A frame that buffers and sorts its window for every row costs the square
    of a history.  Here an entity's rows (one a day at most, so bounded by the
    calendar) pass once through a running median, which inserts and removes
    one value a row.  Nulls are no values.
    """
    outs = list(cols.values())
    schema = ", ".join([f"entity {dict(history.dtypes)['entity']}", "date date", *[f"{o} double, n_{o} long" for o in outs]])

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        values = rows[list(cols)].astype("float64").set_axis(pd.to_datetime(rows["date"]), axis=0)
        frame = values.rolling(f"{days}D", min_periods=1) if days else values.expanding(min_periods=1)
        middle, number = frame.median(), frame.count()
        out = {"entity": rows["entity"].to_numpy(), "date": rows["date"].to_numpy()}
        for c, o in cols.items():
            out |= {o: middle[c].to_numpy(), f"n_{o}": number[c].to_numpy().astype("int64")}
        return pd.DataFrame(out)

    return history.select("entity", "date", *cols).groupBy("entity").applyInPandas(one, schema)


def self_medians_upto(history: DataFrame, min_n: int = 8) -> DataFrame:
    """The same at every date with the history up to it."""
    cols = {"pe": "pe_self_median", "pbr": "pb_self_median", "dividend_yield": "yield_self_median"}
    positive = history.select("entity", "date", *[F.when(F.col(c) > 0, F.col(c)).alias(c) for c in cols])
    d = history_medians(positive, cols)
    return d.select("entity", "date", *[F.when(F.col(f"n_{o}") >= min_n, rn(F.col(o), 2)).alias(o) for o in cols.values()])


def implied_price(price: Column, ratio: Column, ref: Column) -> Column:
    return F.when(ratio > 0, rn(price * (ref / F.nullif(ratio, F.lit(0.0))), 2))


def implied_price_yield(price: Column, y: Column, ref: Column) -> Column:
    return F.when((price > 0) & (y > 0) & (ref > 0), rn(price * (y / F.nullif(ref, F.lit(0.0))), 2))


def gap_pct(implied: Column, price: Column) -> Column:
    return F.when(price > 0, rn((implied / F.nullif(price, F.lit(0.0)) - 1) * 100, 1))


def peg_like(pe: Column, yoy: Column) -> Column:
    return F.when((pe > 0) & (yoy > 0), rn(pe / F.nullif(yoy, F.lit(0.0)), 2))


def composite_gap(legs: Sequence[Column]) -> tuple[Column, Column]:
    """Median of the known legs rounded to one decimal, and how many are known."""
    a = F.array_sort(F.array_compact(F.array(*legs)))
    n = F.size(a)
    mid = F.floor(n / 2).cast("int")
    odd = F.try_element_at(a, mid + 1)
    even = (F.try_element_at(a, F.greatest(mid, F.lit(1))) + odd) / 2
    return F.when(n > 0, rn(F.when(n % 2 == 1, odd).otherwise(even), 1)), n


def gap_legs(snapshot: DataFrame) -> DataFrame:
    """Six gaps and their composite from a row with price, ratios and reference medians."""
    c = F.col
    price = c("close")
    peer_ratio = F.when(c("val_metric") == "PE", c("pe")).when(c("val_metric") == "PB", c("pbr"))
    legs = {
        "gap_peer": gap_pct(implied_price(price, peer_ratio, c("val_median")), price),
        "gap_self": gap_pct(implied_price(price, c("pe"), c("pe_self_median")), price),
        "gap_pb_peer": gap_pct(implied_price(price, c("pbr"), c("pb_peer_median")), price),
        "gap_pb_self": gap_pct(implied_price(price, c("pbr"), c("pb_self_median")), price),
        "gap_yield_peer": gap_pct(implied_price_yield(price, c("dividend_yield"), c("yield_peer_median")), price),
        "gap_yield_self": gap_pct(implied_price_yield(price, c("dividend_yield"), c("yield_self_median")), price),
    }
    d = snapshot.withColumns(legs)
    comp, n = composite_gap([F.col(x) for x in legs])
    return d.withColumns({"composite": comp, "n_legs": n})


def gap_panel(ratios: DataFrame, prices: DataFrame, snapshots: DataFrame, membership: DataFrame, broad: DataFrame, min_peers: int = 5, min_n: int = 8) -> DataFrame:
    """Gap legs of every entity in every snapshot week, all weeks in one job."""
    days = F.broadcast(snapshots.select("date"))
    snap = cut(ratios.join(days, "date", "left_semi").join(prices.select("date", "entity", "close"), ["date", "entity"]))
    k = ["date"]
    val = build_valuation(snap, membership, broad, k, min_peers).select("date", "entity", "val_metric", "val_median", "pe", "pbr", "dividend_yield", F.col("pb_subind_median").alias("pb_peer_median"))
    dy = fill_from_broad(peer_relative(snap, membership, "dividend_yield", k, min_peers), peer_relative(snap, broad, "dividend_yield", k, min_peers), k)
    self_m = self_medians_upto(ratios, min_n).join(days, "date", "left_semi")
    j = snap.select("date", "entity", "close").join(val, ["date", "entity"]).join(dy.select("date", "entity", F.col("subind_median").alias("yield_peer_median")), ["date", "entity"], "left")
    return gap_legs(j.join(self_m, ["date", "entity"], "left"))


def daily_medians(ratios: DataFrame) -> DataFrame:
    """Market median and count of each ratio per date, selected in one pass over (date, ratio)."""
    cols = ("pe", "pbr", "dividend_yield")
    x = F.explode(F.array(*[F.struct(F.lit(c).alias("r"), F.col(c).alias("v")) for c in cols]))
    long = ratios.select("date", x.alias("x")).select("date", "x.*")
    q = exact_quantiles(long, ["date", "r"], "v", {"m": 0.5}, "n")
    return q.groupBy("date").agg(*[
        e for c in cols for e in (F.max(F.when(F.col("r") == c, F.col("m"))).alias(f"median_{c}"), F.coalesce(F.max(F.when(F.col("r") == c, F.col("n"))), F.lit(0)).alias(f"n_{c}"))])


def calendar_medians(ratios: DataFrame, days: int, min_obs: int) -> DataFrame:
    """Medians over a trailing calendar-day range with enough observations; a yield of zero is none."""
    cols = {"pe": "pe_self_med", "pbr": "pb_self_med", "dividend_yield": "dy_self_med"}
    d = history_medians(ratios.withColumn("dividend_yield", F.nullif("dividend_yield", F.lit(0.0))), cols, days)
    return d.select("date", "entity", *[F.when(F.col("n_pb_self_med") >= min_obs, F.col(o)).alias(o) for o in cols.values()])


# ------------------------------------------------------------- statements and DCF


def deadline(year: Column, quarter: Column) -> Column:
    """Filing deadline of a quarter (15 May, 14 Aug, 14 Nov, 31 Mar of the next year)."""
    return (
        F.when(quarter == 1, F.make_date(year, F.lit(5), F.lit(15))).when(quarter == 2, F.make_date(year, F.lit(8), F.lit(14)))
        .when(quarter == 3, F.make_date(year, F.lit(11), F.lit(14))).otherwise(F.make_date(year + 1, F.lit(3), F.lit(31)))
    )


def annual_totals(single: DataFrame, col: str) -> DataFrame:
    """Year totals with four known quarters, else null."""
    return single.where(F.col(col).isNotNull()).groupBy("entity", "year").agg(F.when(F.count(F.lit(1)) >= 4, F.sum(col)).alias(col), F.count(F.lit(1)).alias("n_q"))


def loss_flags(single: DataFrame, col: str, n: int = 4) -> DataFrame:
    w = Window.partitionBy("entity").orderBy(F.desc("year"), F.desc("quarter"))
    d = single.where(F.col(col).isNotNull()).withColumn("_b", F.row_number().over(w)).where(F.col("_b") <= n)
    return d.groupBy("entity").agg(F.when(F.count(F.lit(1)) >= n, F.max(F.col(col) < 0)).alias("any_quarterly_loss"))


def ordered_values(annual: DataFrame, col: str, out: str, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """The entity's known yearly values in year order, as an array."""
    g = annual.where(F.col(col).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("year", F.col(col).alias("v")))).alias("_a"))
    return g.select(*keys, F.transform("_a", lambda x: x["v"]).alias(out))


def conservative_growth(rev: Column, years: int = 5, haircut: float = 0.7, cap: float = 15.0, floor: float = 0.0) -> Column:
    win = F.slice(rev, F.greatest(F.size(rev) - years + 1, F.lit(1)), F.lit(years))
    first, last, n = F.try_element_at(win, F.lit(1)), F.try_element_at(win, F.lit(-1)), F.size(win) - 1
    rate = (F.pow(last / F.nullif(first, F.lit(0.0)), F.lit(1.0) / F.greatest(n, F.lit(1))) - 1.0) * 100.0 * haircut
    return F.when((F.size(rev) >= 3) & (first > 0) & (last > 0), F.greatest(F.lit(floor), F.least(F.lit(cap), rate)))


def yoy_swing(rev: Column, recent: int = 3) -> Column:
    """Spread of the last yearly growth rates, in percentage points."""
    pos = F.filter(rev, lambda v: v > 0)
    n = F.size(pos)
    tail = F.slice(pos, F.greatest(n - recent, F.lit(1)), F.lit(recent + 1))
    g = F.transform(F.sequence(F.lit(2), F.lit(recent + 1)), lambda i: (F.try_element_at(tail, i) / F.try_element_at(tail, i - 1) - 1.0) * 100.0)
    return F.when(n >= recent + 1, F.array_max(g) - F.array_min(g))


def fcf_base(fcf: Column) -> Column:
    n = F.size(fcf)
    last = F.try_element_at(fcf, F.lit(-1))
    avg3 = F.aggregate(F.slice(fcf, F.greatest(n - 2, F.lit(1)), F.lit(3)), F.lit(0.0), lambda a, v: a + v) / 3.0
    return F.when(n >= 3, F.least(avg3, last)).when(n >= 1, last)


def dcf_value(fcf0: Column, growth: Column, rate: Column, terminal: Column, years: int, net_debt: Column, shares: Column) -> Column:
    """Two-stage value per share."""
    g, r, gt = growth / 100.0, rate / 100.0, terminal / 100.0
    one = F.lit(1.0)
    pv = F.aggregate(F.sequence(F.lit(1), F.lit(years)), F.lit(0.0), lambda a, t: a + fcf0 * F.pow(one + g, t) / F.pow(one + r, t))
    tv = fcf0 * F.pow(one + g, F.lit(years)) * (one + gt) / F.nullif(r - gt, F.lit(0.0)) / F.pow(one + r, F.lit(years))
    return F.when((shares > 0) & (r > gt), (pv + tv - net_debt) / F.nullif(shares, F.lit(0.0)))


EXCLUDED = ("排除：產業別未知", "排除：產業不適用", "排除：近 4 季有單季虧損", "排除：營收極端週期", "排除：資料不足", "排除：自由現金流為負／零")


def dcf_table(inputs: DataFrame, cost_of_equity: float, floor: float = 8.0, terminal: float = 2.0, spread: float = 3.0, years: int = 10,
              step: float = 1.0, swing_max: float = 40.0, exclude: Sequence[str] = ()) -> DataFrame:
    """Whole-market DCF: first exclusion reason, bound discount rate, value and sensitivity cells."""
    c = F.col
    sh, nd = c("shares").cast("double"), F.coalesce(c("net_debt").cast("double"), F.lit(0.0))
    reason = F.coalesce(
        F.when(c("industry").isNull(), EXCLUDED[0]), F.when(c("industry").isin(list(exclude)), EXCLUDED[1]), F.when(c("any_quarterly_loss"), EXCLUDED[2]),
        F.when(c("swing") > swing_max, EXCLUDED[3]), F.when(c("fcf0").isNull() | c("growth").isNull() | sh.isNull() | (sh <= 0), EXCLUDED[4]), F.when(c("fcf0") <= 0, EXCLUDED[5]))
    rate, bind = max(cost_of_equity, floor), "floor" if floor >= cost_of_equity else "computed"
    if rate < terminal + spread:
        rate, bind = terminal + spread, "spread"
    ok = reason.isNull()

    def v(r: float, gt: float, mult: float = 1.0) -> Column:
        return F.when(ok, dcf_value(c("fcf0"), c("growth") * mult, F.lit(r), F.lit(gt), years, nd, sh))

    def corner(r: float, gt: float) -> Column:
        return v(max(r, gt + spread), gt)

    return inputs.withColumns({
        "dcf_exclude_reason": reason, "dcf_applicable": ok, "dcf_discount_rate": F.when(ok, F.lit(rate)), "dcf_rate_binding": F.when(ok, F.lit(bind)),
        "dcf_value": v(rate, terminal), "s_dn_dn": corner(rate - step, terminal - step), "s_dn_up": corner(rate - step, terminal + step), "s_up_dn": corner(rate + step, terminal - step),
        "s_up_up": corner(rate + step, terminal + step), "s_g050": v(rate, terminal, 0.5), "s_g075": v(rate, terminal, 0.75)})


def statements_asof(single: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per anchor and entity: trailing-four-quarter sums when the last four filed quarters are consecutive.

    A quarter is usable at the first anchor after its deadline and after, until
    the next one's; the rows made are those of the result, by an equality join
    on the month.
    """
    w = Window.partitionBy("entity").orderBy("qi")
    q = single.withColumn("qi", F.col("year") * 4 + F.col("quarter") - 1).withColumn("known", deadline(F.col("year"), F.col("quarter")))
    f4 = w.rowsBetween(-3, 0)
    full = (F.col("qi") - F.lag("qi", 3).over(w)) == 3
    q = q.select(
        "entity", "qi", "year", "quarter", "known",
        *[F.when(full & (F.count(x).over(f4) == 4), F.sum(x).over(f4)).alias(f"{x}_ttm") for x in ("revenue", "income", "eps")],
        F.when(full, F.max((F.col("income") < 0).cast("int")).over(f4)).alias("any_loss"))
    # A filing is the latest one from the day after its deadline to the deadline of the next; its months meet the anchors, one a month.
    month = lambda d: F.year(d) * 12 + F.month(d)
    q = with_scalar(q.withColumn("kd_next", F.lead("known").over(w)), anchors.agg(F.max("anchor").alias("_end")))
    until = F.greatest(F.coalesce("kd_next", "_end"), F.col("known"))
    q = q.withColumn("_m", F.explode(F.sequence(month("known"), month(until))))
    days = F.broadcast(anchors.select("anchor", month("anchor").alias("_m")))
    held = (F.col("known") < F.col("anchor")) & F.coalesce(F.col("anchor") <= F.col("kd_next"), F.lit(True))
    return q.join(days, "_m").where(held).select("entity", "anchor", "qi", "revenue_ttm", "income_ttm", "eps_ttm", "any_loss")


def derive_shares(income: Column, eps: Column, equity: Column, price: Column, pbr: Column, min_eps: float = 0.1) -> Column:
    a = F.when(F.abs(eps) >= min_eps, income / F.nullif(eps, F.lit(0.0)))
    b = F.when((equity > 0) & (pbr > 0) & (price > 0), equity / F.nullif(price / F.nullif(pbr, F.lit(0.0)), F.lit(0.0)))
    return F.coalesce(F.when(a > 0, a), b)


def leave_self_out_median(values: DataFrame, keys: Sequence[str], col: str, out: str, min_peers: int = 5) -> DataFrame:
    """Median of the other members' positive values, from ranks instead of pairs.

    Removing the element of rank r from n sorted values moves every later
    position by one, so the median of the rest is found among four middle
    order statistics of the whole group.
    """
    ks = list(keys)
    v = values.where(F.col(col) > 0)

    def pos(f):
        return lambda n: (F.greatest(F.least(f(n), n - 1), F.lit(0)), F.greatest(F.least(f(n), n - 1), F.lit(0)), F.lit(0.0))

    lo = lambda n: F.floor((n - 2) / 2)  # noqa: E731  lower middle of n-1 values
    hi = lambda n: F.floor((n - 1) / 2)  # noqa: E731  upper middle of n-1 values
    q = exact_quantiles(v, ks, col, {"a0": pos(lo), "a1": pos(lambda n: lo(n) + 1), "b0": pos(hi), "b1": pos(lambda n: hi(n) + 1)}, "_n")
    d = average_ranks(v, ks, {col: "_r"}, None, "min").join(q, ks)
    r0 = F.col("_r") - 1  # any position of an equal value gives the same remainder
    low = F.when(r0 <= lo(F.col("_n")), F.col("a1")).otherwise(F.col("a0"))
    high = F.when(r0 <= hi(F.col("_n")), F.col("b1")).otherwise(F.col("b0"))
    return d.withColumn(out, F.when(F.col("_n") - 1 >= min_peers, (low + high) / 2)).drop("_r", "_n", "a0", "a1", "b0", "b1")


def composite_main(models: Sequence[Column], price: Column, lo: float = 0.4, hi: float = 2.0) -> tuple[Column, Column]:
    kept = F.filter(F.array(*models), lambda v: (v > 0) & (v >= lo * price) & (v <= hi * price))
    n = F.size(kept)
    return F.when(n > 0, F.aggregate(kept, F.lit(0.0), lambda a, v: a + v) / F.nullif(n, F.lit(0))), n


def composite_raw(models: Sequence[Column]) -> Column:
    a = F.array_sort(F.filter(F.array(*models), lambda v: v > 0))
    n = F.size(a)
    mid = F.floor(n / 2).cast("int")
    odd = F.try_element_at(a, mid + 1)
    return F.when(n > 0, F.when(n % 2 == 1, odd).otherwise((F.try_element_at(a, F.greatest(mid, F.lit(1))) + odd) / 2))
