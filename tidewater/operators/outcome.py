"""Outcome tracking: forward and to-date returns, stops, week-over-week moves, ledgers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.exprs import count_if, own_rows, share, with_scalar
from tidewater.operators.asof import roll_forward
from tidewater.operators.breach import first_below
from tidewater.operators.order import exact_quantiles
from tidewater.operators.panel import clean_prices, with_cumulative_dividends
from tidewater.sources.staging import cut

# fixed patterns: labels and day counts are masked, then the first number after a break sign is the price
STOP_MASK = r"(?:MA|Ma|ma)\s*\d+|low_?\d+|\d+\s*日|\d+(?:\.\d+)?\s*%|\bT[1-9]\b"
STOP_PRICE = r"(?:破|<|＜)[^0-9]*?(\d+(?:\.\d+)?)"
# fixed values: rank of each layer; other names rank 9 before and 3 after, like an absent one
LAYER_ORDER = {"core": 0, "analyst": 1, "opportunity": 1, "pool": 2}


def stop_price(text: Column) -> Column:
    masked = F.regexp_replace(text, STOP_MASK, "◇")
    v = F.regexp_extract(masked, STOP_PRICE, 1)
    num = F.when(v != "", v).try_cast("double")
    return F.when(num > 0, num)


def entries(rows: DataFrame, prices: DataFrame, date_col: str) -> DataFrame:
    """Each row with the entity's first own row strictly after its date."""
    e = rows.withColumn("_ek", F.date_add(date_col, 1))
    return roll_forward(e, clean_prices(prices), "entity", "_ek", "date", "entry_date").drop("_ek")


def forward_returns(screens: DataFrame, prices: DataFrame, dividends: DataFrame, index: DataFrame, holds: Sequence[int]) -> DataFrame:
    """Per screen row and hold: entry next own row, exit ``hold`` own rows later, cash added back,
    index over the same dates; delisted when the market has matured but the entity has not."""
    w = own_rows()
    px = with_cumulative_dividends(clean_prices(prices), dividends)
    arr = F.array(*[F.struct(F.lit(h).alias("hold"), F.lead("date", h).over(w).alias("exit_date"), F.lead("close", h).over(w).alias("exit_price"),
                             (F.lead("cum_div", h).over(w) - F.col("cum_div")).alias("cash")) for h in holds])
    fwd = px.select("entity", F.col("date").alias("entry_date"), F.col("close").alias("entry_price"), arr.alias("x"))
    e = entries(screens, prices, "screened_at").where(F.col("entry_date").isNotNull())
    j = e.join(fwd, ["entity", "entry_date"]).select(*screens.columns, "entry_date", "entry_price", F.explode("x").alias("x")).select(*screens.columns, "entry_date", "entry_price", "x.*")
    n = index.agg(F.count(F.lit(1)).alias("n_days"))
    days = with_scalar(index.select("date", "market_index", F.row_number().over(Window.orderBy("date")).alias("k")), n)
    a = days.select(F.col("date").alias("entry_date"), F.col("market_index").alias("_m0"), (F.col("n_days") - F.col("k") + 1).alias("days_after"))
    b = days.select(F.col("date").alias("exit_date"), F.col("market_index").alias("_m1"))
    j = j.join(F.broadcast(a), "entry_date").join(F.broadcast(b), "exit_date", "left").where(F.col("days_after") > F.col("hold"))
    ret = (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price") * 100 + F.col("cash") / F.col("entry_price") * 100
    mkt = (F.col("_m1") - F.col("_m0")) / F.col("_m0") * 100
    return j.withColumns({"return_pct": ret, "market_pct": mkt, "excess_pct": ret - mkt, "status": F.when(F.col("exit_date").isNull(), "delisted").otherwise("matured")}).drop("_m0", "_m1", "days_after")


def strategy_summary(returns: DataFrame, keys: Sequence[str]) -> DataFrame:
    k = list(keys)
    ok = F.col("status") == "matured"
    g = returns.groupBy(*k).agg(
        count_if(ok).alias("sample_count"), count_if(F.col("status") == "delisted").alias("n_delisted"), F.avg(F.when(ok, (F.col("return_pct") > 0).cast("double"))).alias("win_rate"),
        F.avg(F.when(ok, F.col("return_pct"))).alias("avg_return_pct"), F.min(F.when(ok, F.col("return_pct"))).alias("worst_pct"), F.avg(F.when(ok, F.col("excess_pct"))).alias("avg_excess_pct"),
        F.avg(F.when(ok, (F.col("excess_pct") > 0).cast("double"))).alias("win_rate_vs_market"))
    m = returns.where(ok)
    return g.join(exact_quantiles(m, k, "return_pct", {"median_return_pct": 0.5}), k, "left").join(exact_quantiles(m, k, "excess_pct", {"median_excess_pct": 0.5}), k, "left")


def todate_returns(picks: DataFrame, prices: DataFrame, dividends: DataFrame, membership: DataFrame, min_members: int = 3) -> DataFrame:
    """Return since entry, worst close on the way, and the market's and group's median over the same window.

    The path minimum is a suffix minimum per entity, so no pick is joined to its path.
    """
    tail = Window.partitionBy("entity").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    px = with_cumulative_dividends(clean_prices(prices), dividends)
    d = px.select(
        "entity", F.col("date").alias("entry_date"), F.col("close").alias("entry_price"), F.min("close").over(tail).alias("path_min"),
        F.first("date").over(tail).alias("exit_date"), F.first("close").over(tail).alias("exit_price"), (F.first("cum_div").over(tail) - F.col("cum_div")).alias("cash"))
    e = entries(picks, prices, "data_date").join(d, ["entity", "entry_date"], "left")
    p = clean_prices(prices).select("date", "entity", "close")
    end = with_scalar(p, p.agg(F.max("date").alias("_z"))).where(F.col("date") == F.col("_z")).select("entity", F.col("close").alias("_x"))
    win = p.join(end, "entity").select("entity", F.col("date").alias("entry_date"), ((F.col("_x") / F.col("close") - 1.0) * 100).alias("v"))
    need = e.select("entry_date").distinct()
    win = win.join(F.broadcast(need), "entry_date", "left_semi")
    mk = exact_quantiles(win, ["entry_date"], "v", {"market_pct": 0.5})
    gr = exact_quantiles(membership.join(win, "entity"), ["grp", "entry_date"], "v", {"subind_pct": 0.5}, "subind_n")
    j = e.join(F.broadcast(mk), "entry_date", "left").join(gr, ["grp", "entry_date"], "left")
    ret = (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price") * 100 + F.col("cash") / F.col("entry_price") * 100
    status = F.when(F.col("entry_date").isNull(), "no_entry").when(F.col("exit_date") <= F.col("entry_date"), "no_window").otherwise("matured")
    j = j.withColumn("status", status)
    ok = F.col("status") == "matured"
    sub = F.when(F.coalesce("subind_n", F.lit(0)) >= min_members, F.col("subind_pct"))
    return j.withColumns({
        "return_pct": F.when(ok, ret), "path_min_pct": F.when(ok, (F.col("path_min") - F.col("entry_price")) / F.col("entry_price") * 100),
        "alpha_market": F.when(ok, ret - F.col("market_pct")), "alpha_subind": F.when(ok, ret - sub)})


def layer_summary(todate: DataFrame, keys: Sequence[str]) -> DataFrame:
    v = todate.where((F.col("status") == "matured") & F.col("return_pct").isNotNull())
    k = list(keys)
    g = v.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n"), share(F.col("return_pct") > 0).alias("win_rate"), F.avg("return_pct").alias("avg_return_pct"), F.avg("alpha_market").alias("avg_alpha_market"),
        share(F.col("alpha_market") > 0).alias("beat_market_rate"), F.avg("alpha_subind").alias("avg_alpha_subind"), F.count("alpha_subind").alias("n_subind"),
        F.min("return_pct").alias("worst_return_pct"), F.min("path_min_pct").alias("worst_path_pct"), F.max_by("entity", F.struct("return_pct", -F.col("entity"))).alias("best_entity"))
    return g.join(exact_quantiles(v, k, "return_pct", {"median_return_pct": 0.5}), k)


def stop_ledger(picks: DataFrame, prices: DataFrame, tolerance: float = 1.02) -> DataFrame:
    """First close below the stop, execution next row against execution after the next weekly review.

    The breach is looked up in blocks of minima (``first_below``); every later
    close is a lead of the breach's own row, so no pick carries a history.
    """
    w = own_rows()
    at = lambda c, n: F.lead(c, n).over(w)
    px = cut(clean_prices(prices).select(
        "entity", F.col("date").alias("_date"), F.col("close").alias("_close"), F.row_number().over(w).alias("_i"),
        at("close", 1).alias("_c1"), at("close", 6).alias("_c6"), at("close", 21).alias("_c21")))
    d = roll_forward(picks.withColumn("_ek", F.date_add("data_date", 1)), px, "entity", "_ek", "_date", "_entry").drop("_ek")
    first_row = px.select("entity", F.col("_date").alias("_entry"), F.col("_i").alias("_i0"), F.col("_close").alias("entry_price"))
    d = d.join(first_row, ["entity", "_entry"], "left").withColumn("stop_price", stop_price(F.col("stop")))
    d = d.withColumn("_sp", F.when(F.col("stop_price") <= F.col("entry_price") * tolerance, F.col("stop_price")))
    d = first_below(d, px.select("entity", "_i", "_close"), "entity", "_i0", "_sp", "_si")
    d = d.join(px.select("entity", F.col("_i").alias("_si"), F.col("_date").alias("signal_date"), F.col("_c1").alias("cond_price"), "_c6", "_c21"), ["entity", "_si"], "left")
    # The review after each trading day: both sides are calendars.
    one = F.lit(1).alias("_one")
    days = px.select("_date", F.date_add("_date", 1).alias("_next"), one).distinct()
    reviews = roll_forward(days, picks.select(F.col("data_date").alias("_review"), one).distinct(), "_one", "_next", "_review", "review_date")
    d = d.join(F.broadcast(reviews.select(F.col("_date").alias("signal_date"), "review_date")), "signal_date", "left")
    d = roll_forward(d.withColumn("_ek", F.date_add("review_date", 1)), px, "entity", "_ek", "_date", "_wd").drop("_ek")
    known = F.col("review_date").isNotNull() & F.col("cond_price").isNotNull()
    d = d.withColumn("_wd", F.when(known, F.col("_wd"))).join(px.select("entity", F.col("_date").alias("_wd"), F.col("_i").alias("_wi"), F.col("_close").alias("_wc")), ["entity", "_wd"], "left")
    pct = lambda c: (F.col(c) / F.nullif(F.col("cond_price"), F.lit(0.0)) - 1.0) * 100.0
    status = (
        F.when(F.col("_i0").isNull(), "no_price").when(F.col("_sp").isNull(), "unparsed").when(F.col("_si").isNull(), "not_triggered")
        .when(F.col("_wi").isNull(), "pending_review").otherwise("measured"))
    return d.select(
        *picks.columns, "stop_price", "entry_price", "signal_date", "cond_price", "review_date", (F.col("_wi") - F.col("_si") - 1).alias("delay_td"),
        pct("_wc").alias("delay_cost_pct"), pct("_c6").alias("fwd_r5_pct"), pct("_c21").alias("fwd_r20_pct"), status.alias("status"))


def week_over_week(picks: DataFrame) -> DataFrame:
    """Entities whose layer got worse, or that are absent, in the next recorded week."""
    order = F.create_map(*[F.lit(x) for kv in LAYER_ORDER.items() for x in kv])
    weeks = picks.select("week").distinct().select("week", F.lead("week").over(Window.orderBy("week")).alias("to_week"))
    nxt = picks.select(F.col("week").alias("to_week"), "entity", F.col("layer").alias("to_layer"))
    j = picks.join(F.broadcast(weeks), "week").where(F.col("to_week").isNotNull()).join(nxt, ["to_week", "entity"], "left")
    worse = F.coalesce(order[F.col("to_layer")], F.lit(3)) > F.coalesce(order[F.col("layer")], F.lit(9))
    return j.where(worse).select(F.col("week").alias("from_week"), "to_week", "entity", F.col("layer").alias("from_layer"), F.coalesce("to_layer", F.lit("absent")).alias("to_layer"))


def bucket_ledger(returns: DataFrame) -> DataFrame:
    """Mean return per exclusion reason and hold against the mean of the picks."""
    m = returns.where(F.col("status") == "matured")
    p = m.where(F.col("reason").isNull()).groupBy("hold").agg(F.avg("return_pct").alias("picks_avg"))
    e = m.where(F.col("reason").isNotNull()).groupBy("reason", "hold").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("excess_pct") > 0).alias("n_beat_market"), F.avg("return_pct").alias("avg_return_pct"))
    return e.join(F.broadcast(p), "hold", "left").withColumn("gap_pp", F.col("avg_return_pct") - F.col("picks_avg"))


def recall_check(returns: DataFrame, picks: DataFrame, prefix: str, layer: str = "opportunity", min_picks: int = 10, min_weeks: int = 12) -> DataFrame:
    """Tagged picks of a layer against its other picks, per hold, with one verdict.

    ``returns`` has week, entity, layer, hold, status, return_pct, excess_pct,
    ``picks`` week, entity, layer, thesis_tag.  ``eligible`` needs enough
    tagged picks or enough weeks since the first of them up to the last week of
    the ledger.  ``warn`` is set where both groups have matured rows on some
    hold and the tagged ones have the lower mean excess *and* the lower win
    rate on every such hold; an empty group never counts as worse.
    """
    mine = picks.where((F.col("layer") == layer) & F.coalesce(F.col("thesis_tag").startswith(prefix), F.lit(False))).select("week", "entity", "data_date").distinct()
    last = picks.agg(F.max("data_date").alias("_last"))
    head = mine.agg(F.countDistinct("week", "entity").alias("n_tagged"), F.min("data_date").alias("_first"))
    head = with_scalar(head, last).select("n_tagged", F.floor(F.datediff("_last", "_first") / 7).alias("weeks_elapsed"))
    eligible = (F.col("n_tagged") >= min_picks) | F.coalesce(F.col("weeks_elapsed") >= min_weeks, F.lit(False))
    ok = returns.where((F.col("status") == "matured") & F.col("return_pct").isNotNull() & (F.col("layer") == layer))
    keys = mine.select("week", "entity").distinct().withColumn("_tag", F.lit(True))
    g = ok.join(keys, ["week", "entity"], "left").groupBy("hold").agg(*[
        x for name, c in (("left", F.col("_tag").isNotNull()), ("other", F.col("_tag").isNull())) for x in (
            count_if(c).alias(f"n_{name}"), F.avg(F.when(c, F.col("excess_pct"))).alias(f"alpha_{name}"), F.avg(F.when(c, (F.col("return_pct") > 0).cast("double"))).alias(f"win_{name}"))])
    both = F.col("alpha_left").isNotNull() & F.col("alpha_other").isNotNull()
    worse = both & (F.col("alpha_left") < F.col("alpha_other")) & (F.col("win_left") < F.col("win_other"))
    verdict = g.agg(count_if(both).alias("n_comparable"), count_if(worse).alias("_worse"))
    d = with_scalar(with_scalar(g, head), verdict)
    return d.withColumn("eligible", eligible).withColumn("warn", F.col("eligible") & (F.col("n_comparable") > 0) & (F.col("_worse") == F.col("n_comparable"))).drop("_worse")


def entry_context(prices: DataFrame, dates: DataFrame, pullback: int = 10, ma: int = 60) -> DataFrame:
    from tidewater.functions.exprs import roll_avg

    w = own_rows()
    d = clean_prices(prices).select(
        "date", "entity", ((F.col("close") / F.lag("close", pullback).over(w) - 1) * 100).alias("ret_pullback_pct"),
        ((F.col("close") / roll_avg("close", w, ma) - 1) * 100).alias("ma_dist_pct"), (F.col("close") * F.col("volume") / 1e6).alias("amount_m"))
    return d.join(F.broadcast(dates.select("date")), "date", "left_semi")


def launch_status(launched: DataFrame, held: DataFrame, acted: DataFrame, considered: DataFrame, watch: DataFrame) -> DataFrame:
    """First matching status: held > acted > considered > watchlisted > never surfaced."""
    def flag(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
        return df.select(*keys).distinct().withColumn(name, F.lit(True))

    j = launched.join(flag(held, "_h", ["entity"]), "entity", "left").join(flag(acted, "_a", ["week", "entity"]), ["week", "entity"], "left")
    j = j.join(flag(considered, "_c", ["week", "entity"]), ["week", "entity"], "left").join(flag(watch, "_w", ["entity"]), "entity", "left")
    s = F.when(F.col("_h"), "held").when(F.col("_a"), "acted").when(F.col("_c"), "considered").when(F.col("_w"), "watchlisted").otherwise("never_surfaced")
    return j.withColumn("status", s).drop("_h", "_a", "_c", "_w")


LAUNCH_BUCKETS = ["held", "acted", "considered", "watchlisted", "never_liquid", "never_illiquid"]


def launch_summary(x: DataFrame, min_amount: float) -> DataFrame:
    b = F.when(F.col("status") != "never_surfaced", F.col("status")).when(F.col("amount_m") >= min_amount, "never_liquid").otherwise("never_illiquid")
    p = x.withColumn("_b", b).groupBy("week").pivot("_b", LAUNCH_BUCKETS).agg(F.count(F.lit(1)))
    p = p.fillna(0, LAUNCH_BUCKETS)
    return p.withColumn("total", sum((F.col(c) for c in LAUNCH_BUCKETS[1:]), F.col(LAUNCH_BUCKETS[0])))


# ------------------------------------------------------------- ledgers


def upsert_partitions(rows: DataFrame, path: str, part: str) -> None:
    """Replaces exactly the partitions present in ``rows``; running twice changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def on_time(rows: DataFrame, now: Column, rewrite_days: int) -> DataFrame:
    """Rows still inside their write window: a hard deadline, not a watermark."""
    return rows.where(now <= F.date_add("data_date", rewrite_days))


def with_frozen(rows: DataFrame, factors: Mapping[str, DataFrame], date_col: str = "data_date") -> DataFrame:
    """Rows with each factor's value of their own date, never of an earlier one; null where there is none.

    ``factors`` maps a name to a table (entity, date, value).  A table with two
    rows of one key would multiply rows, so callers compare counts before they write.
    Factors grow with entities and dates and pack so well on disk that a small
    file would be broadcast as millions of rows, so both sides are sorted.
    """
    for name, table in factors.items():
        key, day, value = table.columns[:3]
        table = table.select(F.col(key).alias("entity"), F.col(day).alias(date_col), F.col(value).alias(name))
        rows = rows.join(table.hint("merge"), ["entity", date_col], "left")
    return rows


def known_quarter(d: Column) -> Column:
    """Index (year*4+quarter-1) of the latest quarter past its deadline at ``d``."""
    y = F.year(d)
    md = F.month(d) * 100 + F.dayofmonth(d)
    return F.when(md >= 1114, y * 4 + 2).when(md >= 814, y * 4 + 1).when(md >= 515, y * 4).when(md >= 331, (y - 1) * 4 + 3).otherwise((y - 1) * 4 + 2)


def known_month(d: Column, avail_day: int = 11) -> Column:
    m = F.year(d) * 12 + F.month(d) - 1
    return F.when(F.dayofmonth(d) >= avail_day, m - 1).otherwise(m - 2)


def missing_weeks(have: DataFrame, ledger: DataFrame, min_coverage: float) -> DataFrame:
    """Weeks with input but no ledger row, or with too little coverage."""
    led = ledger.groupBy("week").agg(share(F.col("value").isNotNull()).alias("coverage"))
    j = have.select("week").distinct().join(led, "week", "left")
    return j.where(F.col("coverage").isNull() | (F.col("coverage") < min_coverage)).withColumn("issue", F.when(F.col("coverage").isNull(), "missing").otherwise("coverage"))
