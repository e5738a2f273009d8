"""Forward-return panel, total-return targets and panel health."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.exprs import own_rows, roll_avg, running, share
from tidewater.operators.asof import roll_forward
from tidewater.operators.order import exact_quantiles
from tidewater.sources.staging import cut

HORIZONS = (5, 10, 20, 40)


def clean_prices(prices: DataFrame) -> DataFrame:
    return prices.where(F.col("close").isNotNull() & (F.col("close") > 0))


def dividends_on_rows(prices: DataFrame, dividends: DataFrame) -> DataFrame:
    """entity, date, cash: each event moved to that entity's next own row and summed."""
    ev = (
        dividends.where(F.col("cash") > 0)
        .groupBy("entity", "ex_date").agg(F.sum("cash").alias("cash"))
    )
    return (
        roll_forward(ev, prices, "entity", "ex_date", "date", "date")
        .where(F.col("date").isNotNull())
        .groupBy("entity", "date").agg(F.sum("cash").alias("div_cash"))
    )


def with_cumulative_dividends(prices: DataFrame, dividends: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Prices with ``cum_div`` and the columns of ``more`` (one row per entity and date at most).

    All rows of an entity come together in one shuffle, in which they also stay
    for the windows over its dates; after joins they would be shuffled again.
    """
    cash = dividends_on_rows(prices, dividends)
    extra = [] if more is None else [x for x in more.columns if x not in ("entity", "date")]
    rows = prices.withColumn("_own", F.lit(True)).unionByName(cash, allowMissingColumns=True)
    rows = rows if more is None else rows.unionByName(more, allowMissingColumns=True)
    same = Window.partitionBy("entity", "date")
    known = F.col("entity").isNotNull() & F.col("date").isNotNull()
    rows = rows.repartition("entity").withColumns({x: F.when(known, F.max(x).over(same)) for x in ("div_cash", *extra)}).where("_own")
    return rows.select(*prices.columns, *extra, F.sum(F.coalesce("div_cash", F.lit(0.0))).over(running(own_rows())).alias("cum_div"))


def forward_levels(
    px: DataFrame, horizons: Sequence[int] = HORIZONS, ma_windows: Sequence[int] = (20, 60), vol_lookback: int = 20
) -> DataFrame:
    """r{h}: entry at the next own row, exit h rows later, cash in between added."""
    w = own_rows()
    entry = F.lead("close", 1).over(w)
    cols = [F.col(x) for x in px.columns if x != "cum_div"]
    for h in horizons:
        cash = F.lead("cum_div", 1 + h).over(w) - F.lead("cum_div", 1).over(w)
        cols.append(((F.lead("close", 1 + h).over(w) - entry + cash) / entry * 100).alias(f"r{h}"))
    for k in ma_windows:
        cols.append(((F.col("close") / roll_avg("close", w, k) - 1) * 100).alias(f"ma{k}_dist_pct"))
    prior = w.rowsBetween(-vol_lookback, -1)
    base = F.when(F.count("volume").over(prior) >= vol_lookback, F.avg("volume").over(prior))
    cols.append(F.when(base > 0, F.col("volume") / base).alias("vol_ratio"))
    return px.select(*cols)


def with_market_median(panel: DataFrame, horizons: Sequence[int] = HORIZONS, counted: DataFrame | None = None) -> DataFrame:
    """mkt_ew_r{h} (median of the date, over the rows ``counted`` if given) and alpha{h}; one selection pass for all horizons."""
    long = (panel if counted is None else counted).select(
        "date",
        F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"r{h}").alias("v")) for h in horizons])).alias("e"),
    ).select("date", F.col("e.h").alias("h"), F.col("e.v").alias("v"))
    med = exact_quantiles(long, ["date", "h"], "v", {"m": 0.5})
    wide = med.groupBy("date").agg(
        *[F.max(F.when(F.col("h") == h, F.col("m"))).alias(f"mkt_ew_r{h}") for h in horizons]
    )
    out = panel.join(F.broadcast(cut(wide)), "date", "left")  # one row a date, written so that a reader of the panel joins it only
    return out.withColumns({f"alpha{h}": F.col(f"r{h}") - F.col(f"mkt_ew_r{h}") for h in horizons})


def first_tag(membership: DataFrame, order: str = "grp") -> DataFrame:
    return membership.groupBy("entity").agg(F.min_by("grp", order).alias("sub_industry"))


def build_price_panel(
    prices: DataFrame,
    dividends: DataFrame,
    flows: DataFrame | None = None,
    membership: DataFrame | None = None,
    market: DataFrame | None = None,
    regime: DataFrame | None = None,
    horizons: Sequence[int] = HORIZONS,
) -> DataFrame:
    """One row per (date, entity) with targets, levels, flows, label and first tag.

    ``market`` maps entity -> market; flows of a market-day without any flow
    row are null (not fetched), never zero.  What a row has of its own is
    written once; medians of its date and returns against them are joined by
    every reader, so the wide panel is never written.
    """
    nets = ["foreign_net", "trust_net", "dealer_net"]
    fl = None if flows is None else flows.select("date", "entity", *nets)
    px = with_cumulative_dividends(clean_prices(prices), dividends, fl)
    panel = forward_levels(px, horizons)
    if flows is not None:
        mk = (
            flows.select("entity").distinct().withColumn("market", F.lit("all")) if market is None else market
        )
        # an entity listed twice has two rows, of which medians count one
        mk = mk.withColumn("_again", F.row_number().over(Window.partitionBy("entity").orderBy("market")) > 1)
        covered = fl.join(mk, "entity").select("date", "market").distinct().withColumn("chip_coverage", F.lit(True))
        panel = (
            panel.join(mk, "entity", "left").join(covered, ["date", "market"], "left")
            .withColumn("chip_coverage", F.coalesce("chip_coverage", F.lit(False)))
        )
        panel = panel.withColumns({x: F.when(F.col("chip_coverage"), F.col(x)) for x in nets}).drop("market")
    if regime is not None:
        panel = panel.join(regime.select("date", F.col("regime_label").alias("regime")), "date", "left")
    if membership is not None:
        panel = panel.join(first_tag(membership), "entity", "left")
    panel = cut(panel)
    if flows is None:
        return with_market_median(panel, horizons)
    return with_market_median(panel, horizons, panel.where("_again is null or not _again")).drop("_again")


def panel_summary(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long health table: size counts and the non-null share of each column, in one pass."""
    agg = panel.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        F.countDistinct("entity").cast("double").alias("stocks"),
        F.countDistinct("date").cast("double").alias("trading_days"),
        *[share(F.col(x).isNotNull()).alias(f"coverage_{x}") for x in columns],
    )
    return agg.unpivot([], agg.columns, "metric", "value")


def coverage_by_year(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    agg = panel.groupBy(F.year("date").alias("year")).agg(
        *[share(F.col(x).isNotNull()).alias(x) for x in columns]
    )
    return agg.unpivot(["year"], list(columns), "column", "coverage")


def reconcile_close(panel: DataFrame, reference: DataFrame, tol_pct: float = 0.5) -> DataFrame:
    """Close of the panel against an independent close on the same key."""
    ref = reference.where(F.col("close_ref").isNotNull()).select("date", "entity", "close_ref")
    diff = F.abs(F.col("close_panel") - F.col("close_ref")) / F.col("close_ref") * 100
    return (
        panel.select("date", "entity", F.col("close").alias("close_panel"))
        .join(ref, ["date", "entity"])
        .withColumn("diff_pct", diff)
        .withColumn("within_tol", F.col("diff_pct") < tol_pct)
    )


# ------------------------------------------------------------- total return


def adjustment_events(dividends: DataFrame) -> DataFrame:
    """entity, ex_date, adj: before/after price ratio, null when it is unusable."""
    ok = F.col("before_price").isNotNull() & F.col("after_price").isNotNull()
    ok = ok & (F.col("before_price") > 0) & (F.col("after_price") > 0)
    return dividends.select(
        "entity", "ex_date", F.when(ok, F.col("before_price") / F.col("after_price")).alias("adj")
    )


def total_return_levels(prices: DataFrame, events: DataFrame) -> DataFrame:
    """Per row: running log adjustment and running count of invalid events."""
    px = clean_prices(prices)
    aligned = (
        roll_forward(events, px, "entity", "ex_date", "date", "date")
        .where(F.col("date").isNotNull())
        .groupBy("entity", "date")
        .agg(
            F.sum(F.ln(F.coalesce("adj", F.lit(1.0)))).alias("_l"),
            F.count(F.when(F.col("adj").isNull(), 1)).alias("_b"),
        )
    )
    w = running(own_rows())
    return px.join(aligned, ["entity", "date"], "left").select(
        "date", "entity", "close",
        F.sum(F.coalesce("_l", F.lit(0.0))).over(w).alias("log_factor"),
        F.sum(F.coalesce("_b", F.lit(0))).over(w).alias("n_bad"),
    )


def total_return_targets(
    prices: DataFrame, events: DataFrame, horizons: Sequence[int], covered: DataFrame | None = None
) -> DataFrame:
    """r{h} with multiplicative adjustment; null when an invalid event is in the window."""
    lv = total_return_levels(prices, events)
    known = F.lit(True)
    if covered is not None:
        lv = lv.join(covered.select("entity").distinct().withColumn("_cov", F.lit(1)), "entity", "left")
        known = F.col("_cov").isNotNull()
    w = own_rows()
    cols = []
    for h in horizons:
        a, b = 1, 1 + h
        grow = F.lead("close", b).over(w) / F.lead("close", a).over(w)
        factor = F.exp(F.lead("log_factor", b).over(w) - F.lead("log_factor", a).over(w))
        bad = F.lead("n_bad", b).over(w) - F.lead("n_bad", a).over(w)
        cols += [
            F.when((bad == 0) & known, (grow * factor - 1) * 100).alias(f"r{h}"),
            (bad > 0).alias(f"bad_evt_{h}"),
        ]
    return lv.select("date", "entity", *cols)


# ------------------------------------------------------------- calendar


def market_calendar(prices: DataFrame, min_names: int) -> DataFrame:
    """Dates with enough priced names, numbered from 0 (one row per date)."""
    days = (
        clean_prices(prices).groupBy("date").agg(F.countDistinct("entity").alias("n_names"))
        .where(F.col("n_names") >= min_names)
    )
    return days.select("date", "n_names", (F.row_number().over(Window.orderBy("date")) - 1).alias("day_idx"))


def window_spans(rows: DataFrame, calendar: DataFrame, horizon: int) -> DataFrame:
    """Market days really crossed by each h-row window of an entity."""
    w = own_rows()
    px = rows.select(
        "date", "entity",
        F.lead("date", 1).over(w).alias("entry_date"), F.lead("date", 1 + horizon).over(w).alias("exit_date"),
    )
    cal = F.broadcast(calendar.select("date", "day_idx"))
    a = cal.select(F.col("date").alias("entry_date"), F.col("day_idx").alias("_a"))
    b = cal.select(F.col("date").alias("exit_date"), F.col("day_idx").alias("_b"))
    return px.join(a, "entry_date", "left").join(b, "exit_date", "left").select(
        "date", "entity", (F.col("_b") - F.col("_a")).alias("span")
    )


def month_of(col: str = "date") -> Column:
    return F.date_format(col, "yyyy-MM")


def span_share_by_month(spans: DataFrame, horizon: int) -> DataFrame:
    return spans.where(F.col("span").isNotNull()).groupBy(month_of().alias("ym")).agg(
        F.count(F.lit(1)).alias("n_windows"),
        share(F.col("span") == horizon).alias("share_eq"),
        share(F.col("span") > horizon).alias("share_gt"),
    )


def span_check(by_month: DataFrame, baseline_year: int, margin_pp: float, since: str) -> DataFrame:
    """Months since ``since`` whose exact-span share is below the baseline-year floor."""
    floor = by_month.where(F.col("ym").startswith(f"{baseline_year}-")).agg(
        (F.min("share_eq") - margin_pp / 100.0).alias("floor")
    )
    return by_month.where(F.col("ym") >= since).join(F.broadcast(floor)).withColumn(
        "below", F.col("share_eq") < F.col("floor")
    )


def weekly_dates(dates: DataFrame) -> DataFrame:
    """Last trading day of every ISO week."""
    return dates.select("date").groupBy(
        F.extract(F.lit("YEAROFWEEK"), F.col("date")).alias("iso_year"), F.weekofyear("date").alias("iso_week")
    ).agg(F.max("date").alias("date"))


def monthly_anchors(prices: DataFrame, min_names: int) -> DataFrame:
    """First dense trading day of every month."""
    days = clean_prices(prices).groupBy("date").agg(F.countDistinct("entity").alias("n")).where(F.col("n") >= min_names)
    return days.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.min("date").alias("anchor"))


def row_match_by_month(new: DataFrame, old: DataFrame) -> DataFrame:
    """Share of new keys that the old panel version also has."""
    o = old.select("date", "entity").distinct().withColumn("_hit", F.lit(1))
    return (
        new.select("date", "entity").join(o, ["date", "entity"], "left")
        .groupBy(month_of().alias("ym"))
        .agg(F.count(F.lit(1)).alias("n_new"), F.count("_hit").alias("n_matched"))
        .withColumn("match_rate", F.col("n_matched") / F.col("n_new"))
    )


def target_diff_by_period(new: DataFrame, old: DataFrame, target: str, gt_pp: Sequence[float] = (1.0, 5.0)) -> DataFrame:
    """Distribution of new - old target by month, with one-sided null counts."""
    j = (
        new.select("date", "entity", F.col(target).alias("_n"))
        .join(old.select("date", "entity", F.col(target).alias("_o")), ["date", "entity"], "left")
        .withColumn("period", month_of())
        .withColumn("_d", F.col("_n") - F.col("_o"))
        .withColumn("_a", F.abs("_d"))
    )
    counts = j.groupBy("period").agg(
        F.count("_d").alias("n_both"),
        F.count(F.when(F.col("_n").isNotNull() & F.col("_o").isNull(), 1)).alias("n_new_only"),
        F.count(F.when(F.col("_n").isNull() & F.col("_o").isNotNull(), 1)).alias("n_old_only"),
        F.max("_a").alias("abs_max"),
        *[F.count(F.when(F.col("_a") > g, 1)).alias(f"n_gt_{g:g}pp") for g in gt_pp],
    )
    med = exact_quantiles(j, ["period"], "_d", {"diff_median": 0.5})
    q = exact_quantiles(j, ["period"], "_a", {"abs_p50": 0.5, "abs_p90": 0.9, "abs_p99": 0.99})
    return counts.join(med, "period", "left").join(q, "period", "left")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


