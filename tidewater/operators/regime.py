"""Market regime, causal percentiles, hysteresis lights, washout and event rules.

Everything here works on a per-date or per-(series, date) table, which is
bounded by the calendar; the only large step is the aggregate that makes it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.exprs import clip, count_if, own_rows, rn, roll_avg, running, share, with_scalar
from tidewater.operators.asof import carry_last
from tidewater.operators.momentum import above_ma_share

# fixed label values
ATTACK, NEUTRAL, DEFENSE, INSUFFICIENT = "進攻", "中性", "防禦", "資料不足"
GREEN, YELLOW, RED, GREY = "green", "yellow", "red", "insufficient"
WEIGHTS = {"trend": 0.4, "breadth": 0.3, "flow": 0.3}


def day_window():
    """Ordered by date over one row per date."""
    return Window.orderBy("date")


def trend_score(index: DataFrame, ma_windows: Sequence[int] = (20, 60, 120)) -> DataFrame:
    w = day_window()
    ws = sorted(ma_windows)
    d = index.select("date", "market_index", *[roll_avg("market_index", w, n).alias(f"m{n}") for n in ws])
    chain = ["market_index", *[f"m{n}" for n in ws]]
    pair = [F.when(F.col(a) > F.col(b), 1.0).otherwise(-1.0) for a, b in zip(chain, chain[1:])]
    score = sum(pair[1:], pair[0]) / float(len(pair))
    return d.select("date", F.when(F.col(f"m{ws[-1]}").isNotNull(), score).alias("trend_score"))


def index_position(index: DataFrame, position: int = 120) -> DataFrame:
    """date, pos: where the index stands between its lowest and highest of ``position`` days."""
    f = day_window().rowsBetween(-(position - 1), 0)
    lo, hi = F.min("market_index").over(f), F.max("market_index").over(f)
    pos = F.when(hi > lo, (F.col("market_index") - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(F.lit(0.5))
    return index.select("date", F.when(F.count("market_index").over(f) >= 2, pos).alias("pos"))


def breadth_from(frac: Column, n_priced: Column, pos: Column, min_priced: int) -> Column:
    base = 2 * frac - 1
    return F.when(n_priced >= min_priced, F.when(pos.isNotNull(), (base + (2 * pos - 1)) / 2.0).otherwise(base))


def breadth_score(prices: DataFrame, index: DataFrame, ma: int = 60, position: int = 120, min_priced: int = 200) -> DataFrame:
    j = index_position(index, position).join(above_ma_share(prices, ma), "date", "left")
    return j.select("date", breadth_from(F.col("frac_above_ma"), F.col("n_priced"), F.col("pos"), min_priced).alias("breadth_score"), "frac_above_ma", "n_priced")


def latest_scores(prices: DataFrame, flows: DataFrame, index: DataFrame, ma: int = 60, min_priced: int = 200, saturate: float = 1e8) -> DataFrame:
    """The three sub-scores on the last market day; each entity counts in breadth with its own last row, traded that day or not."""
    d = index_position(index).join(trend_score(index), "date").join(flow_score(flows, index, saturate=saturate), "date")
    d = with_scalar(d, d.agg(F.max("date").alias("_m"))).where(F.col("date") == F.col("_m"))
    own = prices.where(F.col("close") > 0).select("entity", "date", "close", roll_avg("close", own_rows(), ma).alias("ma"))
    last = own.groupBy("entity").agg(F.max_by(F.struct("close", "ma"), "date").alias("l")).where("l.ma is not null")
    last = last.agg(F.avg((F.col("l.close") > F.col("l.ma")).cast("double")).alias("frac"), F.count(F.lit(1)).alias("n_priced"))
    breadth = breadth_from(F.col("frac"), F.col("n_priced"), F.col("pos"), min_priced)
    return with_scalar(d, last).select("date", "trend_score", breadth.alias("breadth_score"), "flow_score")


def flow_score(flows: DataFrame, calendar: DataFrame, windows: Sequence[int] = (5, 20), saturate: float = 1e8) -> DataFrame:
    """Saturated mean net flow, carried backward as-of to the market calendar."""
    w = day_window()
    net = flows.groupBy("date").agg(F.sum("total_net").cast("double").alias("net"))
    net = net.select("date", *[roll_avg("net", w, n, 1).alias(f"a{n}") for n in windows])
    j = carry_last(calendar.select("date"), net, [], "date", "date", [f"a{n}" for n in windows])
    parts = [clip(F.col(f"a{n}") / saturate, -1.0, 1.0) for n in windows]
    return j.select("date", (sum(parts[1:], parts[0]) / len(parts)).alias("flow_score"))


def compose(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean over the available parts only."""
    num = sum((F.coalesce(p * weights[k], F.lit(0.0)) for k, p in parts.items()), F.lit(0.0))
    den = sum((F.when(p.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, p in parts.items()), F.lit(0.0))
    return num / F.nullif(den, F.lit(0.0))


def label(score: Column, attack: float = 0.33, defense: float = -0.33) -> Column:
    return F.when(score.isNull(), INSUFFICIENT).when(score >= attack, ATTACK).when(score <= defense, DEFENSE).otherwise(NEUTRAL)


def regime_history(prices: DataFrame, flows: DataFrame, index: DataFrame, min_priced: int = 200, saturate: float = 1e8) -> DataFrame:
    """date, label, score and the three sub-scores for every market day in one pass."""
    d = index.select("date").join(trend_score(index), "date", "left").join(breadth_score(prices, index, min_priced=min_priced), "date", "left")
    d = d.join(flow_score(flows, index, saturate=saturate), "date", "left")
    score = rn(compose({"trend": F.col("trend_score"), "breadth": F.col("breadth_score"), "flow": F.col("flow_score")}, WEIGHTS), 9)
    d = d.withColumn("regime_score", score)
    return d.select("date", label(F.col("regime_score")).alias("regime_label"), "regime_score", "trend_score", "breadth_score", "flow_score", "frac_above_ma")


# ------------------------------------------------------------- causal percentiles


def _at_most(values: str, cur: Column) -> Column:
    return F.size(F.filter(values, lambda x: x <= cur)) / F.size(values)


def level_pct(series: DataFrame, lookback: int, min_obs: int = 30) -> DataFrame:
    """Share of the last ``lookback`` values at or below the current one, per series and date."""
    f = own_rows("series_id").rowsBetween(-(lookback - 1), 0)
    d = series.where(F.col("value").isNotNull()).withColumn("_v", F.collect_list("value").over(f))
    d = d.withColumn("_n", F.row_number().over(own_rows("series_id")))
    return d.where(F.col("_n") >= min_obs).select("series_id", "date", "value", _at_most("_v", F.col("value")).alias("score"))


def speed_pct(series: DataFrame, lookback: int, delta: int, min_obs: int = 30) -> DataFrame:
    w = own_rows("series_id")
    d = series.where(F.col("value").isNotNull())
    d = d.select("series_id", "date", (F.col("value") - F.lag("value", delta).over(w)).alias("value")).where(F.col("value").isNotNull())
    return level_pct(d, lookback, min_obs)


def dual_risk(series: DataFrame, lookback: int, delta: int, min_obs: int = 30) -> DataFrame:
    return speed_pct(series, lookback, delta, min_obs).withColumn("score", 2 * F.abs(F.col("score") - 0.5))


def next_light(prev: Column, s: Column, green_max: float, red_min: float, band: float) -> Column:
    """Colour after a reading: bare thresholds on the first one, +/- band afterwards."""
    bare = F.when(s < green_max, GREEN).when(s >= red_min, RED).otherwise(YELLOW)
    from_green = F.when(s >= red_min + band, RED).when(s >= green_max + band, YELLOW).otherwise(GREEN)
    from_red = F.when(s >= red_min - band, RED).when(s < green_max - band, GREEN).otherwise(YELLOW)
    from_yellow = F.when(s >= red_min + band, RED).when(s < green_max - band, GREEN).otherwise(YELLOW)
    return (
        F.when(s.isNull(), GREY).when(prev.isNull() | (prev == GREY), bare)
        .when(prev == GREEN, from_green).when(prev == RED, from_red).otherwise(from_yellow)
    )


def light_series(scores: DataFrame, green_max: float, red_min: float, band: float) -> DataFrame:
    """Colour of every reading of every series: a fold over the series in date order."""
    g = scores.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("date", "score"))).alias("a"))
    zero = F.struct(F.lit(None).cast("string").alias("c"), F.array().cast("array<string>").alias("o"))

    def step(acc, x):
        col = next_light(acc["c"], x["score"] * 100, green_max, red_min, band)
        return F.struct(col.alias("c"), F.concat(acc["o"], F.array(col)).alias("o"))

    out = F.aggregate("a", zero, step, lambda acc: acc["o"])
    return g.withColumn("z", F.arrays_zip("a", out.alias("o"))).select("series_id", F.explode("z").alias("z")).select(
        "series_id", F.col("z.a.date").alias("date"), F.col("z.a.score").alias("score"), F.col("z.o").alias("color"))


def panel_reading(series: DataFrame, scores: DataFrame, as_of: Column, stale_days: int) -> DataFrame:
    """Latest value, age, staleness and score of every series at ``as_of``."""
    last = series.where(F.col("value").isNotNull() & (F.col("date") <= as_of)).groupBy("series_id").agg(
        F.max("date").alias("date"), F.max_by("value", "date").alias("raw_value"))
    j = last.join(scores.select("series_id", "date", "score"), ["series_id", "date"], "left")
    age = F.datediff(as_of, "date")
    return j.select("series_id", F.col("date").alias("as_of"), "raw_value", age.alias("age_days"), (age > stale_days).alias("stale"),
                    F.when(age <= stale_days, F.col("score") * 100).alias("score_pct"))


def panel_deltas(now: DataFrame, prev: DataFrame, dead_pct: float) -> DataFrame:
    """Change against the previous run with an arrow outside the dead band."""
    p = prev.select("series_id", F.col("raw_value").alias("prev_raw"), F.col("score_pct").alias("prev_score"))
    d = now.join(p, "series_id", "left")
    ds = F.when(~F.col("stale"), F.col("score_pct") - F.col("prev_score"))
    arrow = F.when(ds.isNull(), "no_prev").when(ds > dead_pct, "up").when(ds < -dead_pct, "down").otherwise("flat")
    return d.select("series_id", "raw_value", "score_pct", (F.col("raw_value") - F.col("prev_raw")).alias("delta_raw"), ds.alias("delta_score"), arrow.alias("arrow"))


# ------------------------------------------------------------- events and fired days


def event_labels(series: DataFrame, n: int, drawdown: float) -> DataFrame:
    """1 where the lowest of the next n values is at least ``drawdown`` below; full window only."""
    w = own_rows("series_id")
    f = w.rowsBetween(1, n)
    d = series.select("series_id", "date", "value", F.min("value").over(f).alias("_m"), F.count("value").over(f).alias("_c"))
    return d.where((F.col("value") > 0) & (F.col("_c") == n)).select(
        "series_id", "date", (1 - F.col("_m") / F.col("value") >= drawdown).cast("int").alias("event"))


def bucket_lift(bucket: DataFrame, events: DataFrame, keys: Sequence[str], block_len: int) -> DataFrame:
    """P(event | bucket) / P(event) with its counts."""
    j = bucket.join(events, [*keys, "date"])
    e, b = F.col("event") == 1, F.col("in_bucket")
    g = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_all"), count_if(b).alias("n_high"), count_if(b & e).alias("n_high_event"), count_if(e).alias("n_event"))
    lift = (F.col("n_high_event") / F.nullif(F.col("n_high"), F.lit(0))) / F.nullif(F.col("n_event") / F.col("n_all"), F.lit(0.0))
    return g.withColumn("lift", lift).withColumn("n_blocks", F.ceil(F.col("n_all") / block_len))


def lift_ci(bucket: DataFrame, events: DataFrame, keys: Sequence[str], block_len: int, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Moving-block interval of the lift: the three counts of a replicate are
    differences of running counts, so no resampled series is built."""
    from tidewater.operators.resample import hash_start

    ks = list(keys)
    j = bucket.join(events, [*ks, "date"])
    w = Window.partitionBy(*ks)
    b, e = F.col("in_bucket").cast("double"), F.col("event").cast("double")
    run = w.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    pts = j.select(*ks, (F.row_number().over(w.orderBy("date")) - 1).cast("bigint").alias("i"), F.count(F.lit(1)).over(w).alias("t"),
                   F.sum(b).over(run).alias("b"), F.sum(e).over(run).alias("e"), F.sum(b * e).over(run).alias("be"))
    h = pts.groupBy(*ks).agg(F.max("t").alias("t")).where(F.col("t") >= 10)
    h = h.withColumn("len", F.least(F.lit(block_len).cast("bigint"), F.col("t"))).withColumn("nb", F.ceil(F.col("t") / F.col("len")))
    d = h.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1)))
    start = hash_start(F.lit(seed), F.col("r"), F.col("k"), F.col("t") - F.col("len") + 1)
    take = F.when(F.col("k") < F.col("nb") - 1, F.col("len")).otherwise(F.col("t") - F.col("len") * (F.col("nb") - 1))
    ends = F.explode(F.array(F.struct((start + take - 1).alias("i"), F.lit(1.0).alias("s")), F.struct((start - 1).alias("i"), F.lit(-1.0).alias("s"))))
    d = d.select(*ks, "t", "r", ends.alias("x")).select(*ks, "t", "r", "x.i", "x.s").join(pts.drop("t"), [*ks, "i"], "left")

    def tot(x: str) -> Column:
        return F.sum(F.col("s") * F.coalesce(x, F.lit(0.0)))

    st = d.groupBy(*ks, "r").agg(F.max("t").alias("t"), tot("b").alias("b"), tot("e").alias("e"), tot("be").alias("be"))
    st = st.withColumn("lift", (F.col("be") / F.nullif(F.col("b"), F.lit(0.0))) / F.nullif(F.col("e") / F.col("t"), F.lit(0.0)))
    q = st.withColumn("q", F.row_number().over(w.orderBy(F.asc_nulls_last("lift"))) - 1)
    lo, hi = int(n_boot * 0.025), int(n_boot * 0.975) - 1
    return q.groupBy(*ks).agg(F.max(F.when(F.col("q") == lo, F.col("lift"))).alias("ci_lo"), F.max(F.when(F.col("q") == hi, F.col("lift"))).alias("ci_hi"))


def fired_episodes(fired: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """Fired days merged across at most ``gap`` quiet rows: (keys, start, end)."""
    w = Window.partitionBy(*keys).orderBy("date")
    d = fired.withColumn("_i", F.row_number().over(w)).where("fired")
    d = d.withColumn("_new", (F.col("_i") - F.lag("_i").over(w) > gap + 1).cast("int"))
    d = d.withColumn("_g", F.sum(F.coalesce("_new", F.lit(0))).over(running(w)))
    return d.groupBy(*keys, "_g").agg(F.min("date").alias("start"), F.max("date").alias("end")).drop("_g")


def combine_fired(fired: DataFrame, min_count: int, n_parts: int) -> DataFrame:
    """Dates on which at least ``min_count`` of the parts fired; only dates all parts have."""
    return fired.groupBy("date").agg(count_if(F.col("fired")).alias("_c"), F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") == n_parts).select("date", (F.col("_c") >= min_count).alias("fired"))


def day_offset(calendar: DataFrame, anchors: DataFrame, n: int) -> DataFrame:
    """n-th market day before and after each anchor, clamped to the calendar."""
    c = calendar.select("date", "idx")
    top = c.agg(F.max("idx").alias("_top"))
    back = carry_last(anchors, c, [], "anchor", "date", ["idx"]).select("anchor", F.col("idx").alias("_b"))
    n_before = with_scalar(anchors.join(F.broadcast(c), F.col("date") == F.col("anchor"), "left").select("anchor", F.col("idx").alias("_eq")), top)
    j = n_before.join(back, "anchor").withColumn("_at", F.greatest(F.coalesce("_b", F.lit(0)), F.lit(0)))
    fwd = F.when(F.col("_eq").isNotNull(), F.col("_eq")).when(F.col("_b").isNull(), F.lit(0)).otherwise(F.col("_b") + 1)
    j = j.withColumn("_lo", F.greatest(F.col("_at") - n, F.lit(0))).withColumn("_hi", F.least(F.least(fwd, F.col("_top")) + n, F.col("_top")))
    lo = c.select(F.col("idx").alias("_lo"), F.col("date").alias("before"))
    hi = c.select(F.col("idx").alias("_hi"), F.col("date").alias("after"))
    return j.join(F.broadcast(lo), "_lo").join(F.broadcast(hi), "_hi").select("anchor", "before", "after")


def episode_scores(fired: DataFrame, keys: Sequence[str], windows: DataFrame, gap: int) -> DataFrame:
    """Per key: episodes, events hit, starts outside every window, fire rate.

    ``windows`` (name, w0, w1) is a short list of event windows.
    """
    ep = fired_episodes(fired, keys, gap)
    hit = ep.join(F.broadcast(windows), (F.col("start") >= F.col("w0")) & (F.col("start") <= F.col("w1")), "left")
    per = hit.groupBy(*keys, "start").agg(F.max(F.col("name").isNotNull()).alias("inside"), F.collect_set("name").alias("names"))
    g = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_episodes"), count_if(~F.col("inside")).alias("false_positives"),
        F.size(F.array_distinct(F.flatten(F.collect_list("names")))).alias("n_events_hit"))
    rate = fired.groupBy(*keys).agg(share(F.col("fired")).alias("fire_rate"))
    return rate.join(g, list(keys), "left").fillna(0, ["n_episodes", "false_positives", "n_events_hit"])


def window_scores(series: DataFrame, lookbacks: Sequence[int], deltas: Sequence[int], min_obs: int = 30) -> DataFrame:
    """series_id, kind, delta (0 for the level), lookback, date, score: shares at or below the current value for every window in one pass a transform."""
    w = own_rows("series_id")
    known = series.where(F.col("value").isNotNull()).select("series_id", "date", "value")
    parts = [known.withColumns({"kind": F.lit("level_pct"), "delta": F.lit(0)})]
    for d in deltas:
        change = known.select("series_id", "date", (F.col("value") - F.lag("value", d).over(w)).alias("value")).where(F.col("value").isNotNull())
        parts.append(change.withColumns({"kind": F.lit("speed_pct"), "delta": F.lit(d)}))
    frame = w.rowsBetween(-(max(lookbacks) - 1), 0)
    out = None
    for part in parts:
        d = part.withColumn("_v", F.collect_list("value").over(frame)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") >= min_obs)
        tail = lambda lb: F.slice("_v", F.greatest(F.size("_v") - lb + 1, F.lit(1)), F.lit(lb))
        each = F.explode(F.array(*[F.struct(F.lit(lb).alias("lookback"), _at_most_of(tail(lb), F.col("value")).alias("score")) for lb in lookbacks])).alias("_x")
        d = d.select("series_id", "kind", "delta", "date", each).select("series_id", "kind", "delta", "date", "_x.*")
        out = d if out is None else out.unionByName(d)
    return out


def _at_most_of(values: Column, x: Column) -> Column:
    return F.size(F.filter(values, lambda y: y <= x)) / F.nullif(F.size(values), F.lit(0))


def episode_starts(scores: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """keys, date, above, score: for which thresholds a date starts an episode, namely those over ``above`` and up to its score.

    As a threshold falls, days join runs and runs join across ``gap`` quiet
    rows.  A day starts an episode as long as no day of the gap before it is
    at the threshold: so one running maximum gives the episodes of every
    threshold, without a pass for each.
    """
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-(gap + 1), -1)
    above = F.coalesce(F.max("score").over(w), F.lit(float("-inf")))
    return scores.select(*keys, "date", "score", above.alias("above")).where("score > above")


def threshold_grid(scores: DataFrame, keys: Sequence[str], thresholds: str, hits: DataFrame, quiet: DataFrame, gap: int) -> DataFrame:
    """keys, threshold, n_episodes, fire_rate, false_positives and hits (event -> first start), for all thresholds of each key at once.

    ``scores`` carry an array column ``thresholds``, constant within keys.
    ``hits`` (event, place, w0, w1) are windows in which a start counts, the
    first place of an event before its later ones; a start in none of the
    ``quiet`` windows (w0, w1) is a false positive.  Both are short lists.
    """
    every = scores.select(*keys, "score", F.explode(thresholds).alias("threshold"))
    rate = every.groupBy(*keys, "threshold").agg(share(F.col("score") >= F.col("threshold")).alias("fire_rate"))
    marks = scores.groupBy(*keys).agg(F.first(thresholds).alias("_t"))
    starts = episode_starts(scores, keys, gap).join(marks, list(keys))
    starts = starts.withColumn("threshold", F.explode(F.filter("_t", lambda x: (x > F.col("above")) & (x <= F.col("score"))))).select(*keys, "threshold", "date")
    inside = starts.select("date").distinct().join(F.broadcast(quiet), (F.col("date") >= F.col("w0")) & (F.col("date") <= F.col("w1"))).select("date").distinct().withColumn("_in", F.lit(1))
    n = starts.join(inside, "date", "left").groupBy(*keys, "threshold").agg(F.count(F.lit(1)).alias("n_episodes"), F.count(F.when(F.col("_in").isNull(), 1)).alias("false_positives"))
    found = starts.join(F.broadcast(hits), (F.col("date") >= F.col("w0")) & (F.col("date") <= F.col("w1")))
    first = found.groupBy(*keys, "threshold", "event").agg(F.min(F.struct("place", "date")).alias("_m"))
    first = first.groupBy(*keys, "threshold").agg(F.map_from_entries(F.collect_list(F.struct("event", F.col("_m.date")))).alias("hits"))
    k = [*keys, "threshold"]
    return rate.join(n, k, "left").join(first, k, "left").fillna(0, ["n_episodes", "false_positives"])


# ------------------------------------------------------------- washout


def washout_signals(margin_series: DataFrame, regime: DataFrame, index: DataFrame, z_threshold: float = -2.0, lookback: int = 250, min_samples: int = 60,
                    span_days: int = 9, max_frac: float = 0.2, max_score: float = -0.9, need: int = 15, ma: int = 60, max_dist: float = -7.0) -> DataFrame:
    """name, hit, value, status of the four sub-signals at the latest date."""
    w = Window.orderBy(F.desc("date"))
    m = margin_series.withColumn("_b", F.row_number().over(w)).where(F.col("_b") <= lookback)
    f5 = Window.orderBy("date").rowsBetween(-4, 0)
    m = m.withColumn("d5", F.when(F.count("chg").over(f5) >= 5, F.sum("chg").over(f5)))

    def z(x: str) -> Column:
        now = F.max(F.when(F.col("_b") == 1, F.col(x)))
        return F.when((F.count(x) >= min_samples) & (F.stddev_samp(x) > 0), (now - F.avg(x)) / F.nullif(F.stddev_samp(x), F.lit(0.0)))

    span = F.datediff(F.max("date"), F.max(F.when(F.col("_b") == 5, F.col("date"))))
    zz = m.agg(z("chg").alias("z1"), F.when(span <= span_days, z("d5")).alias("z5"))
    best = F.least("z1", "z5")
    s1 = zz.select(F.lit("margin").alias("name"), F.coalesce(best < z_threshold, F.lit(False)).alias("hit"), rn(best, 2).alias("value"),
                   F.when(best.isNull(), "insufficient_data").otherwise("ok").alias("status"))
    last = regime.agg(F.max_by("frac_above_ma", "date").alias("v"))
    s2 = last.select(F.lit("breadth").alias("name"), F.coalesce(F.col("v") < max_frac, F.lit(False)).alias("hit"), rn("v", 3).alias("value"),
                     F.when(F.col("v").isNull(), "missing").otherwise("ok").alias("status"))
    fl = regime.where(F.col("flow_score").isNotNull()).withColumn("_b", F.row_number().over(w)).where(F.col("_b") <= need)
    a = fl.agg(F.count(F.lit(1)).alias("n"), F.max("flow_score").alias("v"))
    ok = F.col("n") >= need
    s3 = a.select(F.lit("flow").alias("name"), F.coalesce(ok & (F.col("v") < max_score), F.lit(False)).alias("hit"), F.when(ok, rn("v", 3)).alias("value"),
                  F.when(ok, "ok").otherwise("insufficient_data").alias("status"))
    ix = index.withColumn("_b", F.row_number().over(w)).where(F.col("_b") <= ma).agg(
        F.count(F.lit(1)).alias("n"), (F.max(F.when(F.col("_b") == 1, F.col("market_index"))) / F.avg("market_index") - 1).alias("v"))
    ok = F.col("n") >= ma
    s4 = ix.select(F.lit("index").alias("name"), F.coalesce(ok & (F.col("v") * 100 < max_dist), F.lit(False)).alias("hit"), F.when(ok, rn(F.col("v") * 100, 2)).alias("value"),
                   F.when(ok, "ok").otherwise("insufficient_data").alias("status"))
    return s1.unionByName(s2).unionByName(s3).unionByName(s4)


def washout_trigger(signals: DataFrame, min_hits: int = 2) -> DataFrame:
    return signals.agg(
        count_if(F.col("hit")).alias("n_hit"), count_if(F.col("status") == "ok").alias("n_evaluable"), (count_if(F.col("hit")) >= min_hits).alias("triggered"))
