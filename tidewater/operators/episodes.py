"""Episode detection, crossing triggers and their evaluation against a base rate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.exprs import count_if, own_rows, with_scalar
from tidewater.operators.order import exact_quantiles, list_position
from tidewater.sources.staging import cut


def cooled_starts(cands: DataFrame, key: str, cooldown: int) -> DataFrame:
    """Greedy starts: after a start at i the next may be at i + cooldown + 1.

    A left fold over one key's sorted candidate positions; a key has at most
    one candidate per calendar day, so the array is bounded by the calendar.
    """
    g = cands.groupBy(key).agg(F.array_sort(F.collect_list("i")).alias("c"))
    start = F.struct(F.lit(-10**9).alias("last"), F.array().cast("array<int>").alias("out"))
    fold = F.aggregate(
        "c", start,
        lambda a, x: F.when(
            x > a["last"] + cooldown, F.struct(x.alias("last"), F.concat(a["out"], F.array(x)).alias("out"))
        ).otherwise(a),
        lambda a: a["out"],
    )
    return g.select(key, F.explode(fold).alias("i"))


def scan_episodes(rows: DataFrame, key: str, value: str, context: Column, x_pct: float, n_days: int, cooldown: int,
                  direction: str = "up") -> DataFrame:
    """Rows in context whose best (or worst) of the next n rows moves by x%; the last row never starts."""
    w = own_rows(key)
    nxt = w.rowsBetween(1, n_days)
    best = F.max(value).over(nxt) if direction == "up" else F.min(value).over(nxt)
    d = rows.select(
        key, "date", F.col(value).alias("base"), (F.row_number().over(w) - 1).cast("int").alias("i"),
        (best / F.col(value) - 1.0).alias("fwd"), context.alias("ctx"))
    hit = F.col("fwd") >= x_pct / 100 if direction == "up" else F.col("fwd") <= -x_pct / 100
    cands = d.where(F.col("ctx") & F.col("fwd").isNotNull() & hit)
    return cands.join(cooled_starts(cands, key, cooldown), [key, "i"]).select(
        key, F.col("date").alias("start_date"), "base", (F.col("fwd") * 100).alias("fwd_return_pct"))


def _full(agg, value: str, key: str, n: int) -> Column:
    f = own_rows(key).rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(f) >= n, agg(value).over(f))


def group_breakouts(baskets: DataFrame, x_pct: float = 10.0, n_days: int = 15, m_days: int = 60, tol_pct: float = 3.0, cooldown: int = 15) -> DataFrame:
    ctx = F.col("basket_index") <= _full(F.min, "basket_index", "grp", m_days) * (1 + tol_pct / 100)
    return scan_episodes(baskets, "grp", "basket_index", ctx, x_pct, n_days, cooldown)


def entity_episodes(prices: DataFrame, kind: str, x_pct: float, n_days: int, cooldown: int, window: int = 60, lo: float = 0.0, hi: float = 5.0) -> DataFrame:
    """ambush: near the low; breakout: between lo and hi above it; reversal: lo below the high; top: within hi of it."""
    low, high = _full(F.min, "close", "entity", window), _full(F.max, "close", "entity", window)
    close = F.col("close")
    ctx = {
        "ambush": close <= low * (1 + hi / 100),
        "breakout": ((close / low - 1) * 100 >= lo) & ((close / low - 1) * 100 <= hi),
        "reversal": (close / high - 1) * 100 <= -lo,
        "top": close >= high * (1 - hi / 100),
    }[kind]
    return scan_episodes(prices, "entity", "close", ctx, x_pct, n_days, cooldown, "down" if kind == "top" else "up")


def fired_jobs(panel: DataFrame, key: str, jobs: Mapping[str, Column]) -> DataFrame:
    """key, date, job: rows where a job's condition turned true.

    All conditions are one boolean array; one ``lag`` serves every job and
    only crossings are exploded.
    """
    names = list(jobs)
    d = panel.select(key, "date", F.array(*[F.coalesce(x, F.lit(False)) for x in jobs.values()]).alias("h"))
    d = d.withColumn("p", F.lag("h").over(own_rows(key)))
    was = lambda i: F.coalesce(F.get(F.col("p"), i), F.lit(False))
    hit = F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.get(F.col("h"), i) & ~was(i))
    d = d.where(F.size(hit) > 0).select(key, "date", F.explode(hit).alias("j"))
    return d.select(key, "date", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("j") + 1).alias("job"))


def held_jobs(panel: DataFrame, key: str, jobs: Mapping[str, Column]) -> DataFrame:
    """key, date, job: every row on which a job's condition holds."""
    tags = F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in jobs.items()]))
    return panel.select(key, "date", F.explode(tags).alias("job"))


class Judge:
    """Episodes placed on a calendar, ready to score triggers.

    Every episode marks at most ``lead + occupy + 1`` positions, so occupied
    and hit days are found by equality joins; the key x day grid is never built.
    """

    def __init__(self, episodes: DataFrame, calendar: DataFrame, keys: DataFrame, key: str, lead: int = 15, occupy: int = 15, warmup: int = 0) -> None:
        self.key, self.calendar = key, calendar
        cal = calendar.select("date", F.col("idx").cast("int").alias("p"))
        ep = episodes.select(key, F.col("start_date").alias("date")).join(F.broadcast(cal), "date").select(key, F.col("p").alias("e"))
        size = calendar.agg((F.max("idx") - lead).alias("max_eval"), F.max("idx").alias("top"))
        self.size = size.select("max_eval", F.least(F.lit(warmup), F.col("top")).alias("first"))
        occ = ep.select(key, F.explode(F.sequence(F.col("e") + 1, F.col("e") + occupy)).alias("p"), F.lit(1).alias("o"), F.lit(None).cast("int").alias("e"))
        hit = ep.select(key, F.explode(F.sequence(F.col("e") - lead, F.col("e"))).alias("p"), F.lit(0).alias("o"), "e")
        self.marks = cut(occ.unionByName(hit).groupBy(key, "p").agg(F.max("o").alias("occ"), F.min("e").alias("nxt")))
        self.n_episodes = ep.agg(F.count(F.lit(1)).alias("n_episodes"))
        inside = with_scalar(self.marks, self.size).where((F.col("p") >= F.col("first")) & (F.col("p") <= F.col("max_eval")))
        used = inside.join(keys.select(key).distinct(), key, "left_semi").agg(
            count_if(F.col("occ") == 1).alias("n_occ"), count_if((F.col("occ") == 0) & F.col("nxt").isNotNull()).alias("n_hit"))
        self.n_keys = keys.agg(F.countDistinct(key).alias("n_keys"))
        b = with_scalar(with_scalar(used, self.n_keys), self.size)
        elig = F.col("n_keys") * (F.col("max_eval") - F.col("first") + 1) - F.col("n_occ")
        self.base = b.select(F.when(elig > 0, F.col("n_hit") / elig).otherwise(F.lit(0.0)).alias("base_rate"), elig.alias("n_eligible"))

    def base_by(self, labels: DataFrame) -> DataFrame:
        """label, base_rate: the base rate over the days of each label."""
        cal = self.calendar.join(F.broadcast(labels.select("date", "label")), "date", "left").select(
            F.col("idx").cast("int").alias("p"), F.coalesce("label", F.lit("未標")).alias("label"))
        cal = with_scalar(cal, self.size).where((F.col("p") >= F.col("first")) & (F.col("p") <= F.col("max_eval"))).select("p", "label")
        days = with_scalar(cal.groupBy("label").agg(F.count(F.lit(1)).alias("n_days")), self.n_keys)
        used = self.marks.join(F.broadcast(cal), "p").groupBy("label").agg(
            count_if(F.col("occ") == 1).alias("n_occ"), count_if((F.col("occ") == 0) & F.col("nxt").isNotNull()).alias("n_hit"))
        d = days.join(used, "label", "left")
        elig = F.col("n_keys") * F.col("n_days") - F.coalesce("n_occ", F.lit(0))
        return d.select("label", (F.coalesce("n_hit", F.lit(0)) / F.nullif(elig, F.lit(0))).alias("base_rate"))

    def outcomes(self, triggers: DataFrame) -> DataFrame:
        """Evaluable triggers with ``hit``, ``dist`` and the covered episode."""
        cal = self.calendar.select("date", F.col("idx").cast("int").alias("p"))
        t = with_scalar(triggers.join(F.broadcast(cal), "date"), self.size)
        t = t.where((F.col("p") >= F.col("first")) & (F.col("p") <= F.col("max_eval"))).drop("first", "max_eval")
        t = t.join(self.marks, [self.key, "p"], "left").where(F.coalesce("occ", F.lit(0)) == 0)
        return t.withColumn("hit", F.col("nxt").isNotNull()).withColumn("dist", F.col("nxt") - F.col("p"))

    def evaluate(self, triggers: DataFrame, by: Sequence[str] = ("job",)) -> DataFrame:
        o = cut(self.outcomes(triggers).select(self.key, *by, "nxt", "hit", "dist"))
        s = o.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n_triggers"), count_if(F.col("hit")).alias("hits"), count_if(~F.col("hit")).alias("false_positives"),
            F.countDistinct(F.when(F.col("hit"), F.struct(self.key, "nxt"))).alias("_cov"))
        med = exact_quantiles(o.where("hit"), list(by), "dist", {"median_lead_days": list_position(1, 2)})
        s = with_scalar(with_scalar(s.join(med, list(by), "left"), self.base.select("base_rate")), self.n_episodes)
        hr = F.col("hits") / F.col("n_triggers")
        rec = F.when(F.col("n_episodes") > 0, F.col("_cov") / F.nullif(F.col("n_episodes"), F.lit(0))).otherwise(F.lit(0.0))
        s = s.withColumns({"hit_rate": hr, "recall": rec, "lift": F.when(F.col("base_rate") > 0, hr / F.nullif(F.col("base_rate"), F.lit(0.0)))})
        f1 = 2 * F.col("hit_rate") * F.col("recall") / F.nullif(F.col("hit_rate") + F.col("recall"), F.lit(0.0))
        return s.withColumn("f1", F.coalesce(f1, F.lit(0.0))).drop("_cov")


def cross_window_lead(panel: DataFrame, episodes: DataFrame, calendar: DataFrame, pairs: Sequence[tuple[str, str]], threshold: float = 1.0,
                      lookback: int = 30, min_lead: int = 2) -> DataFrame:
    """First short- and long-window crossing in the days before each start, per signal pair.

    An episode is expanded to its ``lookback`` positions, so the panel joins by equality.
    """
    cal = F.broadcast(calendar.select("date", F.col("idx").cast("int").alias("p")))
    ep = episodes.select("entity", F.col("start_date").alias("date")).join(cal, "date").select("entity", F.col("p").alias("e"))
    spots = ep.select("entity", "e", F.explode(F.sequence(F.col("e") - lookback, F.col("e") - 1)).alias("p"))
    rows = panel.join(cal, "date").select("entity", "p", *sorted({x for pr in pairs for x in pr}))
    j = spots.join(rows, ["entity", "p"])
    aggs = [a for i, (s, lg) in enumerate(pairs) for a in (
        F.min(F.when(F.col(s) >= threshold, F.col("p"))).alias(f"s{i}"), F.min(F.when(F.col(lg) >= threshold, F.col("p"))).alias(f"l{i}"))]
    g = j.groupBy("entity", "e").agg(*aggs)
    arr = F.array(*[F.struct(F.lit(s).alias("short_signal"), F.lit(lg).alias("long_signal"), F.col(f"s{i}").alias("s"), F.col(f"l{i}").alias("l")) for i, (s, lg) in enumerate(pairs)])
    x = g.select(F.explode(arr).alias("x")).select("x.*").where(F.col("s").isNotNull()).withColumn("lead", F.col("l") - F.col("s"))
    k = ["short_signal", "long_signal"]
    n = F.nullif(F.count("lead"), F.lit(0))
    out = x.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n_short_fired"), F.count("lead").alias("n_paired"), count_if(F.col("lead").isNull()).alias("short_only"),
        F.coalesce(count_if(F.col("lead") > 0) / n, F.lit(0.0)).alias("pct_short_leads"),
        F.coalesce(count_if(F.col("lead") >= min_lead) / n, F.lit(0.0)).alias("pct_lead_ge"))
    return out.join(exact_quantiles(x, k, "lead", {"median_lead_days": list_position(1, 2)}), k, "left")


def forward_same_day(panel: DataFrame, horizons: Sequence[int]) -> DataFrame:
    w = own_rows()
    return panel.select("entity", "date", *[((F.lead("close", h).over(w) / F.col("close") - 1.0) * 100).alias(f"fwd{h}") for h in horizons])


def payoff_table(triggers: DataFrame, panel: DataFrame, horizons: Sequence[int] = (5, 10, 20, 40)) -> DataFrame:
    """Per job and horizon: size, mean, median, win rate, win/loss means, payoff ratio, excess over base."""
    fwd = forward_same_day(panel, horizons)
    h = F.explode(F.array(*[F.struct(F.lit(k).alias("horizon_d"), F.col(f"fwd{k}").alias("v")) for k in horizons]))
    base = exact_quantiles(fwd.select(h.alias("x")).select("x.*"), ["horizon_d"], "v", {"base_median_pct": 0.5})
    x = triggers.join(fwd, ["entity", "date"]).select("job", h.alias("x")).select("job", "x.*").where(F.col("v").isNotNull())
    k = ["job", "horizon_d"]
    g = x.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_ret_pct"), F.avg((F.col("v") > 0).cast("double")).alias("win_rate"),
        F.avg(F.when(F.col("v") > 0, F.col("v"))).alias("avg_win_pct"), F.avg(F.when(F.col("v") < 0, F.col("v"))).alias("avg_loss_pct"))
    g = g.join(exact_quantiles(x, k, "v", {"median_ret_pct": 0.5}), k).join(F.broadcast(base), "horizon_d")
    return g.withColumns({
        "payoff_ratio": F.col("avg_win_pct") / F.nullif(F.abs("avg_loss_pct"), F.lit(0.0)),
        "excess_median_pct": F.col("median_ret_pct") - F.col("base_median_pct")})


def pooled_buckets(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], k: int) -> DataFrame:
    """floor((ordinal - 1) * k / n) + 1 within keys, ties broken by ``tie``.

    The ordinal comes from the split rank plus a row number among equal values,
    so no task orders a whole stratum.
    """
    from tidewater.operators.order import average_rank

    d = average_rank(df, keys, value, "_min", "_n", method="min")
    ties = Window.partitionBy(*keys, value).orderBy(*tie)
    o = F.col("_min") + F.row_number().over(ties) - 2
    return d.withColumn("bucket", (F.floor(o * k / F.col("_n")) + 1).cast("int")).drop("_min", "_n")


def two_prop_z(h1: Column, n1: Column, h2: Column, n2: Column) -> Column:
    pool = (h1 + h2) / F.nullif(n1 + n2, F.lit(0))
    se = F.sqrt(pool * (1 - pool) * (1 / F.nullif(n1, F.lit(0)) + 1 / F.nullif(n2, F.lit(0))))
    return F.when(se > 0, (h1 / F.nullif(n1, F.lit(0)) - h2 / F.nullif(n2, F.lit(0))) / F.nullif(se, F.lit(0.0)))
