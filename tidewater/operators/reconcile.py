"""Agreement between two sources of the same facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.exprs import count_if, own_rows, with_scalar
from tidewater.operators.asof import roll_forward
from tidewater.operators.order import exact_quantiles, list_position
from tidewater.operators.panel import clean_prices


def ratio_agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], col: str, limit: float = 0.10) -> DataFrame:
    """One row: pairs, median and quartile elements of a/b, outlier shares by pair and by entity."""
    j = a.select(*keys, F.col(col).alias("_a")).join(b.select(*keys, F.col(col).alias("_b")), list(keys))
    both = j.where(F.col("_a").isNotNull() & (F.col("_b") > 0)).withColumn("ratio", F.col("_a") / F.nullif(F.col("_b"), F.lit(0.0)))
    q = exact_quantiles(both, [], "ratio", {"median": 0.5, "q1": list_position(1, 4), "q3": list_position(3, 4)}, "n")
    out = both.agg(count_if(F.abs(F.col("ratio") - 1.0) > limit).alias("n_pair_outlier"))
    per = exact_quantiles(both, ["entity"], "ratio", {"m": 0.5}).agg(F.count(F.lit(1)).alias("n_stock"), count_if(F.abs(F.col("m") - 1.0) > limit).alias("n_stock_outlier"))
    gaps = j.agg(count_if(F.col("_a").isNull() & (F.col("_b") > 0)).alias("only_b"), count_if(F.col("_b").isNull() & (F.col("_a") > 0)).alias("only_a"))
    return with_scalar(with_scalar(with_scalar(q, out), per), gaps)


def ratio_criteria(s: DataFrame, lo: float, hi: float, max_share: float) -> DataFrame:
    ok = F.col("median").between(lo, hi) & (F.col("n_stock_outlier") / F.col("n_stock") < max_share)
    return s.withColumn("passed", ok)


def event_match(a: DataFrame, b: DataFrame, near_days: int = 3) -> DataFrame:
    """Every event of either side as matched, near (other side within d days) or one-sided.

    Near partners are looked up by equality on each day of the band, so the
    band costs 2d+1 rows per unmatched event and never a pair product.
    """
    k = ["entity", "ex_date"]
    j = a.select(*k, F.col("cash").alias("cash_a"), F.lit(1).alias("_a")).join(b.select(*k, F.col("cash").alias("cash_b"), F.lit(1).alias("_b")), k, "full")
    only_b = j.where(F.col("_a").isNull()).select("entity", F.explode(F.sequence(F.date_sub("ex_date", near_days), F.date_add("ex_date", near_days))).alias("ex_date"), F.lit(1).alias("_near")).distinct()
    j = j.join(only_b, k, "left")
    kind = (
        F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "matched").when(F.col("_b").isNull(), F.when(F.col("_near").isNotNull(), "a_only_near").otherwise("a_only")).otherwise("b_only"))
    return j.select(*k, "cash_a", "cash_b", kind.alias("kind"))


def previous_close(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Each event with its aligned row and the close of the row before that."""
    px = clean_prices(prices)
    e = roll_forward(events, px, "entity", "ex_date", "date", "row_date")
    prev = px.select("entity", F.col("date").alias("row_date"), F.lag("close").over(own_rows()).alias("prev_close"))
    return e.join(prev, ["entity", "row_date"], "left")


def before_price_check(events: DataFrame, prices: DataFrame, tol_pct: float) -> DataFrame:
    d = previous_close(events, prices)
    diff = F.abs(F.col("before_price") - F.col("prev_close")) / F.col("prev_close") * 100
    ok = F.col("before_price").isNotNull() & F.col("prev_close").isNotNull()
    return d.agg(
        F.count(F.lit(1)).alias("n_events"), count_if(F.col("before_price").isNotNull() & F.col("prev_close").isNull()).alias("n_no_prev"), count_if(ok).alias("n_checked"),
        count_if(ok & (diff <= tol_pct)).alias("n_ok"), count_if(F.col("row_date") != F.col("ex_date")).alias("n_realigned"))


def ratio_rounding(events: DataFrame, flag_pp: float) -> DataFrame:
    """Relative error of (before - cash) against the recorded after price."""
    e = events.where((F.col("cash") > 0) & F.col("after_price").isNotNull() & (F.col("before_price") > F.col("cash"))).withColumn(
        "err", ((F.col("before_price") - F.col("cash")) / F.nullif(F.col("after_price"), F.lit(0.0)) - 1) * 100).withColumn("abs_err", F.abs("err"))
    s = e.agg(F.count(F.lit(1)).alias("n_checked"), F.max("abs_err").alias("err_abs_max"), count_if(F.col("abs_err") > flag_pp).alias("n_flagged"))
    return with_scalar(with_scalar(s, exact_quantiles(e, [], "err", {"err_median": 0.5})), exact_quantiles(e, [], "abs_err", {"err_abs_p99": 0.99}))


def return_agreement(adj: DataFrame, raw: DataFrame, ref: DataFrame, col: str, eps: float = 1e-9) -> DataFrame:
    """Three-way comparison of returns by which sides saw an event in the window."""
    k = ["date", "entity"]
    j = adj.select(*k, F.col(col).alias("a")).join(raw.select(*k, F.col(col).alias("r")), k).join(ref.select(*k, F.col(col).alias("f")), k)
    j = j.where(F.col("a").isNotNull() & F.col("r").isNotNull() & F.col("f").isNotNull())
    ea, ef = F.abs(F.col("a") - F.col("r")) > eps, F.abs(F.col("f") - F.col("r")) > eps
    j = j.withColumn("cls", F.when(ea & ef, "both").when(ea, "adjusted_only").when(ef, "reference_only").otherwise("none")).withColumn("d", F.col("a") - F.col("f")).withColumn("ad", F.abs("d"))
    g = j.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.max("ad").alias("diff_abs_max"))
    return g.join(exact_quantiles(j, ["cls"], "d", {"diff_median": 0.5}), "cls").join(exact_quantiles(j, ["cls"], "ad", {"diff_abs_p99": 0.99}), "cls")


def sample_dates(calendar: DataFrame, per_year: int, seed: int) -> DataFrame:
    """A repeatable sample of dates per year, ordered by a hash (calendar-bounded)."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.date_format("date", "yyyy-MM-dd")))
    w = Window.partitionBy(F.year("date")).orderBy(h)
    return calendar.select("date", F.row_number().over(w).alias("_k")).where(F.col("_k") <= per_year).drop("_k")


def frame_agreement(a: DataFrame, b: DataFrame, dates: DataFrame, tol_pct: float, by: Column) -> DataFrame:
    """Close and volume matches and missing rows per period on the sampled dates."""
    d = F.broadcast(dates.select("date"))
    k = ["date", "entity"]
    x = a.join(d, "date", "left_semi").select(*k, F.col("close").alias("ca"), F.col("volume").alias("va"))
    y = b.join(d, "date", "left_semi").select(*k, F.col("close").alias("cb"), F.col("volume").alias("vb"))
    j = x.join(y, k, "full")
    both = F.col("ca").isNotNull() & F.col("cb").isNotNull()
    diff = F.abs(F.col("ca") - F.col("cb")) / F.nullif(F.col("cb"), F.lit(0.0)) * 100
    return j.groupBy(by.alias("period")).agg(
        count_if(both).alias("n_both"), count_if(both & (diff <= tol_pct)).alias("n_close_ok"), count_if(F.col("va") == F.col("vb")).alias("n_volume_ok"),
        count_if(F.col("ca").isNull()).alias("n_missing_a"), count_if(F.col("cb").isNull()).alias("n_missing_b"))
