"""Factor statistics: rank correlation, buckets, partial correlation, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.exprs import fisher_bound, pearson, share
from tidewater.operators.order import average_rank, average_ranks, cell_table, exact_quantiles, rank_rows
from tidewater.operators.resample import block_bootstrap
from tidewater.sources.staging import cut

MIN_DAILY_NAMES = 10


def drop_null(df: DataFrame, *cols: str) -> DataFrame:
    return df.where(F.col(cols[0]).isNotNull() if len(cols) == 1 else _all_known(cols))


def _all_known(cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for x in cols:
        cond = cond & F.col(x).isNotNull()
    return cond


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys, ic, n, ci_lo, ci_hi: average-rank correlation of each group."""
    d = df.where(_all_known([x, y])).select(*keys, x, y)
    if "date" in keys:
        d = average_ranks(d, keys, {x: "_rx", y: "_ry"})
    else:  # pooled rows: two shuffles of each, by the cells of x and of y
        cx, cy = cut(cell_table(d, keys, x)), cut(cell_table(d, keys, y))
        d = rank_rows(rank_rows(d, keys, x, "_rx", cx, y), keys, y, "_ry", cy, "_rx")
    g = d.groupBy(*keys) if keys else d.groupBy()
    out = g.agg(F.count(F.lit(1)).alias("n"), pearson("_rx", "_ry").alias("_ic"))
    out = out.withColumn("ic", F.when(F.col("n") >= 3, F.col("_ic"))).drop("_ic")
    return out.select(
        *keys, "ic", "n",
        fisher_bound(F.col("ic"), F.col("n"), -1.0).alias("ci_lo"),
        fisher_bound(F.col("ic"), F.col("n"), 1.0).alias("ci_hi"),
    )


def long_pairs(df: DataFrame, keys: Sequence[str], factors: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """One row per (row, factor, target) so that many pairs share one job."""
    f = F.explode(F.array(*[F.struct(F.lit(a).alias("factor"), F.col(a).cast("double").alias("x")) for a in factors]))
    t = F.explode(F.array(*[F.struct(F.lit(b).alias("target"), F.col(b).cast("double").alias("y")) for b in targets]))
    return (
        df.select(*keys, f.alias("_f"), *targets).select(*keys, "_f", t.alias("_t"))
        .select(*keys, "_f.factor", "_f.x", "_t.target", "_t.y")
    )


def daily_ic(df: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = MIN_DAILY_NAMES) -> DataFrame:
    """keys, date, ic, n: rank correlation per date with enough names."""
    ks = [*keys, "date"]
    ic = spearman(df, ks, x, y)
    return ic.where((F.col("n") >= min_n) & F.col("ic").isNotNull()).select(*ks, "ic", "n")


def bucket_table(df: DataFrame, x: str, y: str, k: int = 5) -> DataFrame:
    """ceil(percent rank x k) within the date; median, mean and win rate of y."""
    d = df.where(_all_known([x, y])).select("date", x, y)
    d = average_rank(d, ["date"], x, "_r", "_m").where(F.col("_m") >= k)
    b = F.least(F.greatest(F.ceil(F.col("_r") / F.col("_m") * k), F.lit(1)), F.lit(k)).cast("bigint")
    d = d.withColumn("bucket", b)
    base = d.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), share(F.col(y) > 0).alias("win_rate")
    )
    return base.join(exact_quantiles(d, ["bucket"], y, {"median": 0.5}), "bucket")


def rank_within_date(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """rk_{c}: average rank of each column within the date over the date size."""
    d = average_ranks(df.where(_all_known(cols)), ["date"], {x: f"_k_{x}" for x in cols}, "_kn")
    return d.withColumns({f"rk_{x}": F.col(f"_k_{x}") / F.col("_kn") for x in cols}).drop(
        "_kn", *[f"_k_{x}" for x in cols]
    )


def partial_corr(pair: dict[tuple[str, str], Column], x: str, y: str, controls: Sequence[str]) -> Column:
    """Partial correlation from a table of plain correlations, one control at a time."""
    if not controls:
        return pair[tuple(sorted((x, y)))]
    ctl, rest = controls[-1], controls[:-1]
    xy, xc, yc = (partial_corr(pair, a, b, rest) for a, b in ((x, y), (x, ctl), (y, ctl)))
    den = F.sqrt((1 - xc * xc) * (1 - yc * yc))
    return F.when(den >= 1e-12, (xy - xc * yc) / F.nullif(den, F.lit(0.0)))


def residual_ic(df: DataFrame, x: str, y: str, controls: Sequence[str], keys: Sequence[str] = (), min_n: int = 30) -> DataFrame:
    """Rank correlation of x and y given controls; all pair correlations in one aggregate."""
    cols = [x, y, *controls]
    d = rank_within_date(df.select("date", *[k for k in keys if k != "date"], *cols), cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = [pearson(f"rk_{a}", f"rk_{b}").alias(f"_p_{i}") for i, (a, b) in enumerate(pairs)]
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs)
    pair = {tuple(sorted(p)): F.col(f"_p_{i}") for i, p in enumerate(pairs)}
    out = g.where(F.col("n") >= min_n).select(*keys, "n", partial_corr(pair, x, y, controls).alias("ic"))
    return out.select(
        *keys, "ic", "n",
        fisher_bound(F.col("ic"), F.col("n"), -1.0).alias("ci_lo"),
        fisher_bound(F.col("ic"), F.col("n"), 1.0).alias("ci_hi"),
    )


def date_index(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, date, i (0-based), n_dates: distinct dates, a calendar-bounded table."""
    w = Window.partitionBy(*keys)
    return df.select(*keys, "date").distinct().select(
        *keys, "date",
        (F.row_number().over(w.orderBy("date")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n_dates"),
    )


def nonoverlap_ic(df: DataFrame, x: str, y: str, horizon: int, keys: Sequence[str] = ()) -> DataFrame:
    """Pooled rank correlation over every h-th distinct date."""
    picked = date_index(df, keys).where(F.col("i") % horizon == 0).select(*keys, "date")
    counts = picked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_dates"))
    sub = df.join(F.broadcast(picked), [*keys, "date"], "left_semi")
    ic = spearman(sub, keys, x, y).drop("n")
    return ic.join(counts, list(keys)) if keys else ic.crossJoin(F.broadcast(counts))


def walk_forward_splits(
    dates: DataFrame, keys: Sequence[str] = (), n_splits: int = 4, min_train_frac: float = 0.4, embargo: int | str = 0
) -> DataFrame:
    """keys, split_id, train_end, test_start, test_end over the distinct dates."""
    emb = F.col(embargo) if isinstance(embargo, str) else F.lit(embargo)
    d = date_index(dates, keys)
    carry = [F.max(emb).alias("_emb")] if not isinstance(embargo, str) else [F.lit(0).alias("_emb")]
    shape = d.groupBy(*keys).agg(F.max("n_dates").alias("n"), *carry)
    shape = (
        shape.withColumn("train0", F.greatest(F.floor(F.col("n") * F.lit(min_train_frac)), F.lit(1)))
        .withColumn("blk", F.floor((F.col("n") - F.col("train0")) / n_splits))
        .where((F.col("n") >= 20) & (F.col("blk") >= 5))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
        .withColumn("s", F.col("train0") + F.col("k") * F.col("blk"))
        .withColumn("e", F.when(F.col("k") < n_splits - 1, F.col("s") + F.col("blk") - 1).otherwise(F.col("n") - 1))
        .withColumn("t", F.col("s") - 1 - F.col("_emb"))
        .where(F.col("t") >= 1)
    )
    for name, at in (("train_end", "t"), ("test_start", "s"), ("test_end", "e")):
        look = d.select(*keys, F.col("i").cast("bigint").alias(at), F.col("date").alias(name))
        shape = shape.join(look, [*keys, at])
    return shape.select(*keys, (F.col("k") + 1).alias("split_id"), "train_end", "test_start", "test_end")


def in_test_block(df: DataFrame, splits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows labelled with the test block their date falls in.

    The blocks are expanded to one row per date first, so the fact side takes
    part in an equality join on a calendar-bounded table, never a range join.
    """
    days = df.select(*keys, "date").distinct()
    cond = (F.col("date") >= F.col("test_start")) & (F.col("date") <= F.col("test_end"))
    if keys:
        lab = days.join(F.broadcast(splits), list(keys)).where(cond)
    else:
        lab = days.join(F.broadcast(splits), cond)
    return df.join(F.broadcast(lab.select(*keys, "date", "split_id")), [*keys, "date"])


def ic_summary(series: DataFrame, keys: Sequence[str], block_len: int | str, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Mean daily ic with a moving-block interval."""
    return block_bootstrap(series, keys, "date", "ic", block_len, n_boot, seed).select(
        *keys, F.col("n_obs").alias("n_dates"), F.col("mean").alias("mean_ic"), "ci_lo", "ci_hi"
    )
