"""Small column builders: rounding, guarded division, guarded frames.

Every builder returns a native ``Column`` so it stays inside whole-stage
code generation; nothing here is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r6(x: str | Column, digits: int = 6) -> Column:
    """Round and normalise negative zero, the form every result is shown in."""
    return F.round(c(x).cast("double"), digits) + F.lit(0.0)


def div(num: str | Column, den: str | Column) -> Column:
    """Division that gives null (not an ANSI error) on a zero divisor."""
    return c(num) / F.nullif(c(den), F.lit(0).cast("double"))


def iso(x: str | Column) -> Column:
    return F.date_format(c(x), "yyyy-MM-dd")


def week_tag(x: str | Column) -> Column:
    """ISO week as ``YYYY-Www``."""
    d = c(x)
    return F.concat(
        F.extract(F.lit("YEAROFWEEK"), d).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(d).cast("string"), 2, "0"),
    )


def own_rows(key: str | Sequence[str] = "entity", order: str = "date") -> WindowSpec:
    """Window over one entity's own rows in date order.

    After the daily pre-aggregation an entity has at most one row per calendar
    day, so this partition is bounded by the length of the calendar however
    many source rows the entity had.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(order)


def last_n(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def roll_avg(x: str | Column, w: WindowSpec, n: int, min_n: int | None = None) -> Column:
    """Rolling mean of the last ``n`` own rows, null until ``min_n`` values are seen."""
    f = last_n(w, n)
    m = n if min_n is None else min_n
    mean = F.avg(c(x)).over(f)
    return mean if m <= 1 else F.when(F.count(c(x)).over(f) >= m, mean)


def roll_sum_int(x: str | Column, w: WindowSpec, n: int) -> Column:
    """Rolling sum of an integer column (short windows allowed at the start)."""
    return F.sum(c(x)).over(last_n(w, n))


def roll_z(
    x: str | Column, w: WindowSpec, n: int, min_n: int, min_abs: float = 0.0
) -> Column:
    """(x - mean) / sample std in the window; null if too few values or std = 0."""
    f = last_n(w, n)
    sd = F.stddev_samp(c(x)).over(f)
    ok = (F.count(c(x)).over(f) >= min_n) & (sd > 0)
    if min_abs > 0:
        ok = ok & (F.abs(c(x)) >= min_abs)
    return F.when(ok, (c(x) - F.avg(c(x)).over(f)) / sd)


def with_whole_z(df, w: WindowSpec, cols: Sequence[str], n: int, min_n: int):
    """Adds {c}_z for whole-number columns without nulls from running sums.

    A sliding frame costs n steps per row and column; the difference of two
    running sums costs one, and is exact for whole numbers.
    """
    run = running(w)
    d = df.withColumns(
        {"_k": F.row_number().over(w)}
        | {f"_a_{x}": F.sum(F.col(x).cast("double")).over(run) for x in cols}
        | {f"_b_{x}": F.sum(F.col(x).cast("double") * F.col(x)).over(run) for x in cols}
    )
    old = [F.coalesce(F.lag(f"_{p}_{x}", n).over(w), F.lit(0.0)).alias(f"_l{p}_{x}") for x in cols for p in "ab"]
    d = d.select("*", *old)
    m = F.least(F.col("_k"), F.lit(n)).cast("double")
    out = {}
    for x in cols:
        s1, s2 = F.col(f"_a_{x}") - F.col(f"_la_{x}"), F.col(f"_b_{x}") - F.col(f"_lb_{x}")
        var = (m * s2 - s1 * s1) / (m * F.greatest(m - 1, F.lit(1.0)))
        ok = (m >= min_n) & (var > s2 / m * 1e-12)
        out[f"{x}_z"] = F.when(ok, (F.col(x) - s1 / m) / F.sqrt(F.greatest(var, F.lit(1e-300))))
    return d.withColumns(out).drop("_k", *[f"{q}{p}_{x}" for x in cols for p in "ab" for q in ("_", "_l")])


def clip(x: str | Column, lo: float, hi: float) -> Column:
    """Clamp; null stays null (``least`` and ``greatest`` alone would drop it)."""
    return F.when(c(x).isNotNull(), F.greatest(F.least(c(x), F.lit(hi)), F.lit(lo)))


def pearson(x: str | Column, y: str | Column) -> Column:
    """Aggregate Pearson correlation, null for a constant side."""
    den = F.stddev_pop(c(x)) * F.stddev_pop(c(y))
    return F.when(den > 1e-12, F.covar_pop(c(x), c(y)) / F.nullif(den, F.lit(0.0)))


def fisher_bound(rho: Column, n: Column, sign: float) -> Column:
    """tanh(atanh rho +/- 1.96/sqrt(n-3)); null below 11 rows or at |rho| >= 0.999."""
    ok = (n >= 11) & (F.abs(rho) < 0.999)
    safe_n = F.greatest(n, F.lit(11)).cast("double")
    return F.when(ok, F.tanh(F.atanh(rho) + F.lit(sign * 1.96) / F.sqrt(safe_n - 3)))


def share(cond: Column) -> Column:
    """Share of true among non-null conditions."""
    return F.avg(cond.cast("double"))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def rn(x: str | Column, digits: int) -> Column:
    """Round to few digits by way of nine, so that engines agree on decimal halves."""
    return F.round(F.round(c(x).cast("double"), 9), digits) + F.lit(0.0)


def with_scalar(df, one_row):
    """Attaches the columns of a one-row aggregate by a broadcast equality join."""
    left = df.withColumn("_one", F.lit(1))
    return left.join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")
