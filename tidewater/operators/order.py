"""Order statistics that never gather a whole group in one task.

A cross-section (all entities of one date) or the pooled panel can hold a
large part of all rows, so ``rank() over (partition by date)`` or a buffering
``percentile`` would put that part into one task.  Both operators below cut
the value axis into many order-preserving cells instead.  A cell count table
is small and is combined map-side, so the position of every cell is known;
only rows inside one cell are ever sorted together.  Equal values are counted
before they are shuffled, so a hot value costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Cells per factor e of a value: one spans a thousandth of it, and a group has at most some 70,000.
PER_FOLD = 1024
#: A quantile orders the rows of a cell or two only, so its cells are wider and their counts fewer.
PER_FOLD_QUANTILE = 64
#: A task has some hundred rows of a date, so finer cells would hold one row each and their counts be as many as the rows.
PER_FOLD_DATE = 8


def order_cell(v: Column, per_fold: int = PER_FOLD) -> Column:
    """Monotone integer cell of a value: log-spaced, symmetric around zero."""
    v = v.cast("double")
    return F.floor(F.signum(v) * F.log1p(F.abs(v) * F.lit(1e6)) * F.lit(float(per_fold)))


def _keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if keys:
        return df, list(keys)
    return df.withColumn("_all", F.lit(0)), ["_all"]


def rank_table(
    base: DataFrame, ks: Sequence[str], value: str, out: str, n_out: str, method: str, descending: bool
) -> DataFrame:
    """One row per distinct (keys, value) with its rank and the group size."""
    vals = (
        base.where(F.col(value).isNotNull())
        .groupBy(*ks, value)
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_cell", order_cell(F.col(value)))
    )
    w_cells = Window.partitionBy(*ks).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = (
        vals.groupBy(*ks, "_cell")
        .agg(F.sum("_c").alias("_cc"))
        .withColumn("_before", F.sum("_cc").over(w_cells) - F.col("_cc"))
        .withColumn("_n", F.sum("_cc").over(Window.partitionBy(*ks)))
    )
    w_in = Window.partitionBy(*ks, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_before") + F.sum("_c").over(w_in)
    first = F.col("_n") - upto + 1 if descending else upto - F.col("_c") + 1
    rank = first.cast("double")
    if method == "average":
        rank = rank + (F.col("_c") - 1) / F.lit(2.0)
    return vals.join(cells, [*ks, "_cell"]).select(*ks, value, rank.alias(out), F.col("_n").alias(n_out))


def average_ranks(
    df: DataFrame,
    keys: Sequence[str],
    ranks: Mapping[str, str],
    n_out: str | None = None,
    method: str = "average",
    descending: bool = False,
) -> DataFrame:
    """Adds for each ``value: out`` the average (or min) rank within ``keys``.

    Nulls stay null.  ``n_out`` receives the number of non-null values of the
    last ranked column.  Every rank table is built from ``df`` itself, so the
    plan grows linearly with the number of columns.  Groups of one date have a
    row per entity at most and are ranked by windows behind one shuffle.
    """
    if "date" in keys:
        return _date_ranks(df, keys, ranks, n_out, method, descending)
    base, ks = _keys(df, keys)
    res = base
    for value, out in ranks.items():
        table = rank_table(base, ks, value, out, "_group_n", method, descending)
        res = res.drop("_group_n").join(table, [*ks, value], "left")
    if n_out:
        res = res.withColumn(n_out, F.col("_group_n"))
    return res.drop("_group_n", *([] if keys else ["_all"]))


def _tied_rank(order: Window, same: Window, method: str) -> Column:
    rank = F.rank().over(order).cast("double")
    return rank if method == "min" else rank + (F.count(F.lit(1)).over(same) - 1) / F.lit(2.0)


def _date_ranks(df: DataFrame, keys: Sequence[str], ranks: Mapping[str, str], n_out: str | None, method: str, descending: bool) -> DataFrame:
    group = Window.partitionBy(*keys)
    cols = {}
    for value, out in ranks.items():
        v = F.col(value)
        order = group.orderBy(v.desc_nulls_last() if descending else v.asc_nulls_last())
        cols[out] = F.when(v.isNotNull(), _tied_rank(order, Window.partitionBy(*keys, value), method))
        if n_out:  # as beside every rank, null where the value is
            cols[n_out] = F.when(v.isNotNull(), F.count(v).over(group))
    return df.withColumns(cols)


#: Rows of one value that are spread over tasks, for their rank is known without ordering them.
HOT, SPREAD = 100_000, 64


def rank_rows(rows: DataFrame, keys: Sequence[str], value: str, out: str, cells: DataFrame, other: str) -> DataFrame:
    """Rows with their average rank within ``keys``, for groups of any size: each row is shuffled once.

    ``cells`` is ``cell_table`` of the same rows and ``value``, neither of
    which may be null; ``other`` is a column by which rows of a hot value are
    spread.
    """
    ks = [*keys, "_cell"]
    hot = cells.where((F.col("_low") == F.col("_high")) & (F.col("_c") > HOT)).select(*ks, (F.col("_before") + (F.col("_c") + 1) / F.lit(2.0)).alias("_known"))
    d = rows.withColumn("_cell", order_cell(F.col(value))).join(F.broadcast(hot), ks, "left")
    d = d.withColumn("_salt", F.when(F.col("_known").isNotNull(), F.pmod(F.xxhash64(other), F.lit(SPREAD)) + 1).otherwise(F.lit(0).cast("long")))
    part = [*ks, "_salt"]
    before = cells.select(*ks, "_before", F.lit(0).cast("long").alias("_salt"))
    inside = _tied_rank(Window.partitionBy(*part).orderBy(value), Window.partitionBy(*part, value), "average")
    d = d.withColumn("_in", inside).join(F.broadcast(before), part, "left")
    return d.withColumn(out, F.coalesce("_known", F.col("_before") + F.col("_in"))).drop("_cell", "_salt", "_known", "_before", "_in", value)


def cell_table(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, _cell: rows of the cell and before it, and its least and largest value (at most some 70,000 rows a group)."""
    w = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    g = rows.groupBy(*keys, order_cell(F.col(value)).alias("_cell")).agg(F.count(F.lit(1)).alias("_c"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    return g.withColumn("_before", F.sum("_c").over(w) - F.col("_c"))


def average_rank(
    df: DataFrame, keys: Sequence[str], value: str, out: str, n_out: str | None = None,
    method: str = "average", descending: bool = False,
) -> DataFrame:
    return average_ranks(df, keys, {value: out}, n_out, method, descending)


def linear_position(p: float) -> Callable[[Column], tuple[Column, Column, Column]]:
    def at(n: Column) -> tuple[Column, Column, Column]:
        pos = F.lit(p) * (n - 1)
        lo = F.floor(pos)
        return lo, F.ceil(pos), pos - lo

    return at


def nearest_position(p: float) -> Callable[[Column], tuple[Column, Column, Column]]:
    def at(n: Column) -> tuple[Column, Column, Column]:
        lo = F.round(F.lit(p) * (n - 1)).cast("bigint")
        return lo, lo, F.lit(0.0)

    return at


def list_position(k: int, d: int) -> Callable[[Column], tuple[Column, Column, Column]]:
    """Element ``n*k//d`` of the sorted list (0-based)."""

    def at(n: Column) -> tuple[Column, Column, Column]:
        lo = F.floor(n * F.lit(k) / F.lit(d))
        return lo, lo, F.lit(0.0)

    return at


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float | Callable],
    n_out: str | None = None,
) -> DataFrame:
    """Exact quantiles per group by histogram selection: one row per group.

    Pass 1 counts rows per (group, cell).  Pass 2 keeps only the cells that
    hold a wanted position and orders the distinct values inside them.  Those
    cells are a few a group and are broadcast (unless groups are entities), so
    pass 2 shuffles their rows only.
    """
    at = {k: (q if callable(q) else linear_position(q)) for k, q in quantiles.items()}
    base, ks = _keys(df, keys)
    rows = base.where(F.col(value).isNotNull()).select(
        *ks, F.col(value).cast("double").alias("_v")
    ).withColumn("_cell", order_cell(F.col("_v"), PER_FOLD_DATE if "date" in keys else PER_FOLD_QUANTILE))
    w = Window.partitionBy(*ks)
    cells = (
        rows.groupBy(*ks, "_cell")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_end", F.sum("_c").over(w.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_n", F.sum("_c").over(w))
        .withColumn("_base", F.col("_end") - F.col("_c"))
    )
    wanted = F.array_distinct(
        F.array(*[x.cast("bigint") for f in at.values() for x in f(F.col("_n"))[:2]])
    )
    targets = (
        cells.withColumn(
            "_pos", F.filter(wanted, lambda p: (p >= F.col("_base")) & (p < F.col("_end")))
        )
        .where(F.size("_pos") > 0)
        .select(*ks, "_cell", "_base", "_n", "_pos")
    )
    w_in = Window.partitionBy(*ks, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        rows.join(targets if "entity" in ks else F.broadcast(targets), [*ks, "_cell"])
        .groupBy(*ks, "_cell", "_base", "_n", "_pos", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_end", F.col("_base") + F.sum("_c").over(w_in))
        .withColumn(
            "_p",
            F.explode(
                F.filter("_pos", lambda p: (p >= F.col("_end") - F.col("_c")) & (p < F.col("_end")))
            ),
        )
    )
    maps = picked.groupBy(*ks).agg(
        F.max("_n").alias("_n"),
        F.map_from_entries(F.collect_list(F.struct("_p", "_v"))).alias("_m"),
    )
    cols = []
    for name, f in at.items():
        lo, hi, frac = f(F.col("_n"))
        a = F.element_at("_m", lo.cast("bigint"))
        b = F.element_at("_m", hi.cast("bigint"))
        cols.append((a + (b - a) * frac).alias(name))
    out = [F.col("_n").alias(n_out)] if n_out else []
    return maps.select(*keys, *out, *cols)


def group_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return exact_quantiles(df, keys, value, {out: 0.5})


def positions(df: DataFrame, keys: Sequence[str], value: str, tie: str, out: str, per_fold: int = 64) -> DataFrame:
    """Adds the place (from 0) of each row in its group by (value, tie), for values that are not null.

    Places run over order-preserving cells, whose counts are a small table, and
    rows are ordered inside one cell only.
    """
    ks = [*keys, "_cell"]
    rows = df.where(F.col(value).isNotNull()).withColumn("_cell", order_cell(F.col(value), per_fold))
    w = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*ks).agg(F.count(F.lit(1)).alias("_c")).select(*ks, F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*ks).orderBy(value, tie)) - 1
    return rows.withColumn("_in", inside).join(cells, ks).withColumn(out, F.col("_before") + F.col("_in")).drop("_cell", "_in", "_before")
