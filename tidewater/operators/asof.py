"""As-of alignment: one shuffle on the key, no range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def roll_forward(
    events: DataFrame, rows: DataFrame, key: str, event_date: str, row_date: str, out: str
) -> DataFrame:
    """Adds to each event the first row date at or after it (null if none).

    Reading backwards turns "first one ahead" into a running last value, which
    is one step per row; a frame to the end of the partition is not.
    """
    marks = rows.select(key, F.col(row_date).alias("_d"), F.col(row_date).alias("_row"), F.lit(1).alias("_k"))
    evs = events.withColumn("_d", F.col(event_date)).withColumn("_k", F.lit(0))
    w = Window.partitionBy(key).orderBy(F.desc("_d"), F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        evs.unionByName(marks, allowMissingColumns=True)
        .withColumn(out, F.last("_row", ignorenulls=True).over(w))
        .where(F.col("_k") == 0)
        .drop("_d", "_k", "_row")
    )


def carry_last(
    rows: DataFrame, facts: DataFrame, keys: Sequence[str], row_date: str, fact_date: str, cols: Sequence[str]
) -> DataFrame:
    """Backward as-of: each row gets the last fact at or before its date."""
    pack = F.struct(F.col(fact_date).alias("_fd"), *[F.col(x) for x in cols])
    left = rows.withColumn("_d", F.col(row_date)).withColumn("_k", F.lit(1))
    right = facts.select(*keys, F.col(fact_date).alias("_d"), F.lit(0).alias("_k"), pack.alias("_f"))
    w = Window.partitionBy(*keys).orderBy("_d", "_k").rowsBetween(Window.unboundedPreceding, 0)
    merged = left.unionByName(right, allowMissingColumns=True).withColumn(
        "_f", F.last("_f", ignorenulls=True).over(w)
    )
    keep = [F.col(x) for x in rows.columns]
    return merged.where(F.col("_k") == 1).select(
        *keep, F.col("_f._fd").alias(f"{fact_date}_asof"), *[F.col(f"_f.{x}").alias(x) for x in cols]
    )


def carry_many(rows: DataFrame, key: str, row_date: str, facts: dict[str, tuple[DataFrame, str, Sequence[str]]]) -> DataFrame:
    """Backward as-of from several fact tables in one sorted pass.

    ``facts`` maps the name of an output struct to (table, date from which its
    rows are known, columns).  A row gets the last fact of each table dated at
    or before its own date, null where there is none.
    """
    union = rows.withColumn("_d", F.col(row_date)).withColumn("_k", F.lit(1))
    for name, (table, date, cols) in facts.items():
        pack = F.struct(F.col(date).alias("asof"), *[F.col(x) for x in cols]).alias(name)
        union = union.unionByName(table.select(key, F.col(date).alias("_d"), F.lit(0).alias("_k"), pack), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_d", "_k").rowsBetween(Window.unboundedPreceding, 0)
    carried = union.withColumns({name: F.last(name, ignorenulls=True).over(w) for name in facts})
    return carried.where(F.col("_k") == 1).drop("_d", "_k")
