"""Membership that changes: snapshots as validity intervals, and reads as of an earlier time.

A snapshot is the whole state at one step of a calendar (a whole number).
Stored are only changes: an interval opens when a member appears, closes at the
first step at which it is gone, and a new one opens when it comes back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.exprs import with_scalar


def validity_intervals(states: DataFrame, keys: Sequence[str], step: str) -> DataFrame:
    """keys, valid_from, valid_to (first step without the member; null while it is in the last snapshot) from all snapshots (keys, step)."""
    seen = states.select(*keys, step).distinct()
    w = Window.partitionBy(*keys).orderBy(step)
    run = seen.withColumn("_g", F.col(step) - F.row_number().over(w))
    ends = run.groupBy(*keys, "_g").agg(F.min(step).alias("valid_from"), (F.max(step) + 1).alias("valid_to")).drop("_g")
    d = with_scalar(ends, states.agg((F.max(step) + 1).alias("_end")))
    return d.withColumn("valid_to", F.when(F.col("valid_to") < F.col("_end"), F.col("valid_to"))).drop("_end")


def next_snapshot(intervals: DataFrame, snapshot: DataFrame, keys: Sequence[str], step: int) -> DataFrame:
    """The intervals after the snapshot of ``step``: members gone are closed, new and returning ones opened, the rest left.

    Steps come in ascending order; taking the last one again changes nothing.
    """
    now = snapshot.select(*keys).distinct().withColumn("_now", F.lit(True))
    before = intervals.where(F.col("valid_from") < step).withColumn("valid_to", F.when(F.col("valid_to") < step, F.col("valid_to")))
    closed = before.where(F.col("valid_to").isNotNull())
    both = before.where(F.col("valid_to").isNull()).join(now, list(keys), "full")
    begun = F.coalesce("valid_from", F.lit(step).cast(dict(intervals.dtypes)["valid_from"]))
    ended = F.when(F.col("_now").isNull(), F.lit(step)).cast(dict(intervals.dtypes)["valid_to"])
    return closed.unionByName(both.select(*keys, begun.alias("valid_from"), ended.alias("valid_to")))


def as_of(rows: DataFrame, intervals: DataFrame, on: str, step: str, last: int | None = None) -> DataFrame:
    """Every row with each member whose interval holds its step: an equality join on (``on``, step), as large as its result.

    Open intervals reach to the last step of ``rows`` (or ``last``).
    """
    end = rows.agg((F.max(step) + 1).alias("_end")) if last is None else rows.sparkSession.range(1).select(F.lit(last + 1).alias("_end"))
    held = with_scalar(intervals, end).withColumn("_to", F.least(F.coalesce("valid_to", "_end"), F.col("_end"))).where(F.col("valid_from") < F.col("_to"))
    held = held.withColumn(step, F.explode(F.sequence(F.col("valid_from"), F.col("_to") - 1))).drop("valid_from", "valid_to", "_to", "_end")
    return rows.join(held, [on, step])
