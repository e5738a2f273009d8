"""First value below a level after a place in a series, looked up in blocks of minima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.sources.staging import cut

#: Places in a block and blocks in an upper block.
FAN = 64


def _first(arr: str, start: Column, level: str) -> Column:
    """Offset (from 0) of the first entry at or after ``start`` that is below the level, else null."""
    hit = F.array_position(F.transform(arr, lambda x, j: F.coalesce((j >= start) & (x < F.col(level)), F.lit(False))), True)
    return F.when(hit > 0, hit - 1).cast("bigint")


def _packed(cells: DataFrame, key: str, out: str) -> DataFrame:
    """Cells (key, _at gapless from 0, _v) -> blocks of FAN with their values in order and their minimum."""
    return cells.groupBy(key, F.floor(F.col("_at") / FAN).alias("_b")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias(out), F.min("_v").alias("_v"))


def first_below(marks: DataFrame, series: DataFrame, key: str, start: str, level: str, out: str) -> DataFrame:
    """Adds to each mark the smallest place >= ``start`` of its key's series whose value is below ``level``.

    ``series`` has (key, place from 1 without gaps, value not null) in this
    order.  A mark climbs from its block of 64 places to the block of 64 blocks
    and to the row of those (one entry per 4096 places of the key), and comes
    down again where a minimum is low enough: five equality joins, and never
    more than one block beside a mark.  Null starts and levels give null.
    """
    place, value = series.columns[1:]
    leaf = cut(_packed(series.select(key, (F.col(place) - 1).alias("_at"), F.col(value).alias("_v")), key, "_leaf"))
    mid = cut(_packed(leaf.select(key, F.col("_b").alias("_at"), "_v"), key, "_mid"))
    top = mid.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_v"))), lambda x: x["_v"]).alias("_top"))

    def at(d: DataFrame, blocks: DataFrame, arr: str, block: Column) -> DataFrame:
        # A mark that needs no block keeps its key in the join, so such marks stay spread.
        d = d.withColumn("_b", F.coalesce(F.when(F.col("_hit").isNull() & F.col(level).isNotNull(), block), F.lit(-1).cast("bigint")))
        return d.join(blocks.select(key, "_b", arr), [key, "_b"], "left")

    s = (F.col(start) - 1).cast("bigint")
    b0, b1 = F.floor(s / FAN), F.floor(s / (FAN * FAN))
    d = marks.withColumn("_hit", F.lit(None).cast("bigint"))
    d = at(d, leaf, "_leaf", b0).withColumn("_hit", b0 * FAN + _first("_leaf", s - b0 * FAN, level)).drop("_leaf")
    d = at(d, mid, "_mid", b1).withColumn("_low", b1 * FAN + _first("_mid", b0 + 1 - b1 * FAN, level)).drop("_mid", "_b")
    d = d.join(top, key, "left").withColumn("_high", F.when(F.col("_hit").isNull() & F.col("_low").isNull(), _first("_top", b1 + 1, level))).drop("_top")
    d = at(d, mid, "_mid", F.col("_high")).withColumn("_low", F.coalesce("_low", F.col("_high") * FAN + _first("_mid", F.lit(0), level))).drop("_mid")
    d = at(d, leaf, "_leaf", F.col("_low")).withColumn("_hit", F.coalesce("_hit", F.col("_low") * FAN + _first("_leaf", F.lit(0), level)))
    return d.withColumn(out, F.col("_hit") + 1).drop("_leaf", "_b", "_hit", "_low", "_high")
