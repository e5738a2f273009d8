"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is cut into cells at quantiles of its own values, the cells'
curve index orders all rows, and the order is cut into runs of equal length.
Neighbours on the curve are close in every dimension, so a shard covers a
narrow range of each and filters on any of them skip most files.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import text_of, with_outputs
from tidewater.sources.staging import write_stage


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of each row of ``cells`` (n x dimensions, values below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):  # undo the rotations and reflections of each level, from the coarsest
        bit, low = np.int64(1) << b, (np.int64(1) << b) - 1
        for i in range(n):
            turn = (x[i] & bit) != 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turn, low, swap)
            x[i] ^= swap
    for i in range(1, n):  # Gray code across the dimensions
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] & (np.int64(1) << b), (np.int64(1) << b) - 1, 0)
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def number_of(df: DataFrame, name: str) -> Column:
    """An ordered column as a number: numbers as they are, else the first six bytes of its text; null lowest."""
    kind = dict(df.dtypes)[name]
    if kind.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
        value = F.col(name).cast("double")
    else:
        value = F.conv(F.hex(F.substring(F.rpad(F.col(name).cast("string"), 6, "\0").cast("binary"), 1, 6)), 16, 10).cast("double")
    return F.coalesce(value, F.lit(float("-inf")))


def shard(df: DataFrame, shards: int, dims: list[str], tie: list[str], bits: int = 5) -> DataFrame:
    """Every row with curve, shard (0 to shards-1) and slot (gapless from 0 in its shard).

    Shards are runs of the order by curve index, hash of the ``tie`` columns,
    and these columns themselves, and hold equally many rows, at most one
    apart, however the rows spread over the curve: ranges of the whole order are
    dealt out, so a hot cell is split like any other.  Nulls come lowest in a
    dimension; equal rows follow each other; an empty table gives none; input
    columns named like the outputs give way.  Rows of equal metadata and equal
    ``tie`` are interchangeable, so reruns agree.
    """
    d = df.select("*", *[number_of(df, c).alias(f"__d{i}") for i, c in enumerate(dims)])
    points = [k / 2**bits for k in range(1, 2**bits)]
    cuts = d.agg(F.array(*[F.array_distinct(F.percentile_approx(f"__d{i}", points, 2_000)) for i in range(len(dims))]).alias("cuts"))
    d = d.withColumn("__cuts", cuts.scalar())

    def cell(i: int) -> Column:
        return F.size(F.filter(F.get("__cuts", F.lit(i)), lambda c: c < F.col(f"__d{i}")))

    cells = [cell(i) for i in range(len(dims))]

    @F.pandas_udf("long")
    def curve(*cell: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cell], axis=1), bits))

    d = d.withColumn("__curve", curve(*cells)).drop("__cuts", *[f"__d{i}" for i in range(len(dims))])
    order = ["__curve", "__mix", *[f"__t{i}" for i in range(len(tie))]]
    d = d.withColumns({"__mix": F.xxhash64(*[F.col(c) for c in tie]), **{f"__t{i}": F.col(c) for i, c in enumerate(tie)}})
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the partition and the place in it are written down: range bounds are drawn anew in every run
    laid = write_stage(d.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "curve")
    per_part = laid.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    # one row per partition of the range shuffle
    upto = per_part.withColumn("__before", F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    total = per_part.agg(F.sum("n").alias("__total"))
    ranked = laid.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(upto.select("__part", F.coalesce("__before", F.lit(0)).alias("__before"))), "__part")
    ranked = ranked.withColumn("__total", total.scalar())
    rank = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    number = F.expr(f"cast(((__rank + 1) * {shards} - 1) div __total as int)")
    ranked = ranked.withColumn("__rank", rank).withColumn("__shard", number)
    slot = F.expr(f"__rank - (__shard * __total) div {shards}")
    return with_outputs(ranked, {"curve": F.col("__curve"), "shard": F.col("__shard"), "slot": slot.cast("long")}).drop("__part", "__before", "__total", "__rank", "__shard", "__at", *order)


def write_shards(sharded: DataFrame, path: str, shards: int) -> None:
    """One folder per shard, files in curve order; the files' statistics then prune in every dimension."""
    sharded.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    t = text_of("text")
    sized = docs.select("doc_id", "lang", "source", (F.octet_length(t).cast("long") + 16).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    laid = shard(sized, shards, ["source", "lang", "size"], ["text_crc32", "doc_id", "size"])
    return laid.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
