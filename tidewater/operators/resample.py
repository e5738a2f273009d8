"""Moving-block and i.i.d. bootstrap intervals as joins on prefix sums.

A replicate is a set of blocks; the sum of a block is the difference of two
running sums, so no resampled series is ever built.  Block starts come from
an md5 counter hash, which any engine can repeat.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.sources.staging import cut


def hash_start(seed: Column, r: Column, b: Column, width: Column) -> Column:
    """Start of block ``b`` of replicate ``r``: uniform over ``width`` positions."""
    text = F.concat_ws(":", seed.cast("string"), r.cast("string"), b.cast("string"))
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, width)


def block_bootstrap(
    series: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    block_len: int | str,
    n_boot: int = 1000,
    seed: int = 42,
    alpha: float = 0.05,
    lo: str = "ci_lo",
    hi: str = "ci_hi",
) -> DataFrame:
    """Mean, length and percentile interval of each keyed series.

    ``series`` must be a per-date (or other calendar-bounded) series: one row
    per key and ``order``.  Series shorter than 10 give a null interval.
    ``block_len`` is a number or the name of a column constant within a key.
    """
    ks = list(keys)
    blk = F.col(block_len) if isinstance(block_len, str) else F.lit(block_len)
    w = Window.partitionBy(*ks)
    pts = (
        series.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
        .select(*ks, F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"), blk.cast("int").alias("_b"))
        .withColumn("_i", F.row_number().over(w.orderBy("_o")) - 1)
        .withColumn("_t", F.count(F.lit(1)).over(w))
        .withColumn("_s", F.sum("_v").over(w.orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_i", F.col("_i").cast("bigint"))
    )
    pts = cut(pts)  # one row per key and date; its file size decides between broadcast and shuffle
    heads = pts.groupBy(*ks).agg(
        F.max("_t").alias("_t"), F.avg("_v").alias("mean"), F.max("_b").alias("_b")
    )
    heads = heads.withColumn("_len", F.greatest(F.lit(1), F.least(F.col("_b"), F.col("_t"))).cast("bigint"))
    draws = (
        heads.where(F.col("_t") >= 10)
        .withColumn("_nb", F.ceil(F.col("_t") / F.col("_len")))
        .withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
        .repartition(series.sparkSession.sparkContext.defaultParallelism, "_r")
        .withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nb") - 1)))
        .withColumn("_start", hash_start(F.lit(seed), F.col("_r"), F.col("_k"), F.col("_t") - F.col("_len") + 1))
        .withColumn(
            "_take",
            F.when(F.col("_k") < F.col("_nb") - 1, F.col("_len")).otherwise(
                F.col("_t") - F.col("_len") * (F.col("_nb") - 1)
            ),
        )
        .select(
            *ks, "_t", "_r",
            F.explode(
                F.array(
                    F.struct((F.col("_start") + F.col("_take") - 1).alias("p"), F.lit(1.0).alias("sg")),
                    F.struct((F.col("_start") - 1).alias("p"), F.lit(-1.0).alias("sg")),
                )
            ).alias("_e"),
        )
        .select(*ks, "_t", "_r", F.col("_e.p").alias("_i"), F.col("_e.sg").alias("_sg"))
    )
    prefix = pts.select(*ks, "_i", "_s")
    if block_len == 1:  # single values: one lookup per draw instead of two
        draws = draws.where(F.col("_sg") > 0)
        prefix = pts.select(*ks, "_i", F.col("_v").alias("_s"))
    stats = (
        draws.join(prefix, [*ks, "_i"], "left")
        .groupBy(*ks, "_r")
        .agg((F.sum(F.col("_sg") * F.coalesce("_s", F.lit(0.0))) / F.max("_t")).alias("_m"))
    )
    lo_i, hi_i = int(n_boot * (alpha / 2)), int(n_boot * (1 - alpha / 2)) - 1
    ordered = stats.withColumn("_q", F.row_number().over(w.orderBy("_m")) - 1)
    ci = ordered.groupBy(*ks).agg(
        F.max(F.when(F.col("_q") == lo_i, F.col("_m"))).alias(lo),
        F.max(F.when(F.col("_q") == hi_i, F.col("_m"))).alias(hi),
    )
    return heads.select(*ks, F.col("_t").alias("n_obs"), "mean").join(ci, ks, "left")


PRIME = 2_147_483_647
#: Where a uniform whole number below PRIME reaches 1, 2, ... in a Poisson draw of mean 1.
POISSON = [int(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(9)]


STEPS = ((16807, 7), (48271, 11), (69621, 13))
#: Rows drawn at a time, so that their numbers stay in a core's cache, and keys whose sums a task holds.
DRAWN, HELD = 32, 512


def poisson_weights(ident: np.ndarray, n_boot: int, seed: int) -> np.ndarray:
    """The Poisson weight of every row (a whole number that names it) in every replicate, as SQL draws it."""
    u = (np.mod(ident.astype(np.int64), PRIME) * 48271)[:, None] + ((np.arange(n_boot, dtype=np.int64) + seed) * 69621 + 1)
    high = np.empty_like(u)

    def fold() -> None:
        """u modulo 2**31 - 1 without a division, the prime itself standing for zero."""
        for _ in range(2):
            np.right_shift(u, 31, out=high)
            np.bitwise_and(u, PRIME, out=u)
            np.add(u, high, out=u)

    fold()
    for odd, one in STEPS:
        np.add(u, odd, out=high)
        np.multiply(u, high, out=u)
        np.add(u, one, out=u)
        fold()
    drawn = u.astype(np.int32)
    w = np.zeros(u.shape, dtype=np.int8)
    for t in POISSON:
        w += (drawn >= t).view(np.int8)
    w *= (drawn != PRIME).view(np.int8)
    return w


def poisson_interval(rows: DataFrame, keys: Sequence[str], value: str, ident: str, n_boot: int = 1000, seed: int = 20260710, alpha: float = 0.05) -> DataFrame:
    """keys, ci_lo, ci_hi: percentile interval of the pooled mean of a table's rows.

    Every row draws its own Poisson weight in each replicate from a counter
    hash, so a replicate needs neither the number of rows nor their order: all
    replicates are one sum that is combined map-side, however many rows a key
    has.  Rows of one ident that lie together (horizons, labels and totals of
    one source row) are drawn once, and their sums are one matrix product.
    Keys with less than ten rows get a null interval.
    """
    ks = list(keys)
    d = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*ks, F.col(value).cast("double").alias("_y"), F.col(ident).cast("long").alias("_id"))
    size = d.groupBy(*ks).agg(F.count(F.lit(1)).alias("_n"))
    out = StructType([d.schema[k] for k in ks] + StructType.fromDDL("_wy array<double>, _w array<double>").fields)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            part = pd.DataFrame([[*k, s[0], s[1]] for k, s in held.items()], columns=[f.name for f in out])
            held.clear()
            return part

        for batch in batches:
            if not len(batch):
                continue
            labels = list(batch[ks].itertuples(index=False, name=None)) if ks else [()] * len(batch)
            number: dict[tuple, int] = {}
            code = np.array([number.setdefault(k, len(number)) for k in labels])
            ids, at = np.unique(batch["_id"].to_numpy(np.int64), return_inverse=True)
            order = np.argsort(at, kind="stable")
            y, code, at = batch["_y"].to_numpy()[order], code[order], at[order]
            total = {c: np.zeros((2, n_boot)) for c in range(len(number))}
            for lo in range(0, len(ids), DRAWN):
                w = poisson_weights(ids[lo:lo + DRAWN], n_boot, seed).astype(np.float64)
                part = slice(*np.searchsorted(at, (lo, lo + DRAWN)))
                used, col = np.unique(code[part], return_inverse=True)
                m = np.zeros((2 * len(used), len(w)))
                np.add.at(m, (2 * col, at[part] - lo), y[part])
                np.add.at(m, (2 * col + 1, at[part] - lo), 1.0)
                for c, s in zip(used, (m @ w).reshape(len(used), 2, n_boot)):
                    total[c] += s
            for k, c in number.items():
                held[k] = held[k] + total[c] if k in held else total[c]
            if len(held) > HELD:
                yield flush()
        if held:
            yield flush()

    parts = d.mapInPandas(sums, out)
    each = F.posexplode(F.arrays_zip("_wy", "_w")).alias("_b", "_x")
    means = parts.select(*ks, each).groupBy(*ks, "_b").agg((F.sum("_x._wy") / F.nullif(F.sum("_x._w"), F.lit(0.0))).alias("_m"))
    order = Window.partitionBy(*ks).orderBy("_m")
    means = means.withColumn("_q", F.row_number().over(order) - 1)  # one row a replicate
    lo, hi = int(n_boot * (alpha / 2)), int(n_boot * (1 - alpha / 2)) - 1
    ci = means.groupBy(*ks).agg(F.max(F.when(F.col("_q") == lo, F.col("_m"))).alias("_lo"), F.max(F.when(F.col("_q") == hi, F.col("_m"))).alias("_hi"))
    enough = F.col("_n") >= 10
    return size.join(ci, ks, "left").select(*ks, F.when(enough, F.col("_lo")).alias("ci_lo"), F.when(enough, F.col("_hi")).alias("ci_hi"))
