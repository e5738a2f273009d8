"""Exact dedup with a Bloom filter of possibly repeated hashes, in SQL functions only.

Pass 1 counts rows per bit position of their hash and packs the positions met
at least twice into 4 KB bitmaps.  Pass 2 probes them: a row at a position met
once has no copy and passes straight through; only the others shuffle, by the
sha256 of the text, which decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import text_of, with_outputs

#: Bits of one bitmap of bitmap_construct_agg.
BITMAP = 32_768


def repeated_positions(hashes: DataFrame, h: str, bits: int) -> DataFrame:
    """bucket, bitmap: the positions of [0, bits) that two or more rows share."""
    pos = F.pmod(F.col(h), F.lit(bits))
    twice = hashes.groupBy(pos.alias("pos")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # bucket numbers start at 1 and bit positions at 0
    return twice.groupBy(F.bitmap_bucket_number("pos").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("pos")).alias("bitmap"))


def has_bit(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (bit % 8).cast("int")) == 1


def flag_repeats(df: DataFrame, h: str, out: str, bits: int) -> DataFrame:
    """Every row with ``out``: false if no other row has its hash, true if one may have."""
    filt = repeated_positions(df.select(h), h, bits)
    pos = F.pmod(F.col(h), F.lit(bits))
    # at most bits/8 bytes, whatever the input: safe to broadcast
    d = df.withColumn("__bucket", F.bitmap_bucket_number(pos)).join(F.broadcast(filt.select(F.col("bucket").alias("__bucket"), F.col("bitmap").alias("__bitmap"))), "__bucket", "left")
    return d.withColumn(out, F.coalesce(has_bit(F.col("__bitmap"), F.bitmap_bit_position(pos)), F.lit(False))).drop("__bucket", "__bitmap")


def dedup(df: DataFrame, text: str = "text", id_col: str = "doc_id", bits: int = 1 << 26) -> DataFrame:
    """Every row with keep_id, group_size, kept and text_sha256.

    Rows are equal if their texts are, a null text being empty.  The row with
    the largest id of its group is kept (a null id is smaller than any); of
    several rows with that id all bear kept = true, as nothing tells them
    apart.  ``bits`` bounds the broadcast filter to bits/8 bytes: beyond about
    as many rows more unique rows join the shuffle, which stays exact.  Input
    columns named like the outputs give way.
    """
    t = text_of(text).cast("binary")
    d = df.withColumns({"__sha": F.sha2(t, 256), "__h": F.xxhash64(t)})
    d = flag_repeats(d, "__h", "__maybe", bits)
    maybe = d.where("__maybe")
    groups = maybe.groupBy("__sha").agg(F.max(id_col).alias("__keep"), F.count(F.lit(1)).alias("__size"))
    own = {"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long"), "kept": F.lit(True), "text_sha256": F.col("__sha")}
    found = {"keep_id": F.col("__keep"), "group_size": F.col("__size"), "kept": F.col(id_col).eqNullSafe(F.col("__keep")), "text_sha256": F.col("__sha")}
    alone = with_outputs(d.where("not __maybe").drop("__maybe", "__h"), own).drop("__sha")
    shared = with_outputs(maybe.drop("__maybe", "__h").join(groups, "__sha"), found).drop("__sha", "__keep", "__size")
    return alone.unionByName(shared)
