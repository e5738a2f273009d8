"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words.

Slot i of the schedule takes the point frac(i * golden ratio) to a source by
the cumulative targets, so every stretch of the schedule holds the sources in
their shares.  The slot's rank among those of its source names the block it
takes: the source's documents in hashed order, cut every ``block_words`` words,
begun anew when they are used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import text_of
from tidewater.sources.staging import write_stage

#: Golden ratio's fractional part in units of 2**-52: products with slot numbers stay whole, hence exact.
GOLDEN, ONE = 2_783_377_641_436_327, 1 << 52
#: Slots that one row of the schedule's first level stands for; buckets of a source's hashed order.
STRETCH, BUCKETS = 1 << 16, 1 << 12


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """source, size -> and target: weights go round over the sources in code point order, null last.

    All sizes together are shared out by weight; a source takes at most
    ``repeats`` times its size, what it leaves goes to the others by weight.
    With sources ordered by size per weight those that are full come first; the
    first order place at which the rest's share isn't above the next limit ends
    them.  One row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("double")).withColumn("place", place)
    s = s.withColumn("full", F.col("size") * float(repeats))
    w = Window.orderBy(F.col("full") / F.col("weight"), "place")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("rate", (F.sum("size").over(Window.partitionBy()) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    first = F.first(F.when(F.col("rate") <= F.col("full") / F.col("weight"), F.col("rate")), True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("level", first)
    return s.select("source", "size", "place", F.least("full", F.col("level") * F.col("weight")).alias("target"))


def schedule(spark, shares: DataFrame, slots: int) -> DataFrame:
    """place, slot, rank: the source of each slot and the slot's number among those of its source.

    ``shares``: place, target.  Numbers come from two levels, slots within a
    stretch and stretches, so no task holds more than a stretch's share.
    """
    upto = shares.where("target > 0").withColumn("upto", F.sum("target").over(Window.orderBy("place"))).withColumn("all", F.sum("target").over(Window.partitionBy()))
    # one row: a limit per source
    table = upto.agg(F.array_sort(F.collect_list(F.struct((F.col("upto") / F.col("all")).alias("upto"), "place"))).alias("t"))
    i = F.col("id")
    # i * GOLDEN modulo 2**52 in two halves, so that no product leaves 64 bits
    low, high = GOLDEN & ((1 << 26) - 1), GOLDEN >> 26
    j = i % (1 << 26)
    k = F.shiftright(i, 26)
    point = F.pmod(j * low + F.pmod(j * high + k * low, F.lit(1 << 26)) * (1 << 26), F.lit(ONE)) / float(ONE)
    s = spark.range(slots).select(i.alias("slot"), point.alias("point")).withColumn("t", table.scalar())
    place = F.coalesce(F.get(F.filter("t", lambda x: x["upto"] > F.col("point")), F.lit(0))["place"], F.element_at("t", -1)["place"])
    s = s.select("slot", place.alias("place")).withColumn("stretch", F.floor(F.col("slot") / STRETCH))
    per = s.groupBy("place", "stretch").agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("before", F.sum("n").over(Window.partitionBy("place").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy("place", "stretch").orderBy("slot")) - 1
    s = s.withColumn("inside", inside).join(per.select("place", "stretch", F.coalesce("before", F.lit(0)).alias("before")), ["place", "stretch"])
    return s.select("place", "slot", (F.col("before") + F.col("inside")).alias("rank"))


def positions(sized: DataFrame, seed: int) -> DataFrame:
    """Adds begin: the words of the source's documents that come before in hashed order.

    ``sized``: place, size, tie (of identifier and text) and row.  The order is
    that of the contents; row numbers, which depend on the scan, only part rows
    equal in both.  Sums of equal ranges of hashes come first, so a source is
    never sorted as one.
    """
    h = sized.withColumn("mixed", F.xxhash64(F.lit(seed), "tie")).withColumn("bucket", F.pmod(F.shiftright("mixed", 20), F.lit(BUCKETS)))
    per = h.groupBy("place", "bucket").agg(F.sum("size").alias("n"))
    per = per.withColumn("before", F.sum("n").over(Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.sum("size").over(Window.partitionBy("place", "bucket").orderBy("mixed", "tie", "row").rowsBetween(Window.unboundedPreceding, -1))
    h = h.withColumn("inside", F.coalesce(inside, F.lit(0)))
    h = h.join(per.select("place", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["place", "bucket"])
    return h.withColumn("begin", F.col("before") + F.col("inside")).drop("mixed", "bucket", "inside", "before")


def mix(df: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, block_words: int = 32, seed: int = 7, carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns of every row (all but the text by default) with size, source_size, target and taken.

    taken counts the words that the schedule takes from the row's text, repeats
    included: every block that a slot names counts each of its words once.  A
    block is used at most ``repeats`` times, so no row exceeds that multiple of
    its size.  A null text has no words and is never taken; a null source is a
    source of its own; repeated rows are told apart by a number; an empty table
    gives none; input columns named like the outputs give way.

    Each source's words come near its target: within a few blocks, by the
    points' discrepancy.  Raise ``block_words`` with the corpus: slots are the
    words of the corpus over it.
    """
    spark = df.sparkSession
    names = [c for c in (df.columns if carry is None else carry) if c != text and c.lower() not in {"size", "source_size", "target", "taken"}]
    sized = df.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)], F.col(source).cast("string").alias("source"), F.xxhash64(id_col, text).alias("tie"), word_count(text_of(text)).alias("size"))
    sized = write_stage(sized.withColumn("row", F.monotonically_increasing_id()), "mix")
    goals = write_stage(targets(sized.groupBy("source").agg(F.sum("size").alias("size")), weights, repeats), "mix-targets")
    slots = goals.agg(F.ceil(F.coalesce(F.sum("target"), F.lit(0)) / block_words)).first()[0]
    rows = sized.join(goals.select(F.col("source").alias("s"), "place", F.col("size").alias("source_size"), "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = write_stage(positions(rows, seed), "mix-placed")
    blocks = goals.select("place", F.ceil(F.col("size") / block_words).alias("blocks"))
    taken = schedule(spark, goals, slots).join(blocks, "place").where(F.col("rank") < F.col("blocks") * repeats)
    uses = taken.groupBy("place", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count(F.lit(1)).alias("uses"))
    first, last = F.floor(F.col("begin") / block_words), F.floor((F.col("begin") + F.col("size") - 1) / block_words)
    parts = placed.where("size > 0").select("place", "row", "begin", "size", F.explode(F.sequence(first, last)).alias("block"))
    words = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest("begin", F.col("block") * block_words)
    per_row = parts.select("place", "block", "row", words.alias("words")).join(uses, ["place", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    out = placed.join(per_row, "row", "left")
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)], "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
