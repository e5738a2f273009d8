"""Hysteresis lights, idempotent keyed append and late-row rejection on streams."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidewater.operators.outcome import with_frozen
from tidewater.sources.staging import cut, write_stage


def step(prev: str | None, s: float | None, green_max: float, red_min: float, band: float) -> str:
    """Colour after one reading; the same table of cases as the batch expression."""
    if s is None or s != s:
        return "insufficient"
    up, down = ((green_max, red_min), (green_max, red_min)) if prev in (None, "insufficient") else ((green_max + band, red_min + band), (green_max - band, red_min - band))
    if prev == "red":
        return "red" if s >= down[1] else "green" if s < down[0] else "yellow"
    if prev == "green":
        return "red" if s >= up[1] else "yellow" if s >= up[0] else "green"
    return "red" if s >= up[1] else "green" if s < down[0] else "yellow"


STATES = ("insufficient", "green", "yellow", "red")


def _colors(slices: DataFrame, green_max: float, red_min: float, band: float) -> DataFrame:
    """Slices with the state in which they are entered -> one row per reading with its colour."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for key, state, rows in zip(d["series_id"], d["state"], d["rows"]):
                out = []
                for r in rows:
                    state = step(state, r["score"], green_max, red_min, band)
                    out.append((key, r["ts"], r["seq"], state))
                yield pd.DataFrame(out, columns=["series_id", "ts", "seq", "color"])

    return slices.mapInPandas(told, "series_id string, ts timestamp, seq bigint, color string")


def _maps(slices: DataFrame, green_max: float, red_min: float, band: float) -> DataFrame:
    """Each slice as a map of the four states: the colour it ends in for each colour it can be entered with."""

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            ends = []
            for rows in d["rows"]:
                now = list(STATES)
                for r in rows:
                    now = [step(x, r["score"], green_max, red_min, band) for x in now]
                ends.append(now)
            yield d[["series_id", "slice"]].assign(ends=ends)

    return slices.select("series_id", "slice", "rows").mapInPandas(mapped, "series_id string, slice long, ends array<string>")


def light_batch(path: str, state: str, green_max: float, red_min: float, band: float, slice_rows: int = 1024):
    """foreachBatch writer of colours below ``path``; the last colour of every series is kept below ``state``.

    Maps of states compose, so a series need not be folded reading by reading
    in one task: its readings lie in slices of bounded size on many tasks, each
    slice becomes one map, one small row a slice is folded per series, and the
    slices are then coloured where they lie.  A batch is written under its
    number and starts from the state of the batch before, so a replay gives
    the same files.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = cut(batch.select("series_id", F.col("ts").cast("timestamp").alias("ts"), "seq", F.col("score").cast("double").alias("score")))
        # Places within a series from counts of short stretches of time, so that no series is sorted as one.
        stretch = F.floor(F.unix_micros("ts") / 60_000_000)
        rows = rows.withColumn("_t", stretch)
        ends = Window.partitionBy("series_id").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
        counts = rows.groupBy("series_id", "_t").agg(F.count(F.lit(1)).alias("_c")).select("series_id", "_t", F.coalesce(F.sum("_c").over(ends), F.lit(0)).alias("_before"))
        inside = F.row_number().over(Window.partitionBy("series_id", "_t").orderBy("ts", "seq")) - 1
        placed = rows.withColumn("_in", inside).join(counts, ["series_id", "_t"]).withColumn("slice", F.floor((F.col("_before") + F.col("_in")) / slice_rows))
        slices = cut(placed.groupBy("series_id", "slice").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "score"))).alias("rows")))
        try:
            known = spark.read.schema("series_id string, color string, batch long").parquet(state).where(F.col("batch") < batch_id)
            known = known.groupBy("series_id").agg(F.max_by("color", "batch").alias("color"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # only a missing table is a first batch
                raise
            known = slices.limit(0).select("series_id", F.lit("").alias("color"))

        def walk(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            now, out = part["color"].iloc[0] or STATES[0], []
            for n, to in sorted(zip(part["slice"], part["ends"])):
                out.append((key[0], n, now, to[STATES.index(now)]))
                now = out[-1][3]
            return pd.DataFrame(out, columns=["series_id", "slice", "state", "leaves"])

        maps = _maps(slices, green_max, red_min, band).join(known, "series_id", "left")
        entered = cut(maps.groupBy("series_id").applyInPandas(walk, "series_id string, slice long, state string, leaves string"))
        _colors(slices.join(entered, ["series_id", "slice"]), green_max, red_min, band).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        last = entered.groupBy("series_id").agg(F.max_by("leaves", "slice").alias("color"))
        last.write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    return write


def run_lights(scores: DataFrame, spark: SparkSession, base: str, green_max: float, red_min: float, band: float, slice_rows: int = 1024) -> DataFrame:
    """series_id, ts, seq, score as a stream -> the colour of every reading, over all batches available. Batches come in order of time per series."""
    work = light_batch(f"{base}/out", f"{base}/state", green_max, red_min, band, slice_rows)
    scores.writeStream.foreachBatch(work).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("series_id string, ts timestamp, seq bigint, color string").parquet(f"{base}/out")


def upsert_batch(path: str, part: str, keys: Sequence[str], by: Sequence[str]):
    """foreachBatch writer: one row per key, the one largest in ``by`` (then in the other columns), inside the touched partitions only.

    The merged partitions are written aside first, because a job must not read
    the files it overwrites.  A replayed or late batch leaves the table right:
    the largest row wins whatever the order of batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [*by, *[c for c in batch.columns if c not in keys and c not in by]]
        new = cut(batch)
        try:
            old = spark.read.schema(batch.schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # only a missing table is a first batch
                raise
            old = new.limit(0)
        both = old.join(new.select(part).distinct(), part, "left_semi").select(*batch.columns).unionByName(new)
        best = both.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_best")).select(*keys, "_best.*")
        merged = write_stage(best.select(*batch.columns), "merge")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)

    return write


def ledger_schema(rows: DataFrame, factors: Mapping[str, DataFrame]) -> StructType:
    """Columns of a frozen ledger: those of the delivered rows without ``now``, the factors, then the week."""
    mine = [f for f in rows.schema if f.name not in ("week", "now")]
    return StructType([*mine, *[StructField(n, d.schema[d.columns[2]].dataType) for n, d in factors.items()], rows.schema["week"]])


def frozen_batch(path: str, refused: str, factors: Mapping[str, DataFrame], rewrite_days: int):
    """foreachBatch writer of a ledger whose weeks can be replaced until a deadline and are frozen after it.

    Rows have week, data_date, entity, now (the day they came); a batch holds
    whole weeks.  A week is written or replaced as a whole, with the factors of
    its own date, if the last row's ``now`` is at most ``rewrite_days`` after
    the earliest date it has in the ledger (or, not yet there, in the batch).
    Refused, under ``refused`` by batch and reason, and left as it was, is a
    week that is ``late``, has ``no_date``, has several dates or rows without
    one (``dates``), or whose count changes when factors are joined, because a
    factor has two rows of one key (``rows``).  A replayed batch gives the same
    tables.  Columns of other names are kept.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = cut(batch)
        weeks = new.groupBy("week").agg(
            F.count(F.lit(1)).alias("_n"), F.min("data_date").alias("_base"), F.countDistinct("data_date").alias("_dates"), F.count("data_date").alias("_dated"), F.max("now").alias("_now"))
        try:
            old = spark.read.schema(ledger_schema(batch, factors)).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # only a missing table is a first batch
                raise
            old = new.limit(0)
        had = old.join(new.select("week").distinct(), "week", "left_semi").groupBy("week").agg(F.count(F.lit(1)).alias("_had"), F.min("data_date").alias("_old"))
        weeks = weeks.join(had, "week", "left").withColumn("_base", F.when(F.col("_had") > 0, F.col("_old")).otherwise(F.col("_base")))
        full = cut(with_frozen(new, factors))
        # Both counts are one row a week.
        weeks = weeks.join(full.groupBy("week").agg(F.count(F.lit(1)).alias("_m")), "week", "left")
        why = (
            F.when(F.col("_base").isNull(), "no_date").when((F.col("_dates") != 1) | (F.col("_dated") != F.col("_n")), "dates")
            .when(F.col("_now").isNull() | (F.col("_now") > F.date_add("_base", rewrite_days)), "late").when(F.col("_m") != F.col("_n"), "rows"))
        weeks = cut(weeks.select("week", F.col("_n").alias("n_rows"), why.alias("reason")))
        weeks.where("reason is not null").write.mode("overwrite").parquet(f"{refused}/batch={batch_id}")
        good = full.join(weeks.where("reason is null").select("week"), "week", "left_semi")
        names = ledger_schema(batch, factors).names
        # a week is written by one task: a file of every week in every task costs more than its rows
        good.select(*names).repartition("week").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week").parquet(path)

    return write


def on_time_stream(rows: DataFrame, ts: str, now_col: str, days: int) -> DataFrame:
    """Hard deadline as a filter; the watermark only bounds downstream state."""
    d = rows.withWatermark(ts, f"{days} days")
    return d.where(F.col(now_col) <= F.col(ts) + F.expr(f"INTERVAL {days} DAYS"))


def run_to_table(stream: DataFrame, spark: SparkSession, path: str, checkpoint: str) -> DataFrame:
    """Drives a stream over everything available and returns the written table."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def file_stream(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of ``root`` as a file stream."""
    schema = spark.read.parquet(f"{root}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(root)
