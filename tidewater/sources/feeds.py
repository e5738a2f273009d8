"""Parsers of landed feeds: string rows (as read from JSON or CSV) to typed tables.

Each parser is one projection, so many files are one job.  Payloads of the
form {fields, data} are exploded once and addressed by header name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.exprs import with_scalar

TABLE_PAYLOAD = T.StructType([
    T.StructField("stat", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("data", T.ArrayType(T.ArrayType(T.StringType()))),
])
# fixed header names of the feeds
DAILY = {"Date": "date", "Code": "entity", "Name": "name", "TradeVolume": "trade_volume", "TradeValue": "trade_value", "OpeningPrice": "open", "HighestPrice": "high",
         "LowestPrice": "low", "ClosingPrice": "close", "Change": "change", "Transaction": "transaction"}
FOREIGN = ("外陸資買賣超股數(不含外資自營商)", "外資買賣超股數")
FOREIGN_DEALER, TRUST, DEALER, TOTAL = "外資自營商買賣超股數", "投信買賣超股數", "自營商買賣超股數", "三大法人買賣超股數"
CODE, NAME = "證券代號", "證券名稱"
MARGIN_NOW, MARGIN_BEFORE, SHORT_NOW, SHORT_BEFORE = "融資今日餘額", "融資前日餘額", "融券今日餘額", "融券前日餘額"
FALLBACK_PREFIX = "官方:"


def read_payloads(spark: SparkSession, path: str, schema: T.StructType = TABLE_PAYLOAD) -> DataFrame:
    """Landed JSON files with a declared schema and the file each row came from."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))


def clean_int(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), ",", "").try_cast("bigint")


def clean_float(c: Column) -> Column:
    """Number with separators removed; blanks and dashes are null."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast("double")


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def minguo(c: Column) -> Column:
    """``1150514`` or ``115/05/14`` to a date; null when malformed."""
    d = F.lpad(F.regexp_replace(F.trim(c), "/", ""), 7, "0")
    text = F.concat_ws("-", (F.substring(d, 1, 3).try_cast("int") + 1911).cast("string"), F.substring(d, 4, 2), F.substring(d, 6, 2))
    return text.try_cast("date")


def compact(c: Column) -> Column:
    d = F.trim(c)
    return F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)).try_cast("date")


def table_rows(payloads: DataFrame) -> DataFrame:
    """One row per data line of every valid payload, with a header -> value map."""
    ok = payloads.where((F.col("stat") == "OK") & (F.length("date") == 8))
    return ok.select(compact(F.col("date")).alias("date"), "fields", F.explode("data").alias("row")).where(
        F.size("row") >= F.size("fields") / 2).select("date", "fields", "row")


def field(*names: str) -> Column:
    """Value under the first header that exists."""
    pos = F.coalesce(*[F.nullif(F.array_position("fields", n), F.lit(0).cast("bigint")) for n in names])
    return F.trim(F.try_element_at("row", pos.cast("int")))


def parse_daily_list(rows: DataFrame) -> DataFrame:
    ints, floats = ("trade_volume", "trade_value", "transaction"), ("open", "high", "low", "close", "change")
    src = {v: k for k, v in DAILY.items()}
    out = rows.select(
        minguo(F.col(src["date"])).alias("date"), F.trim(F.col(src["entity"])).alias("entity"), F.trim(F.col(src["name"])).alias("name"),
        *[clean_int(F.col(src[x])).alias(x) for x in ints], *[clean_float(F.col(src[x])).alias(x) for x in floats])
    return out.where(F.col("date").isNotNull())


def parse_daily_tables(payloads: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Historical multi-column tables; a payload whose own date was not requested is rejected."""
    r = table_rows(payloads)
    if requested is not None:
        r = r.join(F.broadcast(requested.select("date")), "date", "left_semi")
    sign = F.when(field("漲跌(+/-)").contains("red"), 1.0).when(field("漲跌(+/-)").contains("green"), -1.0).otherwise(0.0)
    return r.select(
        "date", field(CODE).alias("entity"), clean_int(field("成交股數")).alias("trade_volume"), clean_float(field("收盤價")).alias("close"),
        (sign * F.coalesce(clean_float(field("漲跌價差")), F.lit(0.0))).alias("change")).where(F.col("close").isNotNull())


def parse_stock_month(payloads: DataFrame, thousand: bool = False) -> DataFrame:
    """Single-entity month files: the entity is the file's own column, OTC amounts are in thousands."""
    k = 1000 if thousand else 1
    ok = payloads.where(F.col("stat") == "OK").select("entity", "fields", F.explode("data").alias("row"))
    return ok.select("entity", minguo(field("日期")).alias("date"), (clean_int(field("成交股數")) * k).alias("trade_volume"), clean_float(field("收盤價")).alias("close")).where(F.col("date").isNotNull())


def parse_institutional(payloads: DataFrame) -> DataFrame:
    dealer = F.coalesce(clean_int(field(FOREIGN_DEALER)), F.lit(0))
    return table_rows(payloads).select(
        "date", field(CODE).alias("entity"), (clean_int(field(*FOREIGN)) + dealer).alias("foreign_net"), clean_int(field(TRUST)).alias("trust_net"),
        clean_int(field(DEALER)).alias("dealer_net"), clean_int(field(TOTAL)).alias("total_net"))


def parse_margin(rows: DataFrame) -> DataFrame:
    def n(x: str) -> Column:
        return F.coalesce(clean_int(F.col(x)), F.lit(0))

    return rows.where(F.trim("股票代號") != "").select(
        "date", F.trim("股票代號").alias("entity"), n(MARGIN_NOW).alias("margin_balance"), (n(MARGIN_NOW) - n(MARGIN_BEFORE)).alias("margin_chg"),
        n(SHORT_NOW).alias("short_balance"), (n(SHORT_NOW) - n(SHORT_BEFORE)).alias("short_chg"))


def parse_revenue(rows: DataFrame) -> DataFrame:
    ym = F.trim("資料年月")
    year = (F.substring(F.lpad(ym, 5, "0"), 1, 3).try_cast("int") + 1911).cast("string")
    return rows.select(
        F.trim("公司代號").alias("entity"), F.concat(year, F.substring(F.lpad(ym, 5, "0"), 4, 2)).alias("year_month"), clean_int(F.col("營業收入-當月營收")).alias("revenue"),
        clean_float(F.col("營業收入-去年同月增減(%)")).alias("yoy_pct"))


def merge_statements(margin: DataFrame, eps: DataFrame, balance: DataFrame) -> DataFrame:
    """Endpoint tables joined in full on (entity, year, quarter) with guarded ratios."""
    k = ["entity", "year", "quarter"]
    d = margin.join(eps, k, "full").join(balance, k, "full")

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.nullif(F.col(b), F.lit(0.0)))

    return d.withColumns({"debt_ratio_pct": ratio("liabilities", "assets") * 100, "current_ratio": ratio("current_assets", "current_liabilities"), "roe_q_pct": ratio("eps", "bvps") * 100})


def union_ratios(listed: DataFrame, otc: DataFrame) -> DataFrame:
    u = listed.withColumn("market", F.lit("上市")).unionByName(otc.withColumn("market", F.lit("上櫃")))
    return u.where(F.col("pe").isNotNull() | F.col("pbr").isNotNull())


def latest_snapshot(events: DataFrame, keys: Sequence[str], snapshot: str, since: Column) -> DataFrame:
    """Per key the row of the latest snapshot, events from ``since`` on."""
    cols = [x for x in events.columns if x not in keys]
    return events.where(F.col("ex_date") >= since).groupBy(*keys).agg(F.max_by(F.struct(*cols), snapshot).alias("_r")).select(*keys, "_r.*")


def parse_distribution(rows: DataFrame) -> DataFrame:
    """Padded CSV strings; a byte order mark may precede the first value."""
    t = lambda x: F.trim(F.regexp_replace(x, "﻿", ""))
    return rows.select(
        compact(t("data_date")).alias("data_date"), t("entity").alias("entity"), t("level").try_cast("int").alias("level"), clean_int(t("holders")).alias("holders"),
        clean_int(t("shares")).alias("shares"), clean_float(t("pct")).alias("pct")).where(F.col("entity") != "")


def long_to_wide(rows: DataFrame, field_map: Mapping[str, str]) -> DataFrame:
    """(date, entity, type, value) to one row per quarter; unmapped types ignored, the last value wins."""
    d = rows.where(F.col("type").isin(list(field_map)))
    aggs = [F.max_by("value", F.when(F.col("type") == t, F.col("seq"))).alias(c) for t, c in field_map.items()]
    return d.groupBy("entity", F.year("date").alias("year"), F.quarter("date").alias("quarter")).agg(*aggs)


def parse_history(rows: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Vendor history: non-positive values are null, the last row per key wins."""
    d = rows.select(*keys, "seq", *[positive(F.col(c)).alias(c) for c in cols])
    return d.groupBy(*keys).agg(F.max_by(F.struct(*cols), "seq").alias("_r")).select(*keys, "_r.*")


def parse_observations(rows: DataFrame) -> DataFrame:
    return rows.select("series_id", F.trim("date").try_cast("date").alias("date"), F.col("value").try_cast("double").alias("value")).where(F.col("date").isNotNull())


def merge_by_priority(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of file families in priority order, the first family wins per key; one shuffle, no sort."""
    tagged = [f.withColumn("_p", F.lit(i)) for i, f in enumerate(frames)]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    cols = [x for x in u.columns if x not in keys and x != "_p"]
    return u.groupBy(*keys).agg(F.min_by(F.struct(*cols), "_p").alias("_r")).select(*keys, "_r.*")


def last_dates(df: DataFrame, n: int) -> DataFrame:
    """Rows of the n newest distinct dates."""
    d = df.select("date").distinct().orderBy(F.desc("date")).limit(n)
    return df.join(F.broadcast(d), "date", "left_semi")


def with_market(df: DataFrame, otc: DataFrame) -> DataFrame:
    o = otc.select("entity").distinct().withColumn("_o", F.lit(1))
    return df.join(o, "entity", "left").withColumn("market", F.when(F.col("_o").isNotNull(), "otc").otherwise("listed")).drop("_o")


def overlay_history(official: DataFrame, deep: DataFrame) -> DataFrame:
    """Deep vendor history cut at the official last date; official rows win."""
    cut_at = with_scalar(deep, official.agg(F.max("date").alias("_m"))).where(F.col("date") <= F.col("_m")).drop("_m")
    return merge_by_priority([official, cut_at], ["entity", "date"])


def theme_rows(tags: DataFrame) -> DataFrame:
    """entity with an array of tags -> one row per (entity, theme)."""
    return tags.select("entity", F.explode("tags").alias("theme"))


def theme_strings(tags: DataFrame) -> DataFrame:
    return tags.select("entity", F.array_join(F.array_sort("tags"), "、").alias("themes"))


def peer_membership(fine: DataFrame, official: DataFrame) -> DataFrame:
    """Fine tags; untagged entities fall back to their prefixed official class."""
    rest = official.join(fine.select("entity").distinct(), "entity", "left_anti").select(F.concat(F.lit(FALLBACK_PREFIX), F.col("grp")).alias("grp"), "entity")
    return fine.select("grp", "entity").unionByName(rest).distinct()


def freeze(df: DataFrame, week: Column) -> DataFrame:
    """Point-in-time copy of a dimension: joins use (week, entity), never today's tags."""
    return df.withColumn("snapshot_week", week)


def screen_history(files: DataFrame) -> DataFrame:
    """Weekly screen rows with the week taken from the folder name; unique per (week, entity, strategy)."""
    return files.withColumn("week", F.regexp_extract("path", r"(\d{4}-W\d{2})", 1)).dropDuplicates(["week", "entity", "strategy"]).drop("path")


