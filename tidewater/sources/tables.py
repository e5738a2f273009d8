"""Market-shaped views over the given star-schema tables.

A supplier plays the listed entity, a ship date the trading day.  The first
step of every view is the aggregate to one row per (entity, date); it is
combined map-side, so an entity that owns a large part of the source rows
still leaves at most one row per calendar day for the windows that follow.
Prices, volumes and flows are whole numbers, so window sums are exact.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.exprs import own_rows
from tidewater.sources.staging import staged

SMOOTH_ROWS = 20
THEME_MIN_LINES = 20


class Tables:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def daily(self) -> DataFrame:
        """One row per (entity, date), written once: every other view starts here."""
        return staged(self.spark, self.root, "daily", self._daily)

    @cached_property
    def prices(self) -> DataFrame:
        """date, entity, close, volume: close is the 20-row mean of daily mean price."""
        return staged(self.spark, self.root, "prices", self._prices)

    def _daily(self) -> DataFrame:
        q = F.col("l_quantity").cast("bigint")
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        flag, status = F.col("l_returnflag"), F.col("l_linestatus")
        return (
            self.raw("lineitem")
            .groupBy(F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("date"))
            .agg(
                F.sum(cents).alias("cents"),
                F.count(F.lit(1)).alias("n_lines"),
                F.sum(q).alias("qty"),
                F.sum(F.when(flag == "R", -q).when(flag == "A", q).otherwise(0)).alias("foreign_net"),
                F.sum(F.when(status == "F", q).otherwise(-q)).alias("trust_net"),
                F.sum(F.when(F.col("l_discount") > 0.045, q).otherwise(-q)).alias("dealer_net"),
                F.count(F.when(flag != "N", 1)).alias("n_flow"),
            )
            .withColumn("raw", F.floor(F.col("cents") / (F.col("n_lines") * 100)))
        )

    def _prices(self) -> DataFrame:
        w = own_rows().rowsBetween(-(SMOOTH_ROWS - 1), 0)
        return self.daily.select(
            "date",
            "entity",
            F.floor(F.sum("raw").over(w) / F.count(F.lit(1)).over(w)).cast("double").alias("close"),
            F.col("qty").cast("double").alias("volume"),
        )

    @cached_property
    def flows(self) -> DataFrame:
        return self.daily.where("n_flow > 0").select(
            "date", "entity", "foreign_net", "trust_net", "dealer_net",
            (F.col("foreign_net") + F.col("trust_net") + F.col("dealer_net")).alias("total_net"),
        )

    @cached_property
    def dividends(self) -> DataFrame:
        """Events the day after a fully discounted line: often not a trading day."""
        price = F.floor("l_extendedprice").cast("double")
        cash = F.floor(F.col("l_extendedprice") * F.col("l_tax")).cast("double")
        return (
            self.raw("lineitem")
            .where(F.col("l_discount") > 0.095)
            .groupBy(
                F.col("l_suppkey").alias("entity"),
                F.date_add(F.to_date("l_shipdate"), 1).alias("ex_date"),
            )
            .agg(
                F.sum(cash).alias("cash"),
                F.max(price).alias("before_price"),
                F.max(F.when(F.col("l_tax") > 0.005, price - cash)).alias("after_price"),
            )
        )

    @cached_property
    def membership(self) -> DataFrame:
        """grp, entity: written once, so that its size is known and joins send it instead of shuffling the other side."""
        return staged(self.spark, self.root, "membership", self._membership)

    @cached_property
    def broad(self) -> DataFrame:
        return staged(self.spark, self.root, "broad", self._broad)

    def _membership(self) -> DataFrame:
        n = self.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("grp"))
        return self.raw("supplier").join(n, "s_nationkey").select("grp", F.col("s_suppkey").alias("entity"))

    def _broad(self) -> DataFrame:
        n = self.raw("nation").select(
            F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("r_regionkey")
        )
        return (
            self.raw("supplier").join(n, "s_nationkey").join(self.raw("region"), "r_regionkey")
            .select(F.col("r_name").alias("grp"), F.col("s_suppkey").alias("entity"))
        )

    @cached_property
    def themes(self) -> DataFrame:
        """Many-to-many tags: brands of which a supplier shipped enough lines."""
        p = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("grp"))
        return (
            self.raw("lineitem").select("l_partkey", F.col("l_suppkey").alias("entity"))
            .join(p, "l_partkey")
            .groupBy("grp", "entity").agg(F.count(F.lit(1)).alias("n_lines"))
            .where(F.col("n_lines") >= THEME_MIN_LINES)
            .select("grp", "entity")
        )

    @cached_property
    def ratios(self) -> DataFrame:
        """date, entity, pe, pbr, dividend_yield: null where the base is not positive."""
        w = own_rows().rowsBetween(-59, 0)
        base = self.daily.select(
            "date", "entity", "raw", "qty", "foreign_net",
            F.floor(F.sum("raw").over(w) / F.count(F.lit(1)).over(w)).alias("_m"),
            F.sum("qty").over(w).alias("_q"),
            F.count(F.lit(1)).over(w).alias("_c"),
            F.sum("foreign_net").over(w).alias("_f"),
        )
        return base.select(
            "date", "entity",
            F.when(F.col("_f") > -120, F.floor(F.col("raw") * 1500.0 / F.col("_m")) / 100.0).alias("pe"),
            (F.floor(F.col("_q") * 10.0 / F.col("_c")) / 100.0).alias("pbr"),
            F.when(F.col("foreign_net") >= 0, (F.col("qty") % 97) / 10.0).alias("dividend_yield"),
        )

    @cached_property
    def statements(self) -> DataFrame:
        """Year-to-date statements per entity and quarter, in whole currency units."""
        d = F.to_date("l_shipdate")
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        cost = F.round(F.col("l_extendedprice") * (F.lit(0.6) + F.col("l_discount") * 5) * 100).cast("bigint")
        quarters = (
            self.raw("lineitem")
            .groupBy(F.col("l_suppkey").alias("entity"), F.year(d).alias("year"), F.quarter(d).alias("quarter"))
            .agg(
                F.floor(F.sum(cents) / 100).alias("q_revenue"),
                F.floor(F.sum(cost) / 100).alias("q_cost"),
                F.sum(F.col("l_quantity").cast("bigint")).alias("q_units"),
            )
        )
        w = Window.partitionBy("entity", "year").orderBy("quarter").rowsBetween(Window.unboundedPreceding, 0)
        ytd = quarters.select(
            "entity", "year", "quarter",
            F.sum("q_revenue").over(w).alias("revenue"),
            F.sum(F.col("q_revenue") - F.col("q_cost")).over(w).alias("gross"),
            F.sum("q_units").over(w).alias("units"),
        )
        return ytd.select(
            "entity", "year", "quarter",
            F.col("revenue").cast("double").alias("revenue"),
            (F.col("gross") * 100.0 / F.col("revenue")).alias("gross_margin_pct"),
            ((F.col("gross") - F.col("units") * 100) * 100.0 / F.col("revenue")).alias("net_margin_pct"),
            (F.floor((F.col("gross") - F.col("units") * 100) / 1000) / 100.0).alias("eps"),
            (F.floor(F.col("revenue") / 500) / 10.0).alias("bvps"),
        )

    @cached_property
    def series(self) -> DataFrame:
        """series_id, date, value: daily order totals by priority."""
        return self.raw("orders").groupBy(
            F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date")
        ).agg(F.floor(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / 100).cast("double").alias("value"))

    @cached_property
    def margin(self) -> DataFrame:
        """date, entity, margin_balance: a bounded running balance."""
        w = own_rows().rowsBetween(Window.unboundedPreceding, 0)
        return self.daily.select(
            "date", "entity", (F.sum("qty").over(w) % 1000 + 50).cast("double").alias("margin_balance")
        )

    @cached_property
    def holders(self) -> DataFrame:
        """data_date (week end), entity, level 1-6 plus the total level 17, shares."""
        week = F.date_add(F.trunc(F.to_date("l_shipdate"), "week"), 4)
        level = (F.floor(F.round(F.col("l_discount") * 100) / 2) + 1).cast("int")
        return (
            self.raw("lineitem")
            .select(F.col("l_suppkey").alias("entity"), week.alias("data_date"),
                    F.explode(F.array(level, F.lit(17))).alias("level"), F.col("l_quantity").cast("bigint").alias("q"))
            .groupBy("data_date", "entity", "level").agg(F.sum("q").alias("shares"))
        )

    @cached_property
    def revenue(self) -> DataFrame:
        """entity, m (month index), year_month, revenue, yoy_pct: self join on the month a year before."""
        d = F.to_date("l_shipdate")
        m = F.year(d) * 12 + F.month(d) - 1
        rev = self.raw("lineitem").groupBy(F.col("l_suppkey").alias("entity"), m.alias("m")).agg(
            F.floor(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / 100).cast("double").alias("revenue"))
        old = rev.select("entity", (F.col("m") + 12).alias("m"), F.col("revenue").alias("_o"))
        ym = F.format_string("%04d%02d", F.floor(F.col("m") / 12), F.col("m") % 12 + 1)
        return rev.join(old, ["entity", "m"], "left").select(
            "entity", "m", ym.alias("year_month"), "revenue",
            ((F.col("revenue") / F.nullif(F.col("_o"), F.lit(0.0)) - 1) * 100).alias("yoy_pct"))
