"""Ingest queries: feed rows are derived from the tables in the feeds' own text form, then parsed."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions.exprs import iso, r6, week_tag
from tidewater.operators import history as H
from tidewater.operators import panel as P
from tidewater.plans.registry import query, view
from tidewater.sources.staging import staged
from tidewater.sources import feeds as S

view("feed_day", "SELECT date, entity, close, volume, round(close-floor(close/100),0) AS lo FROM prices")


def minguo_text(c):
    return F.concat((F.year(c) - 1911).cast("string"), F.date_format(c, "MMdd"))


def num(c):
    return F.format_number(c, 0)


def daily_list(t):
    c = F.col("close")
    return t.prices.select(
        minguo_text("date").alias("Date"), F.concat(F.lit(" "), F.col("entity").cast("string")).alias("Code"), F.lit("n ").alias("Name"), num("volume").alias("TradeVolume"), num(c * F.col("volume")).alias("TradeValue"),
        num(c).alias("OpeningPrice"), F.lit("--").alias("HighestPrice"), F.lit("").alias("LowestPrice"), num(c).alias("ClosingPrice"), F.lit("1.5").alias("Change"), F.lit("1,000").alias("Transaction"))


@query("src01_daily_feed", "SELECT strftime(date,'%Y-%m-%d') AS date, entity::VARCHAR AS entity, CAST(volume AS BIGINT) AS trade_volume, CAST(close*volume AS BIGINT) AS trade_value, close, NULL::DOUBLE AS high FROM prices")
def src01(t):
    return S.parse_daily_list(daily_list(t)).select(iso("date").alias("date"), "entity", "trade_volume", "trade_value", "close", "high")


def table_payload(rows, fields, cells):
    """{stat, date, fields, data}: payload pages of a day, so that no day is one array."""
    r = F.array(*[x.cast("string") for x in cells])
    g = rows.select("date", r.alias("r")).groupBy("date", F.pmod(F.xxhash64("r"), F.lit(1024)).alias("page")).agg(F.collect_list("r").alias("data"))
    return g.select(F.lit("OK").alias("stat"), F.date_format("date", "yyyyMMdd").alias("date"), F.array(*[F.lit(x) for x in fields]).alias("fields"), "data")


@query("src01_historical_tables", "SELECT strftime(date,'%Y-%m-%d') AS date, entity::VARCHAR AS entity, CAST(volume AS BIGINT) AS trade_volume, close, CASE entity%3 WHEN 0 THEN 2.5 WHEN 1 THEN -2.5 ELSE 0.0 END::DOUBLE AS change FROM prices")
def src01b(t):
    mark = F.when(F.col("entity") % 3 == 0, "<p style= color:red>+</p>").when(F.col("entity") % 3 == 1, "<p style= color:green>-</p>").otherwise("<p> </p>")
    p = table_payload(t.prices, ["證券代號", "成交股數", "收盤價", "漲跌(+/-)", "漲跌價差"], [F.col("entity"), num("volume"), num("close"), mark, F.lit("2.50")])
    d = S.parse_daily_tables(p, t.prices.select("date").distinct())
    return d.select(iso("date").alias("date"), "entity", "trade_volume", "close", (F.col("change") + 0.0).alias("change"))


@query("src02_entity_month_feed", "SELECT strftime(date,'%Y-%m-%d') AS date, entity, CAST(volume AS BIGINT)*1000 AS trade_volume, close FROM prices")
def src02(t):
    d = F.concat((F.year("date") - 1911).cast("string"), F.date_format("date", "/MM/dd"))
    g = t.prices.groupBy("entity", F.date_format("date", "yyyyMM").alias("month")).agg(F.collect_list(F.array(d, num("volume"), num("close"))).alias("data"))
    p = g.select(F.lit("OK").alias("stat"), "entity", F.array(*[F.lit(x) for x in ("日期", "成交股數", "收盤價")]).alias("fields"), "data")
    return S.parse_stock_month(p, True).select(iso("date").alias("date"), "entity", "trade_volume", "close")


@query("src03_institutional_feed", "SELECT strftime(date,'%Y-%m-%d') AS date, entity::VARCHAR AS entity, foreign_net+7 AS foreign_net, trust_net, dealer_net, total_net FROM flows")
def src03(t):
    p = table_payload(t.flows, [S.CODE, S.FOREIGN[0], S.FOREIGN_DEALER, S.TRUST, S.DEALER, S.TOTAL], [F.col("entity"), num("foreign_net"), F.lit("7"), num("trust_net"), num("dealer_net"), num("total_net")])
    return S.parse_institutional(p).select(iso("date").alias("date"), "entity", "foreign_net", "trust_net", "dealer_net", "total_net")


@query("src04_margin_feed", "SELECT strftime(date,'%Y-%m-%d') AS date, entity::VARCHAR AS entity, CAST(margin_balance AS BIGINT) AS margin_balance, CAST(margin_balance AS BIGINT)-100 AS margin_chg, 0 AS short_balance, -3 AS short_chg FROM margin")
def src04(t):
    r = t.margin.select("date", F.col("entity").cast("string").alias("股票代號"), num("margin_balance").alias(S.MARGIN_NOW), F.lit("100").alias(S.MARGIN_BEFORE), F.lit(" ").alias(S.SHORT_NOW), F.lit("3").alias(S.SHORT_BEFORE))
    return S.parse_margin(r).select(iso("date").alias("date"), "entity", "margin_balance", "margin_chg", "short_balance", "short_chg")


@query("src05_revenue_feed", "SELECT entity::VARCHAR AS entity, year_month, CAST(revenue AS BIGINT) AS revenue, round(yoy_pct,2)+0.0 AS yoy_pct FROM (SELECT entity, year_month, revenue, floor(yoy_pct*100)/100 AS yoy_pct FROM revenue)")
def src05(t):
    ym = F.concat((F.substring("year_month", 1, 4).cast("int") - 1911).cast("string"), F.substring("year_month", 5, 2))
    r = t.revenue.select(F.col("entity").cast("string").alias("公司代號"), ym.alias("資料年月"), num("revenue").alias("營業收入-當月營收"),
                         F.coalesce((F.floor(F.col("yoy_pct") * 100) / 100).cast("string"), F.lit("")).alias("營業收入-去年同月增減(%)"))
    return S.parse_revenue(r).select("entity", "year_month", "revenue", r6("yoy_pct", 2).alias("yoy_pct"))


@query("src06_statement_merge", """
SELECT entity, year, quarter, round(net_margin_pct,6)+0.0 AS net_margin_pct, round(eps,6)+0.0 AS eps, CASE WHEN quarter<4 THEN 60.0::DOUBLE+quarter END AS debt_ratio_pct, CASE WHEN quarter<4 THEN round(eps/bvps*100,6)+0.0 END AS roe_q_pct FROM statements""")
def src06(t):
    s = t.statements
    k = ["entity", "year", "quarter"]
    bal = s.where(F.col("quarter") < 4).select(*k, "bvps", F.lit(100.0).alias("assets"), (F.col("quarter") + 60.0).alias("liabilities"), F.lit(3.0).alias("current_assets"), F.lit(2.0).alias("current_liabilities"))
    d = S.merge_statements(s.select(*k, "net_margin_pct"), s.select(*k, "eps"), bal)
    return d.select(*k, *[r6(x).alias(x) for x in ("net_margin_pct", "eps", "debt_ratio_pct", "roe_q_pct")])


@query("src07_ratio_union", "SELECT strftime(date,'%Y-%m-%d') AS date, entity, CASE WHEN b.grp='ASIA' THEN '上櫃' ELSE '上市' END AS market, pe, pbr FROM ratios JOIN broad b USING (entity) WHERE pe IS NOT NULL OR pbr IS NOT NULL")
def src07(t):
    otc = t.broad.where(F.col("grp") == "ASIA").select("entity")
    return S.union_ratios(t.ratios.join(otc, "entity", "left_anti"), t.ratios.join(otc, "entity", "left_semi")).select(iso("date").alias("date"), "entity", "market", "pe", "pbr")


@query("src08_sector_index_feed", "SELECT strftime(date,'%Y-%m-%d') AS date, grp AS index_name, count(*) AS close_index FROM flows JOIN broad USING (entity) GROUP BY 1,2")
def src08(t):
    d = t.flows.join(t.broad, "entity").groupBy("date", "grp").agg(F.count(F.lit(1)).alias("n"))
    p = table_payload(d, ["指數", "收盤指數"], [F.col("grp"), num("n")])
    return S.table_rows(p).select(iso("date").alias("date"), S.field("指數").alias("index_name"), S.clean_int(S.field("收盤指數")).alias("close_index"))


@query("src09_dividend_snapshots", "SELECT entity, strftime(ex_date,'%Y-%m-%d') AS ex_date, cash+1 AS cash FROM dividends WHERE ex_date>=DATE '1996-01-01'")
def src09(t):
    d = t.dividends.select("entity", "ex_date", "cash")
    ev = d.withColumn("snap", F.lit("20260101")).unionByName(d.withColumn("cash", F.col("cash") + 1).withColumn("snap", F.lit("20260108")))
    return S.latest_snapshot(ev, ["entity", "ex_date"], "snap", F.to_date(F.lit("1996-01-01"))).select("entity", iso("ex_date").alias("ex_date"), "cash")


@query("src10_dimension_feed", "SELECT s_suppkey AS entity, n_name AS industry_name, CAST(s_suppkey*1000 AS BIGINT) AS shares FROM supplier JOIN nation ON s_nationkey=n_nationkey")
def src10(t):
    raw = t.raw("supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(" ")).alias("c"), num(F.col("s_suppkey") * 1000).alias("sh"))
    d = raw.select(F.trim("c").try_cast("bigint").alias("entity"), S.clean_int(F.col("sh")).alias("shares"))
    return d.join(t.membership.withColumnRenamed("grp", "industry_name"), "entity")


@query("src11_holder_csv", "SELECT strftime(data_date,'%Y-%m-%d') AS data_date, entity::VARCHAR AS entity, level, shares, NULL::DOUBLE AS pct FROM holders")
def src11(t):
    r = t.holders.select(F.concat(F.lit("﻿"), F.date_format("data_date", "yyyyMMdd")).alias("data_date"), F.rpad(F.col("entity").cast("string"), 8, " ").alias("entity"), F.lpad(F.col("level").cast("string"), 4, " ").alias("level"),
                         F.lit("1").alias("holders"), F.col("shares").cast("string").alias("shares"), F.lit("x").alias("pct"))
    return S.parse_distribution(r).select(iso("data_date").alias("data_date"), "entity", "level", "shares", "pct")


@query("src12_long_to_wide", """
SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderpriority='1-URGENT') AS urgent,
  arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderpriority='5-LOW') AS low FROM orders WHERE o_orderpriority IN ('1-URGENT','5-LOW') GROUP BY 1,2,3""")
def src12(t):
    r = t.raw("orders").select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("type"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"))
    return S.long_to_wide(r, {"1-URGENT": "urgent", "5-LOW": "low"})


@query("src13_vendor_history", "SELECT strftime(date,'%Y-%m-%d') AS date, entity, CASE WHEN pe>0 THEN pe END AS pe, CASE WHEN pbr>0 THEN pbr END AS pbr, CASE WHEN dividend_yield>0 THEN dividend_yield END AS dividend_yield FROM ratios")
def src13(t):
    r = t.ratios.withColumn("seq", F.lit(2))
    old = t.ratios.select("date", "entity", F.lit(1.0).alias("pe"), F.lit(1.0).alias("pbr"), F.lit(1.0).alias("dividend_yield"), F.lit(1).alias("seq"))
    d = S.parse_history(r.unionByName(old), ["date", "entity"], ["pe", "pbr", "dividend_yield"])
    return d.select(iso("date").alias("date"), "entity", "pe", "pbr", "dividend_yield")


@query("src14_observations", "SELECT series_id, strftime(date,'%Y-%m-%d') AS date, CASE WHEN day(date)=13 THEN NULL ELSE value END AS value FROM series")
def src14(t):
    r = t.series.select("series_id", F.date_format("date", "yyyy-MM-dd").alias("date"), F.when(F.dayofmonth("date") == 13, ".").otherwise(F.col("value").cast("string")).alias("value"))
    return S.parse_observations(r).select("series_id", iso("date").alias("date"), "value")


@query("src15_priority_merge", "SELECT strftime(date,'%Y-%m-%d') AS date, entity, close, CASE WHEN f.entity IS NULL THEN 'b' ELSE 'a' END AS src FROM prices p LEFT JOIN flows f USING (date, entity) WHERE date IN (SELECT DISTINCT date FROM prices ORDER BY date DESC LIMIT 250)")
def src15(t):
    a = t.prices.join(t.flows.select("date", "entity"), ["date", "entity"]).select("date", "entity", "close", F.lit("a").alias("src"))
    b = t.prices.select("date", "entity", "close", F.lit("b").alias("src"))
    return S.last_dates(S.merge_by_priority([a, b], ["date", "entity"]), 250).select(iso("date").alias("date"), "entity", "close", "src")


@query("src16_keyed_history", "SELECT entity, year, quarter, revenue FROM statements")
def src16(t):
    s = t.statements.select("entity", "year", "quarter", "revenue")
    old = s.where(F.col("quarter") == 1).select("entity", "year", "quarter")
    return S.merge_by_priority([s, old], ["entity", "year", "quarter"])


@query("src17_market_tag", "SELECT strftime(f.date,'%Y-%m-%d') AS date, f.entity, total_net, CASE WHEN d.entity IS NULL THEN 'listed' ELSE 'otc' END AS market FROM flows f LEFT JOIN (SELECT DISTINCT entity FROM broad WHERE grp='ASIA') d ON d.entity=f.entity")
def src17(t):
    return S.with_market(t.flows, t.broad.where(F.col("grp") == "ASIA")).select(iso("date").alias("date"), "entity", "total_net", "market")


@query("src18_history_overlay", """
SELECT strftime(coalesce(a.date,b.date),'%Y-%m-%d') AS date, coalesce(a.entity,b.entity) AS entity, CASE WHEN a.entity IS NOT NULL THEN 'official' ELSE 'deep' END AS src FROM (SELECT date, entity FROM flows) a
FULL JOIN (SELECT date, entity FROM prices WHERE date<=(SELECT max(date) FROM flows)) b ON a.date=b.date AND a.entity=b.entity""")
def src18(t):
    off = t.flows.select("date", "entity", F.lit("official").alias("src"))
    return S.overlay_history(off, t.prices.select("date", "entity", F.lit("deep").alias("src"))).select(iso("date").alias("date"), "entity", "src")


@query("src19_screen_history", "SELECT DISTINCT isoyear(o_orderdate)||'-W'||lpad(weekofyear(o_orderdate)::VARCHAR,2,'0') AS week, o_custkey AS entity, o_orderpriority AS strategy FROM orders")
def src19(t):
    d = t.raw("orders").select(F.concat(F.lit("/reports/"), week_tag(F.to_date("o_orderdate")), F.lit("/screen.csv")).alias("path"), F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("strategy"))
    return S.screen_history(d).select("week", "entity", "strategy")


def tags_of(t):
    return t.themes.groupBy("entity").agg(F.collect_list("grp").alias("tags"))


@query("src20_theme_rows", "SELECT entity, grp AS theme FROM themes")
def src20(t):
    return S.theme_rows(tags_of(t))


@query("src20_theme_strings", "SELECT entity, string_agg(grp,'、' ORDER BY grp) AS themes FROM themes GROUP BY 1")
def src20b(t):
    return S.theme_strings(tags_of(t))


@query("src21_peer_membership", "SELECT grp, entity FROM themes UNION ALL SELECT '官方:'||grp, entity FROM broad WHERE entity NOT IN (SELECT entity FROM themes)")
def src21(t):
    return S.peer_membership(t.themes, t.broad)


# A quarter's tags: brands that make a twelfth of an entity's lines in it. They come, go and return.
view("quarter_tags", """SELECT q, entity, grp FROM (SELECT year(l_shipdate)*4+quarter(l_shipdate)-1 AS q, l_suppkey AS entity, p_brand AS grp, count(*) AS c, sum(count(*)) OVER (PARTITION BY year(l_shipdate)*4+quarter(l_shipdate)-1, l_suppkey) AS n
  FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2,3) WHERE c*12>=n""")


def quarter_tags(t):
    def build():
        day = F.to_date("l_shipdate")
        p = t.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("grp"))
        c = t.raw("lineitem").select("l_partkey", F.col("l_suppkey").alias("entity"), (F.year(day) * 4 + F.quarter(day) - 1).alias("q")).join(p, "l_partkey").groupBy("q", "entity", "grp").agg(F.count(F.lit(1)).alias("c"))
        return c.withColumn("n", F.sum("c").over(Window.partitionBy("q", "entity"))).where("c * 12 >= n").select("q", "entity", "grp")

    return staged(t.spark, t.root, "quarter_tags", build)


@query("src22_membership_intervals", """SELECT entity, grp, CAST(min(q) AS INTEGER) AS valid_from, CAST(CASE WHEN max(q)<(SELECT max(q) FROM quarter_tags) THEN max(q)+1 END AS INTEGER) AS valid_to
FROM (SELECT *, q-row_number() OVER (PARTITION BY entity, grp ORDER BY q) AS g FROM quarter_tags) GROUP BY entity, grp, g""")
def src22_intervals(t):
    """Tags as validity intervals: opened, closed and reopened by the quarterly snapshots."""
    return H.validity_intervals(quarter_tags(t), ["entity", "grp"], "q")


@query("src22_state_freeze", "SELECT isoyear(w.date)||'-W'||lpad(weekofyear(w.date)::VARCHAR,2,'0') AS snapshot_week, m.grp, p.entity, p.close FROM prices p JOIN weekly w USING (date) JOIN quarter_tags m ON m.entity=p.entity AND m.q=year(w.date)*4+quarter(w.date)-2")
def src22(t):
    """Tags as frozen for each week, those of the last whole quarter before it, kept with the rows they apply to."""
    wk = F.broadcast(P.weekly_dates(t.prices).select("date"))
    rows = t.prices.join(wk, "date", "left_semi").withColumn("q", F.year("date") * 4 + F.quarter("date") - 2)
    held = H.as_of(rows, H.validity_intervals(quarter_tags(t), ["entity", "grp"], "q"), "entity", "q")
    return S.freeze(held, week_tag("date")).select("snapshot_week", "grp", "entity", "close")
