"""SQL twins of the bindings in ``sources.tables``."""

from tidewater.plans.registry import view

view("daily", """
SELECT entity, date, sum(cents) AS cents, count(*) AS n_lines, CAST(sum(q) AS BIGINT) AS qty,
  CAST(sum(CASE WHEN l_returnflag='R' THEN -q WHEN l_returnflag='A' THEN q ELSE 0 END) AS BIGINT) AS foreign_net,
  CAST(sum(CASE WHEN l_linestatus='F' THEN q ELSE -q END) AS BIGINT) AS trust_net,
  CAST(sum(CASE WHEN l_discount > 0.045 THEN q ELSE -q END) AS BIGINT) AS dealer_net,
  count(*) FILTER (WHERE l_returnflag <> 'N') AS n_flow,
  CAST(sum(cents) // (100*count(*)) AS BIGINT) AS raw
FROM (SELECT *, l_suppkey AS entity, CAST(l_shipdate AS DATE) AS date,
        CAST(round(l_extendedprice*100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
GROUP BY entity, date
""")
view("prices", """
SELECT date, entity,
  CAST(CAST(sum(raw) OVER (PARTITION BY entity ORDER BY date ROWS 19 PRECEDING) AS BIGINT)
    // count(*) OVER (PARTITION BY entity ORDER BY date ROWS 19 PRECEDING) AS DOUBLE) AS close,
  CAST(qty AS DOUBLE) AS volume
FROM daily
""")
view("flows", """
SELECT date, entity, foreign_net, trust_net, dealer_net, foreign_net+trust_net+dealer_net AS total_net
FROM daily WHERE n_flow > 0
""")
view("dividends", """
SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) + 1 AS ex_date,
  sum(floor(l_extendedprice*l_tax)) AS cash, max(floor(l_extendedprice)) AS before_price,
  max(CASE WHEN l_tax > 0.005 THEN floor(l_extendedprice) - floor(l_extendedprice*l_tax) END) AS after_price
FROM lineitem WHERE l_discount > 0.095 GROUP BY 1, 2
""")
view("membership", "SELECT n_name AS grp, s_suppkey AS entity FROM supplier JOIN nation ON s_nationkey=n_nationkey")
view("broad", """
SELECT r_name AS grp, s_suppkey AS entity FROM supplier JOIN nation ON s_nationkey=n_nationkey
JOIN region ON n_regionkey=r_regionkey
""")
view("themes", """
SELECT p_brand AS grp, l_suppkey AS entity FROM lineitem JOIN part ON l_partkey=p_partkey
GROUP BY 1, 2 HAVING count(*) >= 20
""")
view("ratios", """
SELECT date, entity,
  CASE WHEN f > -120 THEN floor(raw*1500.0::DOUBLE/m)/100.0::DOUBLE END AS pe,
  floor(sq*10.0::DOUBLE/cnt)/100.0::DOUBLE AS pbr,
  CASE WHEN foreign_net >= 0 THEN (qty % 97)/10.0::DOUBLE END AS dividend_yield
FROM (SELECT date, entity, raw, qty, foreign_net, CAST(sum(raw) OVER w AS BIGINT)//count(*) OVER w AS m,
        CAST(sum(qty) OVER w AS BIGINT) AS sq, count(*) OVER w AS cnt, CAST(sum(foreign_net) OVER w AS BIGINT) AS f
      FROM daily WINDOW w AS (PARTITION BY entity ORDER BY date ROWS 59 PRECEDING))
""")
view("statements", """
SELECT entity, year, quarter, CAST(revenue AS DOUBLE) AS revenue,
  gross*100.0::DOUBLE/revenue AS gross_margin_pct, (gross-units*100)*100.0::DOUBLE/revenue AS net_margin_pct,
  floor((gross-units*100)/1000.0::DOUBLE)/100.0::DOUBLE AS eps, floor(revenue/500.0::DOUBLE)/10.0::DOUBLE AS bvps
FROM (SELECT entity, year, quarter, CAST(sum(rv) OVER w AS BIGINT) AS revenue,
        CAST(sum(rv-cs) OVER w AS BIGINT) AS gross, CAST(sum(un) OVER w AS BIGINT) AS units
      FROM (SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS INTEGER) AS year,
              CAST(quarter(l_shipdate) AS INTEGER) AS quarter,
              CAST(floor(sum(CAST(round(l_extendedprice*100) AS BIGINT))/100) AS BIGINT) AS rv,
              CAST(floor(sum(CAST(round(l_extendedprice*(0.6::DOUBLE+l_discount*5)*100) AS BIGINT))/100) AS BIGINT) AS cs,
              CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS un
            FROM lineitem GROUP BY 1,2,3)
      WINDOW w AS (PARTITION BY entity, year ORDER BY quarter))
""")
view("series", """
SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date,
  floor(sum(CAST(round(o_totalprice*100) AS BIGINT))/100) AS value
FROM orders GROUP BY 1, 2
""")
view("margin", """
SELECT date, entity, CAST(CAST(sum(qty) OVER (PARTITION BY entity ORDER BY date) AS BIGINT) % 1000 + 50 AS DOUBLE) AS margin_balance FROM daily
""")
view("holders", """
SELECT CAST(date_trunc('week', l_shipdate) AS DATE) + 4 AS data_date, l_suppkey AS entity, lv AS level,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS shares
FROM (SELECT *, unnest([CAST(floor(round(l_discount*100)/2)+1 AS INTEGER), 17]) AS lv FROM lineitem) GROUP BY 1,2,3
""")
view("rev_m", """
SELECT l_suppkey AS entity, CAST(year(l_shipdate)*12+month(l_shipdate)-1 AS INTEGER) AS m,
  floor(sum(CAST(round(l_extendedprice*100) AS BIGINT))/100) AS revenue FROM lineitem GROUP BY 1,2
""")
view("revenue", """
SELECT a.entity, a.m, printf('%04d%02d', a.m//12, a.m%12+1) AS year_month, a.revenue, (a.revenue/nullif(b.revenue,0)-1)*100 AS yoy_pct
FROM rev_m a LEFT JOIN rev_m b ON a.entity=b.entity AND b.m=a.m-12
""")
