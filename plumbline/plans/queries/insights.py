"""Insights and chart-shaped frames over the star tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from plumbline.functions import format as X
from plumbline.functions import text as TX
from plumbline.operators import insights as I
from plumbline.operators import semantic as S
from plumbline.operators import shaping as SH
from plumbline.plans import stage
from plumbline.plans.queries import query
from plumbline.plans.queries.common import WITH_ITEMS, rounded
from plumbline.plans.queries.metrics import G, MARGIN, ORDERS, REVENUE

C = stage.CATALOG


def z_sql(source: str, value: str, name: str = "scored", by: str = "1") -> str:
    """Robust z over ``source`` as CTEs ending in ``name``."""
    return f"""
{name}_m AS (SELECT *, quantile_cont({value}, 0.5) OVER (PARTITION BY {by}) AS med,
             count({value}) OVER (PARTITION BY {by}) AS npts FROM {source}),
{name}_d AS (SELECT *, abs({value} - med) AS dev FROM {name}_m),
{name}_s AS (SELECT *, quantile_cont(dev, 0.5) OVER (PARTITION BY {by}) AS mad,
             avg(dev) OVER (PARTITION BY {by}) AS mean_dev FROM {name}_d),
{name} AS (SELECT *, ({value} - med) / CASE WHEN npts < 4 THEN NULL WHEN mad > 0 THEN mad / 0.6745
           WHEN mean_dev > 0 THEN mean_dev / 1.253314 END AS z FROM {name}_s)"""


@query("ins_01_robust_z", "WITH l AS (SELECT l_orderkey, l_extendedprice AS price, l_returnflag "
       "FROM lineitem)," + z_sql("l", "price") + """
SELECT l_returnflag, round(sum(z), 2) AS z_sum, round(max(z), 4) AS z_max,
       round(min(z), 4) AS z_min, count(*) AS n FROM scored GROUP BY 1""")
def ins_01(spark, sf):
    li = stage.table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_extendedprice").alias("price"), "l_returnflag")
    z = I.robust_z(li, "price")
    return rounded(z.groupBy("l_returnflag").agg(
        F.sum("z").alias("z_sum"), F.max("z").alias("z_max"), F.min("z").alias("z_min"),
        F.count(F.lit(1)).alias("n")), 4, z_sum=2)


@query("ins_01_robust_z_grouped", "WITH e AS (SELECT event_id, event_type, value FROM events),"
       + z_sql("e", "value", by="event_type")
       + " SELECT event_id, event_type, round(z, 4) AS z FROM scored")
def ins_01g(spark, sf):
    e = stage.table(spark, sf, "events").select("event_id", "event_type", "value")
    return rounded(I.robust_z(e, "value", ["event_type"]).drop("z_median", "value"))


@query("ins_02_flag_anomalies", "WITH e AS (SELECT event_id, value FROM events),"
       + z_sql("e", "value")
       + " SELECT event_id, round(value, 4) AS value, round(z, 4) AS z,"
         " coalesce(abs(z) >= 3.5, FALSE) AS is_anomaly FROM scored")
def ins_02(spark, sf):
    e = stage.table(spark, sf, "events").select("event_id", "value")
    return rounded(I.flag_anomalies(e, "value"))


DAY_SQL = "WITH e AS (SELECT CAST(event_id AS VARCHAR) AS label, value FROM events)," + z_sql("e", "value")


@query("ins_03_find_anomalies", DAY_SQL + """
SELECT label, round(value, 4) AS value, round(z, 4) AS z, round(med, 4) AS median,
       CASE WHEN z > 0 THEN 'above' ELSE 'below' END AS direction,
       round(100.0 * (value - med) / nullif(abs(med), 0), 4) AS pct_from_median
FROM scored WHERE abs(z) >= 3.5""")
def ins_03(spark, sf):
    return rounded(I.find_anomalies(stage.table(spark, sf, "events"), "value", "event_id"))


@query("ins_04_detect_anomalies", DAY_SQL + """
SELECT label, round(value, 4) AS value, CAST(round_even(CAST(z AS DECIMAL(18, 8)), 2) AS DOUBLE) AS z_score,
       round(med, 2) AS median, CASE WHEN z > 0 THEN 'above' ELSE 'below' END AS direction,
       CAST(round_even(CAST(coalesce(100.0 * (value - med) / nullif(abs(med), 0), 0) AS DECIMAL(18, 8)), 1) AS DOUBLE)
         AS pct_from_median FROM scored WHERE abs(z) >= 2.5""")
def ins_04(spark, sf):
    return rounded(I.detect_anomalies(stage.table(spark, sf, "events"), "value", "event_id"))


@query("ins_05_prior_window", """
SELECT min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, count(*) AS n FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-12-03' AND o_orderdate < TIMESTAMP '1997-01-01'""")
def ins_05(spark, sf):
    lo, hi = I.prior_window("1997-01-29", "1997-01-01")
    f = S.Filters(lo, hi)
    return f.apply(stage.table(spark, sf, "orders").withColumnRenamed("o_orderdate", "order_date"),
                   C).agg(F.min("order_date").alias("first_at"), F.max("order_date").alias("last_at"),
                          F.count(F.lit(1)).alias("n"))


WIN = S.Filters("1998-01-01", "1998-06-30")
NOW = "order_date >= TIMESTAMP '1998-01-01' AND order_date < TIMESTAMP '1998-07-01'"
WAS = "order_date >= TIMESTAMP '1997-07-04' AND order_date < TIMESTAMP '1998-01-01'"


def _pop(metric: str, expr: str, up: bool) -> str:
    expr = f"CAST({expr} AS DOUBLE)"
    return f"""
SELECT '{metric}' AS metric, round(a.v, 4) AS current, round(b.v, 4) AS previous,
       round(a.v - b.v, 4) AS delta, round(100.0 * (a.v - b.v) / nullif(abs(b.v), 0), 4) AS delta_pct,
       a.v - b.v {'>=' if up else '<='} 0 AS improved
FROM (SELECT {expr} AS v FROM items WHERE {NOW}) a, (SELECT {expr} AS v FROM items WHERE {WAS}) b"""


@query("ins_06_period_over_period", WITH_ITEMS + " UNION ALL ".join([
    _pop("revenue", f"sum(sales) {G}", True), _pop("orders", ORDERS, True),
    _pop("discount", f"sum(discount) {G}", False),
    _pop("margin_pct", f"100.0 * (sum(profit) {G}) / nullif(sum(sales) {G}, 0)", True)]))
def ins_06(spark, sf):
    return rounded(I.period_over_period(stage.items(spark, sf, "product"), C,
                                        ["revenue", "orders", "discount", "margin_pct"], WIN))


@query("ins_07_benchmark_vs_parent", WITH_ITEMS + f""",
c AS (SELECT department_name AS department, category_name AS category,
      100.0 * (sum(profit) {G}) / nullif(sum(sales) {G}, 0) AS m, count(*) AS n_lines
      FROM items GROUP BY 1, 2 HAVING count(*) >= 50),
p AS (SELECT department_name AS department,
      100.0 * (sum(profit) {G}) / nullif(sum(sales) {G}, 0) AS pm FROM items GROUP BY 1)
SELECT department, category, round(m, 4) AS margin_pct, n_lines, round(pm, 4) AS parent_value,
       round(m - pm, 4) AS gap, coalesce(m - pm >= 0, FALSE) AS beats_parent
FROM c JOIN p USING (department)""")
def ins_07(spark, sf):
    return rounded(I.benchmark_vs_parent(stage.items(spark, sf, "product"), C, "margin_pct",
                                         min_lines=50))


@query("ins_08_loss_makers", WITH_ITEMS + f""",
g AS (SELECT product_name AS product, sum(profit) {G} AS profit, sum(sales) {G} AS revenue,
      CAST(sum(quantity) {G} AS BIGINT) AS units, count(*) AS n_lines FROM items GROUP BY 1)
SELECT product, round(profit, 4) AS profit, round(revenue, 4) AS revenue,
       round(100.0 * profit / nullif(revenue, 0), 4) AS margin_pct, units, n_lines
FROM g WHERE profit < 0""")
def ins_08(spark, sf):
    return rounded(I.loss_makers(stage.items(spark, sf, "product"), C))


@query("ins_09_movers", WITH_ITEMS + f""",
a AS (SELECT product_name AS product, sum(sales) {G} AS v FROM items WHERE {NOW} GROUP BY 1),
b AS (SELECT product_name AS product, sum(sales) {G} AS v FROM items WHERE {WAS} GROUP BY 1),
m AS (SELECT coalesce(a.product, b.product) AS product, coalesce(a.v, 0) AS x, coalesce(b.v, 0) AS y
      FROM a FULL OUTER JOIN b ON a.product = b.product)
SELECT product, round(x, 4) AS revenue, round(y, 4) AS revenue_prior, round(x - y, 4) AS delta,
       round(100.0 * (x - y) / nullif(abs(y), 0), 4) AS delta_pct
FROM m""")
def ins_09(spark, sf):
    return rounded(I.movers(stage.items(spark, sf, "product"), C, "revenue", "product", WIN))


@query("ins_10_composition_shift", WITH_ITEMS + f""",
s AS (SELECT date_trunc('month', order_date) AS p, sum(sales) {G} AS v FROM items GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM s),
k AS (SELECT x.i - 1 AS i, x.n, x.p AS t,
      (SELECT quantile_cont(v, 0.5) FROM r WHERE r.i < x.i) AS lo,
      (SELECT quantile_cont(v, 0.5) FROM r WHERE r.i >= x.i) AS hi
      FROM r x WHERE x.i > 3 AND x.i <= x.n - 2)
SELECT CAST(t AS TIMESTAMP) AS "at", round(lo, 4) AS "before", round(hi, 4) AS "after",
       i AS n_before, n - i AS n_after, round(hi / lo, 4) AS ratio
FROM k ORDER BY abs(hi / lo - 1.0) DESC, i LIMIT 1""")
def ins_10(spark, sf):
    return rounded(I.composition_shift(stage.items(spark, sf, "lines"), C, "revenue",
                                       threshold=0.0))


@query("ins_10_shift_by_day", WITH_ITEMS + f""",
s AS (SELECT market, date_trunc('day', order_date) AS p, sum(sales) {G} AS v FROM items GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY p) AS i,
      count(*) OVER (PARTITION BY market) AS n FROM s),
k AS (SELECT x.market, x.i - 1 AS i, x.n, x.p AS t,
      quantile_cont(y.v, 0.5) FILTER (y.i < x.i) AS lo, quantile_cont(y.v, 0.5) FILTER (y.i >= x.i) AS hi
      FROM r x JOIN r y USING (market) WHERE x.i > 3 AND x.i <= x.n - 2 GROUP BY 1, 2, 3, 4)
SELECT market, CAST(t AS TIMESTAMP) AS "at", round(lo, 4) AS "before", round(hi, 4) AS "after",
       i AS n_before, n - i AS n_after, round(hi / lo, 4) AS ratio
FROM k WHERE lo <> 0 AND hi IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY market ORDER BY abs(hi / lo - 1.0) DESC, i) = 1""")
def ins_10_by_day(spark, sf):
    daily = replace(C, dimensions={**C.dimensions, "day": S.Dimension("day", "Day", "order_date", "day")})
    return rounded(I.composition_shift(stage.items(spark, sf, "lines", "geo"), daily, "revenue", "day",
                                       threshold=0.0, by=["market"]))


@query("ins_11_confounding", WITH_ITEMS + """,
c AS (SELECT date_trunc('quarter', order_date) AS q, market, count(*) AS n FROM items GROUP BY 1, 2),
p AS (SELECT q, 100.0 * max(n) / sum(n) AS share, count(*) AS vals FROM c GROUP BY 1)
SELECT 'market' AS dimension, 'quarter' AS grain, (SELECT count(DISTINCT market) FROM c) AS n_values,
       count(*) AS periods, count(*) FILTER (WHERE vals > 1) AS multi_value_periods,
       round(quantile_cont(share, 0.5), 4) AS median_top_share,
       quantile_cont(share, 0.5) >= 90 AS is_time_partitioned FROM p""")
def ins_11(spark, sf):
    return rounded(I.confounding(stage.items(spark, sf, "geo"), C, "market", "quarter"))


@query("ins_12_gate_impact", WITH_ITEMS + f"""
SELECT {REVENUE} AS gated, round(sum(sales), 4) AS ungated,
       round(sum(sales) - (sum(sales) {G}), 4) AS excluded,
       round(100.0 * (sum(sales) - (sum(sales) {G})) / nullif(sum(sales), 0), 4) AS excluded_pct
FROM items""")
def ins_12(spark, sf):
    return rounded(I.gate_impact(stage.items(spark, sf, "lines"), C))


COUNTRY_SQL = WITH_ITEMS + f""",
g AS (SELECT country, sum(sales) {G} AS revenue, count(*) AS n_lines FROM items GROUP BY 1)"""


def by_country(spark, sf):
    return S.aggregate(stage.items(spark, sf, "geo"), C, ["revenue"], ["country"])


@query("ins_13_ranking_share", COUNTRY_SQL + """
SELECT row_number() OVER (ORDER BY revenue DESC, country) AS rank, country AS label,
       round(revenue, 4) AS value, round(sum(revenue) OVER (), 4) AS leaders_total,
       round((SELECT sum(revenue) FROM g), 4) AS total,
       round(100.0 * sum(revenue) OVER () / (SELECT sum(revenue) FROM g), 4) AS leaders_share_pct
FROM (SELECT * FROM g ORDER BY revenue DESC, country LIMIT 3)""")
def ins_13(spark, sf):
    return rounded(I.ranking_share(by_country(spark, sf), "revenue", "country"))


YEARS_SQL = WITH_ITEMS + f""",
g AS (SELECT CAST(date_trunc('year', order_date) AS TIMESTAMP) AS year, market,
      sum(sales) {G} AS revenue, count(*) AS n_lines FROM items GROUP BY 1, 2)"""


def by_year_market(spark, sf):
    return S.aggregate(stage.items(spark, sf, "geo"), C, ["revenue"], ["year", "market"])


@query("ins_14_trend_endpoints", YEARS_SQL + """
SELECT market AS label, round(sum(revenue), 4) AS total, min(year) AS first_at,
       round(arg_min(revenue, year), 4) AS first_value, max(year) AS last_at,
       round(arg_max(revenue, year), 4) AS last_value, arg_max(year, revenue) AS peak_at,
       round(max(revenue), 4) AS peak_value
FROM g GROUP BY 1 ORDER BY sum(revenue) DESC LIMIT 1""")
def ins_14(spark, sf):
    return rounded(I.trend_endpoints(by_year_market(spark, sf), "year", "market", "revenue"))


@query("ins_15_spread_summary", WITH_ITEMS + """,
g AS (SELECT shipping_delay_days AS d, count(*) FILTER (WHERE is_shipment_valid) AS n
      FROM items GROUP BY 1)
SELECT arg_max(d, n) AS modal_value, max(n) AS modal_count, CAST(sum(n) AS BIGINT) AS total,
       round(100.0 * sum(n) FILTER (WHERE d <= 0) / sum(n), 4) AS share_at_or_below FROM g""")
def ins_15(spark, sf):
    g = S.aggregate(stage.items(spark, sf, "lines"), C, ["shipped_lines"], ["delay_days"])
    return rounded(I.spread_summary(g, "delay_days", "shipped_lines"))


GRID_SQL = WITH_ITEMS + f""",
g AS (SELECT department_name AS department, segment, {MARGIN} AS m FROM items GROUP BY 1, 2)"""


@query("ins_16_grid_extremes", GRID_SQL + """
SELECT b.department AS best_row, b.segment AS best_col, b.m AS best_value,
       w.department AS worst_row, w.segment AS worst_col, w.m AS worst_value,
       (SELECT count(DISTINCT department) * count(DISTINCT segment) - count(*) FROM g) AS empty_cells
FROM (SELECT * FROM g ORDER BY m DESC, department DESC, segment DESC LIMIT 1) b,
     (SELECT * FROM g ORDER BY m, department, segment LIMIT 1) w""")
def ins_16(spark, sf):
    g = S.aggregate(stage.items(spark, sf, "product", "customer"), C, ["margin_pct"],
                    ["department", "segment"])
    return rounded(I.grid_extremes(g, "department", "segment", "margin_pct"))


SEG_SQL = COUNTRY_SQL + """,
s AS (SELECT sum(revenue) AS total, arg_max(country, revenue) AS top_label, max(revenue) AS tv,
      arg_min(country, revenue) AS bottom_label, min(revenue) AS bv, count(*) AS n_segments,
      quantile_cont(revenue, 0.5) AS med,
      (SELECT sum(revenue) FROM (SELECT revenue FROM g ORDER BY revenue DESC LIMIT 3)) AS t3 FROM g),
summary AS (
SELECT round(total, 4) AS total, top_label, round(tv, 4) AS top_value,
       round(tv / total * 100, 1) AS top_share_pct, bottom_label, round(bv, 4) AS bottom_value,
       round(bv / total * 100, 1) AS bottom_share_pct, round(med, 4) AS median_value,
       round(tv / med, 1) AS top_vs_median_ratio, round(t3 / total * 100, 1) AS top_3_share_pct,
       n_segments FROM s)"""


@query("ins_17_segment_summary", SEG_SQL + " SELECT * FROM summary")
def ins_17(spark, sf):
    return rounded(I.segment_summary(by_country(spark, sf), "revenue", "country"))


@query("ins_18_concentration_flags", SEG_SQL + """
SELECT *, n_segments >= 3 AND top_3_share_pct >= 50 AS is_concentrated,
       top_vs_median_ratio >= 1.5 AS is_spread FROM summary""")
def ins_18(spark, sf):
    return rounded(I.concentration_flags(I.segment_summary(by_country(spark, sf), "revenue",
                                                           "country")))


@query("ins_19_next_drill", COUNTRY_SQL + """
SELECT 'drill' AS action, 'country' AS where_dim, arg_max(country, revenue) AS where_value,
       'month' AS "by", CAST(NULL AS INT) AS "limit" FROM g
UNION ALL SELECT 'top', NULL, NULL, 'country', 5 FROM g HAVING count(*) > 5""")
def ins_19(spark, sf):
    return I.next_drill(by_country(spark, sf), C, "revenue", ["country"])


# --- chart shapes -----------------------------------------------------------

@query("shp_01_top_groups_series", YEARS_SQL + """,
t AS (SELECT market FROM g GROUP BY 1 ORDER BY sum(revenue) DESC, market LIMIT 3)
SELECT year, market, round(revenue, 4) AS revenue,
       (SELECT count(DISTINCT market) - 3 FROM g) AS n_omitted FROM g SEMI JOIN t USING (market)""")
def shp_01(spark, sf):
    return rounded(SH.top_groups_series(by_year_market(spark, sf), "year", "market", "revenue", 3))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("shp_02_pivot_grid", GRID_SQL + " SELECT department, " + ", ".join(
    f"max(m) FILTER (WHERE segment = '{s}') AS \"{s}\"" for s in SEGMENTS) + " FROM g GROUP BY 1")
def shp_02(spark, sf):
    g = S.aggregate(stage.items(spark, sf, "product", "customer"), C, ["margin_pct"],
                    ["department", "segment"])
    return rounded(SH.pivot_grid(g, "department", "segment", "margin_pct", SEGMENTS))


@query("shp_03_ranked_bars", WITH_ITEMS + """,
g AS (SELECT country, avg(shipping_delay_days) FILTER (WHERE is_shipment_valid) AS v,
      count(*) AS n_lines FROM items GROUP BY 1)
SELECT country, round(v, 4) AS avg_delay_days, n_lines,
       greatest((SELECT count(*) FROM g) - 10, 0) AS n_truncated
FROM g ORDER BY v, country LIMIT 10""")
def shp_03(spark, sf):
    return rounded(SH.ranked_bars(stage.items(spark, sf, "geo"), C, "country", "avg_delay_days", 10))


@query("shp_04_median_quadrants", WITH_ITEMS + f""",
g AS (SELECT country, sum(sales) {G} AS revenue, {ORDERS} AS orders, count(*) AS n_lines
      FROM items GROUP BY 1),
m AS (SELECT quantile_cont(revenue, 0.5) AS mx, quantile_cont(orders, 0.5) AS my FROM g)
SELECT country, round(revenue, 4) AS revenue, orders, n_lines, round(mx, 4) AS x_median,
       round(my, 4) AS y_median, CASE WHEN orders >= my THEN 'high' ELSE 'low' END || ' orders, '
       || CASE WHEN revenue >= mx THEN 'high' ELSE 'low' END || ' revenue' AS quadrant FROM g, m""")
def shp_04(spark, sf):
    g = S.aggregate(stage.items(spark, sf, "geo"), C, ["revenue", "orders"], ["country"])
    return rounded(SH.median_quadrants(g, "revenue", "orders"))


@query("shp_05_top_n_with_other", """
WITH g AS (SELECT p_brand AS label, sum(p_retailprice) AS value FROM part GROUP BY 1),
t AS (SELECT * FROM g ORDER BY value DESC, label LIMIT 5)
SELECT label, round(value, 2) AS value,
       round(100.0 * value / (SELECT sum(value) FROM g), 4) AS share_pct FROM (
  SELECT * FROM t UNION ALL
  SELECT 'Other', (SELECT sum(value) FROM g) - (SELECT sum(value) FROM t))""")
def shp_05(spark, sf):
    return rounded(SH.top_n_with_other(stage.table(spark, sf, "part"), "p_brand", "p_retailprice"),
                   4, value=2)


@query("shp_06_dense_trend", """
WITH e AS (SELECT CAST(ts AS DATE) AS d, props AS g, value FROM events),
c AS (SELECT d, g, sum(value) AS v FROM e GROUP BY 1, 2)
SELECT p.d AS period, q.g AS "group", round(coalesce(c.v, 0), 4) AS value
FROM (SELECT DISTINCT d FROM e) p CROSS JOIN (SELECT DISTINCT g FROM e) q
LEFT JOIN c ON c.d = p.d AND c.g = q.g""")
def shp_06(spark, sf):
    return rounded(SH.dense_trend(stage.table(spark, sf, "events"), F.to_date("ts"),
                                  "props", "value"))


@query("shp_07_result_shape", WITH_ITEMS + """
SELECT 'line' AS shape, count(DISTINCT date_trunc('month', order_date)) AS n_rows FROM items
UNION ALL SELECT 'bar', count(DISTINCT market) FROM items
UNION ALL SELECT 'heatmap', count(DISTINCT (department_name, segment)) FROM items
UNION ALL SELECT 'kpi', 1""")
def shp_07(spark, sf):
    li = stage.items(spark, sf, "geo", "product")
    out = [SH.result_shape(S.aggregate(li, C, ["revenue"], by), by, ["revenue"])
           for by in (["month"], ["market"], ["department", "segment"], [])]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("shp_08_display_frame", WITH_ITEMS + f"""
SELECT 'Q' || quarter(q) || ' ' || year(q) AS "Quarter",
       format('${{:,.2f}}', revenue) AS "Revenue", format('{{:,.1f}}%', m) AS "Margin",
       format('{{:,}}', orders) AS "Orders", n_lines FROM (
  SELECT date_trunc('quarter', order_date) AS q, sum(sales) {G} AS revenue,
         100.0 * (sum(profit) {G}) / nullif(sum(sales) {G}, 0) AS m, {ORDERS} AS orders,
         count(*) AS n_lines FROM items GROUP BY 1)""")
def shp_08(spark, sf):
    return SH.display_frame(S.aggregate(stage.items(spark, sf, "product"), C,
                                        ["revenue", "margin_pct", "orders"], ["quarter"]), C)


# --- browsing ---------------------------------------------------------------

@query("brw_01_search_rows", """
SELECT * FROM part WHERE lower(p_name) LIKE '%widget%' OR lower(p_brand) LIKE '%widget%'
  OR lower(p_type) LIKE '%widget%'""")
def brw_01(spark, sf):
    return SH.search_rows(stage.table(spark, sf, "part"), "WIDGET")


@query("brw_02_page_after", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE o_orderstatus < 'O' OR (o_orderstatus = 'O' AND (o_totalprice > 9000
  OR (o_totalprice = 9000 AND o_orderkey > 10)))
ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey LIMIT 40""")
def brw_02_after(spark, sf):
    orders = stage.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return SH.page_after(orders, ["-o_orderstatus", "o_totalprice", "o_orderkey"], ["O", 9000.0, 10], 40)


@query("brw_02_page_rows", """
SELECT *, (SELECT count(*) FROM part) AS total_rows,
       CAST(ceil((SELECT count(*) FROM part) / 40.0) AS BIGINT) AS total_pages
FROM part ORDER BY p_size DESC NULLS LAST, p_partkey LIMIT 40 OFFSET 80""")
def brw_02(spark, sf):
    return SH.page_rows(stage.table(spark, sf, "part"), "p_size", True, 3, 40, ["p_partkey"])


@query("brw_03_measure_summary", " UNION ALL ".join(f"""
SELECT '{m}' AS measure, round(sum({m}), 2) AS sum, round(avg({m}), 2) AS avg,
       CAST(min({m}) AS DOUBLE) AS min, CAST(max({m}) AS DOUBLE) AS max FROM lineitem"""
       for m in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def brw_03(spark, sf):
    return rounded(SH.measure_summary(stage.table(spark, sf, "lineitem"),
                                      ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 2)


@query("brw_04_dimension_summary", " UNION ALL ".join(f"""
SELECT '{d}' AS dimension, (SELECT count(DISTINCT {d}) FROM part) AS n_distinct,
       (SELECT string_agg(v || '=' || n, '|' ORDER BY n DESC, v) FROM (
          SELECT CAST({d} AS VARCHAR) AS v, count(*) AS n FROM part GROUP BY 1
          ORDER BY n DESC, v LIMIT 3)) AS top_values""" for d in ("p_brand", "p_type", "p_size")))
def brw_04(spark, sf):
    return SH.dimension_summary(stage.table(spark, sf, "part"), ["p_brand", "p_type", "p_size"])


@query("brw_05_overview_bars", WITH_ITEMS + f"""
SELECT country, {REVENUE} AS revenue, count(*) AS n_lines FROM items GROUP BY 1
ORDER BY sum(sales) {G} DESC LIMIT 8""")
def brw_05(spark, sf):
    return rounded(SH.overview_bars(stage.items(spark, sf, "geo"), C, "revenue", "country"))


@query("brw_06_frame_kpis", COUNTRY_SQL + """
SELECT round(sum(revenue), 4) AS total, count(*) AS n_groups, round(avg(revenue), 4) AS average FROM g""")
def brw_06(spark, sf):
    return rounded(SH.frame_kpis(by_country(spark, sf), "revenue"))


# --- scalar functions -------------------------------------------------------

@query("fn_01_strip_collapse", r"""
SELECT doc_id, md5(regexp_replace(trim(text, E' \n\r\t'), '[ \n\r\t]+', ' ', 'g')) AS h FROM documents""")
def fn_01(spark, sf):
    return stage.table(spark, sf, "documents").select(
        "doc_id", F.md5(TX.collapse(TX.strip(F.col("text"))).cast("binary")).alias("h"))


@query("fn_05_fmt", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || '$'
         || format('{:,.2f}', abs(c_acctbal)) AS money,
       format('{:,.1f}%', c_acctbal) AS pct, format('{:,.2f} days', c_acctbal) AS days,
       format('{:,.2f}', c_acctbal) AS ratio,
       CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || '$' || CASE WHEN abs(c_acctbal) >= 1000
         THEN format('{:,.1f}k', abs(c_acctbal) / 1000) ELSE format('{:,.2f}', abs(c_acctbal)) END AS compact
FROM customer""")
def fn_05(spark, sf):
    v = F.col("c_acctbal")
    return stage.table(spark, sf, "customer").select(
        "c_custkey", X.fmt(v, "money").alias("money"), X.fmt(v, "percent").alias("pct"),
        X.fmt(v, "days").alias("days"), X.fmt(v, "ratio").alias("ratio"),
        X.fmt(v, "money", True).alias("compact"))


@query("fn_06_fmt_dim", """
SELECT DISTINCT strftime(o_orderdate, '%b %Y') AS month,
       'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS quarter,
       CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders""")
def fn_06(spark, sf):
    v = F.col("o_orderdate")
    return stage.table(spark, sf, "orders").select(
        X.fmt_dim(v, "month").alias("month"), X.fmt_dim(v, "quarter").alias("quarter"),
        X.fmt_dim(v, "year").alias("year")).distinct()


@query("fn_07_fmt_delta", """
SELECT c_custkey, CASE WHEN c_acctbal IS NULL OR isnan(c_acctbal) THEN 'n/a' ELSE
         CASE WHEN c_acctbal >= 0 THEN '+' ELSE '-' END || '$'
         || format('{:,.2f}', abs(c_acctbal)) END AS delta,
       CASE WHEN c_acctbal IS NULL OR isnan(c_acctbal) THEN 'n/a'
            ELSE format('{:,.1f} pp', c_acctbal) END AS change FROM customer""")
def fn_07(spark, sf):
    v = F.col("c_acctbal")
    return stage.table(spark, sf, "customer").select(
        "c_custkey", X.fmt_delta(v, "money").alias("delta"), X.fmt_change(v, "percent").alias("change"))


@query("fn_08_short_label", r"""
SELECT doc_id, CASE WHEN length(t) > 44 THEN rtrim(left(t, 43)) || '…' ELSE t END AS label FROM (
  SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def fn_08(spark, sf):
    return stage.table(spark, sf, "documents").select(
        "doc_id", TX.short_label(F.col("text")).alias("label"))
