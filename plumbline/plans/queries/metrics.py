"""Metrics, dimensions, filters, drill paths and the funnel."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import funnel as FN
from plumbline.operators import semantic as S
from plumbline.plans import stage
from plumbline.plans.queries import query
from plumbline.plans.queries.common import (
    VIEWS_SQL, WITH_BOTH, WITH_ITEMS, fold_sql, rounded)

C = stage.CATALOG
G = "FILTER (WHERE is_revenue_recognised)"
SHIP = "FILTER (WHERE is_shipment_valid)"
R = "round({}, 4)"

REVENUE = f"round(sum(sales) {G}, 4)"
PROFIT = f"round(sum(profit) {G}, 4)"
ORDERS = f"count(DISTINCT order_id) {G}"
MARGIN = f"round(100.0 * (sum(profit) {G}) / nullif(sum(sales) {G}, 0), 4)"
AOV = f"round((sum(sales) {G}) / nullif({ORDERS}, 0), 4)"


@query("met_01_metric", WITH_ITEMS + f"""
SELECT order_status, {REVENUE} AS revenue, round(sum(sales), 4) AS revenue_ungated,
       count(*) AS n_lines FROM items GROUP BY 1""")
def met_01(spark, sf):
    return rounded(S.aggregate(stage.items(spark, sf, "lines"), C,
                               ["revenue", "revenue_ungated"], ["order_status"]))


@query("met_02_ratio", WITH_ITEMS + f"""
SELECT order_status, {MARGIN} AS margin_pct, count(*) AS n_lines FROM items GROUP BY 1""")
def met_02(spark, sf):
    return rounded(S.aggregate(stage.items(spark, sf, "product"), C,
                               ["margin_pct"], ["order_status"]))


@query("met_03_gated_sums", WITH_ITEMS + f"""
SELECT market, {REVENUE} AS revenue, {PROFIT} AS profit,
       round(sum(discount) {G}, 4) AS discount,
       CAST(sum(quantity) {G} AS BIGINT) AS units, round(sum(sales), 4) AS revenue_ungated,
       count(*) AS n_lines FROM items GROUP BY 1""")
def met_03(spark, sf):
    return rounded(S.aggregate(
        stage.items(spark, sf, "geo", "product"), C,
        ["revenue", "profit", "discount", "units", "revenue_ungated"], ["market"]))


@query("met_04_gated_counts", WITH_ITEMS + f"""
SELECT segment, {ORDERS} AS orders, count(*) {G} AS lines, count(*) {SHIP} AS shipped_lines,
       count(*) FILTER (WHERE is_shipment_valid AND shipping_delay_days <= 0) AS on_time_lines,
       count(*) FILTER (WHERE is_shipment_valid AND shipping_delay_days > 0) AS late_lines,
       count(*) AS n_lines FROM items GROUP BY 1""")
def met_04(spark, sf):
    return S.aggregate(stage.items(spark, sf, "customer"), C,
                       ["orders", "lines", "shipped_lines", "on_time_lines", "late_lines"],
                       ["segment"])


@query("met_05_gated_average", WITH_ITEMS + f"""
SELECT shipping_mode, round(avg(shipping_delay_days) {SHIP}, 4) AS avg_delay_days,
       count(*) AS n_lines FROM items GROUP BY 1""")
def met_05(spark, sf):
    return rounded(S.aggregate(stage.items(spark, sf, "lines"), C,
                               ["avg_delay_days"], ["shipping_mode"]))


@query("met_06_ratios", WITH_ITEMS + f"""
SELECT department_name AS department, {MARGIN} AS margin_pct,
       round(100.0 * (sum(discount) {G}) / nullif(sum(sales) {G}, 0), 4) AS discount_pct,
       {AOV} AS aov,
       round(100.0 * (count(*) FILTER (WHERE is_shipment_valid AND shipping_delay_days <= 0))
             / nullif(count(*) {SHIP}, 0), 4) AS on_time_pct,
       round(100.0 * (count(*) FILTER (WHERE is_shipment_valid AND shipping_delay_days > 0))
             / nullif(count(*) {SHIP}, 0), 4) AS late_pct,
       round((count(*) {G})::DOUBLE / nullif({ORDERS}, 0), 4) AS lines_per_order,
       count(*) AS n_lines FROM items GROUP BY 1""")
def met_06(spark, sf):
    return rounded(S.aggregate(
        stage.items(spark, sf, "product"), C,
        ["margin_pct", "discount_pct", "aov", "on_time_pct", "late_pct", "lines_per_order"],
        ["department"]))


@query("met_07_aggregate", WITH_ITEMS + f"""
SELECT market, segment, {REVENUE} AS revenue, {MARGIN} AS margin_pct, {ORDERS} AS orders,
       count(*) AS n_lines FROM items
WHERE order_date >= TIMESTAMP '1996-01-01' AND order_date < TIMESTAMP '1999-01-01'
GROUP BY 1, 2 HAVING count(*) >= 20
ORDER BY revenue DESC NULLS LAST, market, segment LIMIT 15""")
def met_07(spark, sf):
    return rounded(S.aggregate(
        stage.items(spark, sf, "geo", "product"), C, ["revenue", "margin_pct", "orders"],
        ["market", "segment"], S.Filters("1996-01-01", "1998-12-31"),
        order_by="-revenue", limit=15, min_lines=20))


@query("met_07_revenue_by_market", WITH_ITEMS + f"""
SELECT market, {REVENUE} AS revenue, {MARGIN} AS margin_pct, {ORDERS} AS orders,
       count(*) AS n_lines FROM items GROUP BY 1""")
def revenue_by_market(spark, sf):
    return rounded(S.aggregate(stage.items(spark, sf, "geo", "product"), C,
                               ["revenue", "margin_pct", "orders"], ["market"]))


@query("met_07_no_metrics", WITH_ITEMS + """
SELECT market, country, count(*) AS n_lines FROM items GROUP BY 1, 2""")
def met_07_none(spark, sf):
    return S.aggregate(stage.items(spark, sf, "geo"), C, [], ["market", "country"])


@query("met_08_totals", WITH_ITEMS + f"""
SELECT {REVENUE} AS revenue, {PROFIT} AS profit, {MARGIN} AS margin_pct, {ORDERS} AS orders,
       count(*) {G} AS lines, {AOV} AS aov, count(*) AS n_lines FROM items""")
def met_08(spark, sf):
    return rounded(S.totals(stage.items(spark, sf, "product"), C,
                            ["revenue", "profit", "margin_pct", "orders", "lines", "aov"]))


@query("met_09_timeseries", WITH_ITEMS + f"""
SELECT CAST(date_trunc('month', order_date) AS TIMESTAMP) AS month, {REVENUE} AS revenue,
       {ORDERS} AS orders, count(*) AS n_lines FROM items GROUP BY 1""")
def met_09(spark, sf):
    return rounded(S.timeseries(stage.items(spark, sf, "lines"), C,
                                ["revenue", "orders"], "month"))


@query("met_10_time_dimensions", WITH_ITEMS + f"""
SELECT CAST(date_trunc('year', order_date) AS TIMESTAMP) AS year,
       CAST(date_trunc('quarter', order_date) AS TIMESTAMP) AS quarter,
       {REVENUE} AS revenue, count(*) AS n_lines FROM items GROUP BY 1, 2""")
def met_10(spark, sf):
    return rounded(S.aggregate(stage.items(spark, sf, "lines"), C, ["revenue"],
                               ["year", "quarter"]))


@query("met_11_date_window", WITH_ITEMS + f"""
SELECT payment_type, {REVENUE} AS revenue, count(*) AS n_lines FROM items
WHERE order_date >= TIMESTAMP '1997-03-01' AND order_date < TIMESTAMP '1997-07-01'
GROUP BY 1""")
def met_11(spark, sf):
    return rounded(S.aggregate(stage.items(spark, sf, "lines"), C, ["revenue"],
                               ["payment_type"], S.Filters("1997-03-01", "1997-06-30")))


@query("met_12_membership", WITH_ITEMS + f"""
SELECT market, {REVENUE} AS revenue, count(*) AS n_lines FROM items
WHERE market IN ('ASIA', 'EUROPE') AND CAST(shipping_delay_days AS VARCHAR) IN ('0', '2')
GROUP BY 1""")
def met_12(spark, sf):
    f = S.Filters(where={"market": ["ASIA", "EUROPE"], "delay_days": ["0", "2"]})
    return rounded(S.aggregate(stage.items(spark, sf, "geo"), C, ["revenue"], ["market"], f))


@query("met_13_date_bounds",
       "SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi "
       "FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def met_13(spark, sf):
    return S.date_bounds(stage.items(spark, sf, "lines"), C)


@query("met_14_dimension_values", WITH_ITEMS + """
SELECT product_name AS value, count(*) AS n FROM items WHERE product_name IS NOT NULL
GROUP BY 1""")
def met_14(spark, sf):
    return S.dimension_values(stage.items(spark, sf, "product"), C, "product")


@query("met_15_drill", WITH_ITEMS + f"""
SELECT country, {REVENUE} AS revenue, {MARGIN} AS margin_pct, count(*) AS n_lines
FROM items WHERE market IN ('EUROPE') GROUP BY 1""")
def met_15(spark, sf):
    narrowed, finer = S.drill(C, S.Filters(), "geography", "market", ["EUROPE"])
    return rounded(S.aggregate(stage.items(spark, sf, "geo", "product"), C,
                               ["revenue", "margin_pct"], [finer], narrowed))


@query("met_16_rollup", WITH_ITEMS + f"""
SELECT market, country, {REVENUE} AS revenue, {MARGIN} AS margin_pct, {ORDERS} AS orders,
       count(*) AS n_lines, CAST(2 - grouping(market) - grouping(country) AS INT) AS level
FROM items GROUP BY ROLLUP (market, country)""")
def met_16(spark, sf):
    return rounded(S.rollup(stage.items(spark, sf, "geo", "product"), C,
                            ["market", "country"], ["revenue", "margin_pct", "orders"]))


@query("met_18_canonical_values", """
WITH asked(asked) AS (VALUES ('europe'), ('ASIA'), ('Africca')),
stored AS (SELECT r_name AS stored, count(*) AS n
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
           JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
near AS (SELECT asked, stored, levenshtein(lower(asked), lower(stored)) AS d FROM asked, stored
         WHERE levenshtein(lower(asked), lower(stored))
               <= 0.4 * greatest(length(asked), length(stored)))
SELECT a.asked, s.stored AS canonical, s.stored IS NOT NULL AS known,
       CASE WHEN s.stored IS NULL THEN
         (SELECT string_agg(stored, ', ' ORDER BY d, stored) FROM near n WHERE n.asked = a.asked)
       END AS nearest
FROM asked a LEFT JOIN stored s ON lower(a.asked) = lower(s.stored)""")
def met_18(spark, sf):
    return S.canonical_values(stage.items(spark, sf, "geo"), C, "market",
                              ["europe", "ASIA", "Africca"])


@query("met_19_empty_result", WITH_ITEMS + """
SELECT count(*) = 0 AS is_empty,
       CASE WHEN count(*) = 0 THEN 'combination' END AS cause FROM items
WHERE market = 'ASIA' AND order_date >= TIMESTAMP '2001-08-02'
  AND order_date < TIMESTAMP '2001-09-01'""")
def met_19(spark, sf):
    f = S.Filters("2001-08-02", "2001-08-31", {"market": ["ASIA"]})
    return S.empty_result(S.totals(stage.items(spark, sf, "geo"), C, ["revenue"], f), f)


# --- joins and the funnel ---------------------------------------------------

@query("jn_01_fold_key", "WITH " + VIEWS_SQL + f"""
SELECT access_log_id, {fold_sql('product_name')} AS product_key FROM page_views""")
def jn_01(spark, sf):
    from plumbline.functions.text import fold_key
    return stage.page_views(spark, sf).select(
        "access_log_id", fold_key(F.col("product_name")).alias("product_key"))


@query("jn_02_with_join_keys", "WITH " + VIEWS_SQL + f"""
SELECT product_name, {fold_sql('product_name')} AS product_key,
       {fold_sql('category_name')} AS category_key, count(*) AS n
FROM page_views GROUP BY 1, 2, 3""")
def jn_02(spark, sf):
    # labels repeat, so they are counted before they are folded
    few = (stage.page_views(spark, sf).groupBy("product_name", "category_name")
           .agg(F.count(F.lit(1)).alias("n")))
    keyed = FN.with_join_keys(few, {"product_name": "product_key",
                                    "category_name": "category_key"})
    return keyed.groupBy("product_name", "product_key", "category_key").agg(
        F.sum("n").alias("n"))


@query("jn_03_event_window", "WITH " + VIEWS_SQL + """
SELECT CAST(min(viewed_at) AS DATE) AS lo, CAST(max(viewed_at) AS DATE) AS hi FROM page_views""")
def jn_03(spark, sf):
    return FN.event_window(stage.page_views(spark, sf))


def _funnel_sql(by: str, limit: int | None = None) -> str:
    return WITH_BOTH + f""",
win AS (SELECT CAST(min(viewed_at) AS DATE) AS lo, CAST(max(viewed_at) AS DATE) AS hi
        FROM page_views),
v AS (SELECT {fold_sql(by + '_name')} AS k, count(*) AS views, min({by}_name) AS log_label
      FROM page_views GROUP BY 1),
o AS (SELECT {fold_sql(by + '_name')} AS k, min({by}_name) AS fact_label, {ORDERS} AS orders,
             count(*) {G} AS lines, sum(sales) {G} AS revenue
      FROM items, win WHERE order_date >= lo AND order_date < hi + INTERVAL 1 DAY GROUP BY 1)
SELECT coalesce(fact_label, log_label, k) AS {by}, k AS {by}_key,
       coalesce(views, 0) AS views, coalesce(orders, 0) AS orders, coalesce(lines, 0) AS lines,
       round(coalesce(revenue, 0), 4) AS revenue,
       CASE WHEN coalesce(views, 0) > 0
            THEN round(100.0 * coalesce(orders, 0) / views, 4) END AS view_to_order_pct
FROM v FULL OUTER JOIN o USING (k)
ORDER BY views DESC, orders DESC, {by}_key""" + (f" LIMIT {limit}" if limit else "")


@query("jn_04_funnel_product", _funnel_sql("product"))
def jn_04(spark, sf):
    return rounded(FN.funnel(stage.page_views(spark, sf), stage.items(spark, sf, "product")))


@query("jn_04_funnel_category", _funnel_sql("category", 10))
def jn_04c(spark, sf):
    return rounded(FN.funnel(stage.page_views(spark, sf), stage.items(spark, sf, "product"),
                             by="category", limit=10))


@query("jn_05_funnel_totals", WITH_BOTH + f""",
win AS (SELECT CAST(min(viewed_at) AS DATE) AS lo, CAST(max(viewed_at) AS DATE) AS hi,
               count(*) AS views FROM page_views),
o AS (SELECT {ORDERS} AS orders, count(*) {G} AS lines, sum(sales) {G} AS revenue
      FROM items, win WHERE order_date >= lo AND order_date < hi + INTERVAL 1 DAY)
SELECT views, orders, lines, round(revenue, 4) AS revenue,
       round(100.0 * orders / nullif(views, 0), 4) AS view_to_order_pct,
       lo AS window_from, hi AS window_to FROM win, o""")
def jn_05(spark, sf):
    return rounded(FN.funnel_totals(stage.page_views(spark, sf),
                                    stage.items(spark, sf, "lines")))


@query("jn_06_unmatched_keys", WITH_BOTH + f""",
v AS (SELECT {fold_sql('product_name')} AS key, count(*) AS n, min(product_name) AS label
      FROM page_views GROUP BY 1),
o AS (SELECT {fold_sql('product_name')} AS key, count(*) AS n, min(product_name) AS label
      FROM items GROUP BY 1)
SELECT key, 'log' AS side, label, n AS n_rows FROM v WHERE key NOT IN (SELECT key FROM o)
UNION ALL
SELECT key, 'fact', label, n FROM o WHERE key NOT IN (SELECT key FROM v)""")
def jn_06(spark, sf):
    return FN.unmatched_keys(stage.page_views(spark, sf), stage.items(spark, sf, "product"))


@query("jn_07_viewed_never_ordered",
       f"SELECT * FROM ({_funnel_sql('product')}) WHERE views > 0 AND orders = 0")
def jn_07a(spark, sf):
    return rounded(FN.viewed_never_ordered(FN.funnel(
        stage.page_views(spark, sf), stage.items(spark, sf, "product"), limit=None)))


@query("jn_07_ordered_never_viewed",
       f"SELECT * FROM ({_funnel_sql('product')}) WHERE orders > 0 AND views = 0")
def jn_07b(spark, sf):
    return rounded(FN.ordered_never_viewed(FN.funnel(
        stage.page_views(spark, sf), stage.items(spark, sf, "product"), limit=None)))
