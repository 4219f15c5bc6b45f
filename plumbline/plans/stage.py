"""Views of the supplied tables in the shape the semantic layer expects:
one row per order line (`items`) and one row per page view (`page_views`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.format import COUNT, DAYS, MONEY, PERCENT, RATIO
from plumbline.operators.semantic import Catalog, Dimension, Measure, Metric, Ratio


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """Order lines with the joined attributes named in ``parts``.

    ``parts`` is any of 'customer', 'geo' and 'product'; naming none gives all
    of them.  Joins not asked for are not planned.  Small sides are broadcast
    by Spark's own size threshold.
    """
    want = set(parts or ("customer", "geo", "product")) - {"lines"}
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    df = li.join(o, li.l_orderkey == o.o_orderkey)
    cols = {
        "order_item_id": "l_orderkey * 10 + l_linenumber",
        "order_id": "l_orderkey",
        "line_number": "l_linenumber",
        "order_date": "o_orderdate",
        "shipping_date": "l_shipdate",
        "sales": "l_extendedprice",
        "discount": "l_extendedprice * l_discount",
        "total": "l_extendedprice * (1 - l_discount)",
        "quantity": "cast(l_quantity as bigint)",
        "order_status": "o_orderstatus",
        "shipping_mode": "o_orderpriority",
        "payment_type": "l_linestatus",
        "delivery_status": "l_returnflag",
        "is_revenue_recognised": "o_orderstatus <> 'P'",
        "is_shipment_valid": "l_returnflag <> 'R'",
        "shipping_delay_days":
            "((datediff(l_shipdate, o_orderdate) % 7) + 7) % 7 - 2",
    }
    if want & {"customer", "geo"}:
        df = df.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        cols |= {"segment": "c_mktsegment"}
    if "geo" in want:
        places = table(spark, sf_dir, "nation").join(
            table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        df = df.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        cols |= {"market": "r_name", "country": "n_name"}
    if "product" in want:
        df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        cols |= {
            "profit": "l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice",
            "department_name": "p_type",
            "category_name": "p_brand",
            "product_name": "p_name",
        }
    return df.selectExpr(*[f"{e} AS {n}" for n, e in cols.items()])


def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View events, moved into the order years, with deliberately untidy labels.

    Each event names one part.  Blue products are logged under a retired name,
    so both sides of the funnel hold labels the other has never seen.
    """
    ev, part = table(spark, sf_dir, "events"), table(spark, sf_dir, "part")
    n_parts = part.agg(F.count(F.lit(1))).scalar()
    name = F.when(F.col("p_name").startswith("blue "),
                  F.concat(F.lit("retired "), "p_name")).otherwise(F.col("p_name"))
    return (
        ev.filter("event_type = 'view'")
        .withColumn("pk", F.col("event_id") % n_parts)
        .join(part, F.col("pk") == F.col("p_partkey"))
        .select(
            F.col("event_id").alias("access_log_id"),
            F.expr("ts - INTERVAL 24 YEARS").alias("viewed_at"),
            F.when(F.col("event_id") % 3 == 0, F.concat(F.upper(name), F.lit(" ")))
            .when(F.col("event_id") % 3 == 1, F.replace(name, F.lit(" "), F.lit("/")))
            .otherwise(name).alias("product_name"),
            F.lower("p_brand").alias("category_name"),
            F.lower("p_type").alias("department_name"),
        )
    )


REVENUE = "is_revenue_recognised"
SHIPMENT = "is_shipment_valid"

# --- fixed values: the registry of figures and groupings --------------------
METRICS = (
    Metric("revenue", "Revenue", "sum", "sales", REVENUE, MONEY),
    Metric("revenue_ungated", "Revenue (ungated)", "sum", "sales", None, MONEY),
    Metric("profit", "Profit", "sum", "profit", REVENUE, MONEY),
    Metric("discount", "Discount given", "sum", "discount", REVENUE, MONEY,
           higher_is_better=False),
    Metric("orders", "Orders", "count_distinct", "order_id", REVENUE, COUNT),
    Metric("lines", "Order lines", "count", "*", REVENUE, COUNT),
    Metric("units", "Units", "sum", "quantity", REVENUE, COUNT),
    Metric("shipped_lines", "Shipped lines", "count", "*", SHIPMENT, COUNT),
    Metric("on_time_lines", "On-time lines", "count", "*",
           SHIPMENT + " AND shipping_delay_days <= 0", COUNT),
    Metric("late_lines", "Late lines", "count", "*",
           SHIPMENT + " AND shipping_delay_days > 0", COUNT, higher_is_better=False),
    Metric("avg_delay_days", "Average delay", "avg", "shipping_delay_days", SHIPMENT,
           DAYS, higher_is_better=False),
    Ratio("margin_pct", "Margin", "profit", "revenue", 100.0, PERCENT),
    Ratio("discount_pct", "Discount rate", "discount", "revenue", 100.0, PERCENT,
          higher_is_better=False),
    Ratio("aov", "Average order value", "revenue", "orders", 1.0, MONEY),
    Ratio("on_time_pct", "On-time rate", "on_time_lines", "shipped_lines", 100.0, PERCENT),
    Ratio("late_pct", "Late rate", "late_lines", "shipped_lines", 100.0, PERCENT,
          higher_is_better=False),
    Ratio("lines_per_order", "Lines per order", "lines", "orders", 1.0, RATIO),
    Measure("views", "Page views", COUNT),
    Measure("view_to_order_pct", "View-to-order rate", PERCENT),
)
DIMENSIONS = (
    Dimension("month", "Month", "order_date", "month"),
    Dimension("quarter", "Quarter", "order_date", "quarter"),
    Dimension("year", "Year", "order_date", "year"),
    Dimension("market", "Market", "market"),
    Dimension("country", "Country", "country"),
    Dimension("segment", "Customer segment", "segment"),
    Dimension("department", "Department", "department_name"),
    Dimension("category", "Category", "category_name"),
    Dimension("product", "Product", "product_name"),
    Dimension("shipping_mode", "Shipping mode", "shipping_mode"),
    Dimension("order_status", "Order status", "order_status"),
    Dimension("payment_type", "Payment type", "payment_type"),
    Dimension("delivery_status", "Delivery status", "delivery_status"),
    Dimension("delay_days", "Delay (days)", "shipping_delay_days"),
)
DRILL_PATHS = {
    "geography": ("market", "country"),
    "product": ("department", "category", "product"),
    "time": ("year", "quarter", "month"),
}
# --- end of fixed values ----------------------------------------------------

CATALOG = Catalog(
    "items",
    {m.key: m for m in METRICS},
    {d.key: d for d in DIMENSIONS},
    DRILL_PATHS,
    date_column="order_date",
)
