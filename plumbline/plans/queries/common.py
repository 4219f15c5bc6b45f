"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEMS_SQL = """
items AS (
  SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id,
         l_linenumber AS line_number,
         o_orderdate AS order_date, l_shipdate AS shipping_date,
         l_extendedprice AS sales, l_extendedprice * l_discount AS discount,
         l_extendedprice * (1 - l_discount) AS total,
         l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice AS profit,
         CAST(l_quantity AS BIGINT) AS quantity,
         o_orderstatus AS order_status, o_orderpriority AS shipping_mode,
         l_linestatus AS payment_type, l_returnflag AS delivery_status,
         o_orderstatus <> 'P' AS is_revenue_recognised,
         l_returnflag <> 'R' AS is_shipment_valid,
         ((datediff('day', o_orderdate, l_shipdate) % 7) + 7) % 7 - 2 AS shipping_delay_days,
         c_mktsegment AS segment, r_name AS market, n_name AS country,
         p_type AS department_name, p_brand AS category_name, p_name AS product_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
       JOIN part ON l_partkey = p_partkey)
"""

VIEWS_SQL = """
page_views AS (
  SELECT event_id AS access_log_id, ts - INTERVAL 24 YEARS AS viewed_at,
         CASE event_id % 3 WHEN 0 THEN upper(name) || ' '
              WHEN 1 THEN replace(name, ' ', '/') ELSE name END AS product_name,
         lower(p_brand) AS category_name, lower(p_type) AS department_name
  FROM (SELECT *, CASE WHEN p_name LIKE 'blue %' THEN 'retired ' || p_name
                       ELSE p_name END AS name
        FROM events JOIN part ON event_id % (SELECT count(*) FROM part) = p_partkey
        WHERE event_type = 'view'))
"""

WITH_ITEMS = "WITH " + ITEMS_SQL
WITH_BOTH = "WITH " + ITEMS_SQL + ", " + VIEWS_SQL


def rounded(df: DataFrame, places: int = 4, **per_column: int) -> DataFrame:
    """Round every double column, so that summing order cannot show."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            n = per_column.get(f.name, places)
            # adding zero turns -0.0 into 0.0
            out.append((F.round(F.col(f.name), n) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def fold_sql(expr: str) -> str:
    return f"trim(regexp_replace(lower({expr}), '[^a-z0-9]+', ' ', 'g'))"


def select_list(text: str) -> list[str]:
    """The top-level items of a comma-separated select list."""
    items, depth, start, quoted = [], 0, 0, False
    for i, ch in enumerate(text):
        quoted ^= ch == "'"
        if not quoted:
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 0:
                items.append(text[start:i].strip())
                start = i + 1
    return [*items, text[start:].strip()]
