"""Validation rules over the supplied tables, passing and violating."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import validation as V
from plumbline.plans import stage
from plumbline.plans.queries import query
from plumbline.plans.queries.common import rounded

# Damage is put in by expressions, the same on both sides.
DAMAGED_SQL = """
damaged AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey, l_linenumber,
         CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS qty,
         CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_shipdate END AS shipped,
         l_extendedprice AS price, l_discount AS disc, l_tax AS tax,
         l_extendedprice * (1 - l_discount)
           + CASE WHEN l_linenumber = 5 THEN 0.02 ELSE 0 END AS net,
         l_returnflag AS flag,
         CASE WHEN l_linenumber = 7 THEN 'x' || CAST(l_suppkey AS VARCHAR)
              ELSE 'S-' || CAST(l_suppkey AS VARCHAR) END AS code,
         l_suppkey, l_partkey
  FROM lineitem)
"""
WITH = "WITH " + DAMAGED_SQL


def damaged(spark, sf):
    li = stage.table(spark, sf, "lineitem")
    return li.selectExpr(
        "l_orderkey * 10 + l_linenumber AS id", "l_orderkey", "l_linenumber",
        "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS qty",
        "CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_shipdate END AS shipped",
        "l_extendedprice AS price", "l_discount AS disc", "l_tax AS tax",
        "l_extendedprice * (1 - l_discount)"
        " + CASE WHEN l_linenumber = 5 THEN 0.02D ELSE 0.0D END AS net",
        "l_returnflag AS flag",
        "CASE WHEN l_linenumber = 7 THEN 'x' || CAST(l_suppkey AS STRING)"
        " ELSE 'S-' || CAST(l_suppkey AS STRING) END AS code",
        "l_suppkey", "l_partkey")


SHOW = ("rule_id", "severity", "n_checked", "n_violations", "status")


def _show(results):
    return results.select(*SHOW, F.array_join("samples", "|").alias("samples"))


def _row(rule, checked, violations, samples="''", severity="error", expect=0, source="damaged"):
    return f"""
SELECT '{rule}' AS rule_id, '{severity}' AS severity, CAST({checked} AS BIGINT) AS n_checked,
       CAST({violations} AS BIGINT) AS n_violations,
       CASE WHEN ({violations}) = {expect} THEN 'pass'
            ELSE '{'FAIL' if severity == 'error' else 'warn'}' END AS status,
       {samples} AS samples FROM {source}"""


def _five(value, bad, source="damaged"):
    return (f"(SELECT coalesce(string_agg(s, '|' ORDER BY s), '') FROM (SELECT {value} AS s "
            f"FROM {source} WHERE {bad} ORDER BY s LIMIT 5))")


def _validate(spark, sf, *rules):
    return _show(V.validate_table(damaged(spark, sf), "lines", list(rules)))


@query("val_01_not_null", WITH + _row(
    "present", "count(*) * 2", "count(*) FILTER (WHERE qty IS NULL)"
    " + count(*) FILTER (WHERE shipped IS NULL)") + " UNION ALL " + _row(
    "price_present", "count(*)", "count(*) FILTER (WHERE price IS NULL)"))
def val_01(spark, sf):
    return _validate(spark, sf, V.Rule("present", "not_null", spec={"columns": ["qty", "shipped"]}),
                     V.Rule("price_present", "not_null", spec={"column": "price"}))


@query("val_02_unique", WITH + ", k AS (SELECT id, count(*) AS n FROM damaged GROUP BY 1)"
       + _row("line_id", "sum(n)", "coalesce(sum(n) FILTER (WHERE n > 1), 0)",
              _five("CAST(id AS VARCHAR)", "n > 1", "k"), source="k"))
def val_02(spark, sf):
    return _validate(spark, sf, V.Rule("line_id", "unique", spec={"column": "id"}))


@query("val_03_range", WITH + _row(
    "qty_bounds", "count(qty)", "count(*) FILTER (WHERE qty < 2 OR qty > 45)",
    _five("CAST(qty AS VARCHAR)", "qty < 2 OR qty > 45"), "warn") + " UNION ALL " + _row(
    "rates", "count(disc) + count(tax)", "count(*) FILTER (WHERE disc > 0.08)"
    " + count(*) FILTER (WHERE tax > 0.08)", _five(
        "CAST(v AS VARCHAR)", "TRUE", "(SELECT disc AS v FROM damaged WHERE disc > 0.08)")))
def val_03(spark, sf):
    return _validate(spark, sf,
                     V.Rule("qty_bounds", "range", "warn",
                            spec={"column": "qty", "min": 2, "max": 45}),
                     V.Rule("rates", "range", spec={"columns": ["disc", "tax"], "max": 0.08}))


@query("val_04_allowed_values", WITH + _row(
    "flag_known", "count(flag)", "count(*) FILTER (WHERE flag NOT IN ('A', 'N', 'X'))",
    _five("flag", "flag NOT IN ('A', 'N', 'X')")).replace(
    "AS samples", "AS samples, '3 allowed value(s); declared but never observed: X' AS detail"))
def val_04(spark, sf):
    rule = V.Rule("flag_known", "allowed_values", spec={"column": "flag", "values": ["A", "N", "X"]})
    res = V.validate_table(damaged(spark, sf), "lines", [rule])
    return res.select(*SHOW, F.array_join("samples", "|").alias("samples"), "detail")


@query("val_05_regex", WITH + _row(
    "code_shape", "count(code)", "count(*) FILTER (WHERE NOT regexp_full_match(code, 'S-[0-9]+'))",
    _five("code", "NOT regexp_full_match(code, 'S-[0-9]+')")))
def val_05(spark, sf):
    return _validate(spark, sf, V.Rule("code_shape", "regex",
                                       spec={"column": "code", "pattern": "S-[0-9]+"}))


@query("val_06_identity", WITH + _row(
    "net_adds_up", "count(net)",
    "count(*) FILTER (WHERE abs(net - price * (1 - disc)) > 0.005)",
    _five("CAST(round(abs(net - price * (1 - disc)), 6) AS VARCHAR)",
          "abs(net - price * (1 - disc)) > 0.005")) + " UNION ALL " + _row(
    "net_relative", "count(net)",
    "count(*) FILTER (WHERE abs(net - price * (1 - disc)) > 0.005"
    " AND abs(net - price * (1 - disc)) / greatest(abs(price * (1 - disc)), 1e-9) > 1e-6)",
    _five("CAST(round(abs(net - price * (1 - disc)), 6) AS VARCHAR)",
          "abs(net - price * (1 - disc)) > 0.005"
          " AND abs(net - price * (1 - disc)) / greatest(abs(price * (1 - disc)), 1e-9) > 1e-6")))
def val_06(spark, sf):
    same = {"lhs": "net", "rhs": "price * (1 - disc)", "tol_abs": 0.005}
    return _validate(spark, sf, V.Rule("net_adds_up", "identity", spec=same),
                     V.Rule("net_relative", "identity", spec={**same, "tol_rel": 1e-6}))


@query("val_07_expression", WITH + _row(
    "enough", "count(qty)", "count(*) FILTER (WHERE NOT (qty >= 3))",
    _five("CAST(id AS VARCHAR)", "NOT (qty >= 3)")))
def val_07(spark, sf):
    return _validate(spark, sf, V.Rule("enough", "expression", spec={"expr": "qty >= 3"}))


@query("val_08_consistency", """
WITH g AS (SELECT p_brand,
                  count(DISTINCT p_type) + max(CASE WHEN p_type IS NULL THEN 1 ELSE 0 END) > 1 AS b
           FROM part WHERE p_brand IS NOT NULL GROUP BY 1),
h AS (SELECT c_custkey, count(DISTINCT c_mktsegment) > 1 AS b FROM customer GROUP BY 1)""" + _row(
    "brand_type", "count(*)", "count(*) FILTER (WHERE b)", _five("p_brand", "b", "g"), source="g")
    + " UNION ALL " + _row("customer_segment", "count(*)", "count(*) FILTER (WHERE b)", source="h"))
def val_08(spark, sf):
    a = V.validate_table(stage.table(spark, sf, "part"), "part", [V.Rule(
        "brand_type", "consistency", spec={"determinant": "p_brand", "dependent": "p_type"})])
    b = V.validate_table(stage.table(spark, sf, "customer"), "customer", [V.Rule(
        "customer_segment", "consistency",
        spec={"determinant": "c_custkey", "dependent": ["c_mktsegment"]})])
    return _show(a.unionByName(b))


@query("val_09_referential", """
WITH l AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM orders),
r AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS v FROM lineitem)""" + _row(
    "customer_supplies", "count(*)", "count(*) FILTER (WHERE v NOT IN (SELECT v FROM r))",
    _five("v", "v NOT IN (SELECT v FROM r)", "l"), "warn", source="l"))
def val_09(spark, sf):
    tables = {"orders": stage.table(spark, sf, "orders"),
              "lineitem": stage.table(spark, sf, "lineitem")}
    rule = V.Rule("customer_supplies", "referential", "warn",
                  spec={"column": "o_custkey", "references": "lineitem.l_suppkey"})
    return _show(V.validate_table(tables["orders"], "orders", [rule], tables))


@query("val_10_min_rows", _row("min_rows", "count(*)",
                               "CASE WHEN count(*) >= 1000 THEN 0 ELSE 1 END", source="lineitem")
       + " UNION ALL " + _row("min_rows", "count(*)",
                              "CASE WHEN count(*) >= 1000 THEN 0 ELSE 1 END", source="region"))
def val_10(spark, sf):
    rule = V.Rule("min_rows", "min_rows", spec={"min_rows": 1000})
    a = V.validate_table(stage.table(spark, sf, "lineitem"), "lineitem", [rule])
    return _show(a.unionByName(V.validate_table(stage.table(spark, sf, "region"), "region", [rule])))


@query("val_11_no_duplicate_rows", """
WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)"""
       + _row("no_duplicate_rows", "sum(n)", "sum(n - 1)", source="k"))
def val_11(spark, sf):
    pairs = stage.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return _show(V.validate_table(pairs, "pairs", V.parse_rules({"no_duplicate_rows": True})))


SUITE = {
    "lines": {
        "min_rows": 10,
        "rules": [
            {"id": "qty_present", "type": "not_null", "column": "qty", "severity": "warn"},
            {"id": "price_range", "type": "range", "column": "price", "min": 0},
            {"id": "flag_known", "type": "allowed_values", "column": "flag",
             "values": ["A", "N", "R"]},
            {"id": "enough", "type": "expression", "expr": "qty >= 1"},
            {"id": "no_such", "type": "range", "column": "weight", "min": 0, "severity": "warn"},
            {"id": "bad_text", "type": "expression", "expr": "qty >= nowhere", "severity": "warn"},
            {"id": "known_nulls", "type": "not_null", "column": "shipped",
             "expect_violations": 1, "severity": "error"},
        ],
    },
    "absent": {"min_rows": 1},
}


def suite(spark, sf):
    return V.validate({"lines": damaged(spark, sf)}, SUITE)


SUITE_SQL = WITH + ", res AS (" + " UNION ALL ".join([
    _row("min_rows", "count(*)", "CASE WHEN count(*) >= 10 THEN 0 ELSE 1 END"),
    _row("qty_present", "count(*)", "count(*) FILTER (WHERE qty IS NULL)", severity="warn"),
    _row("price_range", "count(price)", "count(*) FILTER (WHERE price < 0)"),
    _row("flag_known", "count(flag)", "count(*) FILTER (WHERE flag NOT IN ('A', 'N', 'R'))"),
    _row("enough", "count(qty)", "count(*) FILTER (WHERE NOT qty >= 1)"),
    _row("no_such", "0", "0", expect=-1).replace("FROM damaged", ""),
    _row("bad_text", "0", "0", expect=-1).replace("FROM damaged", ""),
    _row("known_nulls", "count(*)", "count(*) FILTER (WHERE shipped IS NULL)", expect=1),
    _row("missing_table", "0", "0", expect=-1).replace("FROM damaged", ""),
]) + ")"


@query("val_12_validate", SUITE_SQL + " SELECT * FROM res")
def val_12(spark, sf):
    return _show(suite(spark, sf))


@query("val_12_verdict", SUITE_SQL + """
SELECT count(*) AS rules, count(*) FILTER (WHERE status = 'pass') AS passed,
       count(*) FILTER (WHERE status = 'FAIL') AS failed,
       count(*) FILTER (WHERE status = 'warn') AS warned,
       CASE WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'FAIL'
            WHEN count(*) FILTER (WHERE status = 'warn') > 0 THEN 'PASS with warnings'
            ELSE 'PASS' END AS verdict FROM res""")
def val_12v(spark, sf):
    return V.verdict(suite(spark, sf))


@query("val_13_violating_rows", WITH + """
SELECT id, round(qty, 4) AS qty, 'range' AS why FROM damaged WHERE qty < 2 OR qty > 45
UNION ALL SELECT id, qty, 'unique' FROM damaged
WHERE id IN (SELECT id FROM damaged GROUP BY 1 HAVING count(*) > 1)""")
def val_13(spark, sf):
    d = damaged(spark, sf)
    a = V.violating_rows(d, V.Rule("r", "range", spec={"column": "qty", "min": 2, "max": 45}))
    b = V.violating_rows(d, V.Rule("u", "unique", spec={"column": "id"}))
    return rounded(a.select("id", "qty", F.lit("range").alias("why")).unionByName(
        b.select("id", "qty", F.lit("unique").alias("why"))))


@query("val_14_forbidden_columns", """
SELECT 'by_customer' AS output, 3 AS n_columns, 1 AS n_violations, 'c_name' AS columns,
       count(*) AS exposed_cells, 'FAIL' AS status FROM (SELECT DISTINCT c_name, c_mktsegment FROM customer)
UNION ALL SELECT 'by_segment', 2, 0, '', 0, 'pass'""")
def val_14(spark, sf):
    c = stage.table(spark, sf, "customer")
    outputs = {
        "by_customer": c.groupBy("c_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n")),
        "by_segment": c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")),
    }
    return V.forbidden_columns(outputs, ["C Name", "c_address", "Customer Name"])
