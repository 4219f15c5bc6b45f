"""Schema discovery and matching, dictionary, versions, alerts, jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import dictionary as DI
from plumbline.operators import schema as SC
from plumbline.operators import validation as V
from plumbline.operators import versions as VE
from plumbline.operators.semantic import aggregate
from plumbline.plans import dashboards, publish, spec, stage
from plumbline.plans.queries import SQL, query
from plumbline.plans.queries.cleaning import CHECKED_STEPS, POLICY, WITH as MESSY_WITH, messy
from plumbline.plans.queries.common import WITH_BOTH, WITH_ITEMS, rounded
from plumbline.plans.queries.metrics import G, MARGIN, REVENUE, _funnel_sql
from plumbline.plans.queries.validation import SUITE_SQL, suite
from plumbline.session import shared_folder
from plumbline.sources import files as FI

C = stage.CATALOG


def _t(spark, sf, *names):
    return {n: stage.table(spark, sf, n) for n in names}


def _role(column: str, role: str) -> str:
    """'measured' columns are ids where nearly every value is different."""
    if role != "measured":
        return f"'{role}'"
    return f"CASE WHEN count(DISTINCT {column}) > 0.95 * count({column}) THEN 'id' ELSE 'measure' END"


def _roles_sql(table: str, cols: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS n_present, count(DISTINCT {c}) AS n_distinct,
       {_role(c, role)} AS role,
       CASE WHEN {_role(c, role)} = 'measure' THEN '{unit}' END AS unit FROM {table}"""
                              for c, (role, unit) in cols.items())


@query("sch_01_column_roles", _roles_sql("customer", {
    "c_custkey": ("id", ""), "c_name": ("id", ""), "c_nationkey": ("measure", "measure"),
    "c_acctbal": ("measured", "measure"), "c_mktsegment": ("dimension", "")}))
def sch_01(spark, sf):
    return SC.column_roles(stage.table(spark, sf, "customer"))


@query("sch_01_event_roles", _roles_sql("events", {
    "event_id": ("id", ""), "ts": ("time", ""), "user_id": ("id", ""),
    "event_type": ("dimension", ""), "value": ("measured", "money"), "props": ("dimension", "")}))
def sch_01e(spark, sf):
    return SC.column_roles(stage.table(spark, sf, "events"))


@query("sch_02_is_time", """
SELECT * FROM (VALUES ('ts', TRUE), ('day_text', TRUE), ('time_text', FALSE)) AS t("column", is_time)
WHERE (SELECT count(*) FROM events) > 0""")
def sch_02(spark, sf):
    e = stage.table(spark, sf, "events").select(
        "ts", F.date_format("ts", "yyyy-MM-dd").alias("day_text"),
        F.col("event_type").alias("time_text"), "value")
    return SC.is_time(e)


@query("sch_03_is_boolean", """
SELECT 'linestatus' AS "column", FALSE AS is_boolean FROM lineitem HAVING count(*) > 0
UNION ALL SELECT 'flag', bool_and(lower(f) IN ('yes', 'no')) FROM
  (SELECT CASE WHEN l_tax > 0.04 THEN 'Yes' ELSE 'no' END AS f FROM lineitem)
UNION ALL SELECT 'bit', bool_and(b IN (0, 1)) FROM
  (SELECT CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS b FROM lineitem)""")
def sch_03(spark, sf):
    li = stage.table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("linestatus"),
        F.when(F.col("l_tax") > 0.04, "Yes").otherwise("no").alias("flag"),
        F.when(F.col("l_tax") > 0.04, 1).otherwise(0).alias("bit"))
    return SC.column_facts(li).select("column", "is_boolean")


@query("sch_04_is_id", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(DISTINCT {c}) > 0.95 * count({c}) AS is_id FROM part"""
       for c in ("p_partkey", "p_name", "p_size")))
def sch_04(spark, sf):
    r = SC.column_roles(stage.table(spark, sf, "part").select("p_partkey", "p_name", "p_size"))
    return r.select("column", (F.col("role") == "id").alias("is_id"))


@query("sch_05_infer_unit", """
SELECT 'money' AS unit, round(sum(l_extendedprice), 2) AS total FROM lineitem
UNION ALL SELECT 'count', round(sum(l_quantity), 2) FROM lineitem
UNION ALL SELECT 'measure', round(sum(l_tax), 2) FROM lineitem""")
def sch_05(spark, sf):
    li = stage.table(spark, sf, "lineitem")
    rows = [F.struct(F.lit(SC.infer_unit(c)).alias("unit"), F.sum(c).alias("total"))
            for c in ("l_extendedprice", "l_quantity", "l_tax")]
    return rounded(li.agg(F.array(*rows).alias("a")).selectExpr("inline(a)"), 2)


@query("sch_06_build_catalog", """
SELECT CAST(date_trunc('year', l_shipdate) AS TIMESTAMP) AS year, count(*) AS row_count,
  round(sum(l_quantity), 4) AS sum_l_quantity, round(max(l_quantity), 4) AS max_l_quantity,
  round(avg(l_quantity), 4) AS avg_l_quantity, count(DISTINCT l_orderkey) AS distinct_order_id,
  count(*) AS n_lines FROM lineitem GROUP BY 1""")
def sch_06(spark, sf):
    li = stage.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "order_id").select(
        "order_id", "l_quantity", "l_shipdate", "l_returnflag")
    cat = SC.build_catalog(li, "lineitem")
    return rounded(aggregate(li, cat, ["row_count", "sum_l_quantity", "max_l_quantity",
                                       "avg_l_quantity", "distinct_order_id"], ["year"]))


OVERLAP_SQL = """
WITH a AS (SELECT DISTINCT regexp_replace(lower(p_name), '[ _.\\-]+', '', 'g') AS f, p_name AS v FROM part
           WHERE p_size > 1),
b AS (SELECT DISTINCT regexp_replace(lower(n), '[ _.\\-]+', '', 'g') AS f, n AS v FROM
      (SELECT CASE WHEN p_name LIKE 'red %' THEN upper(replace(p_name, ' ', '_')) ELSE p_name || ' ii' END AS n
       FROM part)),
s AS (SELECT count(*) AS n FROM a JOIN b USING (f)), na AS (SELECT count(*) AS n FROM a),
nb AS (SELECT count(*) AS n FROM b)
SELECT s.n AS n_shared, na.n AS n_left, nb.n AS n_right, round(s.n / least(na.n, nb.n), 3) AS overlap,
  (SELECT coalesce(string_agg(v, '|' ORDER BY v), '') FROM (SELECT v FROM a WHERE f NOT IN (SELECT f FROM b)
     ORDER BY v LIMIT 8)) AS only_left,
  (SELECT coalesce(string_agg(v, '|' ORDER BY v), '') FROM (SELECT v FROM b WHERE f NOT IN (SELECT f FROM a)
     ORDER BY v LIMIT 8)) AS only_right FROM s, na, nb"""


@query("sch_07_value_overlap", OVERLAP_SQL)
def sch_07(spark, sf):
    p = stage.table(spark, sf, "part")
    other = p.select(F.when(F.col("p_name").startswith("red "), F.upper(F.replace(
        "p_name", F.lit(" "), F.lit("_")))).otherwise(F.concat("p_name", F.lit(" ii"))).alias("label"))
    return SC.value_overlap(p.filter("p_size > 1"), "p_name", other, "label")


def _two(spark, sf):
    n, c = stage.table(spark, sf, "nation"), stage.table(spark, sf, "customer")
    left = n.select(F.col("n_name").alias("Country_Name"), F.col("n_regionkey").alias("region_code"))
    right = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.lower("n_name").alias("country"), F.col("c_mktsegment").alias("region"),
        F.col("c_acctbal").alias("balance"))
    return {"places": left, "people": right}


def _types(spark):
    rows = [("places", "Country_Name", "categorical"), ("places", "region_code", "integer"),
            ("people", "country", "categorical"), ("people", "region", "categorical"),
            ("people", "balance", "decimal")]
    return spark.range(1).select(F.explode(F.array(*[F.struct(
        F.lit(t).alias("table"), F.lit(c).alias("column"), F.lit(k).alias("inferred_type"))
        for t, c, k in rows])).alias("r")).select("r.*")


@query("sch_08_match_columns", """
WITH s AS (SELECT count(DISTINCT c_nationkey) AS n FROM customer)
SELECT 'places.Country_Name' AS "left", 'people.country' AS "right", CAST(1 AS DOUBLE) AS name_score,
  TRUE AS type_agreement, round(n / least(n, (SELECT count(*) FROM nation)), 3) AS overlap,
  'joinable' AS verdict FROM s
UNION ALL SELECT 'places.region_code', 'people.region', 1, FALSE, 0.0, 'not joinable' FROM s""")
def sch_08(spark, sf):
    m = SC.match_columns(_two(spark, sf), _types(spark))
    return m.select("left", "right", "name_score", "type_agreement", "overlap", "verdict")


@query("sch_09_naming_conventions", """
WITH n AS (SELECT p_brand AS "table", ['spaced', 'snake_case', 'kebab-case', 'SCREAMING_CASE', 'PascalCase',
             'camelCase', 'Mixed_Pascal_Snake', 'single-word'][1 + p_partkey % 8] AS convention FROM part),
c AS (SELECT "table", convention, count(*) AS n FROM n GROUP BY 1, 2)
SELECT c.*, count(*) FILTER (convention <> 'single-word') OVER (PARTITION BY "table") > 1 AS is_mixed FROM c""")
def sch_09(spark, sf):
    # the parts' names in eight spellings, as columns of one table per brand
    name, at = F.col("p_name"), F.pmod("p_partkey", F.lit(8))
    joined = F.replace(name, F.lit(" "), F.lit("_"))
    title = F.initcap(name)
    pascal = F.replace(title, F.lit(" "), F.lit(""))
    spelt = [name, joined, F.replace(name, F.lit(" "), F.lit("-")), F.upper(joined), pascal,
             F.concat(F.lower(F.substring(pascal, 1, 1)), F.substring(pascal, 2, 1000)),
             F.replace(title, F.lit(" "), F.lit("_")), F.substring_index(name, " ", 1)]
    column = F.element_at(F.array(*spelt), (at + 1).cast("int"))
    return SC.naming_conventions(stage.table(spark, sf, "part").select(
        F.col("p_brand").alias("table"), column.alias("column")))


@query("sch_10_candidate_joins", """
WITH o AS (SELECT count(DISTINCT o_custkey) AS n FROM orders), c AS (SELECT count(*) AS n FROM customer),
s AS (SELECT count(*) AS n FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer))
SELECT 'orders' AS left_table, 'customer_id' AS left_column, 'customers' AS right_table,
  'customer_id' AS right_column, TRUE AS is_exact, round(s.n / least(o.n, c.n), 2) AS overlap,
  CAST(1.0 AS DOUBLE) AS confidence FROM o, c, s
UNION ALL SELECT 'orders', k, 'nations', 'id', FALSE,
  round((SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders
         WHERE o_custkey IN (SELECT n_nationkey FROM nation)))
        / least((SELECT n FROM o), (SELECT count(*) FROM nation)), 2), 0.8
  FROM (VALUES ('nation_id'), ('customer_id')) AS v(k)
UNION ALL SELECT 'customers', 'customer_id', 'nations', 'id', FALSE,
  round((SELECT count(*) FROM customer WHERE c_custkey IN (SELECT n_nationkey FROM nation))
        / least((SELECT n FROM c), (SELECT count(*) FROM nation)), 2), 0.8""")
def sch_10(spark, sf):
    t = _t(spark, sf, "orders", "customer", "nation")
    orders = t["orders"].select(F.col("o_custkey").alias("customer_id"),
                                F.col("o_custkey").alias("nation_id"), "o_totalprice")
    return SC.candidate_joins({
        "orders": orders, "customers": t["customer"].select(
            F.col("c_custkey").alias("customer_id"), "c_name"),
        "nations": t["nation"].select(F.col("n_nationkey").alias("id"), "n_name")})


@query("sch_11_single_source_columns", """
SELECT 'people' AS "table", 'balance' AS "column" FROM customer HAVING count(*) > 0""")
def sch_11(spark, sf):
    two = _two(spark, sf)
    names = SC.column_names({t: d.columns for t, d in two.items()}, spark)
    return SC.single_source_columns(names, SC.match_columns(two, _types(spark)))


@query("sch_12_proposed_schema", """
SELECT 'places.Country_Name' AS "left", 'people.country' AS "right", 'country' AS proposed_name,
  'categorical' AS proposed_type FROM customer HAVING count(*) > 0
UNION ALL SELECT 'places.region_code', 'people.region', 'keep both: region_code + region', 'integer'""")
def sch_12(spark, sf):
    return SC.proposed_schema(SC.match_columns(_two(spark, sf), _types(spark)))


@query("brw_08_describe_columns", """
SELECT * FROM (VALUES ('event_id', 'bigint', 'key'), ('ts', 'timestamp_ntz', 'temporal'),
  ('user_id', 'bigint', 'key'), ('event_type', 'string', 'dimension'), ('props', 'string', 'dimension'))
  AS t("column", type, role) WHERE (SELECT count(*) FROM events) > 0
UNION ALL SELECT 'value', 'double', CASE WHEN count(DISTINCT value) > 0.95 * count(value)
  THEN 'key' ELSE 'measure' END FROM events""")
def brw_08(spark, sf):
    return SC.describe_columns(stage.table(spark, sf, "events"))


@query("fn_09_clean_label", """
WITH w AS (SELECT DISTINCT replace(p_name, ' ', '_') || '-' || lower(p_type) AS name FROM part)
SELECT name, list_aggregate([upper(x[1]) || lower(x[2:]) FOR x IN
  string_split(replace(replace(name, '_', ' '), '-', ' '), ' ')], 'string_agg', ' ') AS label FROM w""")
def fn_09(spark, sf):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"), F.lower("p_type"))
    w = stage.table(spark, sf, "part").select(name.alias("name")).distinct()
    return w.select("name", X.clean_label(F.col("name")).alias("label"))


@query("fn_10_tokenise", """
WITH w AS (SELECT DISTINCT p_name, p_type FROM part)
SELECT p_name || ' ' || p_type AS name,
  list_aggregate([CASE WHEN length(x) > 3 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN x[:-2] ELSE x END
    FOR x IN string_split(lower(p_name || ' ' || p_type), ' ')], 'string_agg', '_') AS canonical FROM w""")
def fn_10(spark, sf):
    w = stage.table(spark, sf, "part").select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("k"),
                                              F.concat_ws(" ", "p_name", "p_type").alias("name")).distinct()
    return w.select("name", X.canonical_name(F.col("k")).alias("canonical"))


# --- versions and alerts ----------------------------------------------------

@query("ver_01_content_hash")
def ver_01(spark, sf):
    t = _t(spark, sf, "lineitem", "orders")
    return VE.describe(t).select("table", "content_hash").distinct()


@query("ver_02_describe_table", " UNION ALL ".join(f"""
SELECT 'orders' AS "table", count(*) AS n_rows, 6 AS n_columns, '{c}' AS "column", '{t}' AS dtype,
  count(*) FILTER (WHERE {c} IS NULL) AS n_nulls FROM orders""" for c, t in (
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
    ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"))))
def ver_02(spark, sf):
    return VE.describe_table(stage.table(spark, sf, "orders"), "orders").drop(
        "content_hash", "position")


def _versions(spark, sf):
    t = _t(spark, sf, "orders", "part", "nation", "region", "customer")
    old = VE.describe({"orders": t["orders"], "part": t["part"], "nation": t["nation"],
                       "region": t["region"]})
    new = VE.describe({
        "orders": t["orders"].filter("o_orderstatus <> 'P'").withColumn(
            "o_custkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey"))),
        "part": t["part"].drop("p_size").withColumn("p_colour", F.lit("red")).withColumn(
            "p_retailprice", F.col("p_retailprice").cast("string")),
        "nation": t["nation"], "customer": t["customer"]})
    return old, new


DIFF_SQL = """
WITH o AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'P') AS m,
  count(*) FILTER (WHERE o_orderstatus <> 'P' AND o_orderpriority = '5-LOW') AS k FROM orders),
d AS (
SELECT 'orders' AS "table", 'changed' AS status, n AS rows_before, m AS rows_after, m - n AS row_delta,
  '' AS columns_added, '' AS columns_removed, '' AS dtype_changes,
  'o_custkey: 0 -> ' || k AS null_changes, 1 AS n_null_columns_grown FROM o
UNION ALL SELECT 'part', 'changed', count(*), count(*), 0, 'p_colour', 'p_size',
  'p_retailprice: double -> string', '', 0 FROM part
UNION ALL SELECT 'nation', 'unchanged', count(*), count(*), 0, '', '', '', '', 0 FROM nation
UNION ALL SELECT 'region', 'removed', count(*), NULL, NULL, '', '', '', '', 0 FROM region
UNION ALL SELECT 'customer', 'added', NULL, count(*), NULL, '', '', '', '', 0 FROM customer)"""


@query("ver_04_diff_versions", DIFF_SQL + " SELECT * FROM d")
def ver_04(spark, sf):
    return VE.diff_versions(*_versions(spark, sf))


@query("mon_01_drift_alerts", DIFF_SQL + """
SELECT 'drift:rows:orders' AS id, 'critical' AS severity, 'lost rows' AS title,
  rows_before || ' -> ' || rows_after AS detail FROM d WHERE "table" = 'orders'
UNION ALL SELECT 'drift:nulls:orders', 'warning', 'nulls increased', null_changes FROM d WHERE "table" = 'orders'
UNION ALL SELECT 'drift:cols_removed:part', 'critical', 'columns disappeared', 'p_size'
UNION ALL SELECT 'drift:cols_added:part', 'warning', 'new columns', 'p_colour'
UNION ALL SELECT 'drift:dtypes:part', 'critical', 'dtypes changed', 'p_retailprice: double -> string'
UNION ALL SELECT 'drift:nation', 'info', 'unchanged', 'content hash identical'
UNION ALL SELECT 'drift:region', 'critical', 'table disappeared', ''
UNION ALL SELECT 'drift:customer', 'info', 'new table', rows_after || ' rows' FROM d WHERE "table" = 'customer'""")
def mon_01(spark, sf):
    return VE.drift_alerts(VE.diff_versions(*_versions(spark, sf))).drop("source")


ALERT_SQL = SUITE_SQL + """, al AS (
SELECT CASE WHEN rule_id = 'missing_table' THEN 'missing_table:absent' ELSE 'rule:lines.' || rule_id END AS id,
  CASE WHEN severity = 'error' THEN 'critical' ELSE 'warning' END AS severity FROM res
WHERE status <> 'pass' AND rule_id NOT IN ('no_such', 'bad_text')
UNION ALL SELECT 'rule:lines.no_such', 'critical' UNION ALL SELECT 'rule:lines.bad_text', 'critical')"""


@query("mon_02_validation_alerts", ALERT_SQL + " SELECT id, severity FROM al")
def mon_02(spark, sf):
    return VE.validation_alerts(suite(spark, sf)).select("id", "severity")


def _clean_alerts(spark, sf):
    from plumbline.operators import cleaning as CL
    problems = stage.table(spark, sf, "region").agg(F.lit("unconfigured").alias("kind"), F.lit(
        "region.csv").alias("file"), F.lit("no policy").alias("detail"))
    raw = messy(spark, sf)
    rejects = CL.rejected_cells(CL.quarantined_table(raw, POLICY))
    expect = CL.Policy("lines", POLICY.columns, drop=POLICY.drop, row_count_expected=7)
    return VE.cleaning_alerts(problems, rejects, CL.check_source(raw, expect))


CLEAN_ALERT_SQL = MESSY_WITH + """, n AS (SELECT
  count(DISTINCT CASE WHEN qty = 'many' THEN (rid, flag, price, shipped, zip, status, promo) END) AS x FROM messy)
SELECT 'source:unconfigured:region.csv' AS id, 'warning' AS severity FROM n
UNION ALL SELECT 'rejects:lines', 'warning' FROM n WHERE x > 0
UNION ALL SELECT 'rowcount:lines', 'critical' FROM messy HAVING count(*) <> 7"""


@query("mon_03_cleaning_alerts", CLEAN_ALERT_SQL)
def mon_03(spark, sf):
    return _clean_alerts(spark, sf).select("id", "severity")


@query("mon_04_alert_counts", ALERT_SQL + """
SELECT count(*) FILTER (WHERE severity = 'critical') AS n_critical,
  count(*) FILTER (WHERE severity = 'warning') AS n_warning, 0 AS n_info,
  count(*) FILTER (WHERE severity = 'critical') = 0 AS ok FROM al""")
def mon_04(spark, sf):
    return VE.alert_counts(VE.rank_alerts(VE.validation_alerts(suite(spark, sf))))


@query("mon_05_snapshot_history", """
WITH n AS (SELECT count(*) AS a, count(*) FILTER (WHERE o_orderstatus <> 'P') AS b FROM orders)
SELECT 'v1' AS version, a AS n_rows, CAST(NULL AS BIGINT) AS row_delta FROM n
UNION ALL SELECT 'v2', b, b - a FROM n UNION ALL SELECT 'v3', a, a - b FROM n""")
def mon_05(spark, sf):
    o = stage.table(spark, sf, "orders")
    parts = [VE.describe_table(d, "orders").withColumn("version", F.lit(v)) for v, d in (
        ("v1", o), ("v2", o.filter("o_orderstatus <> 'P'")), ("v3", o))]
    return VE.snapshot_history(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("dic_01_measure_columns", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_nulls,
  count(DISTINCT {c}) AS n_distinct,
  {"NULL" if c == "c_name" else f'''(SELECT string_agg(v, '|' ORDER BY n DESC, v) FROM (
     SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, v LIMIT 3))'''} AS examples,
  {f"string_agg(DISTINCT {c}, '|' ORDER BY {c})" if c == "c_mktsegment" else "NULL"} AS vocabulary,
  {f"CAST(min({c}) AS VARCHAR)" if c not in ("c_name", "c_mktsegment") else "NULL"} AS minimum
FROM customer""" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))
def dic_01(spark, sf):
    c = stage.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return DI.measure_columns(c, "customer", personal=["c_name"]).select(
        "column", "n_rows", "n_nulls", "n_distinct", "examples", "vocabulary", "minimum")


def _dictionary(spark, sf):
    from plumbline.operators import cleaning as CL
    policy = CL.Policy("part", (
        CL.ColumnRule("Part Key", "p_partkey", description="identifies a part"),
        CL.ColumnRule("Part Name", "p_name"), CL.ColumnRule("Brand", "p_brand"),
        CL.ColumnRule("Price", "p_retailprice", reason="kept as published")))
    rows = [("part name ", ": what the part is called"), ("Brand", "brand"), ("Weight", ": in grams")]
    glossary = DI.read_glossary(spark.range(1).select(F.explode(F.array(*[F.struct(
        F.lit(a).alias("field"), F.lit(b).alias("description")) for a, b in rows])).alias("r")).select("r.*"))
    rules = {"part": {"rules": [{"id": "priced", "type": "expression", "expr": "p_retailprice > 0"}]}}
    return DI.build_dictionary({"part": stage.table(spark, sf, "part")}, {"part": policy},
                               glossary, rules), glossary


@query("dic_02_build_dictionary", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_distinct, {d} AS description, '{r}' AS rules,
  {'TRUE' if ok else 'FALSE'} AS is_documented FROM part""" for c, d, r, ok in (
    ("p_partkey", "'identifies a part'", "", 1), ("p_name", "'What the part is called'", "", 1),
    ("p_brand", "NULL", "", 0), ("p_type", "NULL", "", 0), ("p_size", "NULL", "", 0),
    ("p_retailprice", "NULL", "priced (error)", 1))))
def dic_02(spark, sf):
    return _dictionary(spark, sf)[0].select("column", "n_distinct", "description", "rules",
                                            "is_documented")


@query("dic_03_dictionary_coverage", """
SELECT 6 AS n_fields, 3 AS n_documented, CAST(50 AS DOUBLE) AS coverage_pct,
  'part.p_brand, part.p_size, part.p_type' AS gaps, 'weight' AS unused FROM part HAVING count(*) > 0""")
def dic_03(spark, sf):
    fields, glossary = _dictionary(spark, sf)
    unused = DI.unused_glossary(fields, glossary).agg(F.max("key")).scalar()
    return DI.dictionary_coverage(fields).withColumn("unused", unused)


RULES = {"lines": {"min_rows": 10, "rules": [
    {"id": "priced", "type": "not_null", "column": "price"},
    {"id": "qty_known", "type": "not_null", "column": "quantity", "severity": "warn"}]}}


def _work(spark) -> str:
    """A new folder in the shared checkpoint directory, or locally in tests."""
    return f"{shared_folder(spark)}/publish-{uuid.uuid4().hex}"


@query("pip_01_publish", """
SELECT * FROM (VALUES ('drift:first', 'info'), ('rejects:lines', 'warning'),
  ('rule:lines.qty_known', 'warning')) AS t(id, severity) WHERE (SELECT count(*) FROM lineitem) > 0""")
def pip_01(spark, sf):
    work = _work(spark)
    done = publish.publish(spark, {"lines": messy(spark, sf)}, {"lines": POLICY}, RULES,
                           work + "/clean", work + "/snapshots")
    return done.alerts.select("id", "severity")


@query("pip_01_written_reports", SQL["cln_23_cleaning_actions"])
def pip_01_written(spark, sf):
    """The actions that a run has written beside its data."""
    work = _work(spark)
    done = publish.publish(spark, {"lines": messy(spark, sf)}, {"lines": POLICY}, RULES,
                           work + "/clean", work + "/snapshots")
    actions = publish.read_report(spark, work + "/snapshots", "actions", done.run)
    keep = F.concat_ws("@", "step", "column").isin(*["@".join(s) for s in CHECKED_STEPS])
    return actions.filter(keep).select("step", "column", "n")


@query("src_12_read_snapshot", """
SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def src_12(spark, sf):
    work = _work(spark)
    FI.write_snapshot(_t(spark, sf, "nation", "region"), work, version="20200101T000000")
    t = FI.read_snapshot(spark, work)
    return t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_name", "r_name")


@query("src_05_read_parquet", "SELECT * FROM orders")
def src_05(spark, sf):
    return FI.read_parquet(spark, f"{sf}/orders.parquet")


@query("src_01_read_delimited", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CASE WHEN p_size > 25 THEN '' ELSE 'NA' END AS note
FROM part""")
def src_01(spark, sf):
    work = _work(spark)
    p = stage.table(spark, sf, "part").select(
        "p_partkey", "p_name", F.when(F.col("p_size") > 25, "").otherwise("NA").alias("note"))
    p.write.option("header", "true").option("sep", ";").option("emptyValue", "").csv(work + "/part.csv")
    return FI.read_delimited(spark, work + "/part.csv")


@query("src_13_register_tables", """
SELECT 'orders' AS "view", count(*) AS n_rows, TRUE AS is_primary FROM orders
UNION ALL SELECT 'nation', count(*), FALSE FROM nation
UNION ALL SELECT 'nation_2', count(*), FALSE FROM region""")
def src_13(spark, sf):
    t = _t(spark, sf, "orders", "nation", "region")
    return FI.register_tables({"Orders.csv": t["orders"], "nation.csv": t["nation"],
                               "NATION": t["region"]})


# --- declarative jobs and bundles -------------------------------------------

@query("met_17_run_spec", WITH_ITEMS + f"""
SELECT country, {REVENUE} AS revenue, {MARGIN} AS margin_pct, count(*) AS n_lines FROM items
WHERE market = 'EUROPE' AND order_date >= TIMESTAMP '1996-01-01' AND order_date < TIMESTAMP '1998-01-01'
GROUP BY 1 ORDER BY sum(sales) {G} DESC LIMIT 3""")
def met_17(spark, sf):
    raw = {"metrics": ["Revenue", "margin pct"], "by": ["Country"],
           "where": {"market": ["europe"], "year": ["1997", "1996"]}, "limit": 3}
    return rounded(spec.run_spec(raw, C, stage.items(spark, sf, "geo", "product"))[0])


@query("met_17_run_spec_funnel", f"SELECT * EXCLUDE (category_key) FROM ({_funnel_sql('category')})")
def met_17f(spark, sf):
    raw = {"metrics": ["views", "orders"], "by": ["category"]}
    return rounded(spec.run_spec(raw, C, stage.items(spark, sf, "product"),
                                 stage.page_views(spark, sf))[0])


@query("brw_07_overview", WITH_ITEMS + f"""
SELECT department_name AS department, {REVENUE} AS revenue, count(*) AS n_lines FROM items GROUP BY 1""")
def brw_07(spark, sf):
    return rounded(dashboards.overview(stage.items(spark, sf, "geo", "product"), C)["by_department"])


@query("brw_07_delivery", WITH_ITEMS + """
SELECT market, shipping_mode, round(100.0 * count(*) FILTER (WHERE is_shipment_valid AND shipping_delay_days > 0)
  / nullif(count(*) FILTER (WHERE is_shipment_valid), 0), 4) AS late_pct, count(*) AS n_lines
FROM items GROUP BY 1, 2""")
def brw_07d(spark, sf):
    return rounded(dashboards.delivery(stage.items(spark, sf, "geo"), C)["grid"])


@query("brw_07_geography", WITH_ITEMS + f"""
SELECT country, {REVENUE} AS revenue, {MARGIN} AS margin_pct,
  count(DISTINCT order_id) {G} AS orders, count(*) AS n_lines FROM items GROUP BY 1""")
def brw_07g(spark, sf):
    return rounded(dashboards.geography(stage.items(spark, sf, "geo", "product"), C)["country"])


def _frames_sql(bundle: str) -> str:
    """UNION ALL of plain groupings, one for each frame."""
    own = dashboards.FRAMES[bundle]
    metrics = list(dict.fromkeys(m for shown, _ in own.values() for m in shown))
    dims = list(dict.fromkeys(d for _, by in own.values() for d in by))
    parts = [
        "SELECT '" + name + "' AS frame, "
        + ", ".join([*[f"{FRAME_DIMS[d] if d in by else 'NULL'} AS {d}" for d in dims],
                     *[f"{FRAME_METRICS[m] if m in shown else 'NULL'} AS {m}" for m in metrics]])
        + ", count(*) AS n_lines FROM items"
        + (" GROUP BY " + ", ".join(FRAME_DIMS[d] for d in by) if by else "")
        for name, (shown, by) in own.items()]
    return WITH_ITEMS + " UNION ALL ".join(parts)


FRAME_DIMS = {"month": "CAST(date_trunc('month', order_date) AS TIMESTAMP)", "market": "market",
              "country": "country", "segment": "segment", "department": "department_name",
              "category": "category_name", "product": "product_name",
              "shipping_mode": "shipping_mode", "delay_days": "shipping_delay_days"}
_R, _S = "FILTER (WHERE is_revenue_recognised)", "FILTER (WHERE is_shipment_valid)"
_LATE, _TIMELY = (f"FILTER (WHERE is_shipment_valid AND shipping_delay_days {op} 0)" for op in (">", "<="))
FRAME_METRICS = {
    "revenue": f"round(sum(sales) {_R}, 4)", "profit": f"round(sum(profit) {_R}, 4)",
    "margin_pct": f"round(100.0 * (sum(profit) {_R}) / nullif(sum(sales) {_R}, 0), 4)",
    "discount_pct": f"round(100.0 * (sum(discount) {_R}) / nullif(sum(sales) {_R}, 0), 4)",
    "orders": f"count(DISTINCT order_id) {_R}", "units": f"CAST(sum(quantity) {_R} AS BIGINT)",
    "aov": f"round((sum(sales) {_R}) / nullif(count(DISTINCT order_id) {_R}, 0), 4)",
    "shipped_lines": f"count(*) {_S}",
    "late_pct": f"round(100.0 * (count(*) {_LATE}) / nullif(count(*) {_S}, 0), 4)",
    "on_time_pct": f"round(100.0 * (count(*) {_TIMELY}) / nullif(count(*) {_S}, 0), 4)",
    "avg_delay_days": f"round(avg(shipping_delay_days) {_S}, 4)",
}


def _frames_query(bundle: str) -> None:
    @query(f"brw_07_{bundle}_frames", _frames_sql(bundle))
    def run(spark, sf):
        return rounded(dashboards.frames(stage.items(spark, sf), C, bundle))


for _bundle in dashboards.FRAMES:
    _frames_query(_bundle)


_NEVER = "SELECT '{0}' AS frame, product_key, views, orders FROM f WHERE {1}"


@query("brw_07_funnel_frames", "WITH f AS (" + SQL["jn_04_funnel_product"] + ") "
       + _NEVER.format("groups", "TRUE") + " UNION ALL "
       + _NEVER.format("viewed_never_ordered", "views > 0 AND orders = 0") + " UNION ALL "
       + _NEVER.format("ordered_never_viewed", "orders > 0 AND views = 0"))
def brw_07f(spark, sf):
    shown = dashboards.funnel(stage.items(spark, sf, "product"), stage.page_views(spark, sf))
    names = ("groups", "viewed_never_ordered", "ordered_never_viewed")
    out = [shown[n].select(F.lit(n).alias("frame"), "product_key", "views", "orders") for n in names]
    return out[0].unionByName(out[1]).unionByName(out[2])
