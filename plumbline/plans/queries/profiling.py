"""Profiling of a deliberately untidy text view of the orders table."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import numbers as N
from plumbline.functions import text as X
from plumbline.functions.dates import DATE_FORMATS, DAY_FIRST, MONTH_FIRST
from plumbline.operators import profiling as P
from plumbline.plans import stage
from plumbline.plans.queries import query
from plumbline.plans.queries.common import rounded, select_list

UNTIDY = """
  CASE WHEN o_orderkey % 50 = 0 THEN 'K-0' ELSE 'K-' || CAST(o_orderkey AS VARCHAR) END AS order_no,
  CASE o_orderstatus WHEN 'P' THEN 'Pending' WHEN 'F' THEN ' Done' ELSE 'done' END AS status,
  CASE o_orderkey % 10 WHEN 0 THEN '$' || CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR)
       WHEN 1 THEN CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) || ' EUR'
       WHEN 2 THEN 'tba' WHEN 3 THEN '(12.50)'
       ELSE CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) END AS amount,
  CASE WHEN o_custkey % 3 = 0 THEN '0.' || CAST(o_custkey % 10 AS VARCHAR)
       ELSE CAST(o_custkey % 100 AS VARCHAR) || '%' END AS rate,
  CASE o_custkey % 3 WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y')
       WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d')
       END AS ordered,
  CASE o_custkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'Y' ELSE 'N' END AS flag,
  CASE WHEN o_orderkey % 100 = 7 THEN 'many' ELSE CAST(o_custkey % 97 AS VARCHAR) END AS qty,
  CASE o_custkey % 5 WHEN 0 THEN 'Café' WHEN 1 THEN 'cafe' WHEN 2 THEN 'C.A.F.E'
       WHEN 3 THEN 'FranÃ§ais' ELSE 'Spain' END AS place,
  'x' AS fixed,
  CASE WHEN o_orderkey % 10 < 6 THEN '' ELSE 'v' || CAST(o_orderkey % 7 AS VARCHAR) END AS memo
"""
COLS = "order_no status amount rate ordered flag qty place fixed memo".split()
SPARK_LIST = select_list(
    UNTIDY.replace("VARCHAR", "STRING")
    .replace("strftime(o_orderdate, '%m/%d/%Y')", "date_format(o_orderdate, 'MM/dd/yyyy')")
    .replace("strftime(o_orderdate, '%d/%m/%Y')", "date_format(o_orderdate, 'dd/MM/yyyy')")
    .replace("strftime(o_orderdate, '%Y-%m-%d')", "date_format(o_orderdate, 'yyyy-MM-dd')"))


def untidy(spark, sf):
    return stage.table(spark, sf, "orders").selectExpr(*SPARK_LIST)


def _lit(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _re(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}')"


FORMATS = "[x FOR x IN [" + ", ".join(
    f"CASE WHEN try_strptime(value, '{f}') IS NOT NULL THEN '{f}' END" for f, _ in DATE_FORMATS
) + "] IF x IS NOT NULL]"
TAG = f"""CASE WHEN {_re('value', N.UUID)} THEN 'uuid' WHEN {_re('value', N.EMAIL)} THEN 'email'
  WHEN {_re('value', N.URL)} THEN 'url' WHEN {_re('value', N.PERCENT)} THEN 'percent'
  WHEN {_re('value', N.CURRENCY)} OR {_re('value', N.PAREN_NEGATIVE)} THEN 'currency'
  WHEN len(formats) > 0 THEN 'date' WHEN {_re('value', N.SCIENTIFIC)} THEN 'decimal'
  WHEN {_re('value', N.INT)} OR {_re('value', N.INT_GROUPED)} THEN 'integer'
  WHEN {_re('value', N.DECIMAL)} THEN 'decimal' WHEN {_re('value', N.PHONE)} THEN 'phone'
  ELSE 'text' END"""
NUMBER = """CASE WHEN value LIKE '(%' THEN -1 ELSE 1 END * TRY_CAST(regexp_replace(regexp_replace(
  value, '[$€%, ()]', '', 'g'), '(?i)(USD|EUR|GBP)$', '') AS DOUBLE)"""
FOLDED = ("regexp_replace(trim(lower(regexp_replace(strip_accents(value), '[^\\x00-\\x7F]', '', 'g'))), "
          "'[\\s_\\-.]+', '', 'g')")
PREF = "CASE tag " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(N.TYPE_TAGS)) + " END"

WITH = f"""WITH src AS (SELECT {UNTIDY} FROM orders),
raw AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, {c} AS v FROM src" for c in COLS) + f"""),
cells AS (SELECT col, v, trim(v) AS txt, count(*) AS n,
  CASE WHEN trim(v) = '' THEN 'blank' WHEN lower(trim(v)) IN ({_lit(X.PROFILE_SENTINELS)})
       THEN 'sentinel' ELSE 'present' END AS kind FROM raw GROUP BY ALL),
vc AS (SELECT col, txt AS value, sum(n) AS n FROM cells WHERE kind = 'present' GROUP BY ALL),
fm AS (SELECT *, CASE WHEN length(value) <= 40 AND (regexp_matches(value, '[-/. ]')
         OR regexp_full_match(value, '[0-9]{{8}}')) THEN {FORMATS} ELSE [] END AS formats FROM vc),
tagged AS (SELECT *, {TAG} AS tag FROM fm),
tally AS (SELECT col, tag, sum(n) AS n FROM tagged GROUP BY ALL),
per AS (SELECT col, CAST(sum(n) AS BIGINT) AS n_present, count(*) AS n_distinct,
  bool_and(lower(value) IN ({_lit(P.BOOLEAN_WORDS)})) AS is_bool FROM tagged GROUP BY 1),
best AS (SELECT col, tag, n FROM (SELECT *, row_number() OVER
         (PARTITION BY col ORDER BY n DESC, {PREF}) AS r FROM tally) WHERE r = 1),
money AS (SELECT col, sum(n) AS n FROM tally WHERE tag IN ('currency', 'decimal', 'integer')
  AND col IN (SELECT col FROM tally WHERE tag = 'currency') GROUP BY 1),
typed AS (SELECT p.*, CASE WHEN is_bool THEN 'boolean' WHEN m.col IS NOT NULL
    AND b.tag IN ('decimal', 'integer') THEN 'currency' ELSE b.tag END AS base_type,
  CASE WHEN is_bool THEN 100.0 WHEN m.col IS NOT NULL AND b.tag IN ('decimal', 'integer')
    THEN round(100.0 * m.n / n_present, 2) ELSE round(100.0 * b.n / n_present, 2) END AS conf
  FROM per p JOIN best b USING (col) LEFT JOIN money m USING (col)),
types AS (SELECT *, CASE WHEN base_type = 'text' AND n_distinct <= greatest(50, floor(0.05 * n_present))
    AND round(100.0 * n_distinct / n_present, 2) < 50 THEN 'categorical' ELSE base_type END
    AS inferred_type FROM typed),
nums AS (SELECT col, value, {NUMBER} AS x, n FROM tagged JOIN types USING (col)
  WHERE base_type IN ('integer', 'decimal', 'currency', 'percent')),
numrows AS (SELECT col, x, unnest(range(CAST(n AS BIGINT))) AS i FROM nums WHERE x IS NOT NULL),
numstat AS (SELECT col, count(*) AS n_numbers, min(x) AS mn, max(x) AS mx, avg(x) AS mean,
  stddev_pop(x) AS std, quantile_cont(x, 0.01) AS p01, quantile_cont(x, 0.25) AS q1,
  quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3, quantile_cont(x, 0.99) AS p99,
  count(*) FILTER (WHERE x = 0) AS n_zero, count(*) FILTER (WHERE x < 0) AS n_negative
  FROM numrows GROUP BY 1)
"""


def profiled(spark, sf):
    """Stages shared by the queries below; equal plans share what is kept."""
    return P.profile_table(untidy(spark, sf), "orders")


@query("prf_01_value_counts", WITH + 'SELECT col AS "column", value, CAST(n AS BIGINT) AS n FROM vc')
def prf_01(spark, sf):
    return P.value_counts(profiled(spark, sf).cells)


@query("prf_02_missing_profile", WITH + """
SELECT col AS "column", CAST(sum(n) AS BIGINT) AS n_rows,
  CAST(coalesce(sum(n) FILTER (WHERE kind = 'blank'), 0) AS BIGINT) AS n_blank,
  CAST(coalesce(sum(n) FILTER (WHERE kind = 'sentinel'), 0) AS BIGINT) AS n_sentinel,
  CAST(coalesce(sum(n) FILTER (WHERE kind = 'present'), 0) AS BIGINT) AS n_present,
  round(100.0 * coalesce(sum(n) FILTER (WHERE kind <> 'present'), 0) / sum(n), 2) AS missing_pct,
  coalesce(string_agg(txt || '=' || n, '|' ORDER BY txt) FILTER (WHERE kind = 'sentinel'), '')
    AS sentinel_forms FROM cells GROUP BY 1""")
def prf_02(spark, sf):
    out = P.missing_profile(profiled(spark, sf).cells)
    forms = F.array_join(F.transform(F.map_entries("sentinel_forms"), lambda e: F.concat_ws(
        "=", e["key"], e["value"].cast("string"))), "|")
    return out.select("column", "n_rows", "n_blank", "n_sentinel", "n_present", "missing_pct",
                      F.coalesce(forms, F.lit("")).alias("sentinel_forms"))


@query("prf_03_distinct_profile", WITH + """
SELECT col AS "column", (SELECT count(*) FROM orders) AS n_rows, n_present, n_distinct,
  round(100.0 * n_distinct / n_present, 2) AS distinct_pct, n_distinct = 1 AS is_constant,
  n_distinct = n_present AS is_unique,
  n_distinct = n_present AND n_present = (SELECT count(*) FROM orders) AS candidate_key FROM per""")
def prf_03(spark, sf):
    return P.distinct_profile(profiled(spark, sf).cells)


@query("prf_04_top_values", WITH + """
SELECT col AS "column", value, CAST(n AS BIGINT) AS n, rank FROM (SELECT *, row_number() OVER
  (PARTITION BY col ORDER BY n DESC, value) AS rank FROM vc) WHERE rank <= 10""")
def prf_04(spark, sf):
    return P.top_values(P.value_counts(profiled(spark, sf).cells))


@query("prf_05_distinct_sample", WITH + """
SELECT col AS "column", string_agg(value, '|' ORDER BY value) AS vocabulary FROM vc
GROUP BY 1 HAVING count(*) <= 200""")
def prf_05(spark, sf):
    out = P.distinct_sample(P.value_counts(profiled(spark, sf).cells), 200)
    return out.select("column", F.array_join("distinct_sample", "|").alias("vocabulary"))


@query("prf_06_classify_value", WITH + """
SELECT col AS "column", tag, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_values
FROM tagged GROUP BY ALL""")
def prf_06(spark, sf):
    return profiled(spark, sf).values.groupBy("column", "tag").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_values"))


@query("prf_07_matching_date_formats", WITH + """
SELECT value, list_aggregate(formats, 'string_agg', '|') AS formats FROM tagged
WHERE len(formats) > 0""")
def prf_07(spark, sf):
    return profiled(spark, sf).values.filter(F.size("formats") > 0).select(
        "value", F.array_join("formats", "|").alias("formats"))


@query("prf_08_infer_type", WITH + """
SELECT col AS "column", n_present, n_distinct, base_type, inferred_type, conf AS type_confidence
FROM types""")
def prf_08(spark, sf):
    return profiled(spark, sf).types.select(
        "column", "n_present", "n_distinct", "base_type", "inferred_type", "type_confidence")


DATES_SQL = WITH + f""",
d AS (SELECT col, formats, list_has_any(formats, [{_lit(MONTH_FIRST)}]) AS us,
      list_has_any(formats, [{_lit(DAY_FIRST)}]) AS eu FROM tagged WHERE len(formats) > 0),
dc AS (SELECT col, count(*) FILTER (WHERE us AND NOT eu) AS n_us_only,
      count(*) FILTER (WHERE eu AND NOT us) AS n_eu_only, count(*) FILTER (WHERE us AND eu) AS n_both
      FROM d GROUP BY 1)"""


@query("prf_09_date_order_profile", DATES_SQL + """
SELECT col AS "column", n_us_only, n_eu_only, n_both,
  CASE WHEN n_us_only > 0 AND n_eu_only = 0 THEN 'us' WHEN n_eu_only > 0 AND n_us_only = 0 THEN 'eu' END
    AS resolved,
  (n_us_only > 0 AND n_eu_only > 0) OR (n_both > 0 AND n_us_only = 0 AND n_eu_only = 0)
    AS order_ambiguous FROM dc""")
def prf_09(spark, sf):
    return P.date_order_profile(profiled(spark, sf).values).drop("date_formats")


@query("prf_10_currency_notations", WITH + """
SELECT col AS "column", regexp_extract(value, '([$€]|\\b(USD|EUR)\\b)', 1) AS notation,
  CAST(sum(n) AS BIGINT) AS n FROM tagged JOIN types USING (col)
WHERE base_type = 'currency' AND regexp_matches(value, '[$€]|\\b(USD|EUR)\\b') GROUP BY ALL""")
def prf_10(spark, sf):
    p = profiled(spark, sf)
    return P.currency_notations(p.values, p.types)


@query("prf_11_percent_scale_mixed", WITH + """
SELECT col AS "column", CAST(sum(n) FILTER (WHERE tag = 'percent') AS BIGINT) AS n_percent,
  CAST(coalesce(sum(n) FILTER (WHERE tag IN ('decimal', 'integer')), 0) AS BIGINT) AS n_bare,
  coalesce(sum(n) FILTER (WHERE tag IN ('decimal', 'integer')), 0) > 0 AS percent_scale_mixed
FROM tagged JOIN types USING (col) WHERE base_type = 'percent' GROUP BY 1""")
def prf_11(spark, sf):
    return P.percent_scale_mixed(profiled(spark, sf).types)


@query("prf_12_to_number", WITH + """
SELECT col AS "column", count(*) AS n_values, count(x) AS n_numbers, round(sum(x * n), 2) AS total
FROM nums GROUP BY 1""")
def prf_12(spark, sf):
    p = profiled(spark, sf)
    t, numeric = p.values, p.types.filter(F.col("base_type").isin(*P.NUMERIC_TYPES)).select("column")
    x = N.to_number(F.col("value"))
    return rounded(t.join(F.broadcast(numeric), "column", "left_semi").groupBy("column").agg(
        F.count(F.lit(1)).alias("n_values"), F.count(x).alias("n_numbers"),
        F.sum(x * F.col("n")).alias("total")), 2)


@query("prf_13_numeric_summary", WITH + """
SELECT col AS "column", n_numbers, round(mn, 4) AS "min", round(mx, 4) AS "max",
  round(mean, 4) AS mean, round(std, 4) AS std, round(p01, 4) AS p01, round(q1, 4) AS q1,
  round(med, 4) AS median, round(q3, 4) AS q3, round(p99, 4) AS p99, n_zero, n_negative FROM numstat""")
def prf_13(spark, sf):
    return rounded(profiled(spark, sf).summary.select(
        "column", "n_numbers", "min", "max", "mean", "std", "p01", "q1", "median", "q3", "p99",
        "n_zero", "n_negative"))


@query("prf_14_iqr_outliers", WITH + """,
o AS (SELECT col, n_numbers, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
      FROM numstat WHERE n_numbers >= 20)
SELECT col AS "column", n_numbers, round(lo, 4) AS lower_bound, round(hi, 4) AS upper_bound,
  count(*) FILTER (WHERE x < lo OR x > hi) AS n_outliers,
  count(*) FILTER (WHERE x < lo OR x > hi) > 0.10 * n_numbers AS is_skewed
FROM numrows JOIN o USING (col) GROUP BY col, n_numbers, lo, hi""")
def prf_14(spark, sf):
    p = profiled(spark, sf)
    return rounded(P.iqr_outliers(p.numbers, p.summary).drop("outlier_examples"))


MISMATCH_SQL = WITH + """,
bad AS (SELECT col, value, n FROM tagged JOIN types USING (col) WHERE NOT (
  (base_type IN ('integer', 'decimal') AND tag IN ('integer', 'decimal'))
  OR (base_type = 'currency' AND tag IN ('currency', 'integer', 'decimal'))
  OR (base_type = 'percent' AND tag IN ('percent', 'integer', 'decimal'))
  OR (base_type = 'boolean' AND tag IN ('boolean', 'integer', 'text')) OR tag = base_type))"""


@query("prf_15_type_mismatches", MISMATCH_SQL + """
SELECT col AS "column", CAST(sum(n) AS BIGINT) AS n_mismatch,
  (SELECT string_agg(value, '|' ORDER BY value) FROM (SELECT value FROM bad b2
     WHERE b2.col = bad.col ORDER BY value LIMIT 8)) AS mismatch_examples FROM bad GROUP BY 1""")
def prf_15(spark, sf):
    p = profiled(spark, sf)
    return P.type_mismatches(p.values, p.types).withColumn(
        "mismatch_examples", F.array_join("mismatch_examples", "|"))


@query("prf_16_label_variants", WITH + f"""
SELECT col AS "column", {FOLDED} AS folded, string_agg(value, '|' ORDER BY value) AS variants
FROM vc JOIN types USING (col) WHERE inferred_type IN ('categorical', 'text')
GROUP BY ALL HAVING count(*) > 1""")
def prf_16(spark, sf):
    p = profiled(spark, sf)
    return P.label_variants(p.values, p.types).withColumn(
        "variants", F.array_join("variants", "|"))


@query("prf_17_mojibake_cells", WITH + """
SELECT col AS "column", CAST(sum(n) AS BIGINT) AS n_mojibake,
  string_agg(v, '|' ORDER BY v) AS mojibake_examples
FROM cells WHERE kind = 'present' AND regexp_matches(v, 'Ã|Â|â|�|ï»¿') GROUP BY 1""")
def prf_17(spark, sf):
    return P.mojibake_cells(profiled(spark, sf).cells).withColumn(
        "mojibake_examples", F.array_join("mojibake_examples", "|"))


@query("prf_18_untidy_whitespace", WITH + """
SELECT col AS "column", CAST(coalesce(sum(n) FILTER (WHERE kind = 'present' AND v <> txt), 0) AS BIGINT)
  AS n_untidy FROM cells GROUP BY 1""")
def prf_18(spark, sf):
    return P.untidy_whitespace(profiled(spark, sf).cells)


@query("prf_19_near_unique_key", WITH + """
SELECT col AS "column", round(100.0 * n_distinct / n_present, 2) AS distinct_pct,
  n_present - n_distinct AS n_duplicates FROM types
WHERE round(100.0 * n_distinct / n_present, 2) >= 90 AND n_distinct < n_present
  AND inferred_type IN ('text', 'categorical', 'uuid')""")
def prf_19(spark, sf):
    p = profiled(spark, sf)
    return P.near_unique_key(P.distinct_profile(p.cells), p.types)


@query("prf_20_duplicate_rows", WITH + """,
p AS (SELECT status, flag, place, memo FROM src),
a AS (SELECT count(*) - count(DISTINCT (status, flag, place, memo)) AS n FROM p),
b AS (SELECT count(*) - count(DISTINCT (lower(trim(status)), lower(trim(flag)), lower(trim(place)),
      lower(trim(memo)))) AS n FROM p)
SELECT a.n AS n_exact, b.n AS n_normalised, b.n - a.n AS n_extra FROM a, b""")
def prf_20(spark, sf):
    return P.duplicate_rows(untidy(spark, sf).select("status", "flag", "place", "memo"))


@query("prf_21_empty_rows", WITH + "SELECT count(*) AS n_empty_rows FROM src WHERE trim(memo) = ''")
def prf_21(spark, sf):
    return P.empty_rows(untidy(spark, sf).select("memo", F.lit("  ").alias("pad")))


@query("prf_22_column_findings", MISMATCH_SQL + """,
m AS (SELECT col, sum(n) FILTER (WHERE kind <> 'present') AS miss, sum(n) AS total,
  sum(n) FILTER (WHERE kind = 'sentinel') AS sent,
  sum(n) FILTER (WHERE kind = 'present' AND v <> txt) AS untidy FROM cells GROUP BY 1),
f AS (
SELECT col, 'over half missing' AS finding, miss AS n FROM m WHERE 100.0 * miss / total >= 50
UNION ALL SELECT col, 'some missing', miss FROM m WHERE miss > 0 AND round(100.0 * miss / total, 2) < 50
UNION ALL SELECT col, 'nulls stored as text', sent FROM m WHERE sent > 0
UNION ALL SELECT col, 'untidy whitespace', untidy FROM m WHERE untidy > 0
UNION ALL SELECT col, 'type mismatch', sum(n) FROM bad GROUP BY 1
UNION ALL SELECT col, 'constant column', n_present FROM types WHERE n_distinct = 1
UNION ALL SELECT col, 'boolean spellings', n_distinct FROM types WHERE base_type = 'boolean' AND n_distinct > 2
UNION ALL SELECT col, 'near-unique key', n_present - n_distinct FROM types WHERE n_distinct < n_present
  AND round(100.0 * n_distinct / n_present, 2) >= 90 AND inferred_type = 'text')
SELECT 'orders' AS "table", col AS "column", finding, CAST(n AS BIGINT) AS n FROM f""")
def prf_22(spark, sf):
    shown = ["over half missing", "some missing", "nulls stored as text", "untidy whitespace",
             "type mismatch", "constant column", "boolean spellings", "near-unique key"]
    cols = profiled(spark, sf).columns()
    return P.column_findings(cols).filter(F.col("finding").isin(*shown))


@query("prf_23_profile_columns", MISMATCH_SQL + """,
m AS (SELECT col, sum(n) FILTER (WHERE kind = 'blank') AS b, sum(n) FILTER (WHERE kind = 'sentinel') AS s,
  sum(n) AS t FROM cells GROUP BY 1)
SELECT 'orders' AS "table", col AS "column", inferred_type, conf AS type_confidence,
  CAST(coalesce(b, 0) AS BIGINT) AS n_blank, CAST(coalesce(s, 0) AS BIGINT) AS n_sentinel,
  n_present, n_distinct, CAST(coalesce((SELECT sum(n) FROM bad WHERE bad.col = types.col), 0) AS BIGINT)
    AS n_mismatch, round(med, 4) AS median, round(mean, 4) AS mean
FROM types JOIN m USING (col) LEFT JOIN numstat USING (col)""")
def prf_23(spark, sf):
    return rounded(profiled(spark, sf).columns().select(
        "table", "column", "inferred_type", "type_confidence", "n_blank", "n_sentinel", "n_present",
        "n_distinct", "n_mismatch", "median", "mean"))


@query("prf_23_profile_table", """
SELECT 'part' AS "table", count(*) AS n_rows, 6 AS n_cols, 0 AS n_empty_rows,
  0 AS n_exact_duplicate_rows, 0 AS n_normalised_duplicate_rows,
  array_to_string([x FOR x IN [CASE WHEN count(DISTINCT p_partkey) = count(*) THEN 'p_partkey' END,
    CASE WHEN count(DISTINCT p_retailprice) = count(*) THEN 'p_retailprice' END] IF x IS NOT NULL], ',')
    AS candidate_keys FROM part""")
def prf_23t(spark, sf):
    return P.profile_table(stage.table(spark, sf, "part"), "part").table()


@query("prf_24_risk_register", MISMATCH_SQL + """,
m AS (SELECT col, 100.0 * sum(n) FILTER (WHERE kind <> 'present') / sum(n) AS pct,
  sum(n) FILTER (WHERE kind = 'sentinel') AS sent,
  sum(n) FILTER (WHERE kind = 'present' AND v <> txt) AS untidy FROM cells GROUP BY 1),
x AS (SELECT col, sum(bad.n) / any_value(n_present) AS share FROM bad JOIN types USING (col) GROUP BY 1)
SELECT severity, 'orders.' || col AS "where", risk FROM (
SELECT 'HIGH' AS severity, col, 'mostly missing' AS risk FROM m WHERE pct >= 50
UNION ALL SELECT 'MEDIUM', col, 'partly missing' FROM m WHERE round(pct, 2) >= 10 AND pct < 50
UNION ALL SELECT 'HIGH', col, 'nulls stored as text' FROM m WHERE sent > 0
UNION ALL SELECT 'MEDIUM', col, 'untidy whitespace' FROM m WHERE untidy > 0
UNION ALL SELECT 'BLOCKER', col, 'over a fifth does not fit the type' FROM x WHERE share > 0.20
UNION ALL SELECT 'HIGH', col, 'values do not fit the type' FROM x WHERE share > 0.02 AND share <= 0.20
UNION ALL SELECT 'BLOCKER', 'rate', 'mixed percent scale'
UNION ALL SELECT 'BLOCKER', 'amount', 'mixed currencies'
UNION ALL SELECT 'BLOCKER', 'ordered', 'day/month order unknown'
UNION ALL SELECT 'LOW', 'fixed', 'constant column')""")
def prf_24(spark, sf):
    p = profiled(spark, sf)
    shown = ["mostly missing", "partly missing", "nulls stored as text", "untidy whitespace",
             "over a fifth does not fit the type", "values do not fit the type",
             "mixed percent scale", "mixed currencies", "day/month order unknown",
             "constant column"]
    return P.risk_register(p.columns(), p.table()).filter(F.col("risk").isin(*shown)).select(
        "severity", "where", "risk")


# --- scalar functions on values ---------------------------------------------

@query("fn_02_is_sentinel", WITH + f"""
SELECT col AS "column", v AS value, lower(trim(v)) IN ({_lit(X.PROFILE_SENTINELS)}) AS is_sentinel,
  CAST(n AS BIGINT) AS n FROM cells""")
def fn_02(spark, sf):
    c = profiled(spark, sf).cells
    return c.select("column", "value", X.is_sentinel(F.col("value")).alias("is_sentinel"), "n")


@query("fn_03_looks_numeric", WITH + f"""
SELECT col AS "column", count(*) AS n_values, count(*) FILTER (WHERE {_re('value', N.PAREN_NEGATIVE)}
  OR regexp_full_match(regexp_replace(value, '[$€%, ]', '', 'g'), '[+-]?([0-9]+|[0-9]+\\.[0-9]*|\\.[0-9]+)'))
  AS n_numeric FROM vc GROUP BY 1""")
def fn_03(spark, sf):
    vc = P.value_counts(profiled(spark, sf).cells)
    return vc.groupBy("column").agg(F.count(F.lit(1)).alias("n_values"), F.count_if(
        N.looks_numeric(F.col("value"))).alias("n_numeric"))


@query("fn_04_normalise_category", f"""
WITH w AS (SELECT DISTINCT unnest(string_split(regexp_replace(text, '[^a-zA-ZÀ-ÿ.\\-_ ]', ' ', 'g'), ' ')) AS value
           FROM documents)
SELECT value, {FOLDED} AS folded FROM w""")
def fn_04(spark, sf):
    w = stage.table(spark, sf, "documents").select(F.explode(F.split(
        F.regexp_replace("text", r"[^a-zA-ZÀ-ÿ.\-_ ]", " "), " ")).alias("value")).distinct()
    return w.select(
        "value", X.normalise_category(F.col("value")).alias("folded"))
