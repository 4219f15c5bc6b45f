"""Policy cleaning and schema-free cleaning over deliberately damaged tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import cleaning as CL
from plumbline.operators import upload as U
from plumbline.plans import stage
from plumbline.plans.queries import query
from plumbline.plans.queries.common import rounded, select_list
from plumbline.session import spread

# The same damage in both dialects; every cell is text.
MESSY = """
  CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS rid,
  CASE l_linenumber WHEN 1 THEN '  ' || l_returnflag || ' ' WHEN 2 THEN lower(l_returnflag)
       ELSE l_returnflag END AS flag,
  CASE l_linenumber WHEN 3 THEN 'many' WHEN 4 THEN 'N/A'
       ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS qty,
  CASE l_linenumber WHEN 5 THEN ''
       ELSE CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS VARCHAR) END AS price,
  CASE l_linenumber WHEN 2 THEN strftime(l_shipdate, '%m/%d/%Y %H:%M')
       WHEN 6 THEN 'soon' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS shipped,
  CAST(l_suppkey AS VARCHAR) AS zip,
  CASE l_linestatus WHEN 'O' THEN 'open   order' ELSE 'CANCELED' END AS status,
  CASE WHEN l_linenumber = 7 THEN 'West' ELSE 'Springfield' END AS city,
  CASE WHEN l_linenumber = 7 THEN '91' WHEN l_linenumber = 1 THEN 'west' ELSE 'East' END AS region,
  CASE WHEN l_linenumber = 7 THEN '' ELSE 'z' END AS area,
  CASE WHEN l_discount > 0.05 THEN 'Yes' WHEN l_discount > 0.03 THEN 'F' ELSE 'maybe' END AS promo,
  'note' AS note
"""
MESSY_SPARK = (MESSY.replace("VARCHAR", "STRING")
               .replace("strftime(l_shipdate, '%m/%d/%Y %H:%M')",
                        "date_format(l_shipdate, 'MM/dd/yyyy HH:mm')")
               .replace("strftime(l_shipdate, '%Y-%m-%d')", "date_format(l_shipdate, 'yyyy-MM-dd')"))
MESSY_LIST = select_list(MESSY_SPARK)
COLS = "rid flag qty price shipped zip status city region area promo note".split()
NULLS = ("'', '-', '--', 'n/a', 'na', 'n.a.', 'nan', 'null', 'none', 'nil', 'unknown', "
         "'unspecified', 'not available', 'not applicable', '?', '#n/a'")


def _norm(c: str) -> str:
    t = f"regexp_replace(trim({c}), '\\s+', ' ', 'g')"
    return f"CASE WHEN lower({t}) NOT IN ({NULLS}) THEN {t} END AS {c}"


WITH = f"WITH messy AS (SELECT {MESSY} FROM lineitem)"
NORMAL = WITH + ", norm AS (SELECT " + ", ".join(_norm(c) for c in COLS) + " FROM messy)"


def messy(spark, sf):
    return spread(stage.table(spark, sf, "lineitem")).selectExpr(*MESSY_LIST)


def normal(spark, sf):
    return CL.normalise_text(messy(spark, sf))


def tally(df, *cols):
    """Distinct combinations and their counts: whole tables, small output."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


# --- policy steps -----------------------------------------------------------

@query("cln_01_normalise_text", NORMAL + """
SELECT flag, qty, status, area, count(*) AS n FROM norm GROUP BY ALL""")
def cln_01(spark, sf):
    return tally(normal(spark, sf), "flag", "qty", "status", "area")


@query("cln_01_normalise_counts", WITH + " " + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) FILTER (WHERE trim({c}) <> {c}) AS trim_whitespace,
       count(*) FILTER (WHERE regexp_replace(trim({c}), '\\s+', ' ', 'g') <> trim({c}))
         AS collapse_spaces,
       count(*) FILTER (WHERE lower(regexp_replace(trim({c}), '\\s+', ' ', 'g')) IN ({NULLS}))
         AS sentinel_null FROM messy""" for c in COLS))
def cln_01c(spark, sf):
    return CL.normalise_counts(messy(spark, sf))


SHIFT_SQL = NORMAL + """, fixed AS (
SELECT rid, region, CASE WHEN hit THEN NULL ELSE city END AS c1,
       CASE WHEN hit THEN city ELSE region END AS c2, CASE WHEN hit THEN region ELSE area END AS c3
FROM (SELECT *, (area IS NULL OR trim(area) = '')
                AND coalesce(regexp_full_match(region, '[0-9]+'), FALSE) AS hit FROM norm))"""


@query("cln_02_row_fix_shift_right", SHIFT_SQL + """
SELECT c1 AS city, c2 AS region, c3 AS area, count(*) AS n FROM fixed GROUP BY ALL""")
def cln_02(spark, sf):
    fixed = CL.shift_right(normal(spark, sf), "area is blank and region matches [0-9]+",
                           ["city", "region", "area"])
    return tally(fixed, "city", "region", "area")


@query("cln_03_map_values", NORMAL + """
SELECT CASE region WHEN 'west' THEN 'Occident' WHEN 'West' THEN 'Occident' WHEN '91' THEN '91st'
       ELSE region END AS region, count(*) AS n FROM norm GROUP BY 1""")
def cln_03(spark, sf):
    # west -> West -> Occident composes
    return tally(CL.map_values(normal(spark, sf), "region",
                               {"west": "West", "West": "Occident", "91": "91st"}), "region")


@query("cln_04_map_values_by", NORMAL + """
SELECT CASE WHEN zip = '1' THEN 'One' WHEN zip = '2' THEN 'Two' ELSE city END AS city,
       count(*) AS n FROM norm GROUP BY 1""")
def cln_04(spark, sf):
    return tally(CL.map_values_by(normal(spark, sf), "city", "zip", {"1": "One", "2": "Two"}), "city")


@query("cln_05_drop_columns", NORMAL + """
SELECT status, promo, count(*) AS n FROM (SELECT * EXCLUDE (note, area) FROM norm) GROUP BY ALL""")
def cln_05(spark, sf):
    return tally(normal(spark, sf).drop("note", "area"), "status", "promo")


@query("cln_06_dedupe_exact", """
SELECT l_orderkey, l_linenumber, l_returnflag, min(l_partkey) AS l_partkey
FROM lineitem GROUP BY ALL""")
def cln_06(spark, sf):
    li = stage.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    return CL.dedupe_exact(li, order=["l_partkey"])


@query("cln_07_dedupe_subset", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
         ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def cln_07(spark, sf):
    li = stage.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return CL.dedupe_subset(li, ["l_orderkey", "l_linenumber"],
                            ["l_partkey", "l_suppkey", "l_extendedprice"])


@query("cln_08_coerce_integer", NORMAL + """
SELECT qty, CASE WHEN regexp_full_match(qty, '[+-]?[0-9]+') THEN CAST(qty AS BIGINT) END AS value,
       count(*) AS n FROM norm GROUP BY ALL""")
def cln_08(spark, sf):
    return tally(normal(spark, sf).withColumn("value", CL.coerce_integer(F.col("qty"))),
                 "qty", "value")


@query("cln_09_coerce_number", NORMAL + """
SELECT status, count(TRY_CAST(price AS DOUBLE)) AS n_typed, count(*) AS n,
       round(sum(TRY_CAST(price AS DOUBLE)), 2) AS total FROM norm GROUP BY 1""")
def cln_09(spark, sf):
    v = CL.coerce_number(F.col("price"), 2)
    return rounded(normal(spark, sf).groupBy("status").agg(
        F.count(v).alias("n_typed"), F.count(F.lit(1)).alias("n"), F.sum(v).alias("total")), 2)


@query("cln_10_coerce_datetime", NORMAL + """
SELECT coalesce(CASE WHEN regexp_full_match(shipped, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}')
                     THEN try_strptime(shipped, '%Y-%m-%d') END,
                CASE WHEN regexp_full_match(shipped, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{1,2}')
                     THEN try_strptime(shipped, '%m/%d/%Y %H:%M') END) AS shipped,
       count(*) AS n FROM norm GROUP BY 1""")
def cln_10(spark, sf):
    out = CL.coerce_datetime(F.col("shipped"), ["%Y-%m-%d", "%m/%d/%Y %H:%M"])
    return tally(normal(spark, sf).withColumn("shipped", out), "shipped")


@query("cln_11_coerce_boolean", NORMAL + """
SELECT promo, CASE WHEN lower(promo) IN ('1', 'true', 't', 'yes', 'y') THEN TRUE
                   WHEN lower(promo) IN ('0', 'false', 'f', 'no', 'n') THEN FALSE END AS value,
       count(*) AS n FROM norm GROUP BY ALL""")
def cln_11(spark, sf):
    return tally(normal(spark, sf).withColumn("value", CL.coerce_boolean(F.col("promo"))),
                 "promo", "value")


POLICY = CL.Policy(
    table="lines",
    columns=(
        CL.ColumnRule("rid", "line_id", "integer"),
        CL.ColumnRule("flag", "flag", "category", transform="upper"),
        CL.ColumnRule("qty", "quantity", "integer"),
        CL.ColumnRule("price", "price", "money", nulls="drop_row"),
        CL.ColumnRule("shipped", "shipped_on", "datetime"),
        CL.ColumnRule("zip", "zip_code", "text", transform="zero_pad", width=7),
        CL.ColumnRule("status", "status", "category"),
        CL.ColumnRule("city", "city", "category", nulls="impute_constant", fill="unplaced"),
        CL.ColumnRule("region", "region", "category"),
        CL.ColumnRule("promo", "is_promo", "boolean"),
    ),
    key_columns=("line_id",),
    date_formats=("%Y-%m-%d", "%m/%d/%Y %H:%M"),
    row_fixes=(CL.RowFix("shifted", "area is blank and region matches [0-9]+",
                         ("city", "region", "area")),),
    value_maps={"region": {"west": "West"}},
    drop={"note": "free text", "area": "only needed for the repair"},
    derived=(
        CL.DerivedRule("unit_price", "float", "try_divide(price, quantity)",
                       null_when="quantity = 0"),
        CL.DerivedRule("is_revenue", "boolean", "status <> 'CANCELED'"),
    ),
    deduplicate="exact_rows",
)

# The policy written out once more by hand.
DEDUPED_SQL = NORMAL + """, fixed AS (
SELECT rid, flag, qty, price, shipped, zip, status, promo,
       CASE WHEN hit THEN NULL ELSE city END AS city,
       CASE WHEN hit THEN city WHEN region = 'west' THEN 'West' ELSE region END AS region
FROM (SELECT *, area IS NULL AND coalesce(regexp_full_match(region, '[0-9]+'), FALSE) AS hit
      FROM norm)),
dedup AS (SELECT DISTINCT * FROM fixed),
typed AS (SELECT CAST(rid AS BIGINT) AS line_id, upper(flag) AS flag,
       CASE WHEN regexp_full_match(qty, '[+-]?[0-9]+') THEN CAST(qty AS BIGINT) END AS quantity,
       TRY_CAST(price AS DOUBLE) AS price,
       coalesce(try_strptime(shipped, '%Y-%m-%d'), try_strptime(shipped, '%m/%d/%Y %H:%M'))
         AS shipped_on,
       lpad(zip, 7, '0') AS zip_code, status, city, region,
       CASE WHEN lower(promo) = 'yes' THEN TRUE WHEN lower(promo) = 'f' THEN FALSE END AS is_promo,
       rid, qty, shipped, promo
FROM dedup)"""


@query("cln_12_quarantine_cells", DEDUPED_SQL + "".join(f"""{' UNION ALL' if i else ''}
SELECT 'lines' AS "table", rid AS row_key, '{clean}' AS "column", '{src}' AS source_column,
       '{typ}' AS declared_type, {src} AS raw_value,
       'does not match declared type {typ}' AS reason FROM typed
WHERE {src} IS NOT NULL AND {clean} IS NULL""" for i, (src, clean, typ) in enumerate(
    [("qty", "quantity", "integer"), ("shipped", "shipped_on", "datetime"),
     ("promo", "is_promo", "boolean")])))
def cln_12(spark, sf):
    return CL.rejected_cells(CL.quarantined_table(messy(spark, sf), POLICY))


@query("cln_13_zero_pad", NORMAL + "SELECT lpad(zip, 6, '0') AS zip, count(*) AS n FROM norm GROUP BY 1")
def cln_13(spark, sf):
    return tally(normal(spark, sf).withColumn("zip", CL.zero_pad(F.col("zip"), 6)), "zip")


@query("cln_14_casing", NORMAL + """
SELECT upper(status) AS up, lower(status) AS down,
       CASE status WHEN 'open order' THEN 'Open Order' ELSE 'Canceled' END AS title,
       count(*) AS n FROM norm GROUP BY ALL""")
def cln_14(spark, sf):
    from plumbline.functions.text import title_case
    c = F.col("status")
    few = tally(normal(spark, sf), "status")
    return few.select(F.upper(c).alias("up"), F.lower(c).alias("down"),
                      title_case(c).alias("title"), "n")


@query("cln_15_null_keep", NORMAL + """
SELECT 'nulls:keep_null' AS step, 'price' AS "column", count(*) FILTER (WHERE price IS NULL) AS n
FROM norm UNION ALL
SELECT 'nulls:not_applicable', 'area', count(*) FILTER (WHERE area IS NULL) FROM norm""")
def cln_15(spark, sf):
    policy = CL.Policy("t", (CL.ColumnRule("price", "price"),
                             CL.ColumnRule("area", "area", nulls="not_applicable")))
    acts = CL.cleaning_actions(messy(spark, sf).select("price", "area"), policy)
    return acts.filter(F.col("step").startswith("nulls:")).select("step", "column", "n")


@query("cln_16_null_drop_row", NORMAL + """
SELECT status, count(*) AS n FROM norm WHERE price IS NOT NULL GROUP BY 1""")
def cln_16(spark, sf):
    return tally(CL.drop_null_rows(normal(spark, sf), "price"), "status")


@query("cln_17_impute_constant", NORMAL + """
SELECT coalesce(area, 'none given') AS area, coalesce(TRY_CAST(qty AS BIGINT), 0) AS quantity,
       count(*) AS n FROM norm GROUP BY ALL""")
def cln_17(spark, sf):
    d = normal(spark, sf).select("area", CL.coerce_integer(F.col("qty")).alias("quantity"))
    return tally(CL.impute_zero(CL.impute_constant(d, "area", "none given"), "quantity"),
                 "area", "quantity")


@query("cln_18_impute_median", NORMAL + """,
v AS (SELECT status, TRY_CAST(price AS DOUBLE) AS price FROM norm)
SELECT status, round(sum(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM v))), 2) AS total,
       count(*) AS n FROM v GROUP BY 1""")
def cln_18(spark, sf):
    d = normal(spark, sf).select("status", CL.coerce_number(F.col("price"), 2).alias("price"))
    return rounded(CL.impute_median(d, "price").groupBy("status").agg(
        F.sum("price").alias("total"), F.count(F.lit(1)).alias("n")), 2)


@query("cln_19_impute_mode", NORMAL + """,
v AS (SELECT TRY_CAST(qty AS BIGINT) AS qty FROM norm),
m AS (SELECT qty FROM v WHERE qty IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, qty LIMIT 1)
SELECT coalesce(qty, (SELECT qty FROM m)) AS qty, count(*) AS n FROM v GROUP BY 1""")
def cln_19(spark, sf):
    d = normal(spark, sf).select(CL.coerce_integer(F.col("qty")).alias("qty"))
    return tally(CL.impute_mode(d, "qty"), "qty")


@query("cln_20_derive", """
SELECT l_returnflag,
       round(sum(CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END), 2) AS rate_sum,
       CAST(sum(floor((l_linenumber - 4) / 3.0)) AS BIGINT) AS floor_sum,
       CAST(sum((l_linenumber - 4) - 3 * floor((l_linenumber - 4) / 3.0)) AS BIGINT) AS mod_sum,
       count(*) FILTER (WHERE l_linestatus NOT IN ('O')) AS n_closed
FROM lineitem GROUP BY 1""")
def cln_20(spark, sf):
    li = stage.table(spark, sf, "lineitem")
    shift, three = F.col("l_linenumber") - 4, F.lit(3)
    for rule in (
        CL.DerivedRule("rate", "float", "try_divide(l_discount, l_tax)", null_when="l_tax = 0"),
        CL.DerivedRule("fl", "integer", CL.floor_divide(shift, three)),
        CL.DerivedRule("md", "integer", CL.modulo(shift, three)),
        CL.DerivedRule("closed", "boolean", ~CL.is_in(F.col("l_linestatus"), ["O"])),
    ):
        li = CL.derive(li, rule)
    return rounded(li.groupBy("l_returnflag").agg(
        F.sum("rate").alias("rate_sum"), F.sum("fl").alias("floor_sum"),
        F.sum("md").alias("mod_sum"), F.count_if("closed").alias("n_closed")), 2)


@query("cln_21_surrogate_key", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS order_no FROM orders""")
def cln_21(spark, sf):
    o = stage.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return CL.surrogate_key(o, "order_no", ["o_orderdate", "o_orderkey"]).select(
        "o_orderkey", "order_no")


@query("cln_22_order_columns", """
SELECT string_agg(c, ',') AS names, (SELECT count(*) FROM part) AS n_rows FROM
 (VALUES ('p_type'), ('p_partkey'), ('p_name'), ('p_brand'), ('p_size'), ('p_retailprice')) t(c)""")
def cln_22(spark, sf):
    out = CL.order_columns(stage.table(spark, sf, "part"), ["p_type"])
    return out.agg(F.lit(",".join(out.columns)).alias("names"), F.count(F.lit(1)).alias("n_rows"))


CHECKED_STEPS = (
    ("reject_cell", "quantity"), ("reject_cell", "is_promo"), ("deduplicate", "<table>"),
    ("nulls:drop_row", "price"), ("nulls:impute_constant", "city"), ("transform:zero_pad", "zip_code"),
    ("row_fix:shifted", "city, region, area"), ("value_map:west", "region"), ("type", "shipped_on"))


@query("cln_23_cleaning_actions", DEDUPED_SQL + """,
acts AS (
SELECT 'reject_cell' AS step, 'quantity' AS "column",
       count(*) FILTER (WHERE qty IS NOT NULL AND quantity IS NULL) AS n FROM typed
UNION ALL SELECT 'reject_cell', 'is_promo',
       count(*) FILTER (WHERE promo IS NOT NULL AND is_promo IS NULL) FROM typed
UNION ALL SELECT 'deduplicate', '<table>', (SELECT count(*) FROM fixed) - count(*) FROM typed
UNION ALL SELECT 'nulls:drop_row', 'price', count(*) FILTER (WHERE price IS NULL) FROM typed
UNION ALL SELECT 'nulls:impute_constant', 'city',
       count(*) FILTER (WHERE price IS NOT NULL AND city IS NULL) FROM typed
UNION ALL SELECT 'transform:zero_pad', 'zip_code', count(*) FROM typed
UNION ALL SELECT 'row_fix:shifted', 'city, region, area',
       (SELECT count(*) FROM norm WHERE area IS NULL AND regexp_full_match(region, '[0-9]+'))
UNION ALL SELECT 'value_map:west', 'region', (SELECT count(*) FROM norm WHERE region = 'west')
UNION ALL SELECT 'type', 'shipped_on', count(shipped_on) FROM typed)
SELECT * FROM acts""")
def cln_23(spark, sf):
    acts = CL.cleaning_actions(messy(spark, sf), POLICY)
    keep = F.concat_ws("@", "step", "column").isin(*["@".join(s) for s in CHECKED_STEPS])
    return acts.filter(keep).select("step", "column", "n")


@query("cln_24_check_source", """
SELECT 'part' AS "table", 'row_count' AS kind,
       CAST(count(*) AS VARCHAR) || ' rows, expected 7' AS detail FROM part
UNION ALL SELECT 'part', 'unknown_column', 'p_name, p_brand, p_type, p_size, p_retailprice'
UNION ALL SELECT 'part', 'absent_column', 'p_colour'
UNION ALL SELECT 'part', 'encoding', 'policy pins cp1252, file read as utf-8'
UNION ALL SELECT 'part', 'absent_drop', 'p_memo'""")
def cln_24(spark, sf):
    policy = CL.Policy("part", (CL.ColumnRule("p_partkey", "part_id"),
                                CL.ColumnRule("p_colour", "colour")),
                       drop={"p_memo": ""}, encoding="cp1252", row_count_expected=7)
    return CL.check_source(stage.table(spark, sf, "part"), policy, "utf-8")


@query("cln_25_clean_table", DEDUPED_SQL + """
SELECT line_id, flag, quantity, price, shipped_on, zip_code, status,
       coalesce(city, 'unplaced') AS city, region, is_promo,
       CASE WHEN quantity <> 0 THEN round(price / quantity, 8) END AS unit_price,
       status <> 'CANCELED' AS is_revenue
FROM typed WHERE price IS NOT NULL""")
def cln_25(spark, sf):
    return rounded(CL.clean_table(messy(spark, sf), POLICY).clean, 8)


# --- schema-free cleaning ---------------------------------------------------

UPLOAD = """
  l_orderkey, l_linenumber,
  CASE WHEN l_linenumber = 2 THEN ' ' || l_shipmode_ || ' ' ELSE l_shipmode_ END AS mode,
  CASE WHEN l_linenumber = 7 THEN 'TBC'
       ELSE '$' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.50' END AS fee,
  CASE WHEN l_linenumber = 7 THEN 'n/d'
       ELSE CAST(CAST(l_discount * 100 AS BIGINT) AS VARCHAR) || ' %' END AS cut,
  CAST(CAST(l_partkey AS BIGINT) % 9 + 1 AS VARCHAR) || ',' ||
    lpad(CAST(CAST(l_suppkey AS BIGINT) % 1000 AS VARCHAR), 3, '0') AS units,
  CASE WHEN l_linenumber <= 3 THEN '$5' ELSE 'five' END AS mixed
""".replace("l_shipmode_", "l_returnflag")
UWITH = f"WITH up AS (SELECT {UPLOAD} FROM lineitem)"


def uploaded(spark, sf):
    text = UPLOAD.replace("VARCHAR", "STRING")
    return spread(stage.table(spark, sf, "lineitem")).selectExpr(*select_list(text))


@query("ucl_01_trim_cells", UWITH + """
SELECT trim(mode) AS mode, cut, count(*) AS n FROM up GROUP BY ALL""")
def ucl_01(spark, sf):
    return tally(U.trim_cells(uploaded(spark, sf)), "mode", "cut")


@query("ucl_02_null_sentinels", UWITH + """
SELECT CASE WHEN lower(trim(cut)) <> 'n/d' THEN cut END AS cut, count(*) AS n FROM up GROUP BY 1""")
def ucl_02(spark, sf):
    return tally(U.null_sentinels(uploaded(spark, sf)), "cut")


@query("ucl_02_cell_counts", UWITH + " " + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) FILTER (WHERE trim({c}) <> {c}) AS n_trimmed,
       count(*) FILTER (WHERE lower(trim({c})) = 'n/d') AS n_sentinel FROM up"""
       for c in ("mode", "fee", "cut", "units", "mixed")))
def ucl_02c(spark, sf):
    return U.cell_counts(uploaded(spark, sf))


def _number_sql(column: str, strip: str) -> str:
    return UWITH + f"""
SELECT TRY_CAST(regexp_replace({column}, '{strip}', '', 'g') AS DOUBLE) AS {column},
       mixed, count(*) AS n FROM up GROUP BY ALL"""


@query("ucl_03_coerce_currency", _number_sql("fee", "[$, ]"))
def ucl_03(spark, sf):
    # 'mixed' is only partly money, so it stays text
    return tally(U.coerce_currency(U.null_sentinels(uploaded(spark, sf))), "fee", "mixed")


@query("ucl_04_coerce_percent", _number_sql("cut", "[% ]"))
def ucl_04(spark, sf):
    return tally(U.coerce_percent(U.null_sentinels(uploaded(spark, sf))), "cut", "mixed")


@query("ucl_05_coerce_grouped_number", _number_sql("units", "[, ]"))
def ucl_05(spark, sf):
    return tally(U.coerce_grouped_number(U.null_sentinels(uploaded(spark, sf))), "units", "mixed")


@query("ucl_06_count_duplicate_rows", """
SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicate_rows
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber, l_returnflag)""")
def ucl_06(spark, sf):
    return U.count_duplicate_rows(stage.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag"))


CLEANED_SQL = UWITH + """,
c AS (SELECT l_orderkey, l_linenumber, trim(mode) AS mode,
             TRY_CAST(regexp_replace(fee, '[$, ]', '', 'g') AS DOUBLE) AS fee,
             TRY_CAST(regexp_replace(cut, '[% ]', '', 'g') AS DOUBLE) AS cut,
             CAST(replace(units, ',', '') AS DOUBLE) AS units, mixed FROM up)"""
UCOLS = ("l_orderkey", "l_linenumber", "mode", "fee", "cut", "units", "mixed")


@query("ucl_07_dataset_profile", CLEANED_SQL + f"""
SELECT n_rows, 7 AS n_cols, n_rows * 7 AS n_cells, miss AS n_missing_cells,
       round(100.0 * miss / (n_rows * 7), 2) AS missing_pct,
       round(100.0 - round(100.0 * miss / (n_rows * 7), 2), 1) AS quality_score,
       '' AS candidate_keys
FROM (SELECT count(*) AS n_rows, {' + '.join(f'count(*) FILTER (WHERE {c} IS NULL)' for c in UCOLS)}
      AS miss FROM c)""")
def ucl_07(spark, sf):
    return U.dataset_profile(U.clean_upload(uploaded(spark, sf)))


@query("ucl_07_column_profile", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS missing_count,
       round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct,
       count(DISTINCT {c}) AS unique_count,
       (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v
        FROM part ORDER BY v LIMIT 3)) AS sample_values,
       count(DISTINCT {c}) = count(*) AS candidate_key FROM part"""
       for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")))
def ucl_07c(spark, sf):
    return U.column_profile(stage.table(spark, sf, "part"))
