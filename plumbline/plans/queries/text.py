"""Text jobs over conversations, documents and sentences about results."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import claims as CM
from plumbline.operators.semantic import aggregate
from plumbline.plans import stage
from plumbline.plans.queries import query
from plumbline.plans.queries.common import WITH_ITEMS, rounded
from plumbline.plans.queries.metrics import G, ORDERS

C = stage.CATALOG
ASKED = ("CASE turn % 6 WHEN 0 THEN ' Why did sales fall?' WHEN 1 THEN ' delete the old rows'"
         " WHEN 2 THEN ' forecast next month' WHEN 3 THEN ' select a from b' WHEN 4 THEN"
         " ' which customers buy most' ELSE '' END")


@query("txt_01_tag_scope", f"""
WITH q AS (SELECT conv_id, turn, lower(text || {ASKED}) AS t FROM conversations)
SELECT conv_id, turn, CASE """ + " ".join(
    "WHEN regexp_matches(t, '" + p.replace("'", "''") + f"') THEN '{c}'"
    for c, p in CM.SCOPE_PATTERNS) + " END AS scope FROM q")
def txt_01(spark, sf):
    q = stage.table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", f"text || {ASKED} AS question")
    return CM.tag_scope(q, "question").drop("question")


@query("txt_02_extract_claims")
def txt_02(spark, sf):
    return CM.extract_claims(stage.table(spark, sf, "documents"), "doc_id", "text")


@query("txt_02_claims_beside_labels", """
SELECT p_partkey AS id, 0 AS claim_no, CAST(p_size AS VARCHAR) AS literal, CAST(p_size AS DOUBLE) AS value
FROM part""")
def txt_02l(spark, sf):
    part = stage.table(spark, sf, "part")
    said = part.selectExpr("p_partkey", "p_brand || ' sold ' || p_size || ' units, ' || upper(p_brand) AS said")
    return CM.extract_claims(said, "p_partkey", "said", part, "p_brand").select(
        "id", "claim_no", "literal", "value")


RESULT_SQL = WITH_ITEMS + f""",
r AS (SELECT market, country, sum(sales) {G} AS revenue, {ORDERS} AS orders FROM items GROUP BY 1, 2)"""


def result(spark, sf):
    return aggregate(stage.items(spark, sf, "geo"), C, ["revenue", "orders"], ["market", "country"])


LONG_SQL = RESULT_SQL + """,
l AS (SELECT market AS id, country, 'money' AS kind, revenue AS v FROM r
      UNION ALL SELECT market, country, 'count', CAST(orders AS DOUBLE) FROM r),
o AS (SELECT *, sum(v) OVER (PARTITION BY id, kind ORDER BY country ROWS UNBOUNDED PRECEDING) AS run,
      sum(v) OVER (PARTITION BY id, kind) AS tot FROM l WHERE v IS NOT NULL)"""
SINGLE = """SELECT id, kind, v AS x FROM o
UNION ALL SELECT id, kind, sum(v) FROM o GROUP BY 1, 2 UNION ALL SELECT id, kind, avg(v) FROM o GROUP BY 1, 2
UNION ALL SELECT id, kind, max(v) - min(v) FROM o GROUP BY 1, 2 UNION ALL SELECT id, kind, run FROM o
UNION ALL SELECT id, 'percent', 100.0 * v / tot FROM o WHERE tot <> 0
UNION ALL SELECT market, 'shape', count(*)::DOUBLE FROM r GROUP BY 1"""
SINGLE_SQL = LONG_SQL + ", c AS (" + SINGLE + ")"
CANDIDATES_SQL = LONG_SQL + """,
p AS (SELECT a.id, a.kind, a.v AS a, b.v AS b FROM o a JOIN o b
      ON a.id = b.id AND a.kind = b.kind AND a.country < b.country),
c AS (""" + SINGLE + """
UNION ALL SELECT id, kind, abs(a - b) FROM p
UNION ALL SELECT id, 'percent', 100.0 * a / b FROM p WHERE b <> 0
UNION ALL SELECT id, 'percent', 100.0 * (a / b - 1) FROM p WHERE b <> 0
UNION ALL SELECT id, 'percent', 100.0 * b / a FROM p WHERE a <> 0
UNION ALL SELECT id, 'percent', 100.0 * (b / a - 1) FROM p WHERE a <> 0)"""


def candidates(spark, sf):
    return CM.claim_candidates(result(spark, sf), "market", {"revenue": "money", "orders": "count"},
                               ["country"])


@query("txt_03_claim_candidates", SINGLE_SQL
       + " SELECT DISTINCT id, kind, round(x, 2) AS candidate FROM c")
def txt_03(spark, sf):
    return rounded(candidates(spark, sf), 2).distinct()


def sentences(spark, sf):
    """One sentence per result row; in some the amount is not the result's."""
    r = result(spark, sf)
    amount = F.when(F.col("country") < "K", F.col("revenue")).otherwise(F.col("revenue") * 3 + 0.4)
    return r.select("market", "country", F.concat(
        F.lit("The top 3 countries: revenue was $"), F.format_number(amount, 2),
        F.lit(" from "), F.col("orders").cast("string"), F.lit(" orders in 2001")).alias("sentence"))


def claims(spark, sf):
    named = CM.extract_claims(sentences(spark, sf).withColumn("k", F.struct("market", "country")),
                              "k", "sentence")
    return named.withColumns({"country": F.col("id.country"), "id": F.col("id.market"),
                              "claim_no": F.concat_ws("#", "id.country", F.col("claim_no").cast("string"))})


@query("txt_04_verify_claims", CANDIDATES_SQL + """,
cl AS (SELECT market AS id, country || '#1' AS claim_no, 'money' AS kind,
         round(CASE WHEN country < 'K' THEN revenue ELSE revenue * 3 + 0.4 END, 2) AS value, 0.005 AS tol FROM r
       UNION ALL SELECT market, country || '#2', CASE WHEN orders < 100 THEN 'integer' ELSE '' END, orders, 0.5 FROM r),
ok AS (SELECT DISTINCT cl.id, claim_no FROM cl JOIN c ON cl.id = c.id AND abs(cl.value - c.x) <= tol + 1e-9
       AND (cl.kind = c.kind OR cl.kind = '' OR (cl.kind = 'integer' AND c.kind IN ('count', 'shape'))))
SELECT cl.id, cl.claim_no, ok.id IS NOT NULL AS holds FROM cl LEFT JOIN ok USING (id, claim_no)
UNION ALL SELECT market, country || '#0', count(*) OVER (PARTITION BY market) >= 3 FROM r""")
def txt_04(spark, sf):
    values = CM.claim_values(result(spark, sf), "market", {"revenue": "money", "orders": "count"},
                             ["country"])
    return CM.verify_claims(claims(spark, sf), candidates(spark, sf), values).select(
        "id", "claim_no", "holds")


@query("txt_05_foreign_labels", """
SELECT c_custkey AS id, r_name AS label, 1 AS n_mentions FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE n_name <> r_name""")
def txt_05(spark, sf):
    """Each customer's sentence names its country, which its result holds, and
    its region, which it does not."""
    nation, region = (stage.table(spark, sf, t) for t in ("nation", "region"))
    places = (stage.table(spark, sf, "customer")
              .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
              .join(region, F.col("n_regionkey") == F.col("r_regionkey")))
    texts = places.select("c_custkey", F.concat(
        "n_name", F.lit(" leads, ahead of the rest of "), "r_name", F.lit(".")).alias("sentence"))
    own = places.select(F.col("c_custkey").alias("id"), F.col("n_name").alias("label"))
    known = region.select(F.col("r_name").alias("label")).unionByName(
        nation.select(F.col("n_name").alias("label")))
    return CM.foreign_labels(texts, "c_custkey", "sentence", own, known)


@query("txt_06_match_registry")
def txt_06(spark, sf):
    q = stage.table(spark, sf, "conversations").selectExpr(
        "struct(conv_id, turn) AS k", "text || CASE turn % 3 WHEN 0 THEN ' average order value by market'"
        " WHEN 1 THEN ' monthly orders and late rate' ELSE ' revenue by customer segments' END AS question")
    keys = {m.key: m.label for m in stage.METRICS} | {d.key: d.label for d in stage.DIMENSIONS}
    return CM.match_registry(q, "k", "question", keys).select(
        F.col("id.conv_id").alias("conv_id"), F.col("id.turn").alias("turn"), "key", "position")
