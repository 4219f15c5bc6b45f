"""Readers and sinks on files that Spark writes from the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import cleaning as CL
from plumbline.plans import stage
from plumbline.plans.queries import query
from plumbline.plans.queries.cleaning import POLICY, messy
from plumbline.plans.queries.schema import _work
from plumbline.sources import files as FI


def _written(spark, sf) -> str:
    """Parts as semicolon text and events as JSON lines in a new folder.

    A first task without rows would write an empty file, which is a problem to the
    readers; the first of key ranges has rows if the table has any.
    """
    work = _work(spark)
    stage.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand").repartitionByRange(
        "p_partkey").write.option("header", "true").option("sep", ";").csv(work + "/parts.csv")
    stage.table(spark, sf, "events").select(
        "event_id", F.struct("event_type", F.struct("value").alias("inner")).alias("body")
    ).repartitionByRange("event_id").write.json(work + "/events.jsonl")
    return work


@query("src_01_read_folder", """
SELECT CAST(p_partkey AS VARCHAR) AS k,
  CASE p_partkey % 3 WHEN 0 THEN p_name || chr(10) || '"' || p_brand || '", é' WHEN 1 THEN 'é ' || p_name
    ELSE p_name END AS n,
  CASE p_partkey % 3 WHEN 2 THEN '' ELSE p_brand END AS b, '' AS note
FROM part""")
def src_01(spark, sf):
    """Three shapes in one folder: cells over lines, another header order in another
    encoding, and another delimiter with fewer columns."""
    work, part = _work(spark) + "/folder", stage.table(spark, sf, "part")
    own = part.select(F.col("p_partkey").cast("string").alias("k"), F.col("p_name").alias("n"),
                      F.col("p_brand").alias("b"), F.lit("").alias("note"))
    at = F.col("k").cast("long") % 3
    lines = F.concat("n", F.lit('\n"'), "b", F.lit('", é'))
    for number, rows, options in (
            (0, own.withColumn("n", lines), {}),
            (1, own.select("b", F.concat(F.lit("é "), "n").alias("n"), "note", "k"),
             {"encoding": "ISO-8859-1"}),
            (2, own.select("n", "k"), {"sep": ";"})):
        rows.where(at == number).write.mode("append").option("header", "true").option(
            "escape", '"').options(**options).csv(work)
    return FI.read_delimited(spark, work).select("k", "n", "b", "note")


@query("src_09_dedupe_headers", """
SELECT p_name AS "name", CAST(p_partkey AS VARCHAR) AS name__dup1, p_brand AS name__dup2 FROM part""")
def src_09(spark, sf):
    work = _work(spark)
    rows = stage.table(spark, sf, "part").select(F.concat_ws(",", "p_name", "p_partkey", "p_brand"))
    head = spark.range(1, numPartitions=1).select(F.lit("name,name,name"))
    head.union(rows).coalesce(1).write.text(work + "/repeated")
    return FI.read_delimited(spark, work + "/repeated", sep=",")


@query("src_15_sanitize_table_name", """
SELECT 'q1_r_sum' AS "view", count(*) AS n_rows FROM part
UNION ALL SELECT 'q1_r_sum_2', count(*) FROM region UNION ALL SELECT 'dataset', count(*) FROM nation""")
def src_15(spark, sf):
    named = {"Q1 Ér-sum.csv": "part", "q1 (r) sum.tsv": "region", "???.json": "nation"}
    return FI.register_tables({n: stage.table(spark, sf, t) for n, t in named.items()}).select(
        "view", "n_rows")


@query("src_02_detect_encoding", """
SELECT DISTINCT 'utf-8' AS encoding FROM part""")
def src_02(spark, sf):
    return FI.detect_encoding(spark, _written(spark, sf) + "/parts.csv").select("encoding").distinct()


@query("src_03_sniff_delimiter", "SELECT ';' AS delimiter FROM part HAVING count(*) > 0")
def src_03(spark, sf):
    return FI.sniff_delimiter(spark.read.text(_written(spark, sf) + "/parts.csv"))


@query("src_04_read_json", """
SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS "body.event_type",
  count(*) OVER () AS n FROM events""")
def src_04(spark, sf):
    df = FI.read_json(spark, _written(spark, sf) + "/events.jsonl")
    return df.select("event_id", "`body.event_type`").withColumn(
        "n", df.agg(F.count("`body.inner.value`")).scalar())


@query("src_06_discover_sources", """
SELECT DISTINCT '.csv' AS suffix FROM part UNION ALL SELECT DISTINCT '.json' FROM events""")
def src_06(spark, sf):
    return FI.discover_sources(spark, _written(spark, sf)).select("suffix").distinct()


@query("src_07_load_all", """
SELECT (SELECT count(*) FROM part) AS n_parts, (SELECT count(*) FROM events) AS n_events,
  0 AS n_problems""")
def src_07(spark, sf):
    loaded = FI.load_all(spark, _written(spark, sf))

    def total(column: str):
        parts = [t for t in loaded.tables.values() if column in t.columns]
        rows = parts[0].select(column)
        for p in parts[1:]:
            rows = rows.unionByName(p.select(column))
        return rows.agg(F.count(F.lit(1))).scalar()

    return loaded.problems.agg(total("p_partkey").alias("n_parts"), total("event_id").alias("n_events"),
                               F.count(F.lit(1)).alias("n_problems"))


@query("src_08_load_configured", """
SELECT 'unconfigured' AS kind FROM events HAVING count(*) > 0""")
def src_08(spark, sf):
    policy = CL.Policy("other", (CL.ColumnRule("p_partkey", "id"),))
    return FI.load_configured(spark, _written(spark, sf), {"other": policy}).problems.select(
        "kind").distinct()


@query("src_10_write_clean", """
WITH q AS (SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
SELECT n > 0 AS wrote_clean, n > 0 AS wrote_rejects FROM q""")
def src_10(spark, sf):
    paths = FI.write_clean(CL.clean_table(messy(spark, sf), POLICY), _work(spark))
    clean = spark.read.parquet(paths["clean"]).agg(F.count(F.lit(1)) > 0).scalar()
    return spark.read.parquet(paths["rejects"]).agg(
        clean.alias("wrote_clean"), (F.count(F.lit(1)) > 0).alias("wrote_rejects"))


@query("src_11_write_snapshot", """
SELECT 'nation' AS "table", count(*) AS n_rows, 3 AS n_columns, 'checked' AS validation FROM nation
UNION ALL SELECT 'orders', count(*), 6, 'checked' FROM orders""")
def src_11(spark, sf):
    work = _work(spark)
    FI.write_snapshot({t: stage.table(spark, sf, t) for t in ("nation", "orders")}, work, "checked")
    return FI.read_manifests(spark, work).select(
        "table", "n_rows", "n_columns", "validation").distinct()


@query("src_14_export_csv", "SELECT p_name, count(*) AS n FROM part GROUP BY 1")
def src_14(spark, sf):
    work = _work(spark)
    FI.export_csv(stage.table(spark, sf, "part"), work + "/part")
    return spark.read.option("header", "true").csv(work + "/part").groupBy("p_name").agg(
        F.count(F.lit(1)).alias("n"))


@query("src_14_export_json", "SELECT p_brand, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1")
def src_14j(spark, sf):
    work = _work(spark)
    FI.export_json(stage.table(spark, sf, "part"), work + "/part")
    return spark.read.json(work + "/part").groupBy("p_brand").agg(
        F.round(F.sum("p_retailprice"), 2).alias("total"))


@query("ver_03_list_versions", """
SELECT v AS version, 1 AS n_tables, s AS validation FROM (VALUES ('20200101T000000', 'PASS'),
  ('20200102T000000', 'PASS with warnings')) AS t(v, s) WHERE (SELECT count(*) FROM part) > 0""")
def ver_03(spark, sf):
    work, part = _work(spark), stage.table(spark, sf, "part")
    FI.write_snapshot({"part": part}, work, "PASS", version="20200101T000000")
    FI.write_snapshot({"part": part.filter("p_size > 5")}, work, "PASS with warnings",
                      version="20200102T000000")
    return FI.list_versions(spark, work).select("version", "n_tables", "validation")
