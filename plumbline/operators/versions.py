"""Snapshot descriptions, differences between them, drift and other alerts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
CRITICAL, WARNING, INFO = "critical", "warning", "info"
DEFAULT_THRESHOLDS = {
    "row_growth_pct": 25.0,
    "row_shrink_pct": 0.0,
    "new_null_columns": 0,
    "allow_schema_change": False,
    "max_rejects": 0,
}
# --- end of fixed values ----------------------------------------------------


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _schema_text(df: DataFrame) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)


def content_hash(df: DataFrame) -> Column:
    """An aggregate over names, types and values.

    Rows have no order in Spark, so row hashes are added up, which still
    counts repeated rows; two independent sums and the row count are combined.
    """
    # hashes pass over nulls, so each column brings a flag that says where they are
    cols = [x for c in df.columns for x in (_q(c).isNull(), _q(c))]
    first = F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))
    second = F.sum(F.xxhash64(F.lit("second"), *cols).cast("decimal(38,0)"))
    return F.left(F.sha2(F.concat_ws("|", F.lit(_schema_text(df)), F.count(F.lit(1)).cast("string"),
                                     first.cast("string"), second.cast("string")), 256), F.lit(32))


def describe_table(df: DataFrame, table: str) -> DataFrame:
    """One row per column: type, nulls, and the table's rows and hash."""
    fields = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                                F.lit(f.dataType.simpleString()).alias("dtype"),
                                F.count_if(_q(f.name).isNull()).alias("n_nulls"))
                       for i, f in enumerate(df.schema)])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), content_hash(df).alias("content_hash"),
                  fields.alias("f")).select(
        F.lit(table).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns"),
        "content_hash", F.explode("f").alias("f")).select(
        "table", "n_rows", "n_columns", "content_hash", "f.*")


def describe(tables: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [describe_table(df, t) for t, df in sorted(tables.items())])


def diff_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """What changed between two manifests, from the manifests alone.

    One row per table; changed columns are listed as text.
    """
    def side(m: DataFrame, p: str) -> DataFrame:
        return m.select("table", "column", *[F.col(c).alias(p + c) for c in (
            "n_rows", "content_hash", "dtype", "n_nulls")])

    both = side(old, "o_").join(side(new, "n_"), ["table", "column"], "full_outer")

    def listed(test: Column, text: Column) -> Column:
        # bounded by the number of columns
        return F.array_join(F.sort_array(F.collect_list(F.when(test, text))), "; ")

    had, has = F.col("o_dtype").isNotNull(), F.col("n_dtype").isNotNull()

    def change(c: str) -> Column:
        return F.concat(F.col("column"), F.lit(": "), F.col("o_" + c).cast("string"),
                        F.lit(" -> "), F.col("n_" + c).cast("string"))

    grew = F.coalesce(F.col("n_n_nulls") > F.col("o_n_nulls"), F.lit(False)) | (
        ~had & has & (F.col("n_n_nulls") > 0))
    out = both.groupBy("table").agg(
        F.max("o_n_rows").alias("rows_before"), F.max("n_n_rows").alias("rows_after"),
        F.max("o_content_hash").alias("_oh"), F.max("n_content_hash").alias("_nh"),
        listed(~had & has, F.col("column")).alias("columns_added"),
        listed(had & ~has, F.col("column")).alias("columns_removed"),
        listed(had & has & (F.col("o_dtype") != F.col("n_dtype")), change("dtype")).alias("dtype_changes"),
        listed(had & has & (F.col("o_n_nulls") != F.col("n_n_nulls")), change("n_nulls")).alias("null_changes"),
        F.count_if(grew).alias("n_null_columns_grown"))
    status = (F.when(F.col("_oh").isNull(), "added").when(F.col("_nh").isNull(), "removed")
              .when(F.col("_oh") == F.col("_nh"), "unchanged").otherwise("changed"))
    out = out.withColumn("status", status)
    changed = F.col("status") == "changed"
    return out.select(
        "table", "status", "rows_before", "rows_after",
        (F.col("rows_after") - F.col("rows_before")).alias("row_delta"),
        *[F.when(changed, F.col(c)).otherwise("").alias(c) for c in (
            "columns_added", "columns_removed", "dtype_changes", "null_changes")],
        F.when(changed, F.col("n_null_columns_grown")).otherwise(0).alias("n_null_columns_grown"))


def _alerts(df: DataFrame, tests: list[tuple[Column, str, Column, Column, Column]],
            source: str) -> DataFrame:
    rows = F.filter(F.array(*[
        F.when(F.coalesce(test, F.lit(False)), F.struct(
            ident.alias("id"), severity.alias("severity"), F.lit(title).alias("title"),
            detail.alias("detail"))) for test, title, ident, severity, detail in tests]),
        lambda s: s.isNotNull())
    return (df.select(F.explode_outer(rows).alias("a")).filter(F.col("a").isNotNull())
            .select("a.*", F.lit(source).alias("source")))


def drift_alerts(diff: DataFrame, thresholds: Mapping[str, Any] | None = None) -> DataFrame:
    """Alerts from a manifest difference."""
    t = {**DEFAULT_THRESHOLDS, **(thresholds or {})}
    name, status = F.col("table"), F.col("status")
    changed = status == "changed"
    pct = F.when(F.col("rows_before") > 0, 100.0 * F.col("row_delta") / F.col("rows_before"))
    schema = F.lit(INFO if t["allow_schema_change"] else CRITICAL)
    moved = F.concat(F.col("rows_before").cast("string"), F.lit(" -> "),
                     F.col("rows_after").cast("string"))

    def ident(kind: str = "") -> Column:
        return F.concat(F.lit("drift:" + kind), name)

    return _alerts(diff, [
        (status == "unchanged", "unchanged", ident(), F.lit(INFO), F.lit("content hash identical")),
        (status == "removed", "table disappeared", ident(), F.lit(CRITICAL), F.lit("")),
        (status == "added", "new table", ident(), F.lit(INFO),
         F.concat(F.col("rows_after").cast("string"), F.lit(" rows"))),
        (changed & (pct < -float(t["row_shrink_pct"])), "lost rows", ident("rows:"),
         F.lit(CRITICAL), moved),
        (changed & (pct > float(t["row_growth_pct"])), "unusual row growth", ident("rows:"),
         F.lit(WARNING), moved),
        (changed & (F.col("columns_removed") != ""), "columns disappeared", ident("cols_removed:"),
         schema, F.col("columns_removed")),
        (changed & (F.col("columns_added") != ""), "new columns", ident("cols_added:"),
         F.lit(WARNING), F.col("columns_added")),
        (changed & (F.col("dtype_changes") != ""), "dtypes changed", ident("dtypes:"), schema,
         F.col("dtype_changes")),
        (changed & (F.col("n_null_columns_grown") > int(t["new_null_columns"])), "nulls increased",
         ident("nulls:"), F.lit(WARNING), F.col("null_changes")),
    ], "drift")


def first_snapshot_alert(spark) -> DataFrame:
    return _alerts(spark.range(1), [(F.lit(True), "first snapshot, no baseline", F.lit("drift:first"),
                                     F.lit(INFO), F.lit(""))], "drift")


def validation_alerts(results: DataFrame) -> DataFrame:
    """One alert per rule that did not pass."""
    missing = F.col("rule_id") == "missing_table"
    failed = F.col("status") != "pass"
    detail = F.coalesce(F.concat(F.lit("rule could not run: "), F.col("error")), F.concat(
        F.col("n_violations").cast("string"), F.lit(" of "), F.col("n_checked").cast("string"),
        F.coalesce(F.concat(F.lit(" (expected exactly "), F.col("expect").cast("string"), F.lit(")")),
                   F.lit(""))))
    severity = F.when(F.col("severity") == "error", CRITICAL).otherwise(WARNING)
    return _alerts(results, [
        (missing, "expected table absent", F.concat(F.lit("missing_table:"), F.col("table")),
         F.lit(CRITICAL), F.lit("")),
        (failed & ~missing, "rule violated",
         F.concat(F.lit("rule:"), F.concat_ws(".", "table", "rule_id")), severity, detail),
    ], "validation")


def cleaning_alerts(problems: DataFrame, rejects: DataFrame, warnings: DataFrame,
                    thresholds: Mapping[str, Any] | None = None) -> DataFrame:
    """Alerts from source problems (kind, file, detail), rejected cells and
    row count warnings."""
    t = {**DEFAULT_THRESHOLDS, **(thresholds or {})}
    kind, file = F.col("kind"), F.col("file")
    a = _alerts(problems, [
        (kind == "skipped", "source skipped by policy", F.concat(F.lit("source:skipped:"), file),
         F.lit(INFO), F.col("detail")),
        (kind == "unconfigured", "source nothing consumes",
         F.concat(F.lit("source:unconfigured:"), file), F.lit(WARNING), F.col("detail")),
        (kind == "failed", "source could not be read", F.concat(F.lit("source:error:"), file),
         F.lit(CRITICAL), F.col("detail")),
    ], "cleaning")
    n = rejects.groupBy("table").agg(F.count(F.lit(1)).alias("n"))
    b = _alerts(n, [(F.col("n") > int(t["max_rejects"]), "cells could not be typed",
                     F.concat(F.lit("rejects:"), F.col("table")), F.lit(WARNING),
                     F.col("n").cast("string"))], "cleaning")
    c = _alerts(warnings, [(kind == "row_count", "source row count disagrees with policy",
                            F.concat(F.lit("rowcount:"), F.col("table")), F.lit(CRITICAL),
                            F.col("detail"))], "cleaning")
    return a.unionByName(b).unionByName(c)


def _rank(severity: Column) -> Column:
    return F.when(severity == CRITICAL, 0).when(severity == WARNING, 1).otherwise(2)


def rank_alerts(*alerts: DataFrame) -> DataFrame:
    """All alerts, most severe first."""
    return reduce(DataFrame.unionByName, alerts).withColumn(
        "rank", _rank(F.col("severity"))).orderBy("rank", "id")


def alert_counts(alerts: DataFrame) -> DataFrame:
    n = {s: F.count_if(F.col("severity") == s) for s in (CRITICAL, WARNING, INFO)}
    return alerts.agg(*[n[s].alias("n_" + s) for s in n], (n[CRITICAL] == 0).alias("ok"))


def snapshot_history(manifests: DataFrame) -> DataFrame:
    """Rows per version and the change against the one before, newest first.

    One row per version, so the ordering window is small.
    """
    per = (manifests.select("version", "table", "n_rows").distinct()
           .groupBy("version").agg(F.sum("n_rows").alias("n_rows")))
    before = F.lag("n_rows").over(Window.orderBy("version"))
    return per.select("version", "n_rows", (F.col("n_rows") - before).alias("row_delta")).orderBy(
        F.desc("version"))
