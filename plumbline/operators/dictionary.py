"""Data dictionary: what every column is, measured and documented."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.cleaning import Policy

SMALL_VOCABULARY = 12
EXAMPLES = 3


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _counted_values(df: DataFrame) -> DataFrame:
    """column, value as text, n: every distinct value of every column.

    Columns of one type are counted together as they are, and only distinct values
    become text, where a type has one text per value; other columns are texts first.
    """
    groups: dict[T.DataType, list[str]] = {}
    for f in df.schema:
        whole = isinstance(f.dataType, T.IntegralType)
        own = isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType, T.DateType,
                                      T.TimestampNTZType))
        kind = T.LongType() if whole else f.dataType if own else T.StringType()
        groups.setdefault(kind, []).append(f.name)
    parts = []
    for kind, names in groups.items():
        at = [str(i) for i in range(len(names))]
        cells = df.select(*[_q(c).cast(kind).alias(i) for i, c in zip(at, names)]).unpivot(
            [], at, "_i", "_v")
        keys = [F.col("_i"), F.col("_v")]
        text = F.col("_v").cast("string")
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            # grouping makes one of 0.0 and -0.0, texts do not
            keys.append(F.when(F.col("_v") == 0, text).alias("_zero"))
            text = F.coalesce("_zero", text)
        # never null, or a filter for it would set the second reader's plan apart
        label = F.coalesce(F.get(F.array(*[F.lit(c) for c in names]), F.col("_i").cast("int")),
                           F.lit(""))
        parts.append(cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(
            label.alias("column"), text.alias("value"), "n"))
    return reduce(DataFrame.unionByName, parts)


def measure_columns(df: DataFrame, table: str, personal: Iterable[str] = ()) -> DataFrame:
    """Nulls, distinct values, range of ordered columns, the commonest values
    (never of personal columns) and small vocabularies."""
    personal = list(personal)
    ordered = [f.name for f in df.schema if isinstance(
        f.dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))]
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    vc = _counted_values(df)
    here = F.col("value").isNotNull()
    base = vc.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(~here, F.col("n"))), F.lit(0)).alias("n_nulls"),
        F.count("value").alias("n_distinct"))
    # The first ranks hold the examples, and all values of a small vocabulary; a null comes last.
    # Both figures read the same counts, so that these are made once.
    rank = F.row_number().over(Window.partitionBy("column").orderBy(
        F.asc(~here), F.desc("n"), F.asc("value")))
    ranked = F.sort_array(F.collect_list(F.when(here, F.struct("r", "value"))))
    first = (vc.withColumn("r", rank).filter(F.col("r") <= max(EXAMPLES, SMALL_VOCABULARY))
             .groupBy("column").agg(F.transform(ranked, lambda s: s["value"]).alias("_first"))
             .filter(F.size("_first") > 0))
    few = F.col("n_distinct").between(1, SMALL_VOCABULARY)
    shown = F.lit(True)
    if floats:
        few = few & ~F.col("column").isin(*floats)
    if personal:
        shown = ~F.col("column").isin(*personal)
    out = base.join(first, "column", "left").withColumns({
        "examples": F.when(shown, F.array_join(F.slice("_first", 1, EXAMPLES), "|")),
        "vocabulary": F.when(few, F.array_join(F.sort_array("_first"), "|"))}).drop("_first")
    if ordered:
        ends = F.array(*[F.struct(F.lit(c).alias("column"), F.min(_q(c)).cast("string").alias("minimum"),
                                  F.max(_q(c)).cast("string").alias("maximum")) for c in ordered])
        out = out.join(df.agg(ends.alias("e")).selectExpr("inline(e)"), "column", "left")
    else:
        out = out.withColumns({"minimum": F.lit(None).cast("string"),
                               "maximum": F.lit(None).cast("string")})
    return out.withColumn("table", F.lit(table))


def _folded(text: str) -> str:
    return re.sub(r"[^a-z0-9]", "", text.lower())


def read_glossary(glossary: DataFrame, name: str = "field", text: str = "description") -> DataFrame:
    """(key, description): keys lower-cased, a leading colon dropped."""
    d = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^\s*:\s*", ""), r"\s+", " "))
    out = glossary.select(F.lower(F.trim(name)).alias("key"), d.alias("d")).filter(
        "key <> '' AND d <> ''")
    return out.select("key", F.concat(F.upper(F.substring("d", 1, 1)),
                                      F.expr("substring(d, 2)")).alias("description"))


def _rules_of(column: str, rules: Iterable[Mapping[str, Any]]) -> str:
    """Rules that name a column, or mention it as a word in an expression."""
    word, hits = re.compile(r"\b" + re.escape(column) + r"\b"), []
    for r in rules:
        named = []
        for key in ("column", "columns", "determinant", "dependent"):
            v = r.get(key, [])
            named += v if isinstance(v, list) else [v]
        text = " ".join(str(r[k]) for k in ("expr", "lhs", "rhs") if k in r)
        if column in named or word.search(text):
            hits.append(f"{r['id']} ({r.get('severity', 'error')})")
    return ", ".join(hits)


def build_dictionary(tables: Mapping[str, DataFrame], policies: Mapping[str, Policy],
                     glossary: DataFrame | None = None,
                     rules: Mapping[str, Mapping[str, Any]] | None = None,
                     personal: Iterable[str] = ()) -> DataFrame:
    """One row per field: measures joined with policy, glossary and rules.

    A glossary text that only restates the column name counts as absent.
    """
    frames = []
    for table, df in tables.items():
        policy = policies.get(table)
        by_clean = {r.clean: r for r in policy.columns} if policy else {}
        derived = {d.name: d for d in policy.derived} if policy else {}
        meta = []
        for f in df.schema:
            r, d = by_clean.get(f.name), derived.get(f.name)
            meta.append(F.struct(
                F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                F.lit("derived" if d else "cleaned").alias("kind"),
                F.lit(r.source if r else None).cast("string").alias("source_column"),
                F.lit(_folded(r.source) if r else None).cast("string").alias("_folded"),
                F.lit(r.description if r else None).cast("string").alias("_config"),
                F.lit((r or d).reason if (r or d) else None).cast("string").alias("decision"),
                F.lit(str(d.expr) if d else None).cast("string").alias("expression"),
                F.lit(_rules_of(f.name, (rules or {}).get(table, {}).get("rules") or [])).alias("rules")))
        info = df.sparkSession.range(1).select(F.explode(F.array(*meta)).alias("m")).select("m.*")
        frames.append(measure_columns(df, table, personal).join(info, "column"))
    out = reduce(DataFrame.unionByName, frames)
    if glossary is None:
        out = out.withColumn("_vendor", F.lit(None).cast("string"))
    else:
        out = out.join(glossary.select(F.col("key").alias("_gk"), F.col("description").alias("_g")),
                       F.lower(F.trim("source_column")) == F.col("_gk"), "left")
        echo = F.regexp_replace(F.lower("_g"), "[^a-z0-9]", "") == F.col("_folded")
        out = out.withColumn("_vendor", F.when(~echo, F.col("_g"))).drop("_gk", "_g")
    return out.withColumn("description", F.coalesce("_config", "_vendor")).withColumn(
        "is_documented", F.coalesce("description", "decision", "expression").isNotNull()).drop(
        "_config", "_vendor", "_folded")


def dictionary_coverage(fields: DataFrame) -> DataFrame:
    """Share of documented fields and the list of gaps."""
    done = F.count_if("is_documented")
    gap = F.when(~F.col("is_documented"), F.concat_ws(".", "table", "column"))
    return fields.agg(F.count(F.lit(1)).alias("n_fields"), done.alias("n_documented"),
                      F.round(F.coalesce(F.try_divide(100.0 * done, F.count(F.lit(1))), F.lit(0.0)), 2)
                      .alias("coverage_pct"),
                      F.array_join(F.sort_array(F.collect_list(gap)), ", ").alias("gaps"))


def unused_glossary(fields: DataFrame, glossary: DataFrame, dropped: Iterable[str] = ()) -> DataFrame:
    """Glossary entries no field uses and no policy drops."""
    used = fields.filter("source_column IS NOT NULL").select(
        F.lower(F.trim("source_column")).alias("key"))
    gone = [d.strip().lower() for d in dropped]
    out = glossary.join(used, "key", "left_anti")
    return out.filter(~F.col("key").isin(*gone)).select("key") if gone else out.select("key")
