"""Schema-free cleaning and profiling of an arbitrary table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import numbers as N
from plumbline.functions.text import SENTINELS, strip

# How each notation is recognised and reduced to a bare number.
NOTATIONS = {
    "currency": (N.UPLOAD_CURRENCY, r"[$€£¥₹₩,\s]"),
    "percent": (N.UPLOAD_PERCENT, r"[%\s]"),
    "grouped": (N.UPLOAD_GROUPED, r"[,\s]"),
}
SHARE = 0.8


def _bare_pattern(skip: str) -> str:
    """What ``numbers.CLEAN_NUMBER`` matches once the characters of class ``skip`` are gone."""
    gap, digits = skip + "*", rf"\d[\d{skip[1:]}*"
    return (rf"\A{gap}[+-]?{gap}(?:{digits}(?:\.[\d{skip[1:]}*)?|\.{gap}{digits})"
            rf"(?:[eE]{gap}[+-]?{gap}{digits})?\z")


PARSES = {name: _bare_pattern(skip) for name, (_, skip) in NOTATIONS.items()}


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def sanitise_headers(columns: Sequence[str | None]) -> list[str]:
    """Stripped, single-spaced names; blanks numbered, repeats suffixed."""
    out, seen = [], {}
    for i, raw in enumerate(columns, 1):
        name = re.sub(r"\s+", " ", str(raw or "").strip())
        if not name or name.lower().startswith("unnamed:"):
            name = f"column_{i}"
        n = seen.get(name.lower(), -1) + 1
        seen[name.lower()] = n
        out.append(name if n == 0 else f"{name}__{n}")
    return out


def trim_cells(df: DataFrame) -> DataFrame:
    texts = set(_texts(df))
    return df.select(*[(strip(_q(c)) if c in texts else _q(c)).alias(c) for c in df.columns])


def null_sentinels(df: DataFrame, vocabulary: str = "upload") -> DataFrame:
    """Cells spelled like 'missing' become null; text is trimmed first."""
    texts, words = set(_texts(df)), SENTINELS[vocabulary]

    def cell(c: Column) -> Column:
        return F.when(~F.lower(strip(c)).isin(*words), c)

    return df.select(*[(cell(_q(c)) if c in texts else _q(c)).alias(c) for c in df.columns])


def cell_counts(df: DataFrame, vocabulary: str = "upload") -> DataFrame:
    """Cells trimmed and cells recognised as missing, per text column."""
    rows = [F.struct(
        F.lit(c).alias("column"),
        F.count_if(strip(_q(c)) != _q(c)).alias("n_trimmed"),
        F.count_if(F.lower(strip(_q(c))).isin(*SENTINELS[vocabulary])).alias("n_sentinel"))
        for c in _texts(df)]
    return df.agg(F.array(*rows).alias("a")).selectExpr("inline(a)")


def bare_number(c: Column, notation: str) -> Column:
    return N.parse_double(F.regexp_replace(c, NOTATIONS[notation][1], ""))


def notation_rates(df: DataFrame) -> DataFrame:
    """Per text column: rows, present cells, and cells matching and parsing
    under each number notation.  One aggregation whatever the width; a cell is
    only matched, so none is rewritten or converted for the decision."""
    rows = []
    for c in _texts(df):
        col = _q(c)
        fields = [F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"),
                  F.count(col).alias("n_present")]
        for name, (pattern, _) in NOTATIONS.items():
            fields += [F.count_if(col.rlike(pattern)).alias(name),
                       F.count_if(col.rlike(PARSES[name])).alias(name + "_parsed")]
        rows.append(F.struct(*fields))
    if not rows:
        return df.sparkSession.createDataFrame([], "column string, notation string")
    return df.agg(F.array(*rows).alias("a")).selectExpr("inline(a)")


def choose_notation(rates: DataFrame) -> DataFrame:
    """The first notation that 80% of present cells both match and parse as."""
    enough = (F.col("n_present") > 0) & (
        F.col("n_present") >= F.least(F.col("n_rows") * 0.3, F.lit(5.0)))
    pick = F.when(~enough, None)
    for name in NOTATIONS:
        pick = pick.when((F.col(name) >= SHARE * F.col("n_present"))
                         & (F.col(name + "_parsed") >= SHARE * F.col("n_present")), name)
    return rates.select("column", pick.cast("string").alias("notation"))


def coerce_numbers(df: DataFrame, notations: Sequence[str] = tuple(NOTATIONS)) -> DataFrame:
    """Text columns written as currency, percent or grouped numbers become
    doubles.  The decision reads one row per column, never the data."""
    chosen = {r["column"]: r["notation"] for r in choose_notation(notation_rates(df)).collect()}
    return df.select(*[
        (bare_number(_q(c), chosen[c]) if chosen.get(c) in notations else _q(c)).alias(c)
        for c in df.columns])


def coerce_currency(df: DataFrame) -> DataFrame:
    return coerce_numbers(df, ["currency"])


def coerce_percent(df: DataFrame) -> DataFrame:
    return coerce_numbers(df, ["percent"])


def coerce_grouped_number(df: DataFrame) -> DataFrame:
    return coerce_numbers(df, ["grouped"])


def count_duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each distinct row; nulls are equal."""
    return (df.groupBy(*[_q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicate_rows")))


def clean_upload(df: DataFrame) -> DataFrame:
    """Headers, trimming, sentinels and number notations in that order."""
    named = df.toDF(*sanitise_headers(df.columns))
    return coerce_numbers(null_sentinels(trim_cells(named)))


def _values(df: DataFrame) -> DataFrame:
    """(column, value, n) over every cell, nulls too."""
    wide = df.select(*[_q(c).cast("string").alias(c) for c in df.columns])
    return (wide.unpivot([], [_q(c) for c in wide.columns], "column", "value")
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def _sizes(vc: DataFrame) -> DataFrame:
    out = vc.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing_count"),
        F.count("value").alias("unique_count"))
    return out.withColumn("candidate_key", (F.col("missing_count") == 0)
                          & (F.col("unique_count") == F.col("n_rows")) & (F.col("n_rows") > 1))


def column_profile(df: DataFrame, samples: int = 3) -> DataFrame:
    """Missing and distinct counts and the smallest sample values per column.

    Cells are counted per (column, value) first, so each value is shuffled
    once and a hot value as one partial count per task.
    """
    vc = _values(df)
    base = _sizes(vc)
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    first = (vc.filter(F.col("value").isNotNull()).withColumn("r", rank)
             .filter(F.col("r") <= samples).groupBy("column")
             .agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("sample_values")))
    return base.join(first, "column", "left").select(
        "column", "n_rows", "missing_count",
        F.round(100.0 * F.col("missing_count") / F.col("n_rows"), 2).alias("missing_pct"),
        "unique_count", F.coalesce("sample_values", F.lit("")).alias("sample_values"),
        "candidate_key")


def dataset_profile(df: DataFrame) -> DataFrame:
    """Size, missing share and quality score of a whole table."""
    cells = F.sum("n_rows")
    pct = F.round(F.coalesce(F.try_divide(100.0 * F.sum("missing_count"), cells), F.lit(0.0)), 2)
    return _sizes(_values(df)).agg(
        F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_cols"), cells.alias("n_cells"),
        F.sum("missing_count").alias("n_missing_cells"), pct.alias("missing_pct"),
        F.round(F.greatest(F.lit(0.0), 100.0 - pct), 1).alias("quality_score"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("candidate_key"), F.col("column")))),
                     ",").alias("candidate_keys"))
