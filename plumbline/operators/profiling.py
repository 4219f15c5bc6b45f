"""Profiling of any table, read as text.

Cells are counted per (column, value) once; everything else reads that frame,
so a value is classified once however often it occurs, and a hot value is one
partial count per task.  Frames of one row per column are broadcast to the values:
a shuffle by column would bring all values of a column to one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import dates as D
from plumbline.functions import numbers as N
from plumbline.functions import text as X
from plumbline.operators.quantiles import quantiles
from plumbline.session import materialise

# --- fixed values -----------------------------------------------------------
BOOLEAN_WORDS = ("true", "t", "yes", "y", "1", "on", "false", "f", "no", "n", "0", "off")
NUMERIC_TYPES = ("integer", "decimal", "currency", "percent")
KEYLIKE_TYPES = ("text", "categorical", "uuid")
KEYLIKE_NAME = r"(?i)(^|_)(id|ids|key|code|no|num|number|ref|sku)$"
# Tags that are no mismatch in a column of each type.
COMPATIBLE = {
    "integer": ("integer", "decimal"),
    "decimal": ("integer", "decimal"),
    "currency": ("currency", "integer", "decimal"),
    "percent": ("percent", "integer", "decimal"),
    "boolean": ("boolean", "integer", "text"),
    "categorical": ("text", "categorical", "integer"),
}
MIN_VALUES_FOR_OUTLIERS = 20
# --- end of fixed values ----------------------------------------------------


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def merged(parts: Sequence[DataFrame], key: str = "column") -> DataFrame:
    """Put one-row-per-key frames side by side with one shuffle instead of a
    join for each."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(c)
                                      for c in stacked.columns if c != key])


def _pct(part: Column, whole: Column, places: int = 2) -> Column:
    return F.round(F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0)), places)


def cells(df: DataFrame) -> DataFrame:
    """(column, value, n) over every cell, with the trimmed text and whether
    it is blank, a spelling of 'missing', or present."""
    wide = df.select(*[F.coalesce(_q(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    counted = (wide.unpivot([], [_q(c) for c in wide.columns], "column", "value")
               .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    trimmed = counted.withColumn("text", X.strip(F.col("value")))
    words = ", ".join("'" + w.replace("\\", "\\\\") + "'" for w in X.PROFILE_SENTINELS)
    return trimmed.withColumn("kind", F.expr(
        f"CASE WHEN text = '' THEN 'blank' WHEN lower(text) IN ({words}) THEN 'sentinel' "
        "ELSE 'present' END"))


def value_counts(counted: DataFrame) -> DataFrame:
    """Present trimmed values and their counts per column."""
    return (counted.filter("kind = 'present'").groupBy("column", F.col("text").alias("value"))
            .agg(F.sum("n").alias("n")))


def classified(vc: DataFrame) -> DataFrame:
    """Each distinct value, trimmed already, with its date formats and type tag.

    The single-spaced text is a column of its own, so that no format computes it again.
    """
    return (vc.withColumn("_even", X.collapse(F.col("value")))
            .withColumn("formats", D.formats_of(F.col("_even"))).drop("_even")
            .withColumn("tag", N.classify_value(F.col("value"), F.size("formats") > 0, trimmed=True)))


def missing_profile(counted: DataFrame) -> DataFrame:
    """Blank, sentinel and present cells per column and each spelling used."""
    def total(test: str) -> Column:
        return F.coalesce(F.sum(F.when(F.expr(test), F.col("n"))), F.lit(0))

    base = counted.groupBy("column").agg(
        F.sum("n").alias("n_rows"), total("kind = 'blank'").alias("n_blank"),
        total("kind = 'sentinel'").alias("n_sentinel"), total("kind = 'present'").alias("n_present"),
        total("kind = 'present' AND value <> text").alias("n_untidy"))
    # Spellings are case variants of a fixed word list, so few per column.
    forms = (counted.filter("kind = 'sentinel'").groupBy("column", "text")
             .agg(F.sum("n").alias("n")).groupBy("column").agg(F.map_from_entries(
                 F.sort_array(F.collect_list(F.struct("text", "n")))).alias("sentinel_forms")))
    return base.join(forms, "column", "left").withColumn(
        "missing_pct", _pct(F.col("n_blank") + F.col("n_sentinel"), F.col("n_rows")))


def untidy_whitespace(counted: DataFrame) -> DataFrame:
    return counted.groupBy("column").agg(F.coalesce(F.sum(F.when(
        (F.col("kind") == "present") & (F.col("value") != F.col("text")), F.col("n"))), F.lit(0))
        .alias("n_untidy"))


def mojibake_cells(counted: DataFrame, examples: int = 5) -> DataFrame:
    """Cells with encoding damage per column, and the first examples."""
    hit = counted.filter((F.col("kind") == "present") & X.has_mojibake(F.col("value")))
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    first = (hit.withColumn("r", rank).filter(F.col("r") <= examples).groupBy("column")
             .agg(F.sort_array(F.collect_list("value")).alias("mojibake_examples")))
    return hit.groupBy("column").agg(F.sum("n").alias("n_mojibake")).join(first, "column")


def distinct_profile(counted: DataFrame) -> DataFrame:
    """Distinct present values and what they make the column."""
    by_value = counted.groupBy("column", "text", "kind").agg(F.sum("n").alias("n"))
    here = F.col("kind") == "present"
    base = by_value.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias("n_present"),
        F.count_if(here).alias("n_distinct"))
    unique = (F.col("n_present") > 0) & (F.col("n_distinct") == F.col("n_present"))
    return base.select(
        "column", "n_rows", "n_present", "n_distinct",
        _pct(F.col("n_distinct"), F.col("n_present")).alias("distinct_pct"),
        (F.col("n_distinct") == 1).alias("is_constant"), unique.alias("is_unique"),
        (unique & (F.col("n_present") == F.col("n_rows")) & (F.col("n_rows") > 1))
        .alias("candidate_key"))


def top_values(vc: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent values per column; ties by value.  The rank filter keeps
    k rows per task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value")))
    return vc.select("column", "value", "n").withColumn("rank", rank).filter(F.col("rank") <= k)


def distinct_sample(vc: DataFrame, most: int) -> DataFrame:
    """The whole sorted vocabulary of columns with at most ``most`` values."""
    small = vc.groupBy("column").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") <= most)
    return (vc.join(F.broadcast(small.select("column")), "column", "left_semi").groupBy("column")
            .agg(F.sort_array(F.collect_set("value")).alias("distinct_sample")))


def infer_type(tagged: DataFrame) -> DataFrame:
    """Majority tag and confidence, with the boolean, currency and categorical
    readings; ties go to the tag decided first."""
    n = F.col("n")
    tags = N.TYPE_TAGS
    base = tagged.groupBy("column").agg(
        F.sum(n).alias("n_present"), F.count(F.lit(1)).alias("n_distinct"),
        F.min(F.lower("value").isin(*BOOLEAN_WORDS)).alias("_bool"),
        *[F.coalesce(F.sum(F.when(F.col("tag") == t, n)), F.lit(0)).alias("n_" + t) for t in tags])
    best = F.array_max(F.array(*[F.struct(F.col("n_" + t).alias("n"), F.lit(-i).alias("p"),
                                          F.lit(t).alias("t")) for i, t in enumerate(tags)]))
    out = base.withColumn("_best", best)
    money = F.col("n_currency") + F.col("n_decimal") + F.col("n_integer")
    is_money = (F.col("n_currency") > 0) & F.col("_best.t").isin("decimal", "integer")
    out = out.withColumn("base_type", F.when(F.col("_bool"), "boolean")
                         .when(is_money, "currency").otherwise(F.col("_best.t")))
    few = (F.col("n_distinct") <= F.greatest(F.lit(50), F.floor(0.05 * F.col("n_present")))) & (
        _pct(F.col("n_distinct"), F.col("n_present")) < 50.0)
    return out.select(
        "column", "n_present", "n_distinct", *["n_" + t for t in tags], "base_type",
        F.when((F.col("base_type") == "text") & few, "categorical")
        .otherwise(F.col("base_type")).alias("inferred_type"),
        F.when(F.col("_bool"), 100.0).when(is_money, _pct(money, F.col("n_present")))
        .otherwise(_pct(F.col("_best.n"), F.col("n_present"))).alias("type_confidence"))


def type_mismatches(tagged: DataFrame, types: DataFrame, examples: int = 8) -> DataFrame:
    """Values that do not fit their column's type, with examples."""
    fits = F.lit(False)
    for t, allowed in COMPATIBLE.items():
        fits = fits | ((F.col("base_type") == t) & F.col("tag").isin(*allowed))
    fits = fits | (~F.col("base_type").isin(*COMPATIBLE) & (F.col("tag") == F.col("base_type")))
    bad = tagged.join(F.broadcast(types.select("column", "base_type")), "column").filter(~fits)
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    first = (bad.withColumn("r", rank).filter(F.col("r") <= examples).groupBy("column")
             .agg(F.sort_array(F.collect_list("value")).alias("mismatch_examples")))
    return bad.groupBy("column").agg(F.sum("n").alias("n_mismatch")).join(first, "column")


def currency_notations(tagged: DataFrame, types: DataFrame) -> DataFrame:
    """Cells per currency symbol or code in money columns."""
    money = types.filter("base_type = 'currency'").select("column")
    return (tagged.join(F.broadcast(money), "column", "left_semi")
            .withColumn("notation", N.currency_marker(F.col("value")))
            .filter(F.col("notation").isNotNull())
            .groupBy("column", "notation").agg(F.sum("n").alias("n")))


def percent_scale_mixed(types: DataFrame) -> DataFrame:
    """Percent columns that also hold bare numbers."""
    bare = F.col("n_decimal") + F.col("n_integer")
    return types.filter("base_type = 'percent'").select(
        "column", "n_percent", bare.alias("n_bare"), (bare > 0).alias("percent_scale_mixed"))


def numbers(tagged: DataFrame, types: DataFrame) -> DataFrame:
    """(column, x, n) for every numeric value of a numeric column."""
    numeric = types.filter(F.col("base_type").isin(*NUMERIC_TYPES)).select("column")
    return (tagged.join(F.broadcast(numeric), "column", "left_semi")
            .select("column", "value", N.to_number(F.col("value")).alias("x"), "n")
            .filter(F.col("x").isNotNull()))


def numeric_summary(nums: DataFrame) -> DataFrame:
    """Weighted moments and exact quantiles per numeric column."""
    n, x = F.col("n"), F.col("x")
    base = nums.groupBy("column").agg(
        F.sum(n).alias("n_numbers"), F.min(x).alias("min"), F.max(x).alias("max"),
        (F.sum(x * n) / F.sum(n)).alias("mean"),
        F.coalesce(F.sum(F.when(x == 0, n)), F.lit(0)).alias("n_zero"),
        F.coalesce(F.sum(F.when(x < 0, n)), F.lit(0)).alias("n_negative"))
    off = x - F.col("_mean")
    spread = (nums.join(F.broadcast(base.select("column", F.col("mean").alias("_mean"))), "column")
              .groupBy("column").agg(F.sqrt(F.sum(off * off * n) / F.sum(n)).alias("std")))
    q = quantiles(nums, "x", [0.01, 0.25, 0.5, 0.75, 0.99], ["column"], freq="n").select(
        "column", F.col("q0").alias("p01"), F.col("q1").alias("q1"), F.col("q2").alias("median"),
        F.col("q3").alias("q3"), F.col("q4").alias("p99"))
    return merged([base, spread, q])


def iqr_outliers(nums: DataFrame, summary: DataFrame, examples: int = 5) -> DataFrame:
    """Values beyond 1.5 interquartile ranges, where there are enough values.

    Over a tenth of the values outside means skew rather than outliers.
    """
    iqr = F.col("q3") - F.col("q1")
    bounds = summary.filter(F.col("n_numbers") >= MIN_VALUES_FOR_OUTLIERS).select(
        "column", "n_numbers", (F.col("q1") - 1.5 * iqr).alias("lower_bound"),
        (F.col("q3") + 1.5 * iqr).alias("upper_bound"))
    placed = nums.join(F.broadcast(bounds), "column").withColumn("outside", F.expr(
        "x < lower_bound OR x > upper_bound"))
    counts = placed.groupBy("column").agg(
        *[F.max(c).alias(c) for c in ("n_numbers", "lower_bound", "upper_bound")],
        F.coalesce(F.sum(F.when(F.col("outside"), F.col("n"))), F.lit(0)).alias("n_outliers"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy("x", "value"))
    first = (placed.filter("outside").withColumn("r", rank).filter(F.col("r") <= examples)
             .groupBy("column").agg(F.sort_array(F.collect_list("x")).alias("outlier_examples")))
    return merged([counts, first]).withColumn(
        "is_skewed", F.col("n_outliers") > 0.10 * F.col("n_numbers"))


def label_variants(vc: DataFrame, types: DataFrame) -> DataFrame:
    """Spellings that share one folded label.

    Labels of one spelling, most of a column of free text, are counted out before
    the others are brought together.
    """
    cols = types.filter(F.col("inferred_type").isin("categorical", "text")).select("column")
    folded = vc.join(F.broadcast(cols), "column", "left_semi").select(
        "column", X.normalise_category(F.col("value")).alias("folded"), "value")
    shared = (folded.groupBy("column", "folded")
              .agg(F.min("value").alias("least"), F.max("value").alias("most"))
              .filter("least <> most").select("column", "folded"))
    return (folded.join(shared, ["column", "folded"], "left_semi").groupBy("column", "folded")
            .agg(F.sort_array(F.collect_set("value")).alias("variants")))


def _has(formats: Sequence[str]) -> Column:
    return F.arrays_overlap("formats", F.array(*[F.lit(f) for f in formats]))


def date_order_profile(tagged: DataFrame) -> DataFrame:
    """Whether day/month order can be told, from distinct values.

    One value that can be read only one way settles the column; proof of both
    orders, or proof of neither, leaves it ambiguous.
    """
    dated = tagged.filter(F.size("formats") > 0).select(
        "column", "formats", _has(D.MONTH_FIRST).alias("us"), _has(D.DAY_FIRST).alias("eu"))
    counts = dated.groupBy("column").agg(
        F.count_if(F.col("us") & ~F.col("eu")).alias("n_us_only"),
        F.count_if(F.col("eu") & ~F.col("us")).alias("n_eu_only"),
        F.count_if(F.col("us") & F.col("eu")).alias("n_both"))
    us, eu = F.col("n_us_only") > 0, F.col("n_eu_only") > 0
    counts = counts.withColumn("resolved", F.when(us & ~eu, "us").when(eu & ~us, "eu")).withColumn(
        "order_ambiguous", (us & eu) | ((F.col("n_both") > 0) & ~us & ~eu))
    label = F.create_map(*[F.lit(x) for pair in D.DATE_FORMATS for x in pair])

    def keep(formats: Sequence[str]) -> Column:
        return F.array_intersect("formats", F.array(*[F.lit(f) for f in formats]))

    both = F.col("us") & F.col("eu")
    read = (F.when(both & (F.col("resolved") == "us"), keep(D.MONTH_FIRST))
            .when(both & (F.col("resolved") == "eu"), keep(D.DAY_FIRST)).otherwise(F.col("formats")))
    named = dated.join(F.broadcast(counts.select("column", "resolved")), "column").withColumn(
        "label", F.when(both & F.col("resolved").isNull(), D.AMBIGUOUS_ORDER)
        .otherwise(label[F.get(read, F.lit(0))]))
    # At most one entry per known format.
    tally = (named.groupBy("column", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("column")
             .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n"))))
                  .alias("date_formats")))
    return counts.join(tally, "column")


def near_unique_key(distinct: DataFrame, types: DataFrame) -> DataFrame:
    """Columns that look like an identifier but repeat some values."""
    both = distinct.join(types.select("column", "inferred_type"), "column")
    return both.filter((F.col("n_present") > 0) & (F.col("distinct_pct") >= 90.0)
                       & ~F.col("is_unique")
                       & (F.col("inferred_type").isin(*KEYLIKE_TYPES)
                          | F.col("column").rlike(KEYLIKE_NAME))).select(
        "column", "distinct_pct", (F.col("n_present") - F.col("n_distinct")).alias("n_duplicates"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Exact duplicates and those that differ only by case or outer space."""
    def repeats(frame: DataFrame) -> DataFrame:
        return (frame.groupBy(*[_q(c) for c in frame.columns]).agg(F.count(F.lit(1)).alias("_n"))
                .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("d")))

    folded = df.select(*[F.lower(X.strip(F.coalesce(_q(c).cast("string"), F.lit("")))).alias(c)
                         for c in df.columns])
    return repeats(df).select(
        F.col("d").alias("n_exact"), repeats(folded).scalar().alias("n_normalised")).withColumn(
        "n_extra", F.col("n_normalised") - F.col("n_exact"))


def empty_rows(df: DataFrame) -> DataFrame:
    blank = reduce(lambda a, b: a & b, [
        X.strip(F.coalesce(_q(c).cast("string"), F.lit(""))) == "" for c in df.columns])
    return df.agg(F.count_if(blank).alias("n_empty_rows"))


class Profile:
    """The column and table frames of one table.

    Each stage is planned when first used and kept in memory or on disk for
    the ones after it; call ``unpersist`` when done.
    """

    def __init__(self, df: DataFrame, name: str = "table", vocabulary: int = 200):
        self.name, self.df, self.vocabulary = name, df, vocabulary

    @cached_property
    def cells(self) -> DataFrame:
        return cells(self.df).persist()

    @cached_property
    def values(self) -> DataFrame:
        return classified(value_counts(self.cells)).persist()

    @cached_property
    def types(self) -> DataFrame:
        # One row per column: written once, which keeps later plans short.
        return materialise(infer_type(self.values))

    @cached_property
    def numbers(self) -> DataFrame:
        return numbers(self.values, self.types).persist()

    @cached_property
    def summary(self) -> DataFrame:
        return materialise(numeric_summary(self.numbers))

    def unpersist(self) -> None:
        for stage in ("numbers", "values", "cells"):
            if stage in self.__dict__:
                self.__dict__.pop(stage).unpersist()

    def columns(self) -> DataFrame:
        """One row per column with every measurement."""
        nums, summary = self.numbers, self.summary
        marks = currency_notations(self.values, self.types).groupBy("column").agg(
            F.count(F.lit(1)).alias("n_notations"), F.sum("n").alias("n_marked"))
        variants = label_variants(self.values, self.types).groupBy("column").agg(
            F.count(F.lit(1)).alias("n_variant_labels"))
        types = self.types.select("column", "base_type", "inferred_type", "type_confidence",
                                  "n_percent", "n_decimal", "n_integer")
        distinct = distinct_profile(self.cells).drop("n_rows", "n_present")
        out = merged([
            missing_profile(self.cells), distinct, types,
            type_mismatches(self.values, self.types), summary.drop("n_numbers"),
            iqr_outliers(nums, summary).drop("n_numbers"), date_order_profile(self.values),
            marks, variants, mojibake_cells(self.cells), distinct_sample(self.values, self.vocabulary)])
        return out.withColumns({
            "table": F.lit(self.name),
            "inferred_type": F.coalesce("inferred_type", F.lit("empty")),
            "percent_scale_mixed": F.coalesce((F.col("base_type") == "percent")
                                              & (F.col("n_decimal") + F.col("n_integer") > 0),
                                              F.lit(False)),
            **{c: F.coalesce(c, F.lit(0)) for c in (
                "n_mismatch", "n_outliers", "n_notations", "n_marked", "n_variant_labels",
                "n_mojibake", "n_negative")},
            "order_ambiguous": F.coalesce("order_ambiguous", F.lit(False)),
        })

    def table(self) -> DataFrame:
        """One row: sizes, empty and duplicate rows, candidate keys."""
        keys = distinct_profile(self.cells).agg(F.array_join(F.sort_array(F.collect_list(
            F.when(F.col("candidate_key"), F.col("column")))), ",")).scalar()
        dup = duplicate_rows(self.df)
        return self.df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(self.name).alias("table"), "n_rows", F.lit(len(self.df.columns)).alias("n_cols"),
            empty_rows(self.df).scalar().alias("n_empty_rows"),
            dup.select("n_exact").scalar().alias("n_exact_duplicate_rows"),
            dup.select("n_normalised").scalar().alias("n_normalised_duplicate_rows"),
            keys.alias("candidate_keys"))


def profile_table(df: DataFrame, name: str = "table", vocabulary: int = 200) -> Profile:
    """``vocabulary``: columns with at most so many values list them all."""
    return Profile(df, name, vocabulary)


def _findings(rows: Sequence[tuple]) -> Column:
    return F.filter(F.array(*[
        F.when(F.coalesce(test, F.lit(False)),
               F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k)
                          for k, v in fields.items()])) for test, fields in rows]),
        lambda s: s.isNotNull())


def column_findings(columns: DataFrame) -> DataFrame:
    """One row per finding: (table, column, finding, n)."""
    c = F.col
    few_out = (c("n_outliers") > 0) & (c("n_outliers") <= 0.10 * c("n_present"))
    keylike = c("inferred_type").isin(*KEYLIKE_TYPES) | c("column").rlike(KEYLIKE_NAME)
    missing = c("n_blank") + c("n_sentinel")

    def row(finding: str, n: Column) -> dict:
        return {"finding": finding, "n": n.cast("bigint")}

    tests = [
        (c("n_present") == 0, row("entirely missing", c("n_rows"))),
        ((c("n_present") > 0) & (c("missing_pct") >= 50.0), row("over half missing", missing)),
        ((c("n_present") > 0) & (c("missing_pct") > 0) & (c("missing_pct") < 50.0),
         row("some missing", missing)),
        (c("n_sentinel") > 0, row("nulls stored as text", c("n_sentinel"))),
        (c("n_mismatch") > 0, row("type mismatch", c("n_mismatch"))),
        (c("n_untidy") > 0, row("untidy whitespace", c("n_untidy"))),
        (c("n_variant_labels") > 0, row("label variants", c("n_variant_labels"))),
        (c("n_mojibake") > 0, row("encoding damage", c("n_mojibake"))),
        (c("is_constant"), row("constant column", c("n_present"))),
        ((c("base_type") == "boolean") & (c("n_distinct") > 2),
         row("boolean spellings", c("n_distinct"))),
        (c("n_notations") > 1, row("mixed currencies", c("n_notations"))),
        ((c("n_notations") == 1) & (c("n_marked") < c("n_present")),
         row("partial currency marks", c("n_marked"))),
        (c("percent_scale_mixed"), row("mixed percent scale", c("n_decimal") + c("n_integer"))),
        (c("order_ambiguous"), row("ambiguous date order", c("n_both"))),
        (F.size("date_formats") > 1, row("mixed date formats", F.size("date_formats"))),
        (few_out, row("outliers", c("n_outliers"))),
        (c("n_outliers") > 0.10 * c("n_present"), row("skewed distribution", c("n_outliers"))),
        ((c("n_present") > 0) & (c("distinct_pct") >= 90.0) & ~c("is_unique") & keylike,
         row("near-unique key", c("n_present") - c("n_distinct"))),
        ((c("n_negative") > 0) & (c("inferred_type") == "currency"),
         row("negative money", c("n_negative"))),
    ]
    return (columns.select("table", "column", F.explode_outer(_findings(tests)).alias("f"))
            .filter(F.col("f").isNotNull()).select("table", "column", "f.finding", "f.n"))


# Severities, worst first.
SEVERITIES = ("BLOCKER", "HIGH", "MEDIUM", "LOW")


def risk_register(columns: DataFrame, tables: DataFrame,
                  matches: DataFrame | None = None) -> DataFrame:
    """Ranked risks of columns, tables and column matches."""
    c = F.col
    share = F.coalesce(F.try_divide(c("n_mismatch").cast("double"), c("n_present")), F.lit(0.0))

    def risk(severity: str, what: str) -> dict:
        return {"severity": severity, "risk": what}

    at_column = [
        (c("order_ambiguous"), risk("BLOCKER", "day/month order unknown")),
        (c("n_notations") > 1, risk("BLOCKER", "mixed currencies")),
        (c("percent_scale_mixed"), risk("BLOCKER", "mixed percent scale")),
        (share > 0.20, risk("BLOCKER", "over a fifth does not fit the type")),
        ((share > 0.02) & (share <= 0.20), risk("HIGH", "values do not fit the type")),
        ((F.size("date_formats") > 1) & ~c("order_ambiguous"), risk("HIGH", "mixed date formats")),
        (c("missing_pct") >= 50.0, risk("HIGH", "mostly missing")),
        ((c("missing_pct") >= 10.0) & (c("missing_pct") < 50.0), risk("MEDIUM", "partly missing")),
        (c("n_sentinel") > 0, risk("HIGH", "nulls stored as text")),
        (c("n_variant_labels") > 0, risk("MEDIUM", "label variants")),
        (c("n_untidy") > 0, risk("MEDIUM", "untidy whitespace")),
        (c("n_mojibake") > 0, risk("MEDIUM", "encoding damage")),
        (c("is_constant"), risk("LOW", "constant column")),
        ((c("n_outliers") > 0) & (c("n_outliers") <= 0.10 * c("n_present")),
         risk("MEDIUM", "outliers")),
        ((c("n_negative") > 0) & (c("inferred_type") == "currency"),
         risk("MEDIUM", "negative money")),
    ]
    at_table = [
        (c("n_exact_duplicate_rows") > 0, risk("HIGH", "exact duplicate rows")),
        (c("n_normalised_duplicate_rows") > c("n_exact_duplicate_rows"),
         risk("HIGH", "duplicates by case or space")),
        (c("n_empty_rows") > 0, risk("MEDIUM", "empty rows")),
        (c("candidate_keys") == "", risk("HIGH", "no single-column key")),
    ]

    def listed(df: DataFrame, where: Column, tests: list) -> DataFrame:
        return df.select(where.alias("where"), F.explode_outer(_findings(tests)).alias("f")).filter(
            F.col("f").isNotNull()).select("f.severity", "where", "f.risk")

    parts = [listed(columns, F.concat_ws(".", "table", "column"), at_column),
             listed(tables, F.col("table"), at_table)]
    if matches is not None:
        parts.append(listed(matches, F.concat_ws(" <-> ", "left", "right"), [
            (c("verdict").startswith("not joinable"), risk("BLOCKER", "no shared vocabulary")),
            (c("verdict").startswith("partial"), risk("HIGH", "partial value overlap")),
            (~c("type_agreement"), risk("HIGH", "type conflict"))]))
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", rank.cast("int")).orderBy(
        "rank", "where", "risk")


def readiness(risks: DataFrame) -> DataFrame:
    """Counts per severity and the verdict."""
    n = {s: F.count_if(F.col("severity") == s) for s in SEVERITIES}
    return risks.agg(
        *[n[s].alias(s.lower()) for s in SEVERITIES],
        F.when(n["BLOCKER"] > 0, "NOT READY").when(n["HIGH"] >= 5, "PROCEED WITH CARE")
        .otherwise("READY").alias("verdict"))
