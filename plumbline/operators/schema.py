"""Schema discovery and matching of columns across tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import dates as D
from plumbline.functions import text as X
from plumbline.functions.format import COUNT, DAYS, MONEY, PERCENT, RATIO
from plumbline.operators.semantic import GRAINS, Catalog, Dimension, Metric

# --- fixed values -----------------------------------------------------------
UNIT_HINTS = (
    (MONEY, r"(sales|revenue|profit|price|cost|salary|wage|income|fee|amount|balance|"
            r"budget|gdp|spending|charge|fare|bonus|val|dollar|usd|eur|gbp)"),
    (PERCENT, r"(pct|percent|percentage|rate|ratio|margin|share|yield)"),
    (DAYS, r"(days|delay|duration|hours|minutes|seconds|time_spent|tenure|age)"),
    (COUNT, r"(qty|quantity|units|items|count|num_|number|absences|failures|calls|visits)"),
)
ID_HINT = r"(_id|^id$|uuid|code|_key|^key$|_ref|^ref$|ssn|invoice)"
DATE_HINT = r"(date|time|timestamp|year|month|day|period|dt)"
BOOLEAN_PAIRS = (("true", "false"), ("yes", "no"), ("y", "n"), ("t", "f"), ("0", "1"))
TYPE_FAMILY = {
    "integer": "number", "decimal": "number", "currency": "number", "percent": "number",
    "date": "date", "boolean": "boolean", "text": "label", "categorical": "label",
    "uuid": "label", "email": "label", "url": "label", "phone": "label", "empty": "unknown",
}
SPECIFICITY = ("unknown", "empty", "text", "categorical", "boolean", "integer", "decimal",
               "percent", "currency", "date", "email", "url", "uuid")
STRUCTURAL = ("spaced", "kebab-case", "SCREAMING_CASE", "snake_case", "Mixed_Pascal_Snake",
              "PascalCase", "camelCase")
NAME_MATCH = 0.5
# --- end of fixed values ----------------------------------------------------
PAIR = ["left_table", "left_column", "right_table", "right_column"]


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def infer_unit(name: str) -> str:
    for unit, pattern in UNIT_HINTS:
        if re.search(pattern, name, re.IGNORECASE):
            return unit
    return "measure"


def column_facts(df: DataFrame) -> DataFrame:
    """Per column: present cells, distinct values, and whether the values stay
    inside one boolean vocabulary.  One shuffle of counted values."""
    wide = df.select(*[_q(c).cast("string").alias(c) for c in df.columns])
    vc = (wide.unpivot([], [_q(c) for c in wide.columns], "column", "value")
          .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    here = F.col("value").isNotNull()
    inside = [F.min(F.when(here, F.lower("value").isin(*pair))) for pair in BOOLEAN_PAIRS]
    return vc.groupBy("column").agg(
        F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias("n_present"),
        F.count("value").alias("n_distinct"),
        (F.coalesce(reduce(lambda a, b: a | b, inside), F.lit(False))
         & (F.count("value") <= 2)).alias("is_boolean"))


def is_time(df: DataFrame) -> DataFrame:
    """Timestamps and dates, or a date-like name whose present values all parse.

    One aggregate over all rows decides every column.
    """
    found = []
    for f in df.schema:
        v = _q(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            ok = F.lit(True)
        elif re.search(DATE_HINT, f.name, re.IGNORECASE) and isinstance(f.dataType, T.StringType):
            ok = (F.count(v) > 0) & (F.count(v) == F.count_if(v.isNotNull() & D.is_date(v)))
        else:
            continue
        found.append(F.struct(F.lit(f.name).alias("column"), ok.alias("is_time")))
    if not found:
        return df.sparkSession.createDataFrame([], "column string, is_time boolean")
    return df.agg(F.array(*found).alias("a")).selectExpr("inline(a)")


def column_roles(df: DataFrame) -> DataFrame:
    """Role of each column: time, boolean, id, measure or dimension."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    flags = [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)]
    units = F.create_map(*[F.lit(x) for c in df.columns for x in (c, infer_unit(c))])
    hinted = [c for c in df.columns
              if any(re.search(p, c, re.IGNORECASE) for _, p in UNIT_HINTS)]
    c = F.col("column")
    is_id = (F.col("n_present") > 0) & (
        c.rlike("(?i)" + ID_HINT)
        | ((F.col("n_present") > 30) & (F.col("n_distinct") / F.col("n_present") > 0.95)))
    measure = c.isin(*numeric) & ~((F.col("n_distinct") <= 6) & ~c.isin(*hinted))
    role = (F.when(F.coalesce("is_time", F.lit(False)), "time")
            .when(F.col("is_boolean") | c.isin(*flags), "boolean").when(is_id, "id")
            .when(measure, "measure").otherwise("dimension"))
    return (column_facts(df).join(is_time(df), "column", "left").select(
        "column", "n_present", "n_distinct", role.alias("role"))
        .withColumn("unit", F.when(F.col("role") == "measure", units[F.col("column")])))


def describe_columns(df: DataFrame) -> DataFrame:
    """Name, type and role of each column."""
    types = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    role = (F.when(F.col("role") == "time", "temporal").when(F.col("role") == "id", "key")
            .when(F.col("role") == "boolean", "attribute").otherwise(F.col("role")))
    return column_roles(df).select("column", types[F.col("column")].alias("type"),
                                   role.alias("role"))


def build_catalog(df: DataFrame, name: str = "dataset") -> Catalog:
    """A catalogue of metrics and dimensions for an unknown table.

    Reads one role per column; the data itself stays distributed.
    """
    roles = {r["column"]: (r["role"], r["unit"]) for r in column_roles(df).collect()}

    def label(c: str) -> str:
        return " ".join(w.capitalize() for w in re.sub(r"[_\-]+", " ", c).split())

    metrics = {"row_count": Metric("row_count", "Total Rows", "count")}
    dims: dict[str, Dimension] = {}
    times = [c for c in df.columns if roles[c][0] == "time"]
    grains = []
    for c in df.columns:
        role, unit = roles[c]
        expr = "`" + c + "`"
        if role == "measure":
            for agg, word in (("sum", "Total"), ("avg", "Average"), ("min", "Min"), ("max", "Max")):
                kind = RATIO if agg == "avg" and unit == COUNT else unit
                metrics[f"{agg}_{c}"] = Metric(f"{agg}_{c}", f"{word} {label(c)}", agg, expr, unit=kind)
        elif role == "id":
            metrics[f"distinct_{c}"] = Metric(f"distinct_{c}", f"Distinct {label(c)}",
                                              "count_distinct", expr)
        elif role == "time":
            for grain in GRAINS:
                key = f"{c}_{grain}" if len(times) > 1 else grain
                dims[key] = Dimension(key, f"{label(c)} ({grain.capitalize()})", expr, grain)
                grains.append(key)
        else:
            dims[c] = Dimension(c, label(c), expr)
    return Catalog(name, metrics, dims, {"time": tuple(grains)} if grains else {},
                   times[0] if times else None)


# --- matching columns of several tables -------------------------------------

def folded_values(tables: Mapping[str, DataFrame],
                  wanted: Mapping[str, Sequence[str]] | None = None,
                  fold: Callable[[Column], Column] = X.normalise_category,
                  blank: bool = False) -> DataFrame:
    """Distinct folded labels per (table, column), with one stored spelling.

    Only the ``wanted`` columns of a table are read (all, when not given), and
    empty values are no label unless ``blank``.
    Labels are reduced to distinct values before they are folded and moved,
    and lie by label, so that columns are compared without a further shuffle.
    """
    parts = []
    for name, df in tables.items():
        columns = df.columns if wanted is None else wanted.get(name, ())
        if not columns:
            continue
        wide = df.select(*[_q(c).cast("string").alias(c) for c in columns])
        parts.append(wide.unpivot([], [_q(c) for c in wide.columns], "column", "value")
                     .filter("value IS NOT NULL" + ("" if blank else " AND value <> ''")).distinct()
                     .withColumn("table", F.lit(name)))
    every = reduce(DataFrame.unionByName, parts)
    return (every.withColumn("folded", fold(F.col("value"))).repartition("folded")
            .groupBy("table", "column", "folded").agg(F.min("value").alias("value")))


def _split_ref(prefix: str) -> list[Column]:
    return [F.col(prefix + "_table").alias("table"), F.col(prefix + "_column").alias("column")]


def paired_columns(pairs: Sequence[Row]) -> dict[str, list[str]]:
    """The columns that some pair names, per table."""
    found: dict[str, list[str]] = {}
    for p in pairs:
        for side in ("left", "right"):
            held = found.setdefault(p[side + "_table"], [])
            if p[side + "_column"] not in held:
                held.append(p[side + "_column"])
    return found


def _pair_frame(spark: SparkSession, pairs: Sequence[Row]) -> DataFrame:
    """Known pairs of columns as rows of the plan itself."""
    if not pairs:
        return spark.createDataFrame([], ", ".join(f"{i} string" for i in PAIR) + ", is_exact boolean")
    return spark.range(1).select(F.explode(F.array(*[F.struct(
        *[F.lit(v).alias(k) for k, v in p.asDict().items()]) for p in pairs])).alias("p")).select("p.*")


def overlap_of_pairs(values: DataFrame, pairs: DataFrame, examples: int = 8) -> DataFrame:
    """Shared share of the smaller vocabulary for each pair of columns.

    A pair collects its two columns' labels side by side, grouped by label, so
    no label of one column is paired with every label of the other.  ``pairs``
    grows with the number of columns alone, and is broadcast: labels that lie
    by label stay where they are.
    """
    sides = F.explode(F.array(*[F.struct(*_split_ref(s), F.lit(s).alias("side"))
                                for s in ("left", "right")]))
    uses = pairs.select(*PAIR, sides.alias("u")).select(*PAIR, "u.*")
    met = values.join(F.broadcast(uses), ["table", "column"])
    return _overlap(met.select(*PAIR, "folded", "value", "side"), PAIR, examples)


def _overlap(sides: DataFrame, ids: Sequence[str], examples: int) -> DataFrame:
    """Overlap figures per ``ids`` from labels marked left or right."""
    per = sides.groupBy(*ids, "folded").agg(
        F.max(F.when(F.col("side") == "left", F.col("value"))).alias("l"),
        F.max(F.when(F.col("side") == "right", F.col("value"))).alias("r"))
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    counts = per.groupBy(*ids).agg(
        F.count_if(both).alias("n_shared"), F.count("l").alias("n_left"), F.count("r").alias("n_right"))
    alone = per.filter(~both).select(
        *ids, F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"),
        F.coalesce("l", "r").alias("value"))
    rank = F.row_number().over(Window.partitionBy(*ids, "side").orderBy("value"))
    few = alone.withColumn("k", rank).filter(F.col("k") <= examples).groupBy(*ids).agg(*[
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("value")))), "|")
        .alias("only_" + s) for s in ("left", "right")])
    stacked = counts.unionByName(few, allowMissingColumns=True)
    beside = stacked.groupBy(*ids).agg(*[F.first(c, ignorenulls=True).alias(c)
                                         for c in stacked.columns if c not in ids])
    share = F.round(F.try_divide(F.col("n_shared").cast("double"), F.least("n_left", "n_right")), 3)
    return beside.select(
        *ids, "n_shared", "n_left", "n_right", share.alias("overlap"),
        F.coalesce("only_left", F.lit("")).alias("only_left"),
        F.coalesce("only_right", F.lit("")).alias("only_right"))


def value_overlap(a: DataFrame, a_col: str, b: DataFrame, b_col: str, examples: int = 8) -> DataFrame:
    """Shared folded labels of two columns over the smaller vocabulary."""
    values = folded_values({"left": a.select(a_col), "right": b.select(b_col)})
    return _overlap(values.select(F.col("table").alias("side"), "folded", "value"), [], examples)


def column_names(tables: Mapping[str, Sequence[str]], spark) -> DataFrame:
    """(table, position, column) for every column of every table."""
    rows = [(i, t, j, c) for i, (t, cols) in enumerate(tables.items()) for j, c in enumerate(cols)]
    return spark.range(1).select(F.explode(F.array(*[F.struct(
        F.lit(i).alias("table_at"), F.lit(t).alias("table"), F.lit(j).alias("position"),
        F.lit(c).alias("column")) for i, t, j, c in rows])).alias("r")).select("r.*")


def name_pairs(names: DataFrame) -> DataFrame:
    """Columns of different tables whose names share meaning, with a score.

    Pairs meet on a shared token, so unrelated names are never compared.
    """
    c = F.col("column")
    named = names.select("*", X.meaning_tokens(c).alias("tokens"), X.canonical_name(c).alias("canon"))
    keyed = named.withColumn("key", F.explode(F.array_union("tokens", F.array("canon"))))
    left = keyed.select(*[F.col(x).alias("l_" + x) for x in ("table_at", "table", "column", "tokens", "canon")], "key")
    right = keyed.select(*[F.col(x).alias("r_" + x) for x in ("table_at", "table", "column", "tokens", "canon")], "key")
    met = left.join(right, "key").filter("l_table_at < r_table_at").drop("key").distinct()
    inter = F.size(F.array_intersect("l_tokens", "r_tokens"))
    union = F.size(F.array_union("l_tokens", "r_tokens"))
    subset = (inter == F.size("l_tokens")) | (inter == F.size("r_tokens"))
    score = F.when(F.col("l_canon") == F.col("r_canon"), 1.0).when(
        subset, F.greatest(inter / union, F.lit(0.75))).otherwise(inter / union)
    return (met.withColumn("name_score", F.round(score, 3)).filter(F.col("name_score") >= NAME_MATCH)
            .select(F.col("l_table").alias("left_table"), F.col("l_column").alias("left_column"),
                    F.col("r_table").alias("right_table"), F.col("r_column").alias("right_column"),
                    F.size("l_tokens").alias("left_tokens"), F.size("r_tokens").alias("right_tokens"),
                    "name_score"))


def match_columns(tables: Mapping[str, DataFrame], types: DataFrame) -> DataFrame:
    """Column pairs by name, with type agreement, value overlap and a verdict.

    ``types`` holds (table, column, inferred_type) from the profiles.  The pairs
    are settled first, by a job over the column names alone, so that only
    columns in some pair are read.  Without pairs the result is empty.
    """
    spark = types.sparkSession
    met = name_pairs(column_names({t: df.columns for t, df in tables.items()}, spark)).collect()
    if not met:
        return _matched(spark.createDataFrame(
            [], ", ".join(f"{i} string" for i in PAIR)
            + ", left_tokens int, right_tokens int, name_score double"), None, types)
    pairs = _pair_frame(spark, met)
    return _matched(pairs, overlap_of_pairs(folded_values(tables, paired_columns(met)), pairs), types)


def _matched(pairs: DataFrame, overlaps: DataFrame | None, types: DataFrame) -> DataFrame:
    ids = PAIR
    if overlaps is None:
        overlaps = pairs.select(*ids, F.lit(None).cast("double").alias("overlap"),
                                F.lit("").alias("only_left"), F.lit("").alias("only_right"))
    family = F.create_map(*[F.lit(x) for kv in TYPE_FAMILY.items() for x in kv])
    out = pairs.join(overlaps, ids, "left")
    for side in ("left", "right"):
        out = out.join(types.select(F.col("table").alias(side + "_table"),
                                    F.col("column").alias(side + "_column"),
                                    F.col("inferred_type").alias(side + "_type")),
                       [side + "_table", side + "_column"], "left")
    overlap = F.col("overlap")
    return out.select(
        F.concat_ws(".", "left_table", "left_column").alias("left"),
        F.concat_ws(".", "right_table", "right_column").alias("right"),
        *ids, "left_tokens", "right_tokens", "left_type", "right_type", "name_score",
        (F.coalesce(family[F.col("left_type")], F.lit("unknown"))
         == F.coalesce(family[F.col("right_type")], F.lit("unknown"))).alias("type_agreement"),
        "overlap", F.coalesce("only_left", F.lit("")).alias("only_left"),
        F.coalesce("only_right", F.lit("")).alias("only_right"),
        F.when(overlap.isNull(), "untested").when(overlap >= 0.8, "joinable")
        .when(overlap >= 0.2, "partial overlap").otherwise("not joinable").alias("verdict"))


def naming_conventions(names: DataFrame) -> DataFrame:
    """Columns per convention and table, and whether a table mixes them."""
    counted = (names.select("table", X.naming_convention(F.col("column")).alias("convention"))
               .groupBy("table", "convention").agg(F.count(F.lit(1)).alias("n")))
    mixed = counted.filter(F.col("convention").isin(*STRUCTURAL)).groupBy("table").agg(
        (F.count(F.lit(1)) > 1).alias("is_mixed"))
    return counted.join(mixed, "table", "left").withColumn(
        "is_mixed", F.coalesce("is_mixed", F.lit(False)))


def single_source_columns(names: DataFrame, matches: DataFrame) -> DataFrame:
    """Columns matched in no other table."""
    seen = matches.select(*_split_ref("left")).unionByName(matches.select(*_split_ref("right")))
    return names.select("table", "column").join(seen, ["table", "column"], "left_anti")


def proposed_schema(matches: DataFrame) -> DataFrame:
    """Name and type for each matched pair; both are kept when the
    vocabularies differ."""
    l, r = F.col("left_column"), F.col("right_column")
    winner = (F.when(F.col("left_tokens") > F.col("right_tokens"), l)
              .when(F.col("left_tokens") < F.col("right_tokens"), r)
              .when(X.naming_convention(l) == "snake_case", l)
              .when(X.naming_convention(r) == "snake_case", r).otherwise(F.least(l, r)))
    scale = F.array(*[F.lit(s) for s in SPECIFICITY])
    lt, rt = F.coalesce("left_type", F.lit("unknown")), F.coalesce("right_type", F.lit("unknown"))
    return matches.select(
        "left", "right",
        F.when(F.col("verdict") == "not joinable", F.concat(
            F.lit("keep both: "), X.canonical_name(l), F.lit(" + "), X.canonical_name(r)))
        .otherwise(X.concept_name(winner)).alias("proposed_name"),
        F.when(F.array_position(scale, lt) >= F.array_position(scale, rt), lt).otherwise(rt)
        .alias("proposed_type"))


def key_pairs(tables: Mapping[str, Sequence[str]]) -> list[Row]:
    """Columns of different tables that are named like two ends of one key.

    Names meet on what is left without ``_id``; any ``x_id`` also meets ``id``.
    """
    by_stem: dict[str, list[tuple[int, str, str, str]]] = {}
    keyed, plain = [], []
    for at, (table, columns) in enumerate(tables.items()):
        for column in columns:
            name = column.lower().strip()
            ref = (at, table, column, name)
            by_stem.setdefault(name.replace("_id", ""), []).append(ref)
            if name == "id":
                plain.append(ref)
            elif name.endswith("_id"):
                keyed.append(ref)
    alike = [(a, b) for held in by_stem.values() for a in held for b in held
             if a[0] < b[0] and (a[3] == b[3] or "id" in a[3])]
    ends = [tuple(sorted((a, b))) for a in keyed for b in plain if a[0] != b[0]]
    return [Row(left_table=a[1], left_column=a[2], right_table=b[1], right_column=b[2],
                is_exact=a[3] == b[3]) for a, b in dict.fromkeys([*alike, *ends])]


def candidate_joins(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Column pairs that look like a join key, by name and by exact overlap of
    their distinct values.  Only columns in some pair are read."""
    spark = next(iter(tables.values())).sparkSession
    met = key_pairs({t: df.columns for t, df in tables.items()})
    pairs = _pair_frame(spark, met)
    if not met:
        return pairs.select("*", F.lit(None).cast("double").alias("overlap"),
                            F.lit(None).cast("double").alias("confidence"))
    overlaps = overlap_of_pairs(folded_values(tables, paired_columns(met),
                                              lambda c: F.lower(X.strip(c)), blank=True), pairs)
    share = F.coalesce(F.try_divide(F.col("n_shared").cast("double"),
                                    F.least("n_left", "n_right")), F.lit(0.0))
    base = F.when(F.col("is_exact") & (share > 0.3), 0.95).when(F.col("is_exact"), 0.8).otherwise(0.7)
    return pairs.join(overlaps, PAIR, "left").select(
        *PAIR, "is_exact", F.round(share, 2).alias("overlap"),
        F.round(F.least(F.lit(1.0), base + F.when(share > 0.5, 0.1).otherwise(0.0)), 2)
        .alias("confidence"))
