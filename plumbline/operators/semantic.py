"""Semantic layer: gated metrics, ratios and dimensions over one table.

A gate belongs to its metric: it narrows that one aggregate and never the
rows of the query, so gated and ungated figures share one scan.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.format import COUNT

GRAINS = ("year", "quarter", "month", "day")

_AGGREGATES = {
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "count_distinct": F.count_distinct,
}


@dataclass(frozen=True)
class Metric:
    """One aggregate of one SQL expression, with an optional gate."""

    key: str
    label: str
    agg: str
    of: str = "*"
    gate: str | None = None
    unit: str = COUNT
    higher_is_better: bool = True
    about: str = ""

    def __post_init__(self) -> None:
        if self.agg not in _AGGREGATES:
            raise ValueError(
                f"metric {self.key!r}: {self.agg!r} is not a single aggregate; "
                "a composite figure is a Ratio of two metrics")
        if self.of == "*" and self.agg != "count":
            raise ValueError(f"metric {self.key!r}: only count takes '*'")

    def column(self, extra_gate: Column | None = None) -> Column:
        value = F.lit(1) if self.of == "*" else F.expr(self.of)
        keep = F.expr(self.gate) if self.gate else None
        if extra_gate is not None:
            keep = extra_gate if keep is None else keep & extra_gate
        return _AGGREGATES[self.agg](value if keep is None else F.when(keep, value))


@dataclass(frozen=True)
class Ratio:
    """One metric over another, each with its own gate; null over zero."""

    key: str
    label: str
    num: str
    den: str
    scale: float = 1.0
    unit: str = COUNT
    higher_is_better: bool = True
    about: str = ""


@dataclass(frozen=True)
class Measure:
    """A column of a purpose-built query; labelled here, never aggregated."""

    key: str
    label: str
    unit: str = COUNT
    higher_is_better: bool = True
    about: str = ""


@dataclass(frozen=True)
class Dimension:
    """A grouping expression; with a ``grain`` it is a truncated date."""

    key: str
    label: str
    expr: str
    grain: str | None = None

    def column(self) -> Column:
        value = F.expr(self.expr)
        if self.grain:
            value = F.date_trunc(self.grain, value).cast("timestamp_ntz")
        return value


@dataclass(frozen=True)
class Catalog:
    """What can be asked of one table."""

    name: str
    metrics: dict[str, Metric | Ratio | Measure] = field(default_factory=dict)
    dimensions: dict[str, Dimension] = field(default_factory=dict)
    drill_paths: dict[str, tuple[str, ...]] = field(default_factory=dict)
    date_column: str | None = None

    def metric(self, key: str) -> Metric | Ratio | Measure:
        return _known("metric", key, self.metrics)

    def dimension(self, key: str) -> Dimension:
        return _known("dimension", key, self.dimensions)

    def column(self, key: str, extra_gate: Column | None = None) -> Column:
        """The aggregate column of a metric or ratio."""
        m = self.metric(key)
        if isinstance(m, Measure):
            raise KeyError(f"{key!r} comes from a purpose-built query and cannot be grouped")
        if isinstance(m, Ratio):
            ratio = F.try_divide(self.column(m.num, extra_gate).cast("double"),
                                 self.column(m.den, extra_gate).cast("double"))
            return ratio if m.scale == 1.0 else F.lit(m.scale) * ratio
        return m.column(extra_gate)


def _known(kind: str, key: str, pool: dict):
    if key in pool:
        return pool[key]
    near = difflib.get_close_matches(key.lower(), list(pool), n=3, cutoff=0.6)
    hint = "did you mean " + ", ".join(near) if near else "known: " + ", ".join(sorted(pool))
    raise KeyError(f"unknown {kind} {key!r}; {hint}")


@dataclass(frozen=True)
class Filters:
    """An inclusive date window and per-dimension value lists."""

    date_from: str | None = None
    date_to: str | None = None
    where: dict[str, Sequence[str]] = field(default_factory=dict)

    def with_values(self, key: str, values: Sequence[str]) -> Filters:
        return replace(self, where={**self.where, key: tuple(values)})

    def predicate(self, df: DataFrame, catalog: Catalog) -> Column | None:
        parts: list[Column] = []
        if catalog.date_column and (self.date_from or self.date_to):
            parts += date_window(df, catalog.date_column, self.date_from, self.date_to)
        for key, values in self.where.items():
            if not values:
                continue
            dim = catalog.dimension(key).column()
            # A cast would keep the test from reaching the Parquet scan.
            if not isinstance(df.select(dim).schema[0].dataType, T.StringType):
                dim = dim.cast("string")
            parts.append(dim.isin(*[str(v) for v in values]))
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out

    def apply(self, df: DataFrame, catalog: Catalog) -> DataFrame:
        keep = self.predicate(df, catalog)
        return df if keep is None else df.filter(keep)


def date_window(df: DataFrame, column: str, date_from: str | None,
                date_to: str | None) -> list[Column]:
    """Predicates for a window that includes its whole last day."""
    dtype = df.schema[column].dataType
    target = "timestamp_ntz" if isinstance(dtype, T.StringType) else dtype.simpleString()
    col = F.col(column)
    if isinstance(dtype, T.StringType):
        col = col.cast(target)
    out = []
    if date_from:
        out.append(col >= F.lit(str(date_from)).cast(target))
    if date_to:
        end = datetime.fromisoformat(str(date_to)) + timedelta(days=1)
        out.append(col < F.lit(end.isoformat(sep=" ")).cast(target))
    return out


def ordered(df: DataFrame, order_by: str | None, *ties: str) -> DataFrame:
    """Sort by ``col`` or ``-col``, nulls last both ways."""
    keys = [order_by] if order_by else []
    keys += [t for t in ties if not order_by or t != order_by.lstrip("-")]
    cols = [F.desc_nulls_last(k[1:]) if k.startswith("-") else F.asc_nulls_last(k)
            for k in keys]
    return df.orderBy(*cols) if cols else df


def aggregate(df: DataFrame, catalog: Catalog, metrics: Iterable[str] = (),
              by: Sequence[str] = (), filters: Filters | None = None,
              order_by: str | None = None, limit: int | None = None,
              min_lines: int = 0) -> DataFrame:
    """One row per group, one column per metric, and the ungated ``n_lines``."""
    metrics = list(metrics)
    aggs = [catalog.column(k).alias(k) for k in metrics]
    dims = [catalog.dimension(k).column().alias(k) for k in by]
    if order_by and order_by.lstrip("-") not in (*metrics, *by, "n_lines"):
        raise KeyError(f"cannot order by {order_by!r}: not selected by this query")
    out = ((filters or Filters()).apply(df, catalog)
           .groupBy(*dims).agg(*aggs, F.count(F.lit(1)).alias("n_lines")))
    if min_lines:
        out = out.filter(F.col("n_lines") >= min_lines)
    if order_by:
        out = ordered(out, order_by, *by)
    elif by:
        out = ordered(out, None, *by)
    return out.limit(limit) if limit else out


def _leaves(catalog: Catalog, keys: Iterable[str]) -> dict[str, Metric]:
    """The single aggregates that metrics and ratios are made of."""
    out: dict[str, Metric] = {}
    for key in keys:
        m = catalog.metric(key)
        if isinstance(m, Measure):
            raise KeyError(f"{key!r} comes from a purpose-built query and cannot be grouped")
        out |= _leaves(catalog, [m.num, m.den]) if isinstance(m, Ratio) else {key: m}
    return out


def _reduced(df: DataFrame, catalog: Catalog, metrics: Sequence[str],
             dims: Sequence[Column]) -> tuple[DataFrame, list[Column]]:
    """One row per group and counted identity, with sums that merge, and the figures over them.

    What a distinct count counts becomes a grouping column, so every other figure is a
    sum, least or greatest of partial ones, and any coarser grouping reads these rows.
    """
    leaves = _leaves(catalog, metrics)
    name = {key: f"_m{i}" for i, key in enumerate(leaves)}
    parts: list[Column] = []
    counted: dict[tuple[str, str | None], str] = {}
    for key, m in leaves.items():
        value = F.lit(1) if m.of == "*" else F.expr(m.of)
        gated = F.when(F.expr(m.gate), value) if m.gate else value
        if m.agg == "count_distinct":
            name[key] = counted.setdefault((m.of, m.gate), name[key])
        elif m.agg == "avg":
            parts += [F.sum(gated).alias(name[key]), F.count(gated).alias(name[key] + "n"),
                      F.avg(gated).alias(name[key] + "t")]
        else:
            parts.append(_AGGREGATES[m.agg](gated).alias(name[key]))
    keys = [F.when(F.expr(gate), F.expr(of)).alias(n) if gate else F.expr(of).alias(n)
            for (of, gate), n in counted.items()]
    rows = df.groupBy(*dims, *keys).agg(*parts, F.count(F.lit(1)).alias("_lines"))

    def figure(key: str) -> Column:
        m = catalog.metric(key)
        if isinstance(m, Ratio):
            ratio = F.try_divide(figure(m.num).cast("double"), figure(m.den).cast("double"))
            return ratio if m.scale == 1.0 else F.lit(m.scale) * ratio
        at = name[key]
        if m.agg == "avg":
            return F.try_divide(F.sum(at), F.sum(at + "n")).cast(rows.schema[at + "t"].dataType)
        if m.agg == "count":
            return F.coalesce(F.sum(at), F.lit(0).cast("long"))
        return _AGGREGATES[m.agg](F.col(at))

    return rows, [*[figure(k).alias(k) for k in metrics],
                  F.coalesce(F.sum("_lines"), F.lit(0).cast("long")).alias("n_lines")]


def totals(df: DataFrame, catalog: Catalog, metrics: Iterable[str],
           filters: Filters | None = None) -> DataFrame:
    """One row over everything; computed on its own, never summed from groups.

    Several distinct counts would each expand the rows; they are counted over rows that
    are reduced once instead.
    """
    metrics = list(metrics)
    several = {(m.of, m.gate) for m in _leaves(catalog, metrics).values()
               if m.agg == "count_distinct"}
    if len(several) < 2:
        return aggregate(df, catalog, metrics, filters=filters)
    rows, figures = _reduced((filters or Filters()).apply(df, catalog), catalog, metrics, [])
    return rows.agg(*figures)


def timeseries(df: DataFrame, catalog: Catalog, metrics: Iterable[str],
               grain: str = "month", filters: Filters | None = None) -> DataFrame:
    path = catalog.drill_paths.get("time", ())
    if grain not in path:
        raise KeyError(f"grain must be one of {', '.join(path)}")
    return aggregate(df, catalog, metrics, by=[grain], filters=filters)


def date_bounds(df: DataFrame, catalog: Catalog) -> DataFrame:
    """First and last value of the catalogue's date column."""
    c = F.col(catalog.date_column)
    return df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))


def dimension_values(df: DataFrame, catalog: Catalog, key: str,
                     limit: int | None = None) -> DataFrame:
    """Distinct present values as text, most frequent first."""
    v = catalog.dimension(key).column().cast("string")
    out = (df.select(v.alias("value")).filter(F.col("value").isNotNull())
           .groupBy("value").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), F.asc("value")))
    return out.limit(limit) if limit else out


def drill(catalog: Catalog, filters: Filters, path: str, level: str,
          values: Sequence[str]) -> tuple[Filters, str | None]:
    """Narrow to ``values`` at ``level``; the next finer level, if any."""
    steps = catalog.drill_paths[path]
    at = steps.index(level)
    finer = steps[at + 1] if at + 1 < len(steps) else None
    return filters.with_values(level, values), finer


def rollup(df: DataFrame, catalog: Catalog, path: Sequence[str],
           metrics: Iterable[str], filters: Filters | None = None) -> DataFrame:
    """The same figures at every level of a path in one scan.

    ``level`` is 0 for the grand total and ``len(path)`` for the finest rows.
    Ratios and distinct counts are computed per level, not summed upwards.  Facts are
    first reduced to one row per finest group and counted identity, so only these rows
    are expanded to the levels.
    """
    metrics = list(metrics)
    base = (filters or Filters()).apply(df, catalog)
    rows, figures = _reduced(base, catalog, metrics,
                             [catalog.dimension(k).column().alias(k) for k in path])
    return rows.rollup(*path).agg(
        *figures,
        (F.lit(len(path)) - F.bit_count(F.grouping_id())).cast("int").alias("level"))


def group_sets(df: DataFrame, catalog: Catalog, metrics: Iterable[str],
               sets: Mapping[str, Sequence[str]], filters: Filters | None = None,
               reduce_first: bool = False) -> DataFrame:
    """Several groupings of one scan: ``frame`` names the set a row belongs to.

    Columns are ``frame``, every dimension of any set (null where a set lacks it), the
    metrics and ``n_lines``.  ``reduce_first`` pays where the finest grouping of all
    dimensions is much smaller than the facts, as along a path.  No two sets may be
    equal; groups whose value is null are told from sets without the dimension.
    """
    metrics = list(metrics)
    dims = list(dict.fromkeys(d for by in sets.values() for d in by))
    base = (filters or Filters()).apply(df, catalog)
    own = {k: f"_d{i}" for i, k in enumerate(dims)}
    if reduce_first:
        rows, figures = _reduced(base, catalog, metrics,
                                 [catalog.dimension(k).column().alias(n) for k, n in own.items()])
    else:
        rows = base.withColumns({n: catalog.dimension(k).column() for k, n in own.items()})
        figures = [*[catalog.column(k).alias(k) for k in metrics],
                   F.count(F.lit(1)).alias("n_lines")]
    ids = {name: sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in by)
           for name, by in sets.items()}
    if len(set(ids.values())) < len(ids):
        raise ValueError("two frames group by the same dimensions")
    out = rows.groupingSets([[F.col(own[d]) for d in by] for by in sets.values()],
                            *[F.col(n) for n in own.values()]).agg(
        *figures, F.grouping_id().alias("_set"))
    frame = F.lit(None).cast("string")
    for name, at in ids.items():
        frame = F.when(F.col("_set") == at, name).otherwise(frame)
    return out.select(frame.alias("frame"), *[F.col(n).alias(k) for k, n in own.items()],
                      *metrics, "n_lines")


def _pairs_of_letters(text: Column) -> Column:
    """The neighbouring letters of a text with marked ends, each with its turn among equals."""
    marked = F.concat(F.lit("\u0002"), text, F.lit("\u0003"))
    grams = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(text) + 1),
                                     lambda i: F.substring(marked, i, F.lit(2))))
    return F.transform(grams, lambda g, i: F.struct(
        g.alias("gram"), (i - F.array_position(grams, g)).alias("turn")))


def canonical_values(df: DataFrame, catalog: Catalog, key: str,
                     values: Sequence[str], near: int = 3) -> DataFrame:
    """Each asked value with its stored spelling, or the nearest spellings.

    Values meet on their lower case first.  Only those that no stored value
    equals are compared by edit distance, with stored values that share enough
    letter pairs: an edit changes at most two, so texts of m letters (the
    longer) at distance d keep m + 1 - 2d of them in common, which is over zero
    for the distances allowed (0.4 m).  Null stored values are left out.
    """
    spark = df.sparkSession
    asked = list(dict.fromkeys(str(v) for v in values))
    stored = (df.select(catalog.dimension(key).column().cast("string").alias("stored"))
              .filter(F.col("stored").isNotNull())
              .groupBy("stored").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("folded", F.lower("stored")))
    questions = spark.range(1).select(F.explode(F.array(*[F.lit(a) for a in asked])).alias("asked"))
    folded = questions.withColumn("folded", F.lower("asked"))
    exact = (folded.join(stored, "folded").groupBy("asked")
             .agg(F.max_by("stored", F.struct("n", "stored")).alias("canonical")))
    size, other = F.length("asked"), F.length("stored")
    longest = F.greatest(other, size)
    open_ = folded.join(exact, "asked", "left_anti").withColumnRenamed("folded", "low").select(
        "asked", "low", F.explode(_pairs_of_letters(F.col("low"))).alias("pair"))
    shortest, widest = (f(len(a) for a in asked) for f in (min, max)) if asked else (0, 0)
    in_reach = other.between(math.ceil(shortest * 0.6 - 1e-9), math.floor(widest / 0.6 + 1e-9))
    offered = stored.filter(in_reach).select(
        "stored", "folded", F.explode(_pairs_of_letters(F.col("folded"))).alias("pair"))
    alike = (open_.join(offered, "pair").groupBy("asked", "low", "stored", "folded")
             .agg(F.count(F.lit(1)).alias("shared"))
             .filter(F.col("shared") >= F.greatest(F.length("low"), F.length("folded")) + 1
                     - 2 * F.floor(0.4 * longest + 1e-9)))
    close = (alike.filter(other.between(F.ceil(size * 0.6 - 1e-9), F.floor(size / 0.6 + 1e-9)))
             .withColumn("distance", F.levenshtein("folded", "low"))
             .filter(F.col("distance") <= 0.4 * longest))
    rank = F.row_number().over(
        Window.partitionBy("asked").orderBy(F.asc("distance"), F.asc("stored")))
    nearest = (close.withColumn("r", rank).filter(F.col("r") <= near).groupBy("asked")
               .agg(F.array_join(F.transform(
                   F.sort_array(F.collect_list(F.struct("r", "stored"))),
                   lambda s: s["stored"]), ", ").alias("nearest")))
    return (questions.join(exact, "asked", "left").join(nearest, "asked", "left")
            .select("asked", "canonical", F.col("canonical").isNotNull().alias("known"), "nearest"))


def empty_result(frame: DataFrame, filters: Filters | None = None,
                 min_lines: int = 0) -> DataFrame:
    """Whether a result describes nothing, and what caused it."""
    f = filters or Filters()
    dated = bool(f.date_from or f.date_to)
    where = any(f.where.values())
    cause = ("min_lines" if min_lines else "combination" if where and dated
             else "filters" if where else "dates" if dated else "no rows")
    lines = F.max("n_lines") if "n_lines" in frame.columns else F.max(F.lit(1))
    return (frame.agg(F.coalesce(lines, F.lit(0)).alias("lines"))
            .select((F.col("lines") == 0).alias("is_empty"),
                    F.when(F.col("lines") == 0, cause).alias("cause")))
