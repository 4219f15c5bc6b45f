"""Chart-shaped frames, browsing and summaries (the data part only)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import format as X
from plumbline.operators.quantiles import median
from plumbline.operators.semantic import Catalog, Filters, aggregate, ordered
from plumbline.session import materialise


def top_groups_series(df: DataFrame, time: str, group: str, metric: str, k: int = 6) -> DataFrame:
    """Only the k groups with the largest totals, and how many were left out."""
    totals = df.groupBy(group).agg(F.sum(metric).alias("_t"))
    n = totals.agg(F.count(F.lit(1))).scalar()
    keep = totals.orderBy(F.desc_nulls_last("_t"), F.asc(group)).limit(k).select(
        F.col(group).alias("_g"))
    return (df.join(keep, df[group].eqNullSafe(keep["_g"]), "left_semi")
            .select(time, group, metric, F.greatest(n - k, F.lit(0)).alias("n_omitted")))


def pivot_grid(df: DataFrame, row: str, col: str, metric: str, values: Sequence) -> DataFrame:
    """One row per row value and one column per col value; blank is not zero."""
    return df.groupBy(row).pivot(col, list(values)).agg(F.first(metric))


def ranked_bars(df: DataFrame, catalog: Catalog, dim: str, metric: str, limit: int = 25,
                filters: Filters | None = None, natural_order: bool = False) -> DataFrame:
    """Groups in the metric's own good-first order with the truncated count;
    an ordered dimension keeps its natural order."""
    frame = aggregate(df, catalog, [metric], [dim], filters)
    n = frame.agg(F.count(F.lit(1))).scalar()
    up = catalog.metric(metric).higher_is_better
    order = dim if natural_order else ("-" if up else "") + metric
    return ordered(frame, order, dim).limit(limit).withColumn(
        "n_truncated", F.greatest(n - limit, F.lit(0)))


def median_quadrants(df: DataFrame, x: str, y: str) -> DataFrame:
    """Each point's quadrant by the exact medians of both measures.

    The points are computed once: a sum of doubles taken again may differ in its last
    digit, and the middle point would then miss the median that is its own value.
    """
    df = materialise(df)
    mx = median(df, x).select("median").scalar()
    my = median(df, y).select("median").scalar()
    right, high = F.col(x) >= mx, F.col(y) >= my
    return df.select("*", mx.alias("x_median"), my.alias("y_median"), F.concat_ws(
        " ", F.when(high, "high").otherwise("low"), F.lit(y + ","),
        F.when(right, "high").otherwise("low"), F.lit(x)).alias("quadrant"))


def top_n_with_other(df: DataFrame, dim: str, metric: str, n: int = 5) -> DataFrame:
    """The n largest groups and the rest as 'Other', with shares."""
    groups = df.groupBy(F.col(dim).cast("string").alias("label")).agg(
        F.sum(metric).cast("double").alias("value"))
    total = groups.agg(F.sum("value")).scalar()
    top = groups.orderBy(F.desc_nulls_last("value"), F.asc("label")).limit(n)
    shown = top.agg(F.struct(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"))).scalar()
    rest = groups.agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("k")).filter(
        F.col("k") > shown["n"]).select(F.lit("Other").alias("label"),
                                        (F.col("v") - shown["v"]).alias("value"))
    return top.unionByName(rest).select(
        "label", "value", F.try_divide(100.0 * F.col("value"), total).alias("share_pct"))


def dense_trend(df: DataFrame, period: Column, group: str, value: str) -> DataFrame:
    """Sum per period and group, with zero for combinations without rows.

    The periods are a table numbered 1..n.  Every group is expanded over that
    range of numbers and meets its periods by number, so no row holds the
    calendar and no rows are paired.  Null periods are left out; a null group
    is a group.
    """
    cells = df.groupBy(period.alias("period"), F.col(group).alias("group")).agg(
        F.sum(value).alias("value"))
    axis = cells.select("period").filter(F.col("period").isNotNull()).distinct().withColumn(
        "place", F.row_number().over(Window.orderBy("period")))
    last = axis.agg(F.coalesce(F.max("place"), F.lit(0)).alias("n")).scalar()
    grid = (cells.groupBy(F.col("group").alias("g")).agg(last.alias("last"))
            .filter(F.col("last") > 0)
            .select("g", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("place"))
            .join(axis.withColumnRenamed("period", "p"), "place"))
    return (grid.join(cells, grid["g"].eqNullSafe(cells["group"])
                      & (grid["p"] == cells["period"]), "left")
            .select(F.col("p").alias("period"), F.col("g").alias("group"),
                    F.coalesce("value", F.lit(0.0)).alias("value")))


def result_shape(frame: DataFrame, dims: Sequence[str], metrics: Sequence[str],
                 grains: Sequence[str] = ("year", "quarter", "month", "day")) -> DataFrame:
    """Which chart a result is shaped for, beside its row count."""
    timed = [d for d in dims if d in grains]
    rows = F.count(F.lit(1))
    if not dims:
        shape = F.lit("kpi")
    elif len(dims) > 2 or not metrics:
        shape = F.lit("table")
    elif timed and len(dims) == 1:
        shape = F.when(rows > 1, "line").otherwise("kpi")
    elif timed:
        shape = F.lit("grouped line")
    elif len(dims) == 2:
        shape = F.lit("heatmap")
    elif len(metrics) == 2:
        shape = F.lit("scatter")
    else:
        shape = F.lit("bar")
    return frame.agg(F.when(rows == 0, "table").otherwise(shape).alias("shape"),
                     rows.alias("n_rows"))


def display_frame(df: DataFrame, catalog: Catalog) -> DataFrame:
    """Registry columns as labelled text; folded keys dropped."""
    out = []
    for c in df.columns:
        if c.endswith("_key") and c[:-4] in df.columns:
            continue
        if c in catalog.metrics:
            m = catalog.metrics[c]
            out.append(X.fmt(F.col(c), m.unit).alias(m.label))
        elif c in catalog.dimensions:
            d = catalog.dimensions[c]
            out.append(X.fmt_dim(F.col(c), d.grain).alias(d.label))
        else:
            out.append(F.col(c))
    return df.select(*out)


# --- browsing ---------------------------------------------------------------

def search_rows(df: DataFrame, term: str, first_n: int | None = None) -> DataFrame:
    """Rows holding the term, any case, in any column, or one of the first ``first_n``."""
    needle = F.lit(term.lower())
    tests = [F.contains(F.lower(F.col(f"`{c}`").cast("string")), needle)
             for c in df.columns[:first_n]]
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests]))


def page_rows(df: DataFrame, sort: str | None = None, descending: bool = False, page: int = 1,
              size: int = 50, ties: Sequence[str] = ()) -> DataFrame:
    """One page, nulls last, with the total rows and pages on every row."""
    size, page = max(size, 1), max(page, 1)
    if not (sort or ties):
        raise ValueError("pages need a sort column or ties that order the rows")
    total = df.agg(F.count(F.lit(1))).scalar()
    out = ordered(df, ("-" if descending else "") + sort if sort else None, *ties)
    return out.offset((page - 1) * size).limit(size).select(
        "*", total.alias("total_rows"), F.ceil(total / size).alias("total_pages"))


def page_after(df: DataFrame, keys: Sequence[str], last: Sequence | None = None,
               size: int = 50) -> DataFrame:
    """The page behind the row whose ``keys`` are ``last``; the first page without it.

    ``-key`` sorts downwards, nulls come last either way, and the keys together
    should tell rows apart.  The page is a filter and a limited sort, so a late
    page costs what the first does, where an offset sorts all pages before it.
    """
    if not keys or (last is not None and len(last) != len(keys)):
        raise ValueError("pages need keys, and a last value for each of them")
    names = [k.removeprefix("-") for k in keys]
    behind, same = F.lit(last is None), F.lit(True)
    for key, name, value in zip(keys, names, last or (), strict=False):
        if value is not None:
            c = F.col(name)
            further = (c < F.lit(value)) if key.startswith("-") else (c > F.lit(value))
            behind = behind | (same & (further | c.isNull()))
        same = same & F.col(name).eqNullSafe(F.lit(value))
    order = [F.desc_nulls_last(n) if k.startswith("-") else F.asc_nulls_last(n)
             for k, n in zip(keys, names, strict=True)]
    return df.filter(behind).orderBy(*order).limit(max(size, 1))


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def measure_summary(df: DataFrame, measures: Sequence[str], first_n: int | None = None) -> DataFrame:
    """Sum, average, minimum and maximum per measure."""
    rows = [F.struct(F.lit(m).alias("measure"), F.sum(m).cast("double").alias("sum"),
                     F.avg(m).alias("avg"), F.min(m).cast("double").alias("min"),
                     F.max(m).cast("double").alias("max")) for m in list(measures)[:first_n]]
    return df.agg(F.array(*rows).alias("a")).selectExpr("inline(a)")


def dimension_summary(df: DataFrame, dimensions: Sequence[str], first_n: int | None = None,
                      top: int = 3) -> DataFrame:
    """Cardinality and most frequent values per dimension."""
    dims = list(dimensions)[:first_n]
    vc = (df.select(*[F.col(d).cast("string").alias(d) for d in dims])
          .unpivot([], dims, "dimension", "value").filter(F.col("value").isNotNull())
          .groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n")))
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), F.asc("value")))
    head = (vc.withColumn("r", rank).filter(F.col("r") <= top).groupBy("dimension").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "value", "n"))),
                                 lambda s: F.concat_ws("=", s["value"], s["n"].cast("string"))),
                     "|").alias("top_values")))
    return vc.groupBy("dimension").agg(F.count(F.lit(1)).alias("n_distinct")).join(head, "dimension")


def overview_bars(df: DataFrame, catalog: Catalog, metric: str, dim: str, n: int = 8) -> DataFrame:
    return aggregate(df, catalog, [metric], [dim], order_by="-" + metric, limit=n)


def frame_kpis(df: DataFrame, metric: str) -> DataFrame:
    """Total, number of groups and average per group of a result frame."""
    return df.agg(F.sum(metric).cast("double").alias("total"), F.count(F.lit(1)).alias("n_groups"),
                  F.avg(metric).alias("average"))
