"""Insight operators: outliers, comparisons, shifts, concentration.

Figures that are medians or shares of whole frames use aggregated rows as
scalar subqueries; nothing is ranked in one task except through a limit.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import replace
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.quantiles import median
from plumbline.operators.running import split_medians
from plumbline.operators.semantic import (
    Catalog, Filters, Measure, Ratio, aggregate, group_sets, ordered,
)

# --- fixed values -----------------------------------------------------------
Z_THRESHOLD = 3.5
MAD_TO_SIGMA = 0.6745
MEANAD_TO_SIGMA = 1.253314
MIN_POINTS = 4
# --- end of fixed values ----------------------------------------------------


def _joined(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    renamed = stats.select(*[F.col(k).alias("_g" + k) for k in by],
                           *[c for c in stats.columns if c not in by])
    on = F.lit(True)
    for k in by:
        on = on & df[k].eqNullSafe(renamed["_g" + k])
    return df.join(renamed, on, "left").drop(*["_g" + k for k in by])


def _centre(df: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """Attach the exact median of ``value`` and its count per group."""
    m = median(df, value, by).select(*by, F.col("median").alias(name), F.col("n").alias(name + "_n"))
    return _joined(df, m, by)


def _scaled(x: Column, n: Column, med: Column, mad: Column, mean_dev: Column) -> Column:
    scale = (F.when(n < MIN_POINTS, None)
             .when(mad > 0, mad / MAD_TO_SIGMA)
             .when(mean_dev > 0, mean_dev / MEANAD_TO_SIGMA))
    return (x - med) / scale


def robust_z(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "z") -> DataFrame:
    """Signed robust z-score: distance from the median over the scaled MAD.

    When the MAD is zero the mean absolute deviation over its own constant is
    used; under four points, or with all points equal, the score is null.
    Without groups the two medians are one row each and are read first, so the
    result itself is a plain projection.
    """
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    if by:
        base = df.withColumn("_x", x)
        mid = _centre(base, "_x", by, "_med").withColumn("_dev", F.abs(F.col("_x") - F.col("_med")))
        mean_dev = mid.groupBy(*by).agg(F.avg("_dev").alias("_mean_dev"))
        out = _joined(_centre(mid, "_dev", by, "_mad"), mean_dev, by)
        score = _scaled(F.col("_x"), F.col("_med_n"), F.col("_med"), F.col("_mad"), F.col("_mean_dev"))
        return out.withColumn(name, score).select(*df.columns, name,
                                                  F.col("_med").alias(name + "_median"))

    def number(v) -> Column:
        return F.lit(v).cast("double")

    first = median(df, x).first()
    dev = F.abs(x - number(first["median"]))
    mad = median(df, dev).first()["median"]
    mean_dev = None if mad else df.agg(F.avg(dev)).first()[0]
    return df.select("*", _scaled(x, F.lit(first["n"] or 0), number(first["median"]), number(mad),
                                  number(mean_dev)).alias(name),
                     number(first["median"]).alias(name + "_median"))


def flag_anomalies(df: DataFrame, value: str, threshold: float = Z_THRESHOLD,
                   by: Sequence[str] = ()) -> DataFrame:
    """The frame with ``z`` and ``is_anomaly``."""
    return robust_z(df, value, by).drop("z_median").withColumn(
        "is_anomaly", F.coalesce(F.abs("z") >= threshold, F.lit(False)))


def find_anomalies(df: DataFrame, value: str, label: str | Column,
                   threshold: float = Z_THRESHOLD) -> DataFrame:
    """Flagged points, worst first, with direction and distance in percent."""
    label = F.col(label) if isinstance(label, str) else label
    scored = robust_z(df.select(label.cast("string").alias("label"),
                                F.col(value).cast("double").alias("value")), "value")
    pct = F.try_divide(100.0 * (F.col("value") - F.col("z_median")), F.abs("z_median"))
    return (scored.filter(F.abs("z") >= threshold)
            .select("label", "value", "z", F.col("z_median").alias("median"),
                    F.when(F.col("z") > 0, "above").otherwise("below").alias("direction"),
                    pct.alias("pct_from_median"))
            .orderBy(F.abs("z").desc(), "label"))


def detect_anomalies(df: DataFrame, value: str, label: str,
                     threshold: float = 2.5) -> DataFrame:
    """The looser variant: rounded figures, 0% where the median is zero."""
    found = find_anomalies(df, value, label, threshold)
    return found.select(
        "label", "value", F.bround("z", 2).alias("z_score"), F.bround("median", 2).alias("median"),
        "direction", F.bround(F.coalesce("pct_from_median", F.lit(0.0)), 1).alias("pct_from_median"))


def prior_window(date_from: str, date_to: str) -> tuple[str, str]:
    """The window of the same length that ends the day before."""
    lo, hi = sorted((_day(date_from), _day(date_to)))
    end = lo - timedelta(days=1)
    return (end - (hi - lo)).isoformat(), end.isoformat()


def _day(text: str) -> date:
    return datetime.fromisoformat(str(text)).date()


def _window_gate(catalog: Catalog, lo: str, hi: str) -> Column:
    c = F.col(catalog.date_column)
    end = (_day(hi) + timedelta(days=1)).isoformat()
    return (c >= F.lit(lo).cast("timestamp_ntz")) & (c < F.lit(end).cast("timestamp_ntz"))


def _two_windows(df: DataFrame, catalog: Catalog, filters: Filters):
    """Rows of both windows and a gate for each, so one scan serves both."""
    lo, hi = sorted((filters.date_from, filters.date_to))
    plo, phi = prior_window(lo, hi)
    rows = replace(filters, date_from=plo, date_to=hi).apply(df, catalog)
    return rows, _window_gate(catalog, lo, hi), _window_gate(catalog, plo, phi)


def period_over_period(df: DataFrame, catalog: Catalog, metrics: Iterable[str],
                       filters: Filters | None = None) -> DataFrame:
    """Per metric: this window, the one before, the change and its direction."""
    metrics, f = list(metrics), filters or Filters()
    dated = bool(f.date_from and f.date_to)
    if dated:
        rows, now, before = _two_windows(df, catalog, f)
        aggs = [(catalog.column(m, now), catalog.column(m, before)) for m in metrics]
    else:
        rows = f.apply(df, catalog)
        aggs = [(catalog.column(m), F.lit(None)) for m in metrics]
    structs = [F.struct(F.lit(m).alias("metric"), a.cast("double").alias("current"),
                        b.cast("double").alias("previous"),
                        F.lit(catalog.metric(m).higher_is_better).alias("_up"))
               for m, (a, b) in zip(metrics, aggs)]
    delta = F.col("current") - F.col("previous")
    return (rows.agg(F.array(*structs).alias("a")).selectExpr("inline(a)")
            .select("metric", "current", "previous", delta.alias("delta"),
                    F.try_divide(100.0 * delta, F.abs("previous")).alias("delta_pct"),
                    F.when(F.col("_up"), delta >= 0).otherwise(delta <= 0).alias("improved")))


def benchmark_vs_parent(df: DataFrame, catalog: Catalog, metric: str, child: str = "category",
                        parent: str = "department", filters: Filters | None = None,
                        min_lines: int = 0) -> DataFrame:
    """Each child beside its own parent's figure, which is recomputed over the
    same rows rather than averaged from the children, in the same scan."""
    up = catalog.metric(metric).higher_is_better
    both = group_sets(df, catalog, [metric], {"child": [parent, child], "parent": [parent]},
                      filters, reduce_first=True)
    family = Window.partitionBy(parent)
    gap = F.col(metric) - F.col("parent_value")
    rows = (both.withColumn("parent_value", F.max(F.when(F.col("frame") == "parent", F.col(metric)))
                            .over(family))
            .where((F.col("frame") == "child") & (F.col("n_lines") >= min_lines)))
    out = (rows.select(parent, child, metric, "n_lines", "parent_value").withColumn("gap", gap)
           .withColumn("beats_parent", F.coalesce(
               F.col("gap") >= 0 if up else F.col("gap") <= 0, F.lit(False))))
    return ordered(out, "-gap" if up else "gap", parent, child)


def loss_makers(df: DataFrame, catalog: Catalog, by: str = "product",
                filters: Filters | None = None, limit: int | None = None, min_lines: int = 0) -> DataFrame:
    """Groups with a negative gated profit, deepest first."""
    rows = aggregate(df, catalog, ["profit", "revenue", "margin_pct", "units"], [by], filters,
                     min_lines=min_lines)
    out = rows.filter(F.col("profit") < 0).orderBy(F.asc("profit"), F.asc(by))
    return out.limit(limit) if limit else out


def movers(df: DataFrame, catalog: Catalog, metric: str, by: str, filters: Filters,
           limit: int | None = None, min_lines: int = 0) -> DataFrame:
    """Change per value between a window and the one before, largest first.

    Both windows come from one aggregation, so a value seen in only one of
    them is kept.  A missing sum or count is zero; a missing ratio stays null.
    """
    if not (filters.date_from and filters.date_to):
        raise ValueError("movers needs a dated window to compare against")
    rows, now, before = _two_windows(df, catalog, filters)
    additive = not isinstance(catalog.metric(metric), (Ratio, Measure))
    out = rows.groupBy(catalog.dimension(by).column().alias(by)).agg(
        catalog.column(metric, now).alias("_now"), catalog.column(metric, before).alias("_was"),
        F.count_if(now).alias("_n_now"), F.count_if(before).alias("_n_was"))
    floor = max(min_lines, 1)

    def side(value: str, n: str) -> Column:
        v = F.when(F.col(n) >= floor, F.col(value))
        return (F.coalesce(v, F.lit(0)) if additive else v).cast("double")

    delta = F.col(metric) - F.col(metric + "_prior")
    moved = (out.filter((F.col("_n_now") >= floor) | (F.col("_n_was") >= floor))
            .select(by, side("_now", "_n_now").alias(metric),
                    side("_was", "_n_was").alias(metric + "_prior"))
            .withColumn("delta", delta)
            .withColumn("delta_pct", F.try_divide(100.0 * F.col("delta"),
                                                  F.abs(metric + "_prior")))
            .orderBy(F.abs("delta").desc_nulls_last(), F.asc(by)))
    return moved.limit(limit) if limit else moved


def composition_shift(df: DataFrame, catalog: Catalog, metric: str = "lines_per_order",
                      grain: str = "month", threshold: float = 0.25, min_side: int = 3,
                      filters: Filters | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The split of a series whose two medians differ most, if far enough.

    With ``by`` every group has its own series and at most one row.  The
    earliest of equal splits wins; a series shorter than both sides has none.
    """
    series = aggregate(df, catalog, [metric], [grain, *by], filters)
    left = F.col("place") - 1
    ratio = F.try_divide(F.col("after"), F.col("before"))
    scored = (split_medians(series, grain, metric, by)
              .filter((left >= min_side) & (F.col("n") - left >= min_side))
              .withColumn("score", F.abs(ratio - 1.0)).filter(F.col("score").isNotNull()))
    shown = F.struct("at", "before", "after", left.alias("n_before"),
                     (F.col("n") - left).alias("n_after"), ratio.alias("ratio"))
    return (scored.groupBy(*by).agg(F.max("score").alias("score"), F.max_by(
                shown, F.struct("score", -F.col("place"))).alias("s"))
            .filter(F.col("score") >= threshold).select(*by, "s.*"))


def confounding(df: DataFrame, catalog: Catalog, dim: str, grain: str = "month",
                filters: Filters | None = None) -> DataFrame:
    """How far a dimension is separated in time: per period, the share of
    ungated rows in its largest value."""
    cells = aggregate(df, catalog, [], [grain, dim], filters)
    periods = cells.groupBy(grain).agg(
        (100.0 * F.max("n_lines") / F.sum("n_lines")).alias("share"),
        F.count(F.lit(1)).alias("values"))
    n_values = cells.groupBy(dim).agg(F.lit(1).alias("x")).agg(F.count(F.lit(1)).alias("n")).scalar()
    # One row per calendar period, so the built-in median is small.
    out = periods.agg(F.count(F.lit(1)).alias("periods"),
                      F.count_if(F.col("values") > 1).alias("multi_value_periods"),
                      F.coalesce(F.median("share"), F.lit(0.0)).alias("median_top_share"))
    return out.select(F.lit(dim).alias("dimension"), F.lit(grain).alias("grain"),
                      n_values.alias("n_values"), "periods", "multi_value_periods",
                      "median_top_share",
                      (F.col("median_top_share") >= 90.0).alias("is_time_partitioned"))


def gate_impact(df: DataFrame, catalog: Catalog, gated: str = "revenue",
                ungated: str = "revenue_ungated") -> DataFrame:
    """What the gate leaves out, as an amount and a share of the raw total."""
    return df.agg(catalog.column(gated).alias("gated"),
                  catalog.column(ungated).alias("ungated")).select(
        "gated", "ungated", (F.col("ungated") - F.col("gated")).alias("excluded"),
        F.try_divide(100.0 * (F.col("ungated") - F.col("gated")), F.col("ungated"))
        .alias("excluded_pct"))


def ranking_share(df: DataFrame, metric: str, label: str, top: int = 3,
                  ascending: bool = False) -> DataFrame:
    """The leaders and their joint share of the total.  The share is null when
    signs are mixed or nothing is left out."""
    v = F.col(metric).cast("double")
    all_ = df.agg(F.struct(F.sum(v).alias("total"), F.count(F.lit(1)).alias("n"),
                           (F.min(v) >= 0).alias("up"), (F.max(v) <= 0).alias("down"))
                  .alias("s")).scalar()
    head = ordered(df, metric if ascending else "-" + metric, label).limit(top)
    # ``top`` rows: a window over them is small.
    rank = F.row_number().over(Window.orderBy(
        F.asc_nulls_last(metric) if ascending else F.desc_nulls_last(metric), F.asc(label)))
    led = F.sum(v).over(Window.partitionBy(F.lit(0)))
    share = F.when((all_["n"] > top) & (all_["up"] | all_["down"]),
                   F.try_divide(100.0 * led, all_["total"]))
    return head.select(rank.alias("rank"), F.col(label).alias("label"), v.alias("value"),
                       led.alias("leaders_total"), all_["total"].alias("total"),
                       share.alias("leaders_share_pct"))


def trend_endpoints(df: DataFrame, time: str, group: str, metric: str) -> DataFrame:
    """The largest group's first, last and peak period."""
    v = F.col(metric).cast("double")
    return (df.groupBy(group).agg(
        F.sum(v).alias("total"), F.min(time).alias("first_at"), F.min_by(v, time).alias("first_value"),
        F.max(time).alias("last_at"), F.max_by(v, time).alias("last_value"),
        F.max(F.struct(v.alias("v"), F.col(time).alias("t"))).alias("_peak"))
        .orderBy(F.desc_nulls_last("total"), F.asc(group)).limit(1)
        .select(F.col(group).alias("label"), "total", "first_at", "first_value", "last_at",
                "last_value", F.col("_peak.t").alias("peak_at"), F.col("_peak.v").alias("peak_value")))


def spread_summary(df: DataFrame, dim: str, count: str, cut: float = 0.0) -> DataFrame:
    """The commonest value and the share of the mass at or below ``cut``."""
    n = F.coalesce(F.col(count), F.lit(0))
    return df.agg(F.max_by(dim, F.struct(n, -F.col(dim))).alias("modal_value"),
                  F.max(n).alias("modal_count"), F.sum(n).alias("total"),
                  F.sum(F.when(F.col(dim) <= cut, n)).alias("_w")).select(
        "modal_value", "modal_count", "total",
        F.try_divide(100.0 * F.coalesce("_w", F.lit(0)), F.col("total")).alias("share_at_or_below"))


def grid_extremes(df: DataFrame, row: str, col: str, metric: str,
                  higher_is_better: bool = True) -> DataFrame:
    """Best and worst cell of a grid and the number of empty combinations."""
    cell = F.struct(F.col(row).alias("r"), F.col(col).alias("c"), F.col(metric).alias("v"))
    order = F.struct(F.col(metric), F.col(row), F.col(col))
    here = F.col(metric).isNotNull()
    high = F.max_by(F.when(here, cell), F.when(here, order))
    low = F.min_by(F.when(here, cell), F.when(here, order))
    n_rows = df.select(row).filter(F.col(row).isNotNull()).distinct().agg(F.count(F.lit(1))).scalar()
    n_cols = df.select(col).filter(F.col(col).isNotNull()).distinct().agg(F.count(F.lit(1))).scalar()
    best, worst = (high, low) if higher_is_better else (low, high)
    return df.agg(best.alias("b"), worst.alias("w"), F.count(F.lit(1)).alias("n")).select(
        F.col("b.r").alias("best_row"), F.col("b.c").alias("best_col"), F.col("b.v").alias("best_value"),
        F.col("w.r").alias("worst_row"), F.col("w.c").alias("worst_col"),
        F.col("w.v").alias("worst_value"), (n_rows * n_cols - F.col("n")).alias("empty_cells"))


def segment_summary(df: DataFrame, metric: str, label: str) -> DataFrame:
    """Total, extremes and their shares, median, spread and top-three share.
    No row for fewer than two segments or a total that is not positive."""
    d = df.select(F.col(label).cast("string").alias("l"), F.col(metric).try_cast("double").alias("v")
                  ).filter(F.col("v").isNotNull())
    top3 = d.orderBy(F.desc("v"), F.asc("l")).limit(3).agg(F.sum("v")).scalar()
    mid = median(d, "v").select("median").scalar()
    stats = d.agg(
        F.sum("v").alias("total"), F.max_by("l", F.struct("v", "l")).alias("top_label"),
        F.max("v").alias("top_value"), F.min_by("l", F.struct("v", "l")).alias("bottom_label"),
        F.min("v").alias("bottom_value"), F.count(F.lit(1)).alias("n_segments"))
    out = stats.select("*", mid.alias("median_value"), top3.alias("_top3"))

    def share(c: str) -> Column:
        return F.bround(F.col(c) / F.col("total") * 100, 1)

    return out.filter((F.col("n_segments") >= 2) & (F.col("total") > 0)).select(
        "total", "top_label", "top_value", share("top_value").alias("top_share_pct"),
        "bottom_label", "bottom_value", share("bottom_value").alias("bottom_share_pct"),
        "median_value",
        F.when(F.col("median_value") > 0, F.bround(
            F.col("top_value") / F.greatest(F.col("median_value"), F.lit(1e-9)), 1))
        .otherwise(1.0).alias("top_vs_median_ratio"),
        share("_top3").alias("top_3_share_pct"), "n_segments")


def concentration_flags(summary: DataFrame) -> DataFrame:
    """Whether three segments hold half, and whether the leader stands apart."""
    return summary.select(
        "*", ((F.col("n_segments") >= 3) & (F.col("top_3_share_pct") >= 50.0)).alias("is_concentrated"),
        (F.col("top_vs_median_ratio") >= 1.5).alias("is_spread"))


def next_drill(df: DataFrame, catalog: Catalog, metric: str, by: Sequence[str],
               limit: int | None = None) -> DataFrame:
    """Follow-up specs: the top segment split by the next unused dimension,
    and the top five when the frame is long."""
    dim = by[0]
    unused = [d for d in catalog.dimensions if d not in by]
    top = F.max_by(F.col(dim).cast("string"), F.struct(F.col(metric), F.col(dim)))
    steps = []
    if unused:
        steps.append(F.struct(F.lit("drill").alias("action"), F.lit(dim).alias("where_dim"),
                              top.alias("where_value"), F.lit(unused[0]).alias("by"),
                              F.lit(None).cast("int").alias("limit"), F.lit(True).alias("_on")))
    steps.append(F.struct(F.lit("top").alias("action"), F.lit(None).cast("string").alias("where_dim"),
                          F.lit(None).cast("string").alias("where_value"), F.lit(dim).alias("by"),
                          F.lit(5).alias("limit"),
                          ((F.count(F.lit(1)) > 5) & F.lit(limit is None)).alias("_on")))
    return df.agg(F.array(*steps).alias("a")).selectExpr("inline(a)").filter("_on").drop("_on")
