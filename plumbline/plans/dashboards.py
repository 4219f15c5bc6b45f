"""Fixed bundles of operators, each a name to frame mapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import funnel as FN
from plumbline.operators import insights as I
from plumbline.operators import versions as VE
from plumbline.operators.semantic import Catalog, Filters, aggregate, group_sets, timeseries, totals

Bundle = dict[str, DataFrame]

#: What the grouped frames of each bundle show: metrics, and the dimensions they are by.
FRAMES: dict[str, dict[str, tuple[Sequence[str], Sequence[str]]]] = {
    "overview": {
        "totals": (("revenue", "profit", "margin_pct", "orders", "aov"), ()),
        "trend": (("revenue", "profit"), ("month",)),
        "by_market": (("revenue",), ("market",)),
        "by_department": (("revenue",), ("department",)),
    },
    "delivery": {
        "totals": (("shipped_lines", "on_time_pct", "late_pct", "avg_delay_days"), ()),
        "by_mode": (("late_pct", "shipped_lines"), ("shipping_mode",)),
        "delays": (("shipped_lines",), ("delay_days",)),
        "trend": (("late_pct",), ("month",)),
        "grid": (("late_pct",), ("market", "shipping_mode")),
    },
    "profitability": {
        "by_category": (("profit", "margin_pct", "discount_pct"), ("category",)),
        "by_department": (("profit", "revenue"), ("department",)),
        "products": (("profit", "revenue", "margin_pct", "units"), ("product",)),
        "benchmark": (("margin_pct",), ("department", "category")),
    },
    "geography": {
        "market": (("revenue", "margin_pct", "orders"), ("market",)),
        "country": (("revenue", "margin_pct", "orders"), ("country",)),
        "trend": (("revenue",), ("month", "market")),
        "segments": (("revenue", "margin_pct"), ("segment",)),
    },
}


def frames(df: DataFrame, catalog: Catalog, bundle: str, filters: Filters | None = None) -> DataFrame:
    """All grouped frames of a bundle from one scan of the facts, as rows named by ``frame``.

    A metric that a frame does not show is null there.
    """
    own = FRAMES[bundle]
    metrics = list(dict.fromkeys(m for shown, _ in own.values() for m in shown))
    out = group_sets(df, catalog, metrics, {name: by for name, (_, by) in own.items()}, filters)
    return out.withColumns({m: F.when(F.col("frame").isin(
        [name for name, (shown, _) in own.items() if m in shown]), F.col(m)) for m in metrics})


def frame(rows: DataFrame, bundle: str, name: str) -> DataFrame:
    """One frame of ``frames`` with its own columns."""
    shown, by = FRAMES[bundle][name]
    return rows.where(F.col("frame") == name).select(*by, *shown, "n_lines")


def overview(df: DataFrame, catalog: Catalog, filters: Filters | None = None) -> Bundle:
    keys = ["revenue", "profit", "margin_pct", "orders", "aov"]
    return {
        "totals": totals(df, catalog, keys, filters),
        "comparison": I.period_over_period(df, catalog, keys, filters),
        "trend": timeseries(df, catalog, ["revenue", "profit"], "month", filters),
        "by_market": aggregate(df, catalog, ["revenue"], ["market"], filters, "-revenue"),
        "by_department": aggregate(df, catalog, ["revenue"], ["department"], filters, "-revenue"),
        "gate": I.gate_impact(df, catalog),
        "shift": I.composition_shift(df, catalog, filters=filters),
    }


def delivery(df: DataFrame, catalog: Catalog, filters: Filters | None = None) -> Bundle:
    return {
        "totals": totals(df, catalog, ["shipped_lines", "on_time_pct", "late_pct",
                                       "avg_delay_days"], filters),
        "by_mode": aggregate(df, catalog, ["late_pct", "shipped_lines"], ["shipping_mode"], filters),
        "delays": aggregate(df, catalog, ["shipped_lines"], ["delay_days"], filters),
        "trend": timeseries(df, catalog, ["late_pct"], "month", filters),
        "grid": aggregate(df, catalog, ["late_pct"], ["market", "shipping_mode"], filters),
    }


def profitability(df: DataFrame, catalog: Catalog, filters: Filters | None = None) -> Bundle:
    return {
        "by_category": aggregate(df, catalog, ["profit", "margin_pct", "discount_pct"],
                                 ["category"], filters, "-profit"),
        "losses": I.loss_makers(df, catalog, filters=filters),
        "benchmark": I.benchmark_vs_parent(df, catalog, "margin_pct", filters=filters),
    }


def geography(df: DataFrame, catalog: Catalog, filters: Filters | None = None) -> Bundle:
    return {
        level: aggregate(df, catalog, ["revenue", "margin_pct", "orders"], [level], filters,
                         "-revenue")
        for level in catalog.drill_paths["geography"]
    }


def funnel(df: DataFrame, log: DataFrame, by: str = "product") -> Bundle:
    groups = FN.funnel(log, df, by)
    return {
        "totals": FN.funnel_totals(log, df),
        "groups": groups,
        "viewed_never_ordered": FN.viewed_never_ordered(groups),
        "ordered_never_viewed": FN.ordered_never_viewed(groups),
        "unmatched": FN.unmatched_keys(log, df, by),
    }


def health(manifests: DataFrame, results: DataFrame, alerts: DataFrame) -> Bundle:
    """From manifests, rule results and alerts only; no data is read."""
    return {
        "history": VE.snapshot_history(manifests),
        "failing": results.filter("status <> 'pass'"),
        "alerts": alerts,
        "counts": VE.alert_counts(alerts),
    }
