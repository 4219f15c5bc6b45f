"""Two-table funnel: events against facts, joined on a folded label.

Both sides are aggregated before the join and clamped to the window the event
log covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import fold_key

FUNNEL_DIMS = ("product", "category", "department")


def with_join_keys(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add a folded key beside each label: ``{label column: key column}``."""
    return df.withColumns({key: fold_key(F.col(c)) for c, key in columns.items()})


def event_window(log: DataFrame, at: str = "viewed_at") -> DataFrame:
    """First and last day the log covers."""
    return log.agg(F.to_date(F.min(at)).alias("lo"), F.to_date(F.max(at)).alias("hi"))


def _daily(log: DataFrame, at: str, *labels: str) -> DataFrame:
    """Views per day (and label): what both the window and the counts are read from."""
    return log.groupBy(*labels, F.to_date(at).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))


def _span(daily: DataFrame) -> Column:
    """Count, first and last day as one scalar; it shares the exchange of ``daily``, so the
    log is scanned once, and is a constant by the time the facts are scanned."""
    return daily.agg(F.struct(F.sum("_n").alias("n"), F.min("_day").alias("lo"),
                              F.max("_day").alias("hi")).alias("s")).scalar()


def _in_window(df: DataFrame, at: str, span: Column) -> DataFrame:
    return df.filter((F.col(at) >= span["lo"].cast("timestamp_ntz"))
                     & (F.col(at) < F.date_add(span["hi"], 1).cast("timestamp_ntz")))


def _rate(orders: Column, views: Column) -> Column:
    return F.try_divide(F.lit(100.0) * orders, views.cast("double"))


def funnel(log: DataFrame, facts: DataFrame, by: str = "product",
           limit: int | None = None, log_at: str = "viewed_at",
           fact_at: str = "order_date", order_id: str = "order_id",
           value: str = "sales", gate: str = "is_revenue_recognised") -> DataFrame:
    """Views, orders, lines, revenue and rate per label over the log's window."""
    if by not in FUNNEL_DIMS:
        raise KeyError("the funnel groups by " + ", ".join(FUNNEL_DIMS))
    label = by + "_name"
    # Count raw labels first: the fold then runs once per distinct label.
    daily = _daily(log, log_at, label)
    views = (daily.groupBy(label).agg(F.sum("_n").alias("n"))
             .groupBy(fold_key(F.col(label)).alias("k"))
             .agg(F.sum("n").alias("views"), F.min(label).alias("log_label")))
    # Orders are distinct per key, so they are first reduced to one row per
    # label and order: that spreads a hot label over its orders.
    gated = F.expr(gate)
    sold = (
        _in_window(facts, fact_at, _span(daily))
        .groupBy(label, order_id)
        .agg(F.count(F.when(gated, 1)).alias("lines"),
             F.sum(F.when(gated, F.col(value))).alias("revenue"))
        .groupBy(fold_key(F.col(label)).alias("k"))
        .agg(F.count_distinct(F.when(F.col("lines") > 0, F.col(order_id))).alias("orders"),
             F.sum("lines").alias("lines"), F.sum("revenue").alias("revenue"),
             F.min(label).alias("fact_label"))
    )
    zero = F.lit(0)
    joined = views.join(sold, "k", "full_outer").select(
        F.coalesce("fact_label", "log_label", "k").alias(by),
        F.col("k").alias(by + "_key"),
        F.coalesce("views", zero).alias("views"),
        F.coalesce("orders", zero).alias("orders"),
        F.coalesce("lines", zero).alias("lines"),
        F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
        _rate(F.coalesce("orders", zero), F.coalesce("views", zero)).alias("view_to_order_pct"))
    out = joined.orderBy(F.desc("views"), F.desc("orders"), F.asc_nulls_last(by + "_key"))
    return out.limit(limit) if limit else out


def funnel_totals(log: DataFrame, facts: DataFrame, log_at: str = "viewed_at",
                  fact_at: str = "order_date", order_id: str = "order_id",
                  value: str = "sales", gate: str = "is_revenue_recognised") -> DataFrame:
    """The window's own totals; orders are distinct over the whole window."""
    gated = F.expr(gate)
    span = _span(_daily(log, log_at))
    views = F.coalesce(span["n"], F.lit(0).cast("long"))
    return _in_window(facts, fact_at, span).agg(
        F.count_distinct(F.when(gated, F.col(order_id))).alias("orders"),
        F.count(F.when(gated, 1)).alias("lines"),
        F.sum(F.when(gated, F.col(value))).alias("revenue"),
    ).select(views.alias("views"), "orders", "lines", "revenue",
             _rate(F.col("orders"), views).alias("view_to_order_pct"),
             span["lo"].alias("window_from"), span["hi"].alias("window_to"))


def unmatched_keys(log: DataFrame, facts: DataFrame, by: str = "product") -> DataFrame:
    """Folded keys found on one side only, with that side's row count."""
    label = by + "_name"

    def counted(df: DataFrame, name: str) -> DataFrame:
        return (df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
                .groupBy(fold_key(F.col(label)).alias("key"))
                .agg(F.sum("n").alias(name), F.min(label).alias(name + "_label")))

    both = counted(log, "log").join(counted(facts, "fact"), "key", "full_outer")
    return (both.filter(F.col("log").isNull() | F.col("fact").isNull())
            .select("key", F.when(F.col("fact").isNull(), "log").otherwise("fact").alias("side"),
                    F.coalesce("log_label", "fact_label").alias("label"),
                    F.coalesce("log", "fact").alias("n_rows")))


def viewed_never_ordered(frame: DataFrame) -> DataFrame:
    return frame.filter((F.col("views") > 0) & (F.col("orders") == 0))


def ordered_never_viewed(frame: DataFrame) -> DataFrame:
    return frame.filter((F.col("orders") > 0) & (F.col("views") == 0))
