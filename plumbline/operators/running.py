"""Exact medians of everything before and after each row of an ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How many values, neighbours by rank, are looked through to read one of them.
BUCKET = 256


def split_medians(series: DataFrame, order: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``by..., at, place, n, before, after`` for every row of each group's series.

    ``place`` counts rows from 1 in ``order`` (nulls first; rows that tie in it
    are ranged by value), ``n`` is the length of the series, ``before`` the
    median of the values ahead of the row and ``after`` that of the row and all
    later ones.  Null and NaN values keep their place but no rank; a side
    without values has a null median.  Null keys are a group of their own; an
    empty table gives no rows.

    Values get a rank in their group, and ``BUCKET`` neighbours by rank form a
    bucket.  A running count per bucket says how many values ahead of a row lie
    in it or below, so the bucket that holds a wanted rank is found by counting,
    and the value is read in that bucket alone.  No row holds more than one
    bucket: a series of n rows takes n * n / BUCKET counts and 4 * n looks.
    """
    key = F.struct(*[F.col(k) for k in by]) if by else F.lit(0)
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    group = Window.partitionBy("_g")
    timed = group.orderBy(F.asc_nulls_first("at"), F.asc_nulls_last("_v"))
    rank = F.row_number().over(group.orderBy(F.asc_nulls_last("_v"), "place")) - 1
    placed = (series.select(key.alias("_g"), F.col(order).alias("at"), v.alias("_v"))
              .select("*", F.row_number().over(timed).alias("place"),
                      F.count(F.lit(1)).over(group).alias("n"),
                      F.count("_v").over(group).alias("_all"),
                      F.coalesce(F.count("_v").over(timed.rowsBetween(
                          Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
              .withColumn("_r", F.when(F.col("_v").isNotNull(), rank))
              .withColumn("_b", F.floor(F.col("_r") / BUCKET)))

    last = F.greatest(F.ceil(F.col("_all") / BUCKET) - 1, F.lit(0))
    grid = placed.select("_g", "at", "place", "n", "_all", "_ahead", "_b",
                         F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_k"))
    running = Window.partitionBy("_g", "_k").orderBy("place").rowsBetween(
        Window.unboundedPreceding, -1)
    low = F.coalesce(F.count_if(F.col("_b") <= F.col("_k")).over(running), F.lit(0))
    counted = grid.withColumn("_low", low).withColumn(
        "_high", F.least((F.col("_k") + 1) * BUCKET, F.col("_all")) - F.col("_low"))

    def sought(seen: str, size: Column, upper: bool) -> tuple[Column, Column]:
        """The bucket that holds a middle rank, and that rank less all in lower buckets."""
        want = F.floor((size if upper else size - 1) / 2)
        c = F.col(seen)
        return (F.min(F.when((size > 0) & (c > want), F.col("_k"))),
                F.first(want) - F.coalesce(F.max(F.when(c <= want, c)), F.lit(0)))

    sides = [(name, seen, size, upper) for name, seen, size in (
        ("before", "_low", F.col("_ahead")), ("after", "_high", F.col("_all") - F.col("_ahead")))
        for upper in (False, True)]
    aggs = []
    for j, (_, seen, size, upper) in enumerate(sides):
        bucket, step = sought(seen, size, upper)
        aggs += [bucket.alias(f"_b{j}"), step.alias(f"_s{j}")]
    wanted = counted.groupBy("_g", "at", "place", "n").agg(*aggs).select(
        "_g", "at", "place", "n", F.explode(F.array(*[F.struct(
            F.lit(side).alias("side"), F.col(f"_b{j}").alias("bucket"), F.col(f"_s{j}").alias("step"))
            for j, (side, *_) in enumerate(sides)])).alias("w"))

    buckets = placed.filter(F.col("_b").isNotNull()).groupBy(
        F.col("_g").alias("_bg"), F.col("_b").alias("_bk")).agg(F.array_sort(F.collect_list(
            F.struct("_r", F.col("place").alias("_p"), "_v"))).alias("_held"))
    side = F.col("w.side")
    among = F.filter("_held", lambda e: (e["_p"] < F.col("place")) == (side == "before"))
    read = (wanted.join(buckets, (F.col("_g") == F.col("_bg")) & (F.col("w.bucket") == F.col("_bk")),
                        "left")
            .select("_g", "at", "place", "n", side.alias("side"),
                    F.get(among, F.col("w.step").cast("int"))["_v"].alias("_v")))
    return (read.groupBy("_g", "at", "place", "n")
            .agg(*[F.avg(F.when(F.col("side") == s, F.col("_v"))).alias(s)
                   for s in ("before", "after")])
            .select(*[F.col("_g")[k].alias(k) for k in by], "at", "place", "n", "before", "after"))
