"""Records of delimited text, found by many tasks although a quoted cell may span lines.

A line is a function from the state before it (inside a quoted cell or not) to the
state after it.  Functions compose: each split reduces to one function, a prefix over
the splits of a file says in which state every split starts, and then every line knows
whether it stands alone, opens, continues or closes a record.  Only lines of records
that span several are brought together.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def text_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Lines with their place: path, block (start of the split), line (order in it), value."""
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value")


def _ends_inside(value: Column, sep: str) -> tuple[Column, Column]:
    """Whether a line ends inside a quoted cell, if it starts outside and if it starts inside.

    A quote opens a cell only where the cell starts; a doubled quote inside stays inside.
    """
    s = re.escape(sep)
    quoted = '(?:[^"]++|"")*+'
    whole = f'(?:(?:"{quoted}"[^{s}]*+|(?!")[^{s}]*+){s})*+'
    opens = f'(?s)^{whole}"{quoted}$'
    stays = f'(?s)^{quoted}$'
    closes = f'(?s)^{quoted}"[^{s}]*+(?:{s}{whole}"{quoted})$'
    has = value.contains('"')
    return (F.when(has, value.rlike(opens)).otherwise(False),
            F.when(has, value.rlike(stays) | value.rlike(closes)).otherwise(True))


def _turn(state: Column) -> Column:
    """The state after a line or split, from the one before it: constants, or a flip."""
    return F.coalesce(F.col("const"), F.pmod(state + F.col("flip"), F.lit(2)))


def _states(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """Beside each row, the state before it if its group starts outside (s0) or inside (s1)."""
    upto = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    anchored = df.withColumn("flips", F.sum("flip").over(upto)).withColumn(
        "anchor", F.pmod(F.col("const") + F.col("flips"), F.lit(2)))
    before = F.coalesce(F.sum("flip").over(past), F.lit(0))
    last = F.last("anchor", ignorenulls=True).over(past)
    return anchored.select(*df.columns, *[
        F.pmod(F.coalesce(last, F.lit(k)) + before, F.lit(2)).alias(f"s{k}") for k in (0, 1)])


def records(lines: DataFrame, sep: str) -> DataFrame:
    """Whole records: path, value.

    Lines of one record are joined by a line feed.  A quote that no later line closes
    opens nothing: the lines from there on stand alone, so a stray quote cannot pull the
    rest of a file into one row.  Text crosses one shuffle, by split.
    """
    zero, one = _ends_inside(F.col("value"), sep)
    first, second = zero.cast("int"), one.cast("int")
    typed = lines.withColumns({
        "const": F.when(first == second, first),
        "flip": F.when((first == 1) & (second == 0), 1).otherwise(0)})
    split = ["path", "block"]
    known = _states(typed, split, "line")
    for k in (0, 1):
        known = known.withColumn(f"o{k}", ((F.col(f"s{k}") == 0) & (_turn(F.col(f"s{k}")) == 1))
                                 .cast("long"))
    upto = Window.partitionBy(*split).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    known = known.withColumns({f"n{k}": F.sum(f"o{k}").over(upto) for k in (0, 1)})

    ends = known.groupBy(*split).agg(*[F.max_by(_turn(F.col(f"s{k}")), "line").alias(f"e{k}")
                                       for k in (0, 1)],
                                     *[F.sum(f"o{k}").alias(f"many{k}") for k in (0, 1)])
    ends = ends.select(*split, "many0", "many1", F.when(F.col("e0") == F.col("e1"), F.col("e0"))
                       .alias("const"),
                       F.when((F.col("e0") == 1) & (F.col("e1") == 0), 1).otherwise(0).alias("flip"))
    by_file = Window.partitionBy("path")
    placed = _states(ends, ["path"], "block").withColumn(
        "many", F.when(F.col("s0") == 0, F.col("many0")).otherwise(F.col("many1")))
    past = by_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.select(
        F.col("path").alias("_path"), F.col("block").alias("_block"), F.col("s0").alias("entry"),
        F.coalesce(F.sum("many").over(past), F.lit(0)).alias("past"),
        F.sum("many").over(by_file).alias("total"),
        F.max_by(_turn(F.col("s0")), "block").over(by_file).alias("open_end"))

    def entered(name: str) -> Column:
        return F.when(F.col("entry") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    told = (known.join(starts, (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block")))
            .withColumn("state", entered("s"))
            .withColumn("record", F.col("past") + entered("n")))
    several = ((F.col("state") == 1) | (_turn(F.col("state")) == 1)) & ~(
        (F.col("open_end") == 1) & (F.col("record") == F.col("total")))
    alone = told.where(~several).select("path", "value")
    joined = told.where(several).groupBy("path", "record").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("block", "line", "value"))),
        lambda r: r["value"]), "\n").alias("value"))
    return alone.unionByName(joined.select("path", "value"))
