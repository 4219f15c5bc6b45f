"""Exact de-duplication by content-defined chunk recipes, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import materialise

SPACE = r"[\x20\x09-\x0D]+"
#: A chunk ends after one of these pairs, between the two lengths.
CUT, SHORTEST, LONGEST = "[aeiou0-9][nrst][hdeg]", 256, 4096


def chunks(text: Column) -> Column:
    """Split where the content says so; concatenating the chunks gives the text.

    A cut depends only on the characters since the last cut, and falls back in
    step soon after a difference, so documents that share a passage share
    chunks.
    """
    pattern = f"(?s).{{{SHORTEST},{LONGEST}}}?{CUT}|.{{1,{LONGEST + 3}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          name: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row: id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when they agree after white space is deleted; null counts
    as empty.  A chunk's identifier is its ``name`` (a hash) and length.  Over
    the whole table, every identifier is verified against a second digest of
    its chunks: where one stands for different contents, the chunk that has it
    keeps that digest beside it.  Documents with the same ordered list of
    verified identifiers are one group; nothing else decides, and the text's
    own digest is output only.  The row with most code points stays, then the
    least id (null ids last); of rows that tie in both, one stays.  Empty texts
    form one group.  A very long text is one list of some thousand identifiers
    a million characters.  Extra columns are ignored, whatever their names; an
    empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).alias("chars"),
                       F.regexp_replace(text, SPACE, "").alias("norm"))
    digested = materialise(rows.select(
        "doc_id", "chars", F.sha2("norm", 256).alias("text_sha256"),
        F.transform(chunks(F.col("norm")), lambda c: F.struct(
            name(c).alias("h"), F.length(c).alias("n"),
            F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long").alias("d"),
        )).alias("parts"))).withColumn("row", F.monotonically_increasing_id())

    placed = digested.select("row", F.posexplode("parts").alias("pos", "p")).select(
        "row", "pos", "p.h", "p.n", "p.d")
    clashes = (placed.groupBy("h", "n").agg(F.min("d").alias("low"), F.max("d").alias("high"))
               .where("low <> high").select("h", "n"))
    told_apart = (placed.join(clashes, ["h", "n"]).groupBy("row")
                  .agg(F.array_sort(F.collect_list(F.struct("pos", "d"))).alias("apart")))
    keyed = digested.join(told_apart, "row", "left").select(
        "doc_id", "chars", "row", "text_sha256",
        F.transform("parts", lambda p: F.struct(p["h"], p["n"])).alias("recipe"),
        F.coalesce("apart", F.array()).alias("apart"))

    best = F.struct(F.col("chars"), F.col("doc_id").isNotNull().alias("named"),
                    (-F.col("doc_id")).alias("early"), (-F.col("row")).alias("turn"))
    groups = keyed.groupBy("recipe", "apart").agg(
        F.max(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return keyed.join(groups, ["recipe", "apart"]).select(
        "doc_id", (-F.col("best.early")).alias("keep_id"), "group_size",
        (F.col("row") == -F.col("best.turn")).alias("kept"), "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns, one for every group of ``dedup``.

    Null, empty and white-space texts are one group.  Rows that share an id are
    told apart by their text, and of equal rows one stays.  The columns travel
    as one value, so none can clash with a name used here; an empty table stays
    empty.
    """
    stay = dedup(docs, id_col, text_col).where("kept").select(
        F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_text")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("whole"), F.col(id_col).alias("id"),
                       F.length(text).alias("chars"),
                       F.sha2(F.regexp_replace(text, SPACE, ""), 256).alias("same"))
    turn = Window.partitionBy("stay_id", "stay_text").orderBy(F.desc("chars"))
    met = rows.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("same") == F.col("stay_text")))
    return met.withColumn("turn", F.row_number().over(turn)).where("turn = 1").select("whole.*")
