"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import materialise

WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: Sequence[float], share: float,
            repeats: int) -> DataFrame:
    """Adds ``weight`` and ``target`` to a table of one row per source with ``source_size``.

    Sources in code point order (null last) take the weights in turn and share
    ``share`` of all words.  A source whose share would pass ``repeats`` times
    its size stops there, and what it leaves is shared again by weight.  With
    sources ordered by that limit per weight, the share per weight that is left
    to a source and all later ones rises while sources stop and falls after
    the first that does not, so its highest value at an open source is the level.
    """
    turn = F.row_number().over(Window.orderBy(
        F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)),
                          (F.pmod(turn, F.lit(len(weights))) + 1).cast("int"))
    held = sources.withColumn("weight", weight).withColumn(
        "most", (F.col("source_size") * repeats).cast("double"))
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    stepped = held.withColumn(
        "pot", F.sum("source_size").over(whole) * share
        - F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn(
        "heavy", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = F.col("pot") / F.col("heavy")
    open_ = F.col("most") / F.col("weight") > level
    found = stepped.withColumn("level", F.max(F.when(open_, level)).over(whole))
    return found.withColumn(
        "target", F.coalesce(F.least("most", F.col("level") * F.col("weight")), "most")
    ).select("source", "source_size", "rows", "weight", "target")


def apportion(parties: DataFrame, votes: str, seats: Column, cap: str, by: list[str],
              key: list[str]) -> DataFrame:
    """Adds ``quota``: seats by the highest quotients votes / (2s + 1), within ``cap``.

    Rounding votes to the divisor that would share all seats gives nearly the
    right number at once; what is missing or over goes by the next quotients.
    A party with v of V votes can be off by at most (off + parties) v / V + 1
    seats, so that many quotients of each decide exactly, and their number is
    in proportion to the parties.  Ties go by key.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    start = parties.withColumn("seats", seats).withColumn(
        "all_votes", F.sum(votes).over(group)).withColumn("parties", F.count(F.lit(1)).over(group))
    exact = F.when(F.col("all_votes") > 0,
                   F.col(votes) * F.col("seats") / F.col("all_votes")).otherwise(0.0)
    start = start.withColumn("base", F.least(F.floor(exact + 0.5), F.col(cap))).withColumn(
        "off", F.col("seats") - F.sum("base").over(group))
    slack = F.when(F.col("all_votes") > 0, F.ceil(
        (F.abs("off") + F.col("parties")) * F.col(votes) / F.col("all_votes")) + 1).otherwise(0)
    more = F.least(slack, F.col(cap) - F.col("base"), F.abs("off"))
    fewer = F.least(slack, F.col("base"), F.abs("off"))
    count = F.greatest(F.when(F.col("off") > 0, more).when(F.col("off") < 0, fewer)
                       .otherwise(0), F.lit(0))
    steps = start.where(count > 0).select(
        *key, votes, "base", "off", F.explode(F.sequence(F.lit(1).cast("long"), count.cast("long"))).alias("k"))
    seat = F.when(F.col("off") > 0, F.col("base") + F.col("k") - 1).otherwise(
        F.col("base") - F.col("k"))
    quotient = F.col(votes) / (2 * seat + 1)
    rank = F.row_number().over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
                               .orderBy(F.when(F.col("off") > 0, -quotient).otherwise(quotient),
                                        *key))
    chosen = (steps.withColumn("place", rank).where(F.col("place") <= F.abs("off"))
              .groupBy(*key).agg(F.sum(F.sign("off")).cast("long").alias("moved")))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return start.alias("l").join(chosen.alias("r"), on, "left").select(
        *[F.col(f"l.{c}") for c in parties.columns],
        (F.col("base") + F.coalesce("moved", F.lit(0))).cast("long").alias("quota"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
        repeats: int = 2, block: int = 64, shard_rows: int = 128, seed: int = 17,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source, source_size, target, taken`` for every row, and its draw.

    ``draw`` has the whole passes and what fixes the words drawn besides (see
    ``drawn_text``).

    Each source is dealt by a seeded hash into shards of about ``shard_rows``
    rows, so a source with a third of all rows is many small tasks.  A shard's
    words, in seeded order, form blocks of nearly ``block`` words.  Blocks are
    apportioned to sources by their targets, and each source's to its shards
    by their blocks.  A shard takes all of its blocks as often as its quota
    allows and the rest by a seeded systematic draw, whose running count has a
    closed form: a row's words follow from where it starts and ends, and no
    block becomes a row.  Nobody is taken more than ``repeats`` times.

    Null texts have size 0 and take nothing; a null source is a source; rows
    that repeat are separate rows of equal worth; an empty table, or one
    without words, takes nothing.  Reruns agree, since order and draw depend
    on the rows alone (equal rows share their hash and are interchangeable).
    """
    sized = materialise(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
        .alias("size")))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"),
                                                  F.count(F.lit(1)).alias("rows")),
                      weights, share, repeats)
    keyed = sized.alias("d").join(
        sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "d.doc_id", "d.source", "d.size", "s.source_size", "s.target", "s.rows")
    dealt = keyed.withColumn("turn", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn(
        "shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.ceil(F.col("rows") / shard_rows)))
    shards = dealt.groupBy("source", "shard").agg(
        F.sum("size").alias("shard_size"), F.first("target").alias("target")).withColumn(
        "blocks", F.when(F.col("shard_size") > 0,
                         F.greatest(F.lit(1), F.round(F.col("shard_size") / block))).otherwise(0)
        .cast("long"))
    by_source = shards.groupBy("source").agg(
        F.sum("blocks").alias("source_blocks"), F.first("target").alias("target"),
        F.sum("shard_size").alias("words")).withColumn(
        "cap", F.col("source_blocks") * repeats)
    # a block of this source holds words / source_blocks words; votes are targets in blocks
    by_source = by_source.withColumn(
        "votes", F.when(F.col("words") > 0,
                        F.col("target") * F.col("source_blocks") / F.col("words")).otherwise(0.0))
    one = Window.partitionBy(F.lit(1))
    seats = apportion(by_source, "votes", F.round(F.sum("votes").over(one)), "cap", [], ["source"])
    shared = shards.drop("target").alias("a").join(
        seats.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        "a.source", "a.shard", "a.shard_size", "a.blocks", "b.quota").withColumnRenamed(
        "quota", "source_quota").withColumn("most", F.col("blocks") * repeats)
    quotas = apportion(shared, "blocks", F.col("source_quota"), "most", ["source"],
                       ["source", "shard"])
    line = Window.partitionBy("source", "shard").orderBy("turn", "doc_id", "size")
    placed = dealt.withColumn("to", F.sum("size").over(
        line.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "from", F.col("to") - F.col("size"))
    joined = placed.alias("p").join(
        quotas.alias("q"), F.col("p.source").eqNullSafe(F.col("q.source"))
        & (F.col("p.shard") == F.col("q.shard"))).select(
        "p.*", "q.shard_size", "q.blocks", "q.quota",
        F.pmod(F.xxhash64(F.lit(seed + 2), "p.source", "p.shard"),
               F.greatest(F.col("q.blocks"), F.lit(1))).alias("offset"))
    passes = F.expr("case when blocks > 0 then quota div blocks else 0 end")
    rest = F.expr("case when blocks > 0 then quota % blocks else 0 end")
    return joined.withColumn("passes", passes).withColumn("rest", rest).select(
        "doc_id", "size", "source", "source_size", "target",
        F.when(F.col("size") > 0, F.col("passes") * F.col("size")
               + _drawn("`to`") - _drawn("`from`")).otherwise(F.lit(0)).cast("long")
        .alias("taken"),
        F.struct("passes", "from", "shard_size", "blocks", "rest", "offset").alias("draw"))


def _drawn(at: str) -> Column:
    """Words drawn before word ``at`` of a shard, of the ``rest`` blocks drawn once more.

    A block is shard_size / blocks words long, so word ``at`` lies in block
    b = at * blocks div shard_size.  Block b is drawn when (b * rest + offset)
    div blocks steps up after it, and that quotient counts the draws before
    it.  The sum never rises faster than ``at``, so floors of it never give a
    row more than its size.
    """
    b = f"({at} * blocks div shard_size)"
    before = f"(({b} * rest + offset) div blocks)"
    here = f"((({b} + 1) * rest + offset) div blocks - {before})"
    part = f"({at} * blocks % shard_size)"
    return F.expr(f"({before} * shard_size + {part} * {here}) div blocks")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              source_col: str = "source", count_col: str = "n_chars", **options: object) -> DataFrame:
    """The mixed rows, with the columns of ``docs``.

    A row comes out once for every whole pass, unchanged, and once more with
    the words of the blocks drawn besides, if any (the text itself when all
    are drawn, else those words joined by one space, with ``count_col``, where
    there is one, counted anew).  Decisions meet rows on the id; rows that
    share an id take theirs in the order of source and size.

    Null texts and those without words have no words to take, but come out
    unchanged with each whole pass of their shard; null ids and sources are
    values like others; repeated rows come out as often as each is drawn; a
    very long text is one array of words in the task that spells it.
    The columns travel as one value, so none can clash with a name used here;
    an empty table stays empty.
    """
    made = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).groupBy(
        F.col("doc_id").alias("drawn_id")).agg(F.array_sort(F.collect_list(F.struct(
            "source", "size", "draw"))).alias("draws"))
    rows = docs.select(F.struct("*").alias("whole"), F.col(id_col).alias("id"),
                       F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    turn = Window.partitionBy("id").orderBy(
        F.col("source").asc_nulls_first(), F.regexp_count(
            F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)))
    met = rows.join(made, F.col("id").eqNullSafe(F.col("drawn_id"))).select(
        "whole", "text", F.element_at("draws", F.row_number().over(turn))["draw"].alias("draw"))
    rest = met.withColumn("part", drawn_text(F.col("text"), F.col("draw")))
    copies = F.concat(
        F.when(F.col("draw.passes") > 0, F.array_repeat("text", F.col("draw.passes").cast("int")))
        .otherwise(F.array().cast("array<string>")),
        F.when(F.length("part") > 0, F.array("part")).otherwise(F.array().cast("array<string>")))
    return rest.select("whole", F.explode(copies).alias("copy")).select(*[
        F.col("copy").alias(c) if c == text_col
        else F.coalesce(F.length("copy"), F.col("whole")[c]).cast(docs.schema[c].dataType).alias(c) if c == count_col
        else F.col("whole")[c].alias(c) for c in docs.columns])


def drawn_text(text: Column, draw: Column) -> Column:
    """The words of a row that its shard's extra draw takes: those in drawn blocks."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    block = lambda i: F.floor((draw["from"] + i) * draw["blocks"] / draw["shard_size"])
    step = lambda b: F.floor((b * draw["rest"] + draw["offset"]) / draw["blocks"])
    taken = F.filter(words, lambda w, i: step(block(i) + 1) > step(block(i)))
    return (F.when((draw["blocks"] == 0) | (draw["rest"] == 0) | text.isNull(), "")
            .otherwise(F.when(F.size(taken) == F.size(words), text)
                       .otherwise(F.array_join(taken, " "))))
