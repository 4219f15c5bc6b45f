"""Prefix trie of conversations by collapse of whole sequences.

Identical conversations become one weighted sequence first, so a conversation that
a third of all rows repeat is one row from then on.  Sequences that are proper
prefixes of others fall to an anti-join; the rest are the leaves.  Prefixes of the
weighted sequences are then aggregated into nodes.  A subtree's total comes without a
walk: each node gives its value to one sequence that passes through it, and sums from
the end of each sequence are added up by prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import ship
from plumbline.session import materialise

#: Fixed values of the rebuilding: conversations that share a head, and its turns.
FAMILY, HEADS = 5, 9
#: Ids in one piece of an end list; salts of a parent's children.
PIECE_IDS, SALTS = 16384, 64


def turns(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, turns (an array of role and text digest, bytes).

    Turns are ordered by turn (null first), then role and text; null roles and texts
    count as empty, rows without a conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = (conversations.where("conv_id IS NOT NULL")
              .select("conv_id", "turn", role.alias("role"), text.alias("text"))
              .select("conv_id", F.row_number().over(order).alias("p"),
                      F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role",
                                     "text")).alias("digest"),
                      F.octet_length("text").cast("long").alias("bytes")))
    return placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("p", "digest", "bytes"))).alias("turns"))


def rebuild(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and the rebuilt turns.

    The first h turns come from conversation conv_id - conv_id % 5 (all if it has
    fewer, none if it is absent), the others are the conversation's own after its first
    h; h is the CRC-32 of the decimal conv_id, modulo 9.
    """
    own = materialise(turns(conversations))
    heads = own.where(f"conv_id % {FAMILY} = 0").select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS)).cast("int")
    rest = F.when(h < F.size("turns"), F.slice("turns", h + 1, F.size("turns"))).otherwise(
        F.slice("turns", 1, 0))
    return (own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
            .join(heads, "base", "left")
            .select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), h),
                                                   F.slice("turns", 1, 0)), rest).alias("turns")))


def _node_ids(turns_col: Column) -> Column:
    """The names of all prefixes of a sequence, the empty one first: chained digests."""
    root = F.array(F.md5(F.lit("").cast("binary")))
    return F.aggregate(turns_col, root, lambda a, t: F.concat(a, F.array(
        F.md5(F.concat(F.element_at(a, -1), t["digest"]).cast("binary")))))


def _end_lists(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: the digest of each node's conversation ids, ascending, comma-joined.

    Ids are sorted over range partitions, so one node may fill many tasks; each writes
    pieces of text, and only these are read in order to feed the digest, which is the
    one step that has to see a list from end to end.  It holds one piece at a time.
    """
    ship(ends.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        for batch in batches:
            for n, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if n != node or len(ids) == PIECE_IDS:
                    yield from piece(node, ids)
                    node, ids = n, []
                ids.append(c)
        yield from piece(node, ids)

    def piece(node: str | None, ids: list[int]) -> Iterator[pa.RecordBatch]:
        if ids:
            yield pa.RecordBatch.from_pydict(
                {"node": [node], "least": pa.array([ids[0]], pa.int64()),
                 "part": [",".join(map(str, ids))]})

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            names, found = [], []
            for n, part in zip(batch.column("node").to_pylist(), batch.column("part").to_pylist(),
                               strict=True):
                if n == node:
                    sha.update(b",")
                else:
                    if node is not None:
                        names.append(node)
                        found.append(sha.hexdigest())
                    node, sha = n, hashlib.sha256()
                sha.update(part.encode())
            if names:
                yield pa.RecordBatch.from_pydict({"node": names, "ends_sha256": found})
        if node is not None:
            yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [sha.hexdigest()]})

    parts = (ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
             .mapInArrow(pieces, "node string, least long, part string"))
    return (parts.repartition("node").sortWithinPartitions("node", "least")
            .mapInArrow(digests, "node string, ends_sha256 string"))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.  ``conversations`` has conv_id,
    turn, role and text; other columns are ignored.  Nulls: see ``turns``.  Repeated
    rows and rows that tie in turn are turns each.  A conversation without turns after
    rebuilding is a member of the root.  An empty table gives no rows.  Texts leave the
    first shuffle as digests of 128 bits; a conversation's digests (about 60 bytes a
    turn) are one row, whatever its texts' length.
    """
    whole = materialise(rebuild(conversations).withColumn("ids", _node_ids(F.col("turns")))
                        .withColumn("node", F.element_at("ids", -1)))
    ends = _end_lists(whole.select("node", "conv_id"))
    counted = whole.groupBy("node").agg(F.min("conv_id").alias("least"),
                                        F.count(F.lit(1)).alias("weight"))
    # weighted sequences, each with the turns of its first conversation
    kept = materialise(counted.withColumnRenamed("node", "seq").join(
        whole.select("conv_id", "ids", F.transform("turns", lambda t: t["bytes"]).alias("bytes")),
        F.col("least") == F.col("conv_id")).drop("conv_id"))
    inner = kept.select(F.explode(F.slice("ids", F.lit(1), F.size("ids") - 1)).alias("seq")).distinct()
    leaves = kept.join(inner, "seq", "left_anti").select("seq", F.lit(1).alias("leaf"))

    paths = materialise(
        kept.join(leaves, "seq", "left")
        .select("seq", "least", "weight", F.coalesce("leaf", F.lit(0)).alias("leaf"), "ids", "bytes",
                F.posexplode("ids").alias("depth", "node"))
        .select("seq", "least", "weight", "leaf", "depth", "node",
                F.when(F.col("depth") > 0, F.get("ids", F.col("depth") - 1)).alias("parent"),
                F.when(F.col("depth") > 0, F.get("bytes", F.col("depth") - 1))
                .otherwise(0).alias("bytes")))
    nodes = materialise(paths.groupBy("node").agg(
        F.min("least").alias("conv_id"), F.sum("weight").alias("n_convs"),
        F.sum("leaf").alias("n_leaves"), F.min("depth").alias("depth"),
        F.min("parent").alias("parent"), F.min("bytes").alias("bytes")))

    # A node's value goes to the sequence of its smallest member, then sums from the end.
    owned = nodes.select(F.col("conv_id").alias("least"), "depth",
                         ((F.col("n_convs") - 1) * F.col("bytes")).alias("value"))
    onward = Window.partitionBy("least").orderBy(F.col("depth").desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    saved = (paths.select("least", "depth", "node").join(owned, ["least", "depth"], "left")
             .select("node", F.sum(F.coalesce("value", F.lit(0))).over(onward).alias("below"))
             .groupBy("node").agg(F.sum("below").alias("saved_tokens")))

    # Children meet their parent by parent and salt, so a parent of many is many keys.
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt")
    children = nodes.where("parent IS NOT NULL").select("node", "parent", salt)
    by_salt = materialise(children.groupBy("parent", "salt").agg(F.count(F.lit(1)).alias("many")))
    n_children = by_salt.groupBy(F.col("parent").alias("node")).agg(F.sum("many").alias("n_children"))
    named = by_salt.join(nodes.select(F.col("node").alias("parent"),
                                      F.col("conv_id").alias("parent_conv_id")), "parent")
    above = children.join(named, ["parent", "salt"]).select("node", "parent_conv_id")
    zero = F.lit(0).cast("long")
    return (nodes.join(above, "node", "left").join(n_children, "node", "left")
            .join(saved, "node", "left").join(ends, "node", "left")
            .select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id",
                    "n_convs", F.coalesce("n_children", zero).alias("n_children"),
                    F.col("n_leaves").cast("long").alias("n_leaves"),
                    F.coalesce("saved_tokens", zero).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
                    .alias("ends_sha256")))
