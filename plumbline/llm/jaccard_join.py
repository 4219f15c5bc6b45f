"""Similarity join on word n-grams with prefixes under several global token orders."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import ship
from plumbline.llm.components import components
from plumbline.llm.words import (
    Words, lists_by_row, mix, salted, slices, split_words, starts_of_windows, window_hashes,
)
from plumbline.session import materialise

_ODD = np.uint64(0xD1342543DE82EF95)
#: Hashes that order tokens in parts; bits of a token; numbers of parity bits.
PART_ORDERS, TOKEN_BITS, PARITIES = (12, 13, 14), 48, 8


@dataclass
class Rule:
    """Two sets link when 100 * intersection >= percent * union."""

    size: int
    percent: int
    shared: int

    def least(self, n: np.ndarray) -> np.ndarray:
        """Tokens that a set of n must share with any set it links to."""
        return (self.percent * n + 99) // 100

    def levels(self, n: int) -> list[tuple[int, int]]:
        """(level, largest difference) of a size's level and the next.

        Level bounds grow by 100 / percent, so linked sets lie in one level or
        in neighbours and meet in the larger one's.
        """
        bound, level = 8, 0
        while bound < n:
            bound, level = -(-bound * 100 // self.percent), level + 1
        out = []
        for k in (level, level + 1):
            out.append((k, 2 * bound * (100 - self.percent) // (100 + self.percent)))
            bound = -(-bound * 100 // self.percent)
        return out


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 48-bit hash of every distinct n-gram, ordered by row and then hash.

    A row with fewer words than ``size`` has its whole sequence as one.  At
    most 65,536 rows at a time, so that row and hash sort as one number.
    """
    h = w.hashes()
    at = starts_of_windows(w, size)
    row, token = w.doc[at], window_hashes(h, size)[at] if len(at) else np.zeros(0, np.uint64)
    n = w.counts()
    for k in range(1, size):
        few = np.flatnonzero(n == k)
        if len(few):
            row = np.concatenate([row, few])
            token = np.concatenate([token, salted(window_hashes(h, k)[w.first[few]], 100 + k)])
    bits = np.uint64(TOKEN_BITS)
    key = np.unique((row.astype(np.uint64) << bits) | (token >> (np.uint64(64) - bits)))
    return (key >> bits).astype(np.int64), key & np.uint64((1 << TOKEN_BITS) - 1)


def packed(token: np.ndarray) -> bytes:
    return token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BITS // 8].tobytes()


def unpacked(code: bytes) -> np.ndarray:
    width = TOKEN_BITS // 8
    out = np.zeros((len(code) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(code, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def parities(token: np.ndarray, bits: int = 64 * PARITIES) -> np.ndarray:
    """Whether an odd number of tokens falls in each of so many classes, as bytes.

    Every token in which two sets differ changes one bit, so two sets differ
    in at least as many tokens as their parities differ in bits.
    """
    odd = np.bincount((token % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def wide(token: np.ndarray) -> bytes:
    """Parities in a power of two of classes, two or more for each token."""
    return parities(token, max(64, 1 << (2 * len(token) - 1).bit_length())).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two wide parities differ, the longer one folded to the shorter."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = _folded(a)
    while len(b) > len(a):
        b = _folded(b)
    return int(np.bitwise_count(a ^ b).sum())


def _folded(a: np.ndarray) -> np.ndarray:
    """Classes of the half number: class k and class k + half fall together."""
    return a[:len(a) // 2] ^ a[len(a) // 2:]


def signatures(row: np.ndarray, token: np.ndarray, rows: int) -> tuple[np.ndarray, ...]:
    """Set sizes and two digests that depend on the set alone."""
    n = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(n)])
    out = [n.astype(np.int64)]
    for salt in (21, 22):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(salted(token, salt))])
        out.append(mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64)).view(np.int64))
    return tuple(out)


def part_keys(token: np.ndarray, rule: Rule) -> np.ndarray:
    """Keys of which two linked sets have at least one in common.

    At a level, sets differ by at most d tokens.  Tokens are dealt into more
    than d parts, so one part is the same in both; its first tokens under
    every one of several orders then agree, and all of them make one key: the
    filters of the orders are intersected before anything is paired.  A set
    with d or fewer parts in use deals again by another hash, and so on until
    it has more; of two linked sets, the first to be done decides for both.
    """
    out = []
    for level, d in rule.levels(len(token)):
        parts = d + 1 + max(2, d // 16)
        deal = 0
        while True:
            part = (salted(token, 1000 + deal) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part = part[order]
            heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            key = np.full(len(heads), level * 64 + deal, np.uint64) * _ODD + part[heads].astype(
                np.uint64)
            for o in PART_ORDERS:
                key = mix(key * _ODD + np.minimum.reduceat(salted(token[order], o), heads))
            out.append(key)
            deal += 1
            if len(heads) > d or deal == 64 or len(token) <= d:
                break
    return np.unique(np.concatenate(out))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets link: wide parities rule most others out, whole sets decide."""
    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (np.asarray(batch.column("m")) + np.asarray(batch.column("n"))) * (
                100 - percent) // (100 + percent)
            apart = np.array([differing(x, y) for x, y in zip(
                batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)],
                np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(apart <= most))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(),
                            strict=True):
                u, v = unpacked(x), unpacked(y)
                both = len(np.intersect1d(u, v, assume_unique=True))
                kept.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    for column, check in (("wide", close), ("tokens", exact)):
        left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("m"),
                           F.col(column).alias("x"))
        right = sets.select(F.col("doc_id").alias("b"), "n", F.col(column).alias("y"))
        pairs = pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(
            check, "a bigint, b bigint")
    return pairs.distinct()


def join(docs: DataFrame, size: int = 5, percent: int = 80, shared: int = 32, few: int = 200,
         id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``doc_id, n_shingles, class_id, component_id`` for every row, and verified links.

    1. Rows with one set are a class, its least id its representative; links
       run between classes, so a group of copies costs its rows only.
    2. Under one token order, linked sets share ``shared`` tokens among the
       first n - ceil(n * percent / 100) + ``shared`` of each.  A token seen
       in one class links nothing; a set with fewer seen in more is done.
    3. Under a second order, by falling frequency, each set forgets the first
       ``shared`` - 1 of these tokens: the rarest one that two linked sets
       share comes later in both.  Sets meet in what is left and seen at most
       ``few`` times.  Where the rarest shared token is more frequent, both
       sets have ``shared`` frequent ones, and sets with so many also meet in
       ``part_keys``, whose several orders tell apart what only has a passage
       in common.
    4. Each set is compared with the one it meets most among the least of its
       keys; these links already join large groups.  Then all pairs that meet,
       are not yet in one component and differ in few enough parities are
       compared, so that no link between components is missed and none inside
       one has to be enumerated.

    Links compare whole sets of 48-bit token hashes.  Null and empty texts
    have an empty set and link with nothing; a row with a null id takes no
    part and has a null component; rows with one id are one node.  Repeated
    rows get repeated results; extra columns are ignored; no rows, no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rule = Rule(size, percent, shared)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                        F.col(text_col).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part in slices(batch):
                for at in range(0, part.num_rows, 1 << 16):
                    some = part.slice(at, 1 << 16)
                    yield some, *shingles(split_words(some.column("text"), lower=True), rule.size)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, token in read(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"),
                 *(pa.array(x) for x in signatures(row, token, part.num_rows))],
                names=["doc_id", "n", "s", "t"])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, token in read(batches):
            n, s, _ = signatures(row, token, part.num_rows)
            first = np.concatenate([[0], np.cumsum(n)])
            rank = np.arange(len(row)) - first[row]
            least = rule.least(n)
            keep = rank < (n - least + np.minimum(rule.shared, least))[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[keep].view(np.int64)), pa.array(s[row[keep]])],
                names=["token", "s"])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            raw = [(x or "").encode() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()),
                 pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary())],
                names=["doc_id", "size", "code"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")

        def opened() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = [codec.decompress(c, n, asbytes=True) for c, n in zip(
                    batch.column("code").to_pylist(), batch.column("size").to_pylist(),
                    strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("frequent"),
                     pa.array(raw, pa.binary()).cast(pa.string())],
                    names=["doc_id", "frequent", "text"])

        for part, row, token in read(opened()):
            first = np.searchsorted(row, np.arange(part.num_rows + 1))
            sets = [token[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            keys = [part_keys(t, rule) if f else token[:0] for t, f in zip(
                sets, part.column("frequent").to_pylist(), strict=True)]
            at = np.repeat(np.arange(part.num_rows), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(t) for t in sets], pa.int64()),
                 pa.array([packed(t) for t in sets], pa.binary()),
                 pa.array([wide(t) for t in sets], pa.binary()),
                 *(pa.array(p) for p in np.stack(
                     [parities(t).view(np.int64) for t in sets], axis=1)),
                 lists_by_row(np.concatenate(keys).view(np.int64), at, part.num_rows, pa.int64())],
                names=["doc_id", "n", "tokens", "wide", *odd, "keys"])

    odd = [f"p{k}" for k in range(PARITIES)]
    signed = materialise(texts.mapInArrow(sign, "doc_id bigint, n bigint, s bigint, t bigint"))
    classes = signed.where("n > 0 and doc_id is not null").groupBy("n", "s", "t").agg(
        F.min("doc_id").alias("class_id"))

    tokens = texts.where("doc_id is not null").mapInArrow(prefixes, "token bigint, s bigint")
    common = tokens.groupBy("token").agg(
        F.min("s").alias("m"), F.max("s").alias("x"), F.count(F.lit(1)).alias("seen")).where(
        "m <> x").select("token", "seen")
    met = materialise(tokens.join(common, "token").groupBy("s", "token").agg(
        F.max("seen").alias("seen")))
    hits = met.groupBy("s").agg(F.count(F.lit(1)).alias("hits"), F.sum(
        F.when(F.col("seen") > few, 1).otherwise(0)).alias("frequent"))
    need = F.least(F.lit(shared), F.ceil(F.col("n") * percent / 100)).cast("int")
    left = materialise(classes.join(hits, "s").where(F.col("hits") >= need).select(
        F.col("class_id").alias("doc_id"), "s", "n", need.alias("need"),
        (F.col("frequent") >= need).alias("frequent")))
    flags = left.groupBy("doc_id").agg(F.max("frequent").alias("frequent"))
    coded = texts.mapInArrow(squeeze, "doc_id bigint, size bigint, code binary")
    # one plan at every size: the flags grow with the table, so they are never broadcast
    sets = materialise(coded.join(flags.hint("merge"), "doc_id").mapInArrow(
        whole, "doc_id bigint, n bigint, tokens binary, wide binary, " + "".join(f"{p} bigint, " for p in odd)
        + "keys array<bigint>"))

    falling = Window.partitionBy("s").orderBy(F.desc("seen"), "token")
    by_token = met.join(left.select("s", "doc_id", "need"), "s").withColumn(
        "place", F.row_number().over(falling)).where(
        (F.col("place") >= F.col("need")) & (F.col("seen") <= few)).select(
        F.col("token").alias("key"), "doc_id")
    by_part = sets.select(F.explode("keys").alias("key"), "doc_id")
    keyed = by_token.unionByName(by_part)
    hubs = keyed.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("m")).where(
        "hub < m").select("key", "hub")
    keyed = materialise(keyed.join(hubs, "key"))
    votes = keyed.where("doc_id > hub").groupBy("doc_id", "hub").count()
    chosen = votes.groupBy("doc_id").agg(
        F.max(F.struct("count", (-F.col("hub")).alias("h"))).alias("v")).select(
        F.col("doc_id").alias("a"), (-F.col("v.h")).alias("b"))
    apart = " + ".join(f"bit_count(l.{p} ^ r.{p})" for p in odd)
    near = (f"100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n) "
            f"and {100 + percent} * ({apart}) <= {100 - percent} * (l.n + r.n)")
    figures = sets.select("doc_id", "n", *odd)
    likely = chosen.join(figures.alias("l"), F.col("a") == F.col("l.doc_id")).join(
        figures.alias("r"), (F.col("b") == F.col("r.doc_id")) & F.expr(near)).select("a", "b")
    links = materialise(_verified(likely, sets, percent))
    label = components(links, "a", "b")

    grouped = keyed.join(label, F.col("doc_id") == F.col("node"), "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    open_ = grouped.groupBy("key").agg(F.min("c").alias("m"), F.max("c").alias("x")).where(
        "m <> x").select("key")
    rest = grouped.join(open_, "key").join(figures, "doc_id")
    l, r = rest.alias("l"), rest.alias("r")
    pairs = l.join(r, F.expr(
        f"l.key = r.key and l.doc_id < r.doc_id and l.c <> r.c and {near}")).select(
        F.col("l.doc_id").alias("a"), F.col("r.doc_id").alias("b")).distinct()
    links = materialise(links.unionByName(_verified(pairs, sets, percent)).distinct())
    final = components(links, "a", "b")

    named = F.col("doc_id").isNotNull()
    found = signed.join(classes, ["n", "s", "t"], "left").join(
        final, F.col("class_id") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(named, F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(named, F.coalesce("component", "class_id", "doc_id")).alias("component_id"))
    return found, links
