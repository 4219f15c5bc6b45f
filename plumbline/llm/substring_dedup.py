"""Substring de-duplication by recompression of word sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import ship
from plumbline.llm.words import Words, salted, slices, split_words, starts_of_windows, window_hashes

FAR = np.int32(1 << 30)
_ODD = np.uint64(0xD1342543DE82EF95)


@dataclass
class Symbols:
    """A level of the parse: name, row, words spanned, and words that the name hangs on."""

    name: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray     # -FAR when it hangs on the start of the text
    high: np.ndarray    # FAR when it hangs on the end

    def take(self, keep: np.ndarray) -> Symbols:
        return Symbols(*(x[keep] for x in (self.name, self.row, self.start, self.end, self.low,
                                           self.high)))


def _runs(t: Symbols, salt: int) -> tuple[Symbols, np.ndarray]:
    """Name every maximal run of one symbol after it and its length; also each one's new place."""
    n = len(t.name)
    head = np.ones(n, bool)
    head[1:] = (t.name[1:] != t.name[:-1]) | (t.row[1:] != t.row[:-1])
    a = np.flatnonzero(head)
    b = np.append(a[1:], n) - 1
    size = (b - a + 1).astype(np.uint64)
    name = np.where(size > 1, salted(t.name[a] * _ODD + size, 2 * salt + 1), t.name[a])
    low, high = np.minimum.reduceat(t.low, a), np.maximum.reduceat(t.high, a)
    left, right = np.maximum(a - 1, 0), np.minimum(b + 1, n - 1)
    low = np.where((a > 0) & (t.row[left] == t.row[a]), np.minimum(low, t.low[left]), -FAR)
    high = np.where((b < n - 1) & (t.row[right] == t.row[a]), np.maximum(high, t.high[right]), FAR)
    return Symbols(name, t.row[a], t.start[a], t.end[b], low, high), np.cumsum(head) - 1


def _pairs(t: Symbols, salt: int) -> tuple[Symbols, np.ndarray]:
    """Name every pair of a left symbol and a right one; a coin by name tells them apart.

    Whether a symbol stays single hangs on one neighbour, the one it could
    have joined.  Also each symbol's new place.
    """
    n = len(t.name)
    coin = (salted(t.name, 2 * salt) >> np.uint64(63)).astype(bool)
    left, right = coin, ~coin
    together = np.zeros(n, bool)
    same = t.row[1:] == t.row[:-1]
    together[:-1] = left[:-1] & right[1:] & same
    second = np.zeros(n, bool)
    second[1:] = together[:-1]
    i = np.flatnonzero(together)
    low, high, name, end = t.low.copy(), t.high.copy(), t.name.copy(), t.end.copy()
    alone = np.flatnonzero(left & ~together)
    nxt = np.minimum(alone + 1, n - 1)
    high[alone] = np.where((alone < n - 1) & (t.row[nxt] == t.row[alone]),
                           np.maximum(high[alone], t.high[nxt]), FAR)
    alone = np.flatnonzero(right & ~second)
    prv = np.maximum(alone - 1, 0)
    low[alone] = np.where((alone > 0) & (t.row[prv] == t.row[alone]),
                          np.minimum(low[alone], t.low[prv]), -FAR)
    low[i] = np.minimum(t.low[i], t.low[i + 1])
    high[i] = np.maximum(t.high[i], t.high[i + 1])
    name[i] = salted(t.name[i] * _ODD + salted(t.name[i + 1], 1), 2 * salt)
    end[i] = t.end[i + 1]
    return Symbols(name, t.row, t.start, end, low, high).take(~second), np.cumsum(~second) - 1


def parse(row: np.ndarray, h: np.ndarray, low_rounds: int,
          rounds: int, places: bool = True) -> tuple[Symbols, list[tuple[Symbols, np.ndarray]]]:
    """Symbols after ``low_rounds`` rounds, and each later level with their places in it.

    Names are functions of the words spanned, so equal names are equal words
    everywhere, and a symbol whose name hangs on words inside a passage comes
    out the same wherever that passage stands.  Rounds go on until every row
    is one symbol.
    """
    at = np.arange(len(h), dtype=np.int32)
    t, low, above = Symbols(h, row.astype(np.int32), at, at + 1, at, at + 1), None, []
    up = at[:0]
    if not len(h):
        return t, above
    for r in range(rounds):
        if r == low_rounds:
            low, up = t, np.arange(len(t.name))
            above.append((t, up))
        if r % 8 == 0:
            t, to = _runs(t, r)
            up = to[up] if places else up
        t, to = _pairs(t, r)
        up = to[up] if places else up
        if low is not None:
            above.append((t, up))
            if t.row[0] != t.row[-1] and not (t.row[1:] == t.row[:-1]).any() or len(t.name) == 1:
                break
    return low, above


def _marks(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of n places lie in some ``[start, stop)``."""
    ok = stop > start
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(start[ok], 0, n), 1)
    np.add.at(edge, np.clip(stop[ok], 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _keyed(row: np.ndarray, name: np.ndarray) -> np.ndarray:
    return salted(name, 3) + row.astype(np.uint64) * _ODD


def _flat(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers and fields of a list-of-structs column; null lists are empty."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    values = column.flatten()
    return np.repeat(np.arange(len(column)), sizes), [
        np.asarray(values.field(k)) for k in range(values.type.num_fields)]


@dataclass
class Settings:
    size: int
    low_rounds: int
    rounds: int


def _regions(w: Words, h: np.ndarray, doc_id: np.ndarray, shared: pa.Array,
             s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Words that long symbols remove, and the windows that remain to be compared.

    A window that holds the whole context of a symbol seen in one document
    occurs in that one; a window inside a run may hold no context at all.
    One inside a long symbol that a smaller document has is settled, and the
    smallest document of a window never settles it so.  One inside a long
    symbol X that holds the context of a short symbol of X, seen as often as
    X, is closed: wherever the window stands, that short symbol stands, hence
    X around it, which settles the window or makes that document its smallest.
    """
    row, (name, least, often) = _flat(shared)
    key = _keyed(row, name.astype(np.int64).view(np.uint64))
    order = np.argsort(key)
    key, least, often = key[order], least[order], often[order]

    def seen(t: Symbols) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol (1 when not shared) and its least document."""
        if not len(key):
            return np.ones(len(t.name), np.int64), doc_id[t.row]
        mine = _keyed(t.row, t.name)
        at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
        hit = key[at] == mine
        return np.where(hit, often[at], 1), np.where(hit, least[at], doc_id[t.row])

    n = len(h)
    low, levels = parse(w.doc, h, s.low_rounds, s.rounds if len(key) else s.low_rounds + 1)
    whole = (low.low > -FAR) & (low.high < FAR)
    times, _ = seen(low)
    lone = low.take(whole & (times == 1))
    out = _marks(n, lone.high - s.size, lone.low + 1)
    removed = np.zeros(n, bool)
    from_, to = np.zeros(len(low.name), np.int64), np.zeros(len(low.name), np.int64)
    for t, up in levels:
        big = np.flatnonzero(t.end - t.start >= s.size)
        if not len(big):
            continue
        x = t.take(big)
        count, first = seen(x)
        took = x.take(first < doc_id[x.row])
        removed |= _marks(n, took.start, took.end)
        out |= _marks(n, took.start, took.end - s.size + 1)
        place = np.full(len(t.name), -1)
        place[big] = np.arange(len(big))
        mine = place[up]
        same = (mine >= 0) & whole & (times > 1)
        same &= count[mine] == times
        from_[same], to[same] = x.start[mine[same]], x.end[mine[same]]
    out |= _marks(n, np.maximum(low.high - s.size, from_),
                  np.where(to > from_, np.minimum(low.low, to - s.size) + 1, 0))
    at = starts_of_windows(w, s.size)
    return removed, at[~out[at]]


def dedup(docs: DataFrame, size: int = 50, low_rounds: int = 7, rounds: int = 96, splits: int = 8,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` for every row.

    A word goes when a window of ``size`` words that covers it also starts in
    a document with a smaller id.  Rounds name runs and pairs of words, then
    of symbols, until a text is one symbol; the names go through one shuffle, once a
    document, so a passage in a third of all documents costs its occurrences
    and no pairs.  Names seen in one document rule windows out,
    long names settle the inside of repeats, and the windows left, mostly at
    the borders of repeats, are compared by a 128-bit digest.  Those windows
    are found once and dealt by digest and one of ``splits`` turns of the
    document, so a window of very many documents is several tasks' work, and
    count and look-up read the same exchange.

    Null and empty texts have no words; rows with one id never remove from
    each other; rows with a null id neither lose nor take words; texts shorter
    than a window stay whole.  Extra columns are ignored; no rows, no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    s = Settings(size, low_rounds, rounds)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                        F.col(text_col).alias("text"))

    def name_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = split_words(part.column("text"))
                ids = np.asarray(part.column("doc_id"))
                low, levels = parse(w.doc, w.hashes(), s.low_rounds, s.rounds, False)
                long = [t.take(t.end - t.start >= s.size) for t, _ in levels]
                row = np.concatenate([low.row, *(t.row for t in long)])
                name = np.concatenate([low.name, *(t.name for t in long)])
                start = np.concatenate([low.start, *(t.start for t in long)])
                enough = w.counts()[row] >= s.size
                row, name, start = row[enough], name[enough], start[enough]
                order = np.lexsort((start, name, row))
                row, name, start = row[order], name[order], start[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (name[1:] != name[:-1])
                other = new.copy()  # a symbol that stays is one occurrence on all its levels
                other[1:] |= start[1:] != start[:-1]
                heads = np.flatnonzero(new)
                times = np.add.reduceat(other, heads, dtype=np.int32) if len(heads) else heads
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[new].view(np.int64)), pa.array(ids[row[new]]),
                     pa.array(times, pa.int32())], names=["name", "doc_id", "times"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                part = part.filter(part.column("doc_id").is_valid())
                known = part.column("shared").is_valid()
                for some in (part.filter(known), part.filter(pc.invert(known))):
                    w = split_words(some.column("text"))
                    h, ids = w.hashes(), np.asarray(some.column("doc_id"))
                    _, at = _regions(w, h, ids, some.column("shared"), s)
                    a, b = (window_hashes(h, s.size, k)[at] for k in (5, 6))
                    _, first = np.unique(_keyed(w.doc[at], a), return_index=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a[first].view(np.int64)), pa.array(b[first].view(np.int64)),
                         pa.array(ids[w.doc[at[first]]])], names=["a", "b", "doc_id"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                known = pc.or_(part.column("shared").is_valid(), part.column("repeats").is_valid())
                yield _cut(part.filter(known), s)
                yield _cut(part.filter(pc.invert(known)), s)

    named = texts.where("doc_id is not null").mapInArrow(
        name_all, "name bigint, doc_id bigint, times int")
    # every name crosses one exchange: its figures go to its own rows there, without a join
    by_name = Window.partitionBy("name")
    shared = named.select(
        "doc_id", "name", F.min("doc_id").over(by_name).alias("least"),
        F.max("doc_id").over(by_name).alias("m"), F.sum("times").over(by_name).alias("times")
    ).where("least < m").groupBy("doc_id").agg(
        F.collect_list(F.struct("name", "least", "times")).alias("shared"))
    marked = texts.join(shared, "doc_id", "left")
    # what the join would ask of one branch is asked of both, so that they read one exchange
    open_ = marked.mapInArrow(windows, "a bigint, b bigint, doc_id bigint").withColumn(
        "turn", F.pmod(F.xxhash64("doc_id"), F.lit(splits))).where(
        "a is not null and b is not null and doc_id is not null and turn is not null").repartition(
        "a", "b", "turn")
    again = open_.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("m")) \
        .where("least < m").select("a", "b", "least", F.explode(F.sequence(
            F.lit(0).cast("bigint"), F.lit(splits - 1).cast("bigint"))).alias("turn"))
    repeats = open_.join(again, ["a", "b", "turn"]).where("doc_id > least").groupBy("doc_id").agg(
        F.collect_set(F.struct("a", "b")).alias("repeats"))
    return marked.join(repeats, "doc_id", "left").mapInArrow(
        cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, "
             "kept_text string")


def _cut(part: pa.RecordBatch, s: Settings) -> pa.RecordBatch:
    w = split_words(part.column("text"))
    gone = np.zeros(len(w.start), bool)
    if min(part.column(c).null_count for c in ("shared", "repeats")) < part.num_rows:
        h = w.hashes()
        ids = np.asarray(part.column("doc_id").fill_null(0))
        gone, at = _regions(w, h, ids, part.column("shared"), s)
        row, (a, b) = _flat(part.column("repeats"))
        if len(row):
            known = _keyed(row, a.view(np.uint64)) ^ salted(b.view(np.uint64), 4)
            mine = _keyed(w.doc[at], window_hashes(h, s.size, 5)[at]) ^ salted(
                window_hashes(h, s.size, 6)[at], 4)
            start = at[np.isin(mine, known)]
            gone |= _marks(len(gone), start, start + s.size)
    lost = np.bincount(w.doc[gone], minlength=w.rows)
    raw, kept = w.data.tobytes(), []
    for k in range(w.rows):
        if lost[k]:
            span = np.arange(w.first[k], w.first[k + 1])
            span = span[~gone[span]]
            words = [raw[x:y] for x, y in zip(w.start[span], w.end[span], strict=True)]
        else:
            words = raw[w.offsets[k]:w.offsets[k + 1]].split()
        kept.append(b" ".join(words))
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), pa.array(w.counts(), pa.int64()), pa.array(lost, pa.int64()),
         pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
         pa.array([x.decode() for x in kept], pa.string())],
        names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
