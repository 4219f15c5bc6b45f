"""Best-fit packing of token pieces into sequences by linear grouping.

The plan needs only how many pieces there are of each length, a table of at most
``size`` rows, so it costs the same at every corpus size.  Large lengths are cut
into groups of equal cardinality and rounded up to the longest of their group; the
configuration problem on these few sizes is solved by column generation, and whole
sequences are taken from it.  Actual pieces stand in for all rounded ones of a
sequence but its shortest; what is left, and all small pieces, go best-fit into the
room that remains, which thereby gets back what rounding took.  A plan is a list of
runs: pieces of one length, by rank, fill consecutive sequences at one offset.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import ship
from plumbline.llm.words import Words, slices, split_words
from plumbline.session import materialise, spread

#: Pieces of one length are ranked in groups of about so many rows.
RANK_ROWS = 8192
#: Distinct units whose ids a Python worker remembers before it starts afresh.
MEMO_UNITS = 1_000_000
SLICE_BYTES = 2 << 20
#: Parts of the configurations' sequences that plans are tried with.
PARTS = (1.0, 0.98, 0.95, 0.9, 0.8, 0.6)


# ---------------------------------------------------------------- tokens

class Encoder:
    """Token ids of text columns, by a tokenizer that lower-cases and drops white space.

    No token crosses white space, so ids of a text are those of its words.  Words of
    ASCII and Latin-1 letters fall into letter runs, digits and runs of other
    characters, just as the tokenizer splits them; each distinct unit meets the
    model once.  Words with an apostrophe, other characters or ``<|`` go through the
    whole tokenizer.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_str(spec)
        self.model = self.whole.model
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {b: chr(b) for b in visible} | {
            b: chr(256 + k) for k, b in enumerate(hidden)}
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)      # hashes, ascending
        self.at = np.zeros(0, np.int64)          # place of a unit's ids
        self.many = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _unit(self, raw: bytes, plain: bool) -> list[int]:
        if plain:
            return [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, raw)))]
        return self.whole.encode(raw.decode(), add_special_tokens=False).ids

    def _learn(self, hashes: np.ndarray, units: list[tuple[bytes, bool]]) -> None:
        if len(self.known) + len(hashes) > MEMO_UNITS:
            self.forget()
        found = [self._unit(*u) for u in units]
        many = np.array([len(f) for f in found], np.int64)
        at = len(self.ids) + np.cumsum(many) - many
        self.ids = np.concatenate([self.ids, np.array([i for f in found for i in f], np.uint32)])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.at = np.concatenate([self.at, at])[order]
        self.many = np.concatenate([self.many, many])[order]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column, one end (id 0) after each row, and ids per row."""
        w = split_words(column)
        u, plain = _units(w)
        hashes = u.hashes() ^ np.where(plain, 0, 1).astype(np.uint64)
        every, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, every)
        new = place == len(self.known)
        new[~new] = self.known[place[~new]] != every[~new]
        if new.any():
            if len(self.known) + int(new.sum()) > MEMO_UNITS:
                self.forget()
                new[:] = True
            fresh = first[new]
            self._learn(every[new], [(u.data[u.start[k]:u.end[k]].tobytes(), bool(plain[k]))
                                     for k in fresh])
            place = np.searchsorted(self.known, every)
        many = np.append(self.many[place], 1)[np.insert(back, u.first[1:], len(every))]
        at = np.append(self.at[place], len(self.ids))[np.insert(back, u.first[1:], len(every))]
        ends = np.cumsum(many)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(at - (ends - many), many) + np.arange(total)
        ids = np.append(self.ids, np.uint32(0))[take]
        per_row = np.diff(np.concatenate([[0], ends])[
            np.concatenate([[0], u.first[1:] + np.arange(1, w.rows + 1)])])
        return ids, per_row


_KIND = np.full(256, 4, np.uint8)                # 4: only the whole tokenizer knows
_KIND[33:127] = 3                                # other visible ASCII
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1


def _units(w: Words) -> tuple[Words, np.ndarray]:
    """Units of words, lower-cased where plain, and whether each is plain."""
    data, n = w.data.copy(), len(w.data)
    kind = _KIND[data]
    if n:
        lead = np.flatnonzero(data == 0xC3)
        lead = lead[lead + 1 < n]
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = 1
        upper = lead[data[lead + 1] <= 0x9E] + 1
    odd = (kind == 4) | (data == 0x27)
    odd[1:] |= (data[1:] == 0x7C) & (data[:-1] == 0x3C)
    hard = np.concatenate([[0], np.cumsum(odd)])
    plain_word = hard[w.end] == hard[w.start]
    inside = np.zeros(n, bool)
    if len(w.start):
        inside[w.start[0]:] = np.repeat(plain_word, np.diff(np.append(w.start, n)))
        inside &= kind != 4
    head = np.zeros(n, bool)
    head[w.start] = True
    if n:
        head[1:] |= inside[1:] & inside[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        capital = inside & (data >= 65) & (data <= 90)
        data[capital] += 32
        data[upper[inside[upper]]] += 32
    start = np.flatnonzero(head)
    word = np.searchsorted(w.start, start, "right") - 1
    end = np.minimum(np.append(start[1:], n), w.end[word]) if len(start) else start
    first = np.searchsorted(start, w.offsets)
    return (Words(w.rows, data, w.offsets, start, end, w.doc[word], first), plain_word[word])


def tokenise(docs: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Pieces of at most ``size`` tokens: doc_id, piece, start, length, ids.

    ``path`` names a tokenizer file, read on the driver and sent to tasks (some
    megabytes, whatever the table).  A document is its ids and one end (id 0); only
    longer ones are cut, so a null or empty text is one piece of one token.  ``ids``
    are little-endian unsigned 32-bit numbers.  Texts of any length are whole; a
    task holds about 30 bytes for each byte of one text.  Repeated rows and ids give
    pieces each, a null id stays null, extra columns are ignored, an empty table
    gives no rows.  Units are told apart by 64 bits.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                encoder = encoder or Encoder(spec.value)
                yield _pieces(encoder, part, size)

    return spread(rows).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary")


def _pieces(encoder: Encoder, part: pa.RecordBatch, size: int) -> pa.RecordBatch:
    ids, per_row = encoder.encode(part.column("text"))
    many = -(-per_row // size)
    row = np.repeat(np.arange(len(per_row)), many)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = piece * size
    length = np.minimum(per_row[row] - start, size)
    off = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * np.int32(4)
    raw = pa.Array.from_buffers(pa.binary(), len(row), [
        None, pa.py_buffer(off), pa.py_buffer(ids.astype("<u4"))])
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()),
         pa.array(start), pa.array(length), raw],
        names=["doc_id", "piece", "start", "length", "ids"])


# ---------------------------------------------------------------- the plan

@dataclass
class Plan:
    """Runs of equal lengths, and how many sequences there are.

    Pieces of ``length`` with ranks from ``rank`` on fill sequences from ``first``
    on, ``per`` of them in each, from token ``offset``.
    """

    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0

    def arrays(self) -> dict[str, np.ndarray]:
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 5)
        return dict(zip(("length", "rank", "first", "per", "offset"), runs.T.copy(), strict=True))


def plan(counts: Mapping[int, int], size: int = 2048, groups: int = 128,
         small: float = 1 / 8) -> Plan:
    """Place ``counts[length]`` pieces of each length into sequences of ``size`` tokens.

    The configuration problem is solved once; plans that use all or only a part of its
    sequences, and leave the rest to best fit, are compared, and the shortest stands.
    """
    if any(not 1 <= n <= size for n in counts):
        raise ValueError(f"lengths must lie between 1 and {size}")
    large = [(n, counts[n]) for n in sorted(counts, reverse=True)
             if size * small < n < size and counts[n]]
    parts, solution = [], []
    if large:
        # few lengths need no rounding
        parts = ([[x] for x in large] if len(large) <= groups
                 else _equal_groups(large, min(groups, -(-sum(c for _, c in large) // 3))))
        solution = _configurations([p[0][0] for p in parts],
                                   [sum(c for _, c in p) for p in parts], size)
    plans = [_fill(counts, parts, solution, part, size) for part in PARTS]
    return min(plans, key=lambda p: p.sequences)


def _fill(counts: Mapping[int, int], parts: list[list[tuple[int, int]]],
          solution: list[tuple[list[tuple[int, int]], int]], part: float, size: int) -> Plan:
    """The plan that takes ``part`` of each configuration's sequences."""
    out, left, rank = Plan(), dict(counts), defaultdict(int)
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)   # free tokens: (first, sequences)
    parts = [list(p) for p in parts]

    def fill(length: int, first: int, bins: int, per: int, offset: int) -> None:
        out.runs.append((length, rank[length], first, per, offset))
        rank[length] += bins * per
        left[length] -= bins * per

    def open_bins(bins: int) -> int:
        out.sequences += bins
        return out.sequences - bins

    if whole := left.get(size):
        fill(size, open_bins(whole), whole, 1, 0)
    for pattern, bins in solution:
        if bins := int(bins * part):
            _substitute(pattern, bins, parts, open_bins(bins), size, fill, room)
    _best_fit(left, size, fill, room, open_bins)
    return out


def _equal_groups(large: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """Cut lengths with counts, longest first, into ``k`` groups of nearly one cardinality."""
    total = sum(c for _, c in large)
    bounds = [total * (g + 1) // k for g in range(k)]
    parts: list[list[tuple[int, int]]] = [[]]
    seen = 0
    for length, count in large:
        while count:
            take = min(count, bounds[len(parts) - 1] - seen)
            parts[-1].append((length, take))
            seen, count = seen + take, count - take
            if seen == bounds[len(parts) - 1] and len(parts) < k:
                parts.append([])
    return parts


def _substitute(pattern, bins, parts, first, size, fill, room) -> None:
    """Put actual pieces into ``bins`` sequences of one configuration, all but the shortest.

    Each slot takes the next ``bins`` pieces of its group, longest first, so what a
    sequence holds changes only where a slot passes to the next length.
    """
    slots, cuts, several = [], {0, bins}, sum(c for _, c in pattern) > 1
    for g, copies in pattern:
        for _ in range(copies - (several and g == pattern[-1][0])):
            at, slot = 0, []
            while at < bins:
                length, count = parts[g][0]
                take = min(count, bins - at)
                slot.append((at, length))
                at += take
                cuts.add(at)
                parts[g][0] = (length, count - take)
                if count == take:
                    parts[g].pop(0)
            slots.append(slot)
    edges = sorted(cuts)
    for lo, hi in zip(edges, edges[1:], strict=False):
        offset = 0
        for slot in slots:
            length = next(n for at, n in reversed(slot) if at <= lo)
            fill(length, first + lo, hi - lo, 1, offset)
            offset += length
        room[size - offset].append((first + lo, hi - lo))


def _best_fit(left, size, fill, room, open_bins) -> None:
    """Longest first, into the sequences with the least room that takes them."""
    for length in sorted((n for n in left if left[n]), reverse=True):
        free = length
        while left[length]:
            while free < size and not room.get(free):
                free += 1
            per = free // length
            if free < size:
                first, bins = room[free].pop()
            else:
                bins = -(-left[length] // per)
                first = open_bins(bins)
            full = min(bins, left[length] // per)
            if full:
                fill(length, first, full, per, size - free)
                room[free - per * length].append((first, full))
            if full < bins and left[length]:
                last = left[length]
                fill(length, first + full, 1, last, size - free)
                room[free - last * length].append((first + full, 1))
                full += 1
            if full < bins:
                room[free].append((first + full, bins - full))


def _configurations(sizes: list[int], demand: list[int], size: int,
                    tolerance: float = 1e-4) -> list[tuple[list[tuple[int, int]], int]]:
    """Whole sequences of a configuration problem: (group, copies) pairs and how often.

    Column generation: the simplex prices configurations by a knapsack, and stops
    when no configuration can lower the number of sequences by more than
    ``tolerance`` of it.  The whole parts of the solution never exceed a demand.
    """
    m = len(sizes)
    width, wanted = np.array(sizes), np.array(demand, float)
    base, inverse, value = np.zeros((m, m)), np.eye(m), wanted

    def enter(column: np.ndarray, u: np.ndarray, row: int) -> np.ndarray:
        base[:, row] = column
        inverse[row] /= u[row]
        others = u.copy()
        others[row] = 0
        inverse[:] -= np.outer(others, inverse[row])
        return np.maximum((inverse * wanted).sum(axis=1), 0)

    for column, row in _first_fit(width, wanted, size):
        value = enter(column, (inverse * column).sum(axis=1), row)
    for _ in range(20 * m):
        column, worth = _knapsack(width, inverse.sum(axis=0), size)
        if worth <= 1 + tolerance:
            break
        u = (inverse * column).sum(axis=1)
        ratio = np.where(u > 1e-9, value / np.where(u > 1e-9, u, 1), np.inf)
        value = enter(column, u, int(np.argmin(ratio)))
    left, found = list(demand), []
    for row in range(m):
        pattern = [(int(g), int(base[g, row])) for g in np.flatnonzero(base[:, row])]
        bins = int(value[row] + 1e-6)
        bins = min([bins, *(left[g] // c for g, c in pattern)])
        for g, c in pattern:
            left[g] -= bins * c
        found.append((pattern, bins))
    return found


def _first_fit(width: np.ndarray, wanted: np.ndarray,
               size: int) -> Iterator[tuple[np.ndarray, int]]:
    """A start for the simplex: each configuration takes, longest first, what is left, until
    one of its groups is used up.  No later one holds that group, so the base is regular."""
    left, open_ = wanted.copy(), np.ones(len(width), bool)
    for _ in range(len(width)):
        column, free = np.zeros(len(width)), size
        for g in np.flatnonzero(open_):
            column[g] = free // width[g]
            free -= int(column[g]) * int(width[g])
        used = np.flatnonzero(column)
        times = left[used] / column[used]
        gone = int(used[int(np.argmin(times))])
        left = np.maximum(left - times.min() * column, 0)
        open_[gone] = False
        yield column, gone


def _knapsack(width: np.ndarray, prices: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """The configuration of greatest total price, by blocks no longer than the least width."""
    best, choice = np.zeros(size + 1), np.full(size + 1, -1)
    step = int(width.min())
    for lo in range(step, size + 1, step):
        at = np.arange(lo, min(lo + step, size + 1))
        back = at[None, :] - width[:, None]
        gain = np.where(back >= 0, best[np.maximum(back, 0)] + prices[:, None], -1.0)
        g = gain.argmax(axis=0)
        top = gain[g, np.arange(len(at))]
        use = top > 0
        best[at], choice[at] = np.where(use, top, 0), np.where(use, g, -1)
    column, c = np.zeros(len(width)), int(np.argmax(best))
    while choice[c] >= 0:
        column[choice[c]] += 1
        c -= int(width[choice[c]])
    return column, float(best.max())


# ---------------------------------------------------------------- the pieces

def pack(pieces: DataFrame, size: int = 2048, groups: int = 128,
         length_col: str = "length") -> DataFrame:
    """``pieces`` with the columns ``sequence_id`` and ``offset``.

    Only the count of each length reaches the driver.  Pieces of one length are
    ranked in buckets of about ``RANK_ROWS`` rows, so no length is one task, and
    each finds its run by rank.  All columns are kept, whatever they are called
    (a column named ``sequence_id`` or ``offset`` is replaced); rows may repeat and
    tie; a piece whose length is null or outside 1 to ``size`` gets nulls; an empty
    table gives no rows.
    """
    ship(pieces.sparkSession)
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = materialise(pieces.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("piece"),
        F.col(f"`{length_col}`").cast("long").alias("length")))
    fits = F.coalesce(F.col("length").between(1, size), F.lit(False))
    counts = {r["length"]: r["count"] for r in rows.where(fits).groupBy("length").count().collect()}
    arrays = plan(counts, size, groups).arrays()

    buckets = [-(-counts.get(n, 0) // RANK_ROWS) or 1 for n in range(1, size + 1)]
    bucket_of = F.element_at(F.expr(f"array({', '.join(map(str, buckets))})"),
                             F.col("length").cast("int"))
    placed = (rows.withColumn("row", F.monotonically_increasing_id()).where(fits)
              .withColumn("bucket", F.pmod(F.xxhash64("row"), bucket_of)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = placed.groupBy("length", "bucket").count().select(
        "length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    turn = Window.partitionBy("length", "bucket").orderBy("row")
    ranked = (placed.withColumn("turn", F.row_number().over(turn))
              .join(offsets, ["length", "bucket"])
              .select("piece", "length", (F.col("before") + F.col("turn") - 1).alias("rank")))

    step = 1 << 48                               # more than there are pieces of one length
    key = arrays["length"] * step + arrays["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            k = np.searchsorted(key, length * step + rank, "right") - 1
            turn = rank - arrays["rank"][k]
            yield pa.RecordBatch.from_arrays(
                [batch.column("piece"), pa.array(arrays["first"][k] + turn // arrays["per"][k]),
                 pa.array(arrays["offset"][k] + turn % arrays["per"][k] * length)],
                names=["piece", "sequence_id", "offset"])

    place = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    found = ranked.mapInArrow(run, T.StructType([ranked.schema["piece"], *place]))
    none = F.lit(None).cast("long")
    return found.unionByName(rows.where(~fits).select(
        "piece", none.alias("sequence_id"), none.alias("offset"))).select(
        "piece.*", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence of ``pack(tokenise(...))``: sequence_id, n_pieces, length, ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.sum("length").alias("length"),
        F.aggregate(parts, F.lit(b"").cast("binary"),
                    lambda a, p: F.concat(a, p["ids"])).alias("ids"))
