"""SentencePiece encoding and decoding by lattices of pieces."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import ship
from plumbline.llm.words import Words, lists_by_row, slices, texts_of

#: The mark of a space, and the longest stretch a 64-bit state can hold.
SPACE_MARK, LONGEST_STATE = "▁", 60
SLICE = 1 << 19


@dataclass
class Vocabulary:
    """A model's pieces: id, rank of the score (best first), and what ids decode to."""

    pieces: list[tuple[str, int, int]]
    outputs: list[bytes]
    bytes_at: list[int]
    unknown: int
    merges: bool


def vocabulary(path: str | None = None) -> Vocabulary:
    """Read a model file; the default is the public 32,000-piece BPE model of this machine."""
    import sentencepiece
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    from sentencepiece import sentencepiece_model_pb2
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(m.serialized_model_proto())
    spec, norm = proto.trainer_spec, proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
        raise ValueError("only models with identity normalisation and a dummy prefix are read")
    if spec.model_type != 2 or not spec.byte_fallback:
        raise ValueError("only BPE models with byte fallback are read")
    n = m.get_piece_size()
    plain = [k for k in range(n) if not (m.is_control(k) or m.is_byte(k) or m.is_unknown(k)
                                         or m.is_unused(k))]
    scores = sorted({m.get_score(k) for k in plain}, reverse=True)
    rank = {s: r for r, s in enumerate(scores)}
    outputs, bytes_at = [], [0] * 256
    for k in range(n):
        piece = m.id_to_piece(k)
        if m.is_byte(k):
            value = int(piece[3:5], 16)
            bytes_at[value] = k
            outputs.append(bytes([value]))
        else:
            outputs.append(b"" if m.is_control(k) else piece.replace(SPACE_MARK, " ").encode())
    return Vocabulary([(m.id_to_piece(k), k, rank[m.get_score(k)]) for k in plain], outputs,
                      bytes_at, m.unk_id(), True)


# ---------------------------------------------------------------- segments of texts

def _marked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts with a space before each that is not empty."""
    column = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), SPACE_MARK, " ")
    raw, off = texts_of(column)
    extra = (np.diff(off) > 0).astype(np.int64)
    shift = np.concatenate([[0], np.cumsum(extra)])
    out = np.full(len(raw) + int(shift[-1]), 0x20, np.uint8)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    out[np.arange(len(raw)) + shift[row + 1]] = raw
    return out, off + shift


def segments(column: pa.Array) -> Words:
    """Stretches that no piece crosses: a run of spaces and what follows it, or a line break."""
    raw, off = _marked(column)
    n = len(raw)
    head = np.zeros(n, bool)
    if n:
        space, line = raw == 0x20, raw == 0x0A
        head = line.copy()
        head[0] = True
        head[1:] |= (space[1:] & ~space[:-1]) | line[:-1]
        head[off[:-1][np.diff(off) > 0]] = True
    start = np.flatnonzero(head)
    first = np.searchsorted(start, off)
    return Words(len(off) - 1, raw, off, start, np.append(start[1:], n)[:len(start)],
                 np.repeat(np.arange(len(off) - 1), np.diff(first)), first)


# ---------------------------------------------------------------- the lattice

@dataclass
class Lattice:
    """All pieces by their beginnings, as sorted steps from one beginning to the next.

    A step's key is the number of a beginning times ``alphabet``, and the
    number of the character that follows; both are small next to a text.
    """

    points: np.ndarray      # characters of all pieces, in order; the first has number 1
    alphabet: int
    keys: np.ndarray
    to: np.ndarray
    ids: np.ndarray         # of each beginning that is a piece, else -1
    ranks: np.ndarray

    @staticmethod
    def of(pieces: Iterable[tuple[str, int, int]]) -> Lattice:
        table = list(pieces)
        points = np.array(sorted({ord(c) for p, _, _ in table for c in p}), np.int64)
        number = {chr(c): k + 1 for k, c in enumerate(points.tolist())}
        alphabet, steps, found = len(number) + 1, {}, {}
        for piece, k, rank in table:
            node = 0
            for c in piece:
                node = steps.setdefault(node * alphabet + number[c], len(steps) + 1)
            found[node] = (k, rank)
        keys = np.array(sorted(steps), np.int64)
        ids, ranks = np.full((2, len(steps) + 1), -1, np.int64)
        for node, (ids[node], ranks[node]) in found.items():
            pass
        return Lattice(points, alphabet, keys, np.array([steps[k] for k in keys.tolist()], np.int64),
                       ids, ranks)

    def numbers(self, points: np.ndarray) -> np.ndarray:
        """The number of every character, 0 for those of no piece."""
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, at + 1, 0)

    def step(self, node: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The longer beginning, -1 if no piece begins so."""
        key = node * self.alphabet + number
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def edges(self, number: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """Segment, start, length and id of every piece of two characters or more in segments.

        They come by segment, then by score, then by start.  Segments longer
        than a 64-bit state have none.
        """
        size = np.diff(off)
        row = np.repeat(np.arange(len(size)), np.where(size > LONGEST_STATE, 0, size))
        at = _ranges(off[:-1], np.where(size > LONGEST_STATE, 0, size))
        node = self.step(np.zeros(len(at), np.int64), number[at])
        found, n = [], 1
        while len(at):
            on = np.flatnonzero((node >= 0) & (at + n < off[row + 1]))
            at, row, node = at[on], row[on], node[on]
            node = self.step(node, number[at + n])
            n += 1
            hit = np.flatnonzero((node >= 0) & (self.ids[node] >= 0))
            found.append((row[hit], at[hit] - off[row[hit]], np.full(len(hit), n), node[hit]))
        row, start, n, node = (np.concatenate(x) if x else np.zeros(0, np.int64)
                               for x in (zip(*found, strict=True) if found else [()] * 4))
        by = np.lexsort((start, self.ranks[node], row))
        return row[by], start[by], n[by], self.ids[node[by]]

    def tokens(self, number: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """Segment, start, length and id of the tokens that merging in score order leaves.

        The state of a segment has a bit for every boundary still standing.
        An edge can be taken when both its ends and just one boundary inside
        it stand; the best such edge of every segment is taken, until none is
        left.
        """
        row, start, n, ids = self.edges(number, off)
        one = np.uint64(1)
        s, k = start.astype(np.uint64), n.astype(np.uint64)
        ends = (one << s) | (one << (s + k))
        inner = ((one << (k - one)) - one) << (s + one)
        state = (one << np.minimum(np.diff(off) + 1, 63).astype(np.uint64)) - one
        left = np.arange(len(row))
        while len(left):
            now = state[row[left]]
            inside = np.bitwise_count(now & inner[left])
            stands = (now & ends[left]) == ends[left]
            can = left[stands & (inside == 1)]
            best = can[np.append(True, row[can[1:]] != row[can[:-1]])] if len(can) else can
            state[row[best]] &= ~inner[best]
            moved = np.zeros(len(state), bool)
            moved[row[best]] = True
            left = left[stands & (inside > 0) & moved[row[left]]]
        now = state[row]
        keep = ((now & inner) == 0) & ((now & ends) == ends)
        return row[keep], start[keep], n[keep], ids[keep]


def _points(segs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all strings and where each string's begin; their bytes and where each point's begin."""
    raw, ends = texts_of(segs)
    begins = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64)
    return points, np.searchsorted(begins, ends), raw, begins


def lattice(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """``seg, tokens, uses``: the tokens of two characters or more of every distinct segment.

    Tasks meet their segments with the pieces, as many as the vocabulary has
    (a fixed bound).  Segments of one character, or longer than a 64-bit
    state, are left out.  A token is id * 4096 + start * 64 + length, where
    the first start is 1.
    """
    spark = words.sparkSession
    ship(spark)
    table = spark.sparkContext.broadcast(Lattice.of(pieces.select("piece", "id", "rank").collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "seg", SLICE):
                points, off, *_ = _points(part.column("seg"))
                row, start, n, ids = table.value.tokens(table.value.numbers(points), off)
                by = np.lexsort((start, row))
                yield pa.RecordBatch.from_arrays(
                    [part.column("seg"), lists_by_row(
                        (ids * 4096 + (start + 1) * 64 + n)[by], row[by], part.num_rows, pa.int64()),
                     part.column("uses")], names=["seg", "tokens", "uses"])

    return words.where(F.length("seg").between(2, LONGEST_STATE)).select("seg", "uses").mapInArrow(
        run, f"seg string, tokens array<bigint>, uses {words.schema['uses'].dataType.simpleString()}")


def merge_long(text: str, known: dict[str, tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The same merges for one long stretch, with a queue: (start from 1, length, id)."""
    n = len(text)
    end, before = list(range(1, n + 1)), list(range(-1, n))
    alive = [True] * n
    queue: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        b = end[a]
        if a >= 0 and b < n and text[a:end[b]] in known:
            heapq.heappush(queue, (known[text[a:end[b]]][0], a, end[b]))

    for a in range(n):
        offer(a)
    while queue:
        _, a, stop = heapq.heappop(queue)
        b = end[a]
        if not alive[a] or b >= n or end[b] != stop:
            continue
        alive[b], end[a] = False, stop
        if stop < n:
            before[stop] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return [(a + 1, end[a] - a, known[text[a:end[a]]][1])
            for a in range(n) if alive[a] and end[a] - a > 1]


@dataclass
class Speller:
    """All ids of segments: their tokens, and single characters or bytes between them."""

    table: Lattice
    known: dict[str, tuple[int, int]]
    bytes_at: np.ndarray

    def slow(self, seg: str) -> list[int]:
        """One segment of any length."""
        out, done = [], 0
        for s, n, k in [*merge_long(seg, self.known), (len(seg) + 1, 0, -1)]:
            for c in seg[done:s - 1]:
                hit = self.known.get(c)
                out += [hit[1]] if hit else self.bytes_at[list(c.encode())].tolist()
            out += [k] * (n > 0)
            done = s - 1 + n
        return out

    def codes(self, segs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of every segment, one after another, and how many each has."""
        points, off, raw, begins = _points(segs)
        number = self.table.numbers(points)
        row, start, n, ids = self.table.tokens(number, off)
        at = off[row] + start
        code = np.append(self.table.ids, -1)[self.table.step(np.zeros(len(number), np.int64), number)]
        code[at] = ids
        edge = np.zeros(len(points) + 1, np.int64)
        np.add.at(edge, at + 1, 1)
        np.add.at(edge, at + n, -1)
        long = np.diff(off) > LONGEST_STATE
        keep = np.flatnonzero((np.cumsum(edge[:-1]) == 0) & ~np.repeat(long, np.diff(off)))
        code = code[keep]
        width = np.where(code < 0, np.diff(begins)[keep], 1)    # a character of no piece is its bytes
        out = np.repeat(code, width)
        out[out < 0] = self.bytes_at[raw[_ranges(begins[keep[code < 0]], width[code < 0])]]
        size = np.diff(np.concatenate([[0], np.cumsum(width)])[np.searchsorted(keep, off)])
        if not long.any():
            return out, size
        slow = {int(k): np.array(self.slow(segs[int(k)].as_py()), np.int64) for k in np.flatnonzero(long)}
        ends = np.cumsum(size)
        done = [slow.get(k, out[e - m:e]) for k, (e, m) in enumerate(zip(ends, size, strict=True))]
        return np.concatenate(done), np.array([len(x) for x in done], np.int64)


# ---------------------------------------------------------------- whole documents

def encode(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_fallback, ids, ids_sha256, round_trip`` for every row.

    A task takes slices of whole texts.  The distinct segments of a slice meet
    the piece table; their lattices are folded together, each segment once,
    and the texts are spelled out from the segments' ids.  Nothing is
    shuffled, and a task holds one slice.  ``round_trip`` says whether
    decoding gives the text again.

    Null and empty texts have no ids.  Segments longer than a 64-bit state
    are merged by a queue, with the same result.  A text that holds the space
    mark itself decodes to spaces there, and its ``round_trip`` is false.  Repeated rows get repeated results;
    extra columns are ignored; an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    ids_of = spark.sparkContext.broadcast((Speller(
        Lattice.of(vocab.pieces), {p: (r, k) for p, k, r in vocab.pieces},
        np.array(vocab.bytes_at, np.int64)), vocab.outputs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller, outputs = ids_of.value
        width = np.array([len(x) for x in outputs], np.int64)
        flat = np.frombuffer(b"".join(outputs), np.uint8)
        begin = np.cumsum(width) - width
        is_byte = np.zeros(len(outputs), bool)
        is_byte[speller.bytes_at] = True
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                yield _spelled(part, speller, flat, begin, width, is_byte)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, n_fallback bigint, ids array<int>, "
             "ids_sha256 string, round_trip boolean")


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of the ranges ``[start, start + size)``, one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - size), size)


def _spelled(part: pa.RecordBatch, speller: Speller, flat: np.ndarray, begin: np.ndarray,
             width: np.ndarray, is_byte: np.ndarray) -> pa.RecordBatch:
    """Rows with their ids; ``flat`` holds what each id decodes to, from ``begin``."""
    w = segments(part.column("text"))
    every, at, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
    length = w.end[at] - w.start[at]
    off = np.concatenate([[0], np.cumsum(length)])
    segs = pc.replace_substring(pa.LargeStringArray.from_buffers(
        len(every), pa.py_buffer(off.astype(np.int64)),
        pa.py_buffer(w.data[_ranges(w.start[at], length)])), " ", SPACE_MARK)
    code, size = speller.codes(segs) if len(every) else (off[:0], off[:0])
    ids = code[_ranges((np.cumsum(size) - size)[which], size[which])]
    n = np.bincount(w.doc, size[which], w.rows).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(n)])
    decoded = flat[_ranges(begin[ids], width[ids])].tobytes()
    edge = np.concatenate([[0], np.cumsum(width[ids])])[off]
    fallback = np.diff(np.concatenate([[0], np.cumsum(is_byte[ids])])[off])
    wide = ids.astype("<i4")
    own, text = texts_of(part.column("text"))
    own = own.tobytes()
    same = [decoded[a:b] == (b" " + own[c:d] if d > c else b"") for a, b, c, d in zip(
        edge[:-1], edge[1:], text[:-1], text[1:], strict=True)]
    return pa.RecordBatch.from_arrays([
        part.column("doc_id"), pa.array(n), pa.array(fallback),
        pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(wide)),
        pa.array([hashlib.sha256(wide[a:b].tobytes()).hexdigest()
                  for a, b in zip(off[:-1], off[1:], strict=True)], pa.string()),
        pa.array(same, pa.bool_())],
        names=["doc_id", "n_tokens", "n_fallback", "ids", "ids_sha256", "round_trip"])


def decode(encoded: DataFrame, vocab: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """Adds ``text`` to rows with an id list; null lists give null, empty ones empty texts.

    The space put before each text is taken off; bytes that form no character
    become the replacement character.
    """
    spark = encoded.sparkSession
    ship(spark)
    outputs = spark.sparkContext.broadcast(vocab.outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if ids is None else b"".join(outputs.value[k] for k in ids).decode(
                errors="replace").removeprefix(" ") for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.string())],
                names=[*batch.schema.names, "text"])

    kept = encoded.drop("text")
    return kept.mapInArrow(run, ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", text string")
