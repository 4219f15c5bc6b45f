"""Spelling variants by permuterm rotations.

A word ends in a terminator, and every rotation of it is one row.  A rotation that
ends with the edited character has the rest of the word as its prefix: words that
differ by one replaced character share it, and it is the whole rotation of the word
from which that character was deleted.  Rows with one prefix are neighbours in the
sorted rotations; one scan of each such group gives every member the number of its
near words and the best of them, so no pair is ever listed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import ship
from plumbline.llm.words import slices, texts_of
from plumbline.session import materialise, spread

#: One run in so many loses a character.
EVERY = 199
#: Ends a word; no word holds it.
END = "\x00"
SLICE_BYTES, LONG_RUN = 4 << 20, 64


# ---------------------------------------------------------------- words

def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


_CRC = _crc_table()
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _crc_of(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """CRC-32 of each run of bytes, continued from ``seed``; one step per byte position."""
    out = seed.astype(np.uint32)
    size = end - start
    short = np.flatnonzero(size <= LONG_RUN)
    short = short[np.argsort(size[short], kind="stable")]
    state, at, many = ~out[short], start[short], size[short]
    for k in range(int(many[-1]) if len(many) else 0):
        lo = int(np.searchsorted(many, k, "right"))
        state[lo:] = _CRC[(state[lo:] ^ raw[at[lo:] + k]) & np.uint32(0xFF)] ^ (
            state[lo:] >> np.uint32(8))
    out[short] = ~state
    for k in np.flatnonzero(size > LONG_RUN):
        out[k] = zlib.crc32(raw[start[k]:end[k]].tobytes(), int(out[k]))
    return out


def _runs(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of letter runs (A-Z, a-z, U+00C0 to U+00FF), and the row of each."""
    n = len(raw)
    inside = _LETTER[raw]
    lead = np.flatnonzero(raw == 0xC3)           # a UTF-8 lead: U+00C0 to U+00FF
    inside[lead] = inside[lead + 1] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = off[(off > 0) & (off < n)]
    before[edges] = False
    after[edges - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def _without(raw: bytes, h: int) -> bytes:
    word = raw.decode()
    k = h % len(word)
    return (word[:k] + word[k + 1:]).encode()


def _count(part: pa.RecordBatch, least: int, every: int) -> pa.RecordBatch:
    raw, off = texts_of(part.column("text"))
    raw = raw.copy()
    raw[(raw >= 65) & (raw <= 90)] += 32
    start, end, row = _runs(raw, off)
    ids = ["" if i is None else str(i) for i in part.column("doc_id").to_pylist()]
    seed = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    h = _crc_of(raw, start, end, seed[row])
    chars = (end - start) - np.diff(np.concatenate([[0], np.cumsum(raw == 0xC3)])[
        np.stack([start, end])], axis=0)[0]
    cut = h % np.uint32(every) == 0
    changed = [_without(raw[start[k]:end[k]].tobytes(), int(h[k]))
               for k in np.flatnonzero(cut & (chars > least))]
    use = np.flatnonzero(~cut & (chars >= least))
    size = end[use] - start[use]
    ends = np.cumsum(size)
    data = raw[np.repeat(start[use] - (ends - size), size) + np.arange(int(size.sum()))]
    words = pa.Array.from_buffers(pa.large_string(), len(use), [
        None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data)])
    words = pa.concat_arrays([words, pa.array([c.decode() for c in changed], pa.large_string())])
    found = words.value_counts()
    return pa.RecordBatch.from_arrays(
        [found.field("values").cast(pa.string()), found.field("counts")], names=["word", "n"])


def vocabulary(docs: DataFrame, least_chars: int = 6, least_n: int = 5, every: int = EVERY,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words with their counts (word, n), over whole texts.

    A run of letters is lower-cased in A-Z; where ``every`` divides the CRC-32 of
    ``<id>:<run>``, it loses the code point that the CRC names.  Words are counted in
    slices of text before the shuffle.  A null text has no words, a null id is written
    as nothing, repeated rows count each, extra columns are ignored, an empty table
    gives no rows.  A text of any length is whole; a task holds about 40 bytes for
    each byte of one text.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield _count(part, least_chars, every)

    return (spread(rows).mapInArrow(run, "word string, n long").groupBy("word")
            .agg(F.sum("n").alias("n")).where(F.col("n") >= least_n))


# ---------------------------------------------------------------- near words

def _rotations() -> Column:
    """Rows of a word's sorted list: the shared prefix, and what was skipped.

    ``whole`` rows are complete rotations, one for each place where a character may be
    inserted.  The others leave the last character out; ``first`` marks the first of
    equal adjacent characters, the only one whose deletion counts, since the others
    give the same word.
    """
    word, size = F.col("word"), F.length("word")
    rest = F.concat(word, F.lit(END))

    def turned(k: Column, skip: int) -> Column:
        """``rest`` from character k + skip on, then its first k characters."""
        return F.concat(F.substr(rest, k + skip + 1), F.substr(rest, F.lit(1), k))

    whole = F.transform(F.sequence(F.lit(0), size), lambda k: F.struct(
        turned(k, 0).alias("prefix"), F.lit(True).alias("whole"), F.lit(False).alias("first")))
    skipped = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.struct(
        turned(k, 1).alias("prefix"), F.lit(False).alias("whole"),
        ((k == 0) | (F.substr(word, k, F.lit(1)) != F.substr(word, k + 1, F.lit(1))))
        .alias("first")))
    return F.concat(whole, skipped)


def near(words: DataFrame) -> DataFrame:
    """Per word that has any: word, n_near, and ``best`` (n and word of its best near word).

    Rotations are sorted by prefix, within it by count and word.  In a group, each
    shorter word (one at most, on a ``whole`` row) meets the ``first`` rows, and rows
    without a character meet each other; a word's best partner is then the first or the
    second of a kind.  A group has one row for each character of the alphabet at most,
    and is read in sorted runs that can spill.
    """
    rows = words.select("word", "n", F.explode(_rotations()).alias("r")).select(
        "word", "n", "r.prefix", "r.whole", "r.first")
    group = Window.partitionBy("prefix")
    order = group.orderBy(F.col("n").desc(), "word").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    item = F.struct("n", "word")
    skipped = F.when(~F.col("whole"), item)
    scanned = rows.select(
        "word", "n", "whole", "first",
        F.count(skipped).over(order).alias("replaced"),
        F.first(skipped, ignorenulls=True).over(order).alias("one"),
        F.nth_value(skipped, 2, ignoreNulls=True).over(order).alias("two"),
        F.count(F.when(F.col("first"), 1)).over(order).alias("longer"),
        F.first(F.when(F.col("first"), item), ignorenulls=True).over(order).alias("long"),
        F.first(F.when(F.col("whole"), item), ignorenulls=True).over(order).alias("short"))
    other = F.when(F.col("one.word") != F.col("word"), F.col("one")).otherwise(F.col("two"))
    deleted = F.when(F.col("first"), F.col("short"))
    met = scanned.select(
        "word",
        F.when(F.col("whole"), F.col("longer")).otherwise(
            F.col("replaced") - 1 + F.when(deleted.isNotNull(), 1).otherwise(0)).alias("n_near"),
        F.when(F.col("whole"), F.col("long")).otherwise(_better(other, deleted)).alias("best"))
    return met.where("n_near > 0").groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.max("best.n").alias("form_n"),
        F.min_by("best.word", F.struct(-F.col("best.n"), F.col("best.word"))).alias("form"))


def _better(a: Column, b: Column) -> Column:
    """The greater count, then the smaller word; null is no candidate."""
    return F.when(b.isNull(), a).when(a.isNull(), b).when(
        (a["n"] > b["n"]) | ((a["n"] == b["n"]) & (a["word"] < b["word"])), a).otherwise(b)


def group(words: DataFrame, times: int = 5) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    ``words`` has distinct words without the character U+0000 and their counts; other
    columns are ignored, rows with a null word or count too.  Words are near if they
    differ by exactly one inserted, deleted or replaced code point.  A word's form is
    the near word of largest n (ties: smallest) if that n is at least ``times`` the
    word's; counts grow along forms, so following them ends, and halves the way in each
    round.  Words of one length but another by more than an edit, and words alone, have
    no form and are their own root.  An empty table gives no rows.
    """
    words = materialise(words.where("word IS NOT NULL AND n IS NOT NULL").select("word", "n"))
    met = near(words)
    strong = F.col("form_n") >= times * F.col("n")
    formed = materialise(words.join(met, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("form")).alias("form"),
        F.when(strong, F.col("form_n")).alias("form_n")))
    links = materialise(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        known = links.select(F.col("word").alias("via"), F.col("root").alias("next"))
        moved = materialise(links.join(known, links["root"] == known["via"], "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")))
        links = moved.select("word", "root")
        if not moved.where("on").limit(1).count():
            break
    return formed.join(links, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
