"""Quality rules on repetition, from suffix arrays over the words of each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm import ship
from plumbline.llm.words import Words, slices, split_words

SYMBOLS = b"#*$%&|<>"
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_covered", "longest_repeat")


def common_prefixes(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For every word position, the longest prefix its suffix shares with another.

    Suffixes of one row compete with suffixes of that row only.  The suffix
    array comes from prefix doubling, in which only suffixes that are still
    tied are sorted again; the ranks of every doubling give the common prefix
    of neighbours in the array by steps of falling powers of two.  The longest
    of both neighbours is the depth of the deepest prefix interval that holds
    the suffix.
    """
    n = len(h)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    order = np.lexsort((h, doc))
    fresh = np.ones(n, bool)
    fresh[1:] = (doc[order[1:]] != doc[order[:-1]]) | (h[order[1:]] != h[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, step = [rank.copy()], 1
    last = np.ones(n, bool)
    last[:-1] = fresh[1:]
    tied = np.flatnonzero(~(fresh & last))          # places in the array
    while len(tied):
        pos = order[tied]
        to = pos + step
        inside = (to < n) & (doc[np.minimum(to, n - 1)] == doc[pos])
        after = np.where(inside, rank[np.minimum(to, n - 1)] + 1, 0)
        again = np.lexsort((after, rank[pos]))
        pos, after, head = pos[again], after[again], rank[pos[again]]
        order[tied] = pos
        new = np.ones(len(tied), bool)
        new[1:] = (head[1:] != head[:-1]) | (after[1:] != after[:-1])
        rank[pos] = np.maximum.accumulate(np.where(new, tied, 0))
        end = np.ones(len(tied), bool)
        end[:-1] = new[1:]
        tied = tied[~(new & end)]
        step *= 2
        if len(tied):
            levels.append(rank.copy())
    left, right = order[:-1], order[1:]
    near = np.flatnonzero(levels[0][left] == levels[0][right])
    a, b = left[near], right[near]
    length = np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + length, b + length
        ok = (np.maximum(i, j) < n)
        i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
        ok &= (doc[i] == doc[a]) & (doc[j] == doc[b]) & (levels[k][i] == levels[k][j])
        length += np.where(ok, 1 << k, 0)
    np.maximum.at(best, a, length)
    np.maximum.at(best, b, length)
    return best


def covered(length: np.ndarray) -> np.ndarray:
    """Which positions lie in a span ``[i, i + length[i])``."""
    reach = np.maximum.accumulate(np.arange(len(length)) + length)
    return np.arange(len(length)) < reach


def measures(w: Words, shortest: int) -> dict[str, np.ndarray]:
    """The per-row figures named in ``FIELDS``."""
    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[w.offsets])

    def per_words(values: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc, values, w.rows).astype(np.int64)

    space = np.zeros(256, bool)
    space[[0x20, *range(9, 14)]] = True
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    h = w.hashes()
    deep = common_prefixes(w.doc, h)
    longest = np.zeros(w.rows, np.int64)
    np.maximum.at(longest, w.doc, np.where(deep >= shortest, deep, 0))
    return {
        "n_words": w.counts(),
        "word_chars": per_row(~space[w.data] & ((w.data & 0xC0) != 0x80)),
        "n_symbols": per_row(symbol[w.data]),
        "n_dup_lines": duplicate_lines(w),
        "n_repeat_words": per_words(covered(np.where(deep >= 3, 3, 0))),
        "n_covered": per_words(covered(np.where(deep >= shortest, deep, 0))),
        "longest_repeat": longest,
    }


def duplicate_lines(w: Words) -> np.ndarray:
    """Lines that hold a word and equal an earlier line of their row."""
    breaks = np.flatnonzero(w.data == 10)
    start = np.unique(np.concatenate([w.offsets[:-1], breaks + 1]))
    start = start[start < len(w.data)]
    if not len(start):
        return np.zeros(w.rows, np.int64)
    end = np.append(start[1:], len(w.data))
    end = np.where(w.data[end - 1] == 10, end - 1, end)
    row = np.searchsorted(w.offsets, start, "right") - 1
    lines = Words(w.rows, w.data, w.offsets, start, end, row, w.first)
    full = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    h, row = lines.hashes()[full], row[full]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[same], minlength=w.rows).astype(np.int64)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            shortest: int = 10, most_covered: float = 0.4, longest: int = 200,
            fewest_words: int = 50) -> DataFrame:
    """Repetition figures and a verdict for every row.

    A text is kept unless it has fewer than ``fewest_words`` words, over half
    of its words lie in repeated three-word windows, maximal repeated
    substrings of ``shortest`` words or more cover over ``most_covered`` of
    its words, or one of them is longer than ``longest``.  (Every maximal
    repeat is the prefix interval of its occurrences, and their spans joined
    are the spans of each suffix's deepest interval.)  Null and empty texts
    have no words and fail.  Rows never meet: no shuffle, repeated rows give
    repeated results, an empty table none; extra columns are ignored.
    """
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                m = measures(split_words(part.column("text")), shortest)
                n = m["n_words"]
                failed = (n < fewest_words) | (100 * m["n_repeat_words"] > 50 * n)
                kept = ~failed & (m["n_covered"] <= most_covered * n) & (
                    m["longest_repeat"] <= longest)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(m[f], pa.int64()) for f in FIELDS),
                     pa.array(failed), pa.array(kept)],
                    names=["doc_id", *FIELDS, "base_failed", "kept"])

    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInArrow(
        run, f"doc_id {id_type}, " + ", ".join(f"{f} bigint" for f in FIELDS)
        + ", base_failed boolean, kept boolean")
