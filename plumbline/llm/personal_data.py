"""Personal data: patterns, and a skip-chain conditional random field that adds spans."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import ship
from plumbline.llm.words import slices, split_words

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1                       # 0 is none
CHAIN, SAME, ALIKE = 0, 1, 2                  # edge types
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = np.zeros(256, bool)
_HINT[[*range(48, 58), 64]] = True


def luhn(digits: str) -> bool:
    odd = [ord(c) - 48 for c in digits[::-1]]
    return (sum(odd[::2]) + sum(2 * d - 9 * (d > 4) for d in odd[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, ``@`` and dotted domain, found from each ``@``."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, ordered; failing matches are dropped."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Tokens:
    """Words with a digit or ``@``: row, place among the row's words, code point span, form."""

    row: np.ndarray
    place: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: list[str]

    def features(self) -> np.ndarray:
        """A code below 2 ** 11 for the shape of each token."""
        out = np.zeros(len(self.text), np.int64)
        for k, t in enumerate(self.text):
            digits = sum("0" <= c <= "9" for c in t)
            letters = sum(c.isalpha() for c in t)
            size = np.searchsorted((1, 2, 4, 7, 10, 14, 20), digits, "right")
            out[k] = (size | np.searchsorted((1, 4), letters, "right") << 3
                      | min(t.count("."), 3) << 5 | ("@" in t) << 7 | t.startswith("+") << 8
                      | ("-" in t) << 9 | ("(" in t or ")" in t) << 10)
        return out

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbours in the text, and each token with the next one like it in its row.

        Like means the same form without case and closing marks, else the
        same last seven digits; every token has at most one later partner of
        either sort, so a token that repeats n times makes n - 1 edges.
        """
        a, b, kind = [], [], []
        last: dict[tuple[int, str], int] = {}
        for k, t in enumerate(self.text):
            row = int(self.row[k])
            if k and self.row[k - 1] == row and self.place[k - 1] + 1 == self.place[k]:
                a.append(k - 1), b.append(k), kind.append(CHAIN)
            form = t.lower().strip("().,;:!?\"'")
            digits = "".join(c for c in t if "0" <= c <= "9")
            keys = [(row, "=" + form)] + ([(row, "~" + digits[-7:])] if len(digits) >= 7 else [])
            seen = None
            for sort, key in zip((SAME, ALIKE), keys, strict=False):
                if key in last and last[key] != seen:
                    seen = last[key]
                    a.append(seen), b.append(k), kind.append(sort)
                last[key] = k
        return np.array(a, np.int64), np.array(b, np.int64), np.array(kind, np.int64)


def tokens_of(part: pa.RecordBatch) -> tuple[Tokens, dict[int, list[tuple[int, int, int]]]]:
    """Candidate tokens and base spans of a block of rows."""
    w = split_words(part.column("text"))
    hints = np.concatenate([[0], np.cumsum(_HINT[w.data])])
    marked = np.flatnonzero(hints[w.end] > hints[w.start])
    points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    row = w.doc[marked]
    origin = points[w.offsets[row]]
    raw = w.data.tobytes()
    forms = [raw[a:b].decode() for a, b in zip(w.start[marked], w.end[marked], strict=True)]
    tokens = Tokens(row, marked, points[w.start[marked]] - origin,
                    points[w.end[marked]] - origin, forms)
    spans = {int(k): patterns(raw[w.offsets[k]:w.offsets[k + 1]].decode())
             for k in np.unique(row)}
    return tokens, spans


def labels_of(tokens: Tokens, spans: dict[int, list[tuple[int, int, int]]]) -> np.ndarray:
    """The kind of the first base span that each token meets, plus one; else 0."""
    out = np.zeros(len(tokens.text), np.int64)
    for k in range(len(out)):
        for start, kind, end in spans[int(tokens.row[k])]:
            if start < tokens.end[k] and tokens.start[k] < end:
                out[k] = kind + 1
                break
    return out


@dataclass
class Field:
    """Log potentials: of labels by feature, and of label pairs by edge type."""

    bits: np.ndarray
    pair: np.ndarray

    def unary(self, codes: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros((0, LABELS))
        return _one_hot(codes) @ self.bits

    def marginals(self, codes: np.ndarray, a: np.ndarray, b: np.ndarray, kind: np.ndarray,
                  rounds: int = 10, damp: float = 0.5) -> np.ndarray:
        """Loopy sum-product over all rows of a block at once; rows share no edge."""
        unary = self.unary(codes)
        m = len(a)
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        pot = np.concatenate([self.pair[kind], self.pair[kind].transpose(0, 2, 1)])
        sent = np.zeros((2 * m, LABELS))
        belief = unary.copy()
        for _ in range(rounds if m else 0):
            out = (belief[src] - sent[back])[:, :, None] + pot
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None]).sum(1))
            new -= new.max(1, keepdims=True)
            sent = damp * sent + (1 - damp) * new
            belief = unary.copy()
            np.add.at(belief, dst, sent)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _one_hot(codes: np.ndarray) -> np.ndarray:
    """Fields of the feature code as indicator columns, with a constant."""
    out = [np.ones((len(codes), 1))]
    for shift, width in ((0, 8), (3, 4), (5, 4), (7, 2), (8, 2), (9, 2), (10, 2)):
        out.append(np.eye(width)[(codes >> shift) % width])
    # digits together with dots and with marks tell addresses from numbers
    out.append(np.eye(32)[(codes & 7) * 4 + ((codes >> 5) & 3)])
    out.append(np.eye(32)[(codes & 7) * 4 + ((codes >> 8) & 1) * 2 + ((codes >> 9) & 1)])
    return np.concatenate(out, 1)


def fit(docs: DataFrame, text_col: str = "text", steps: int = 300, ridge: float = 1e-3) -> Field:
    """Potentials from all rows, taught by the base patterns.

    Tasks count labels by feature code, and label pairs by edge type; the sums
    over the whole table have at most 2 ** 11 * 5 + 75 rows, a fixed bound.
    The single potentials are a softmax regression on those counts, the pair
    potentials their smoothed pointwise mutual information (piecewise
    training).  Without candidate tokens every potential is flat.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int, int], int] = defaultdict(int)
        for batch in batches:
            for part in slices(batch):
                tokens, spans = tokens_of(part)
                y = labels_of(tokens, spans)
                for code, label in zip(tokens.features().tolist(), y.tolist(), strict=True):
                    found[(-1, code, label)] += 1
                for i, j, kind in zip(*tokens.edges(), strict=True):
                    found[(int(kind), int(y[i]), int(y[j]))] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[n] for k in found], pa.int64()) for n in range(3)]
            + [pa.array(list(found.values()), pa.int64())], names=["what", "x", "y", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(
        run, "what bigint, x bigint, y bigint, n bigint").groupBy("what", "x", "y").agg(
        F.sum("n").alias("n")).collect()
    pair = np.zeros((3, LABELS, LABELS))
    seen: dict[int, np.ndarray] = {}
    for r in rows:
        if r.what >= 0:
            pair[r.what, r.x, r.y] += r.n
        else:
            seen.setdefault(r.x, np.zeros(LABELS))[r.y] += r.n
    joint = pair + 0.5
    joint /= joint.sum((1, 2), keepdims=True)
    pmi = np.log(joint / joint.sum(2, keepdims=True) / joint.sum(1, keepdims=True))
    codes = np.array(sorted(seen), np.int64)
    width = _one_hot(np.zeros(1, np.int64)).shape[1]
    bits = np.zeros((width, LABELS))
    if len(codes):
        x, counts = _one_hot(codes), np.stack([seen[int(c)] for c in codes])
        n = counts.sum(1, keepdims=True)
        m, v = np.zeros_like(bits), np.zeros_like(bits)
        for k in range(1, steps + 1):
            z = x @ bits
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = x.T @ (n * p - counts) / n.sum() + ridge * bits
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            bits -= 0.1 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
    return Field(bits, pmi)


def _added(tokens: Tokens, spans: dict[int, list[tuple[int, int, int]]], p: np.ndarray,
           sure: float) -> dict[int, list[tuple[int, int, int]]]:
    """Runs of neighbouring tokens with one sure kind that meet no base span."""
    best = p.argmax(1)
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    before = None
    for k in range(len(best)):
        row, kind = int(tokens.row[k]), int(best[k]) - 1
        start, end = int(tokens.start[k]), int(tokens.end[k])
        end = start + len(tokens.text[k].rstrip(".,;:!?\"'"))
        free = all(end <= a or b <= start for a, _, b in spans[row])
        if kind < 0 or p[k, kind + 1] < sure or not free or end == start:
            before = None
            continue
        if before == (row, kind, int(tokens.place[k]) - 1):
            out[row][-1] = (out[row][-1][0], kind, end)
        else:
            out[row].append((start, kind, end))
        before = (row, kind, int(tokens.place[k]))
    return out


def find(docs: DataFrame, field: Field, sure: float = 0.9, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` for every row.

    Nodes are the words with a digit or ``@``; neighbours and repeated or
    similar words of a document share potentials, so a number that is plain in
    one place is found where it stands in another guise.  A node whose
    marginal is ``sure`` or more for a kind, and that no base span meets,
    adds a span.  Null and empty texts have no spans; each row is read whole
    and alone; repeated rows get repeated results; extra columns are ignored;
    no rows give no rows.
    """
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def joined(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                tokens, spans = tokens_of(part)
                p = field.marginals(tokens.features(), *tokens.edges())
                more = _added(tokens, spans, p, sure)
                base = [spans.get(k, []) for k in range(part.num_rows)]
                extra = [more.get(k, []) for k in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"),
                     *(pa.array([sum(s[1] == k for s in b) for b in base], pa.int64())
                       for k in range(len(KINDS))),
                     pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base],
                              pa.string()),
                     pa.array([joined(sorted(b + e)) for b, e in zip(base, extra, strict=True)],
                              pa.string()),
                     pa.array([len(e) for e in extra], pa.int64())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans",
                           "n_added"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {id_type}, " + ", ".join(f"n_{k} bigint" for k in KINDS)
        + ", base_sha256 string, spans string, n_added bigint")
