"""Language-model scores: a gated recurrent network with a class-factored softmax, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import ship
from plumbline.llm.words import lists_by_row, slices, split_words
from plumbline.session import materialise

#: Fixed values of the network: hidden units, words of each class.  The unknown token
#: and the end are classes of their own, so that half of all words need no inner softmax.
UNITS, SIZES = 16, (1, 1, 2, 4, 8, 16, 32, 64, *[160] * 12)
CLASSES, VOCABULARY = len(SIZES), sum(SIZES)
EDGES = np.cumsum([0, *SIZES])
CLASS_OF = np.repeat(np.arange(CLASSES), SIZES)
UNKNOWN, END = 0, 1
#: Least and most streams of a training, between them so many that it has the steps; steps in
#: which the rate rises.
STREAMS, LEAST_STEPS, WARM_STEPS = (16, 256), 500, 50
END_HASH = np.int64(1)  # counts keep the end of a text under this value


@dataclass
class Net:
    """Weights, flat in ``PARTS`` order; the first input of a text is ``END``.

    One more input than there are units, always 1, carries the biases.
    """

    w: dict[str, np.ndarray]

    PARTS = (("embed", (VOCABULARY, UNITS)), ("wx", (UNITS + 1, 3 * UNITS)), ("wh", (UNITS + 1, 3 * UNITS)),
             ("wc", (CLASSES, UNITS + 1)), ("wo", (VOCABULARY, UNITS + 1)))

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 3) -> Net:
        """Random recurrent weights over output biases that give the unigram model."""
        rng = np.random.default_rng(seed)
        w = {k: rng.normal(0, 0.2, s).astype(np.float32) for k, s in cls.PARTS}
        w["wx"][-1], w["wh"][-1] = 0, 0
        w["wc"] *= 0.1
        w["wo"] *= 0.1
        w["wo"][:, -1] = np.log(counts + 0.5)
        w["wc"][:, -1] = np.log(np.add.reduceat(counts + 0.5, EDGES[:-1]))
        return cls(w)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k, _ in self.PARTS])

    @classmethod
    def views(cls, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parts of flat weights, without a copy."""
        w, at = {}, 0
        for k, s in cls.PARTS:
            size = int(np.prod(s))
            w[k] = flat[at:at + size].reshape(s)
            at += size
        return w

    @classmethod
    def of(cls, flat: np.ndarray) -> Net:
        return cls(cls.views(flat.astype(np.float32)))


def _inputs(w: dict[str, np.ndarray], e: np.ndarray) -> np.ndarray:
    """What every word gives the gates and the candidate, a column for each; see ``_cell``."""
    table = w["wx"][:-1].T @ e.T
    table += w["wx"][-1][:, None]
    table[:2 * UNITS] *= -1
    return table


def _recurrent(w: dict[str, np.ndarray]) -> np.ndarray:
    wh = w["wh"].T.copy()
    wh[:2 * UNITS] *= -1
    return wh


def _cell(wh: np.ndarray, a: np.ndarray, before: np.ndarray, u: np.ndarray, gates: np.ndarray,
          new: np.ndarray, after: np.ndarray) -> None:
    """One step of all sequences, a column for each; fills the last four.

    The inputs of the gates come with their sign turned: a gate is
    1 / (1 + exp(input)), and 0 where that is beyond the numbers.
    """
    np.matmul(wh, before, out=u)
    np.add(a[:2 * UNITS], u[:2 * UNITS], out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    np.multiply(gates[UNITS:], u[2 * UNITS:], out=new)
    new += a[2 * UNITS:]
    np.tanh(new, out=new)
    np.subtract(before[:UNITS], new, out=after)
    after *= gates[:UNITS]
    after += new


def _by_class(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by class, and where each class begins and ends in it."""
    order = np.argsort(y, kind="stable")
    return order, np.searchsorted(y[order], EDGES)


def _logits(weight: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Inputs of a softmax, at most 0, a column for each row of ``s``."""
    x = weight @ s.T
    x -= x.max(0)
    return x


def _log_of(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log probability of row ``at`` in every column; ``x`` is used up."""
    own = x[at, np.arange(x.shape[1])]
    np.exp(x, out=x)
    return own - np.log(x.sum(0))


def _errors(x: np.ndarray, at: np.ndarray, part: np.float32) -> np.ndarray:
    """Gradient of a softmax's inputs, in place, whose target is row ``at``."""
    np.exp(x, out=x)
    x *= part / x.sum(0)
    x.reshape(-1)[at * x.shape[1] + np.arange(x.shape[1])] -= part
    return x


def likelihoods(net: Net, ids: np.ndarray, first: np.ndarray, block: int = 1 << 14,
                together: int = 1024) -> np.ndarray:
    """Natural-log probability of every sequence, each word given all before it.

    Sequences step together, those of like length at a time, longest first,
    and the state of a sequence is carried from its first word to its last.
    States wait in a buffer, in which the words of one class share a product.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    total = np.zeros(len(n))
    for at in range(0, len(n), together):
        some = order[at:at + together]
        total[some] = _stepped(net.w, ids, first[:-1][some], n[some], block)
    return total


def _stepped(w: dict[str, np.ndarray], ids: np.ndarray, start: np.ndarray, n: np.ndarray,
             block: int) -> np.ndarray:
    """The same for sequences that begin at ``start``, longest first."""
    total = np.zeros(len(n))
    table, wh = _inputs(w, w["embed"]), _recurrent(w)
    h = np.zeros((UNITS + 1, len(n)), np.float32)
    h[UNITS] = 1
    room = np.empty((6 * UNITS, len(n)), np.float32)
    longest = int(n[0])
    active = np.searchsorted(-n, -np.arange(longest), "left")
    last = np.full(len(n), END)
    states, targets, owners, held = [], [], [], 0

    def flush() -> None:
        nonlocal states, targets, owners, held
        if not held:
            return
        s, y, o = np.concatenate(states, 1).T, np.concatenate(targets), np.concatenate(owners)
        by, edges = _by_class(y)
        s, y, o = s[by], y[by], o[by]
        out = _log_of(_logits(w["wc"], s), CLASS_OF[y])
        for c in np.flatnonzero((np.diff(edges) > 0) & (np.diff(EDGES) > 1)):
            (a, b), (low, high) = edges[c:c + 2], EDGES[c:c + 2]
            out[a:b] += _log_of(_logits(w["wo"][low:high], s[a:b]), y[a:b] - low)
        total[:] += np.bincount(o, out, len(total))
        states, targets, owners, held = [], [], [], 0

    with np.errstate(over="ignore"):
        for t in range(longest):
            k = int(active[t])
            before, h = h[:, :k], np.ones((UNITS + 1, k), np.float32)
            u, gates, new = np.split(room[:, :k], [3 * UNITS, 5 * UNITS])
            _cell(wh, np.take(table, last[:k], 1), before, u, gates, new, h[:UNITS])
            y = ids[start[:k] + t]
            states.append(h)
            targets.append(y)
            owners.append(np.arange(k))
            last, held = y, held + k
            if held >= block:
                flush()
        flush()
    return total


def lanes(texts: list[np.ndarray], streams: int, window: int, seed: int = 5) -> np.ndarray:
    """Texts in lanes of nearly one length, whole windows, -1 behind them.

    A lane's texts come in a drawn order, so that no training ends on short texts only.
    """
    rng = np.random.default_rng(seed)
    dealt: list[list[np.ndarray]] = [[] for _ in range(streams)]
    load = np.zeros(streams, np.int64)
    for t in sorted(texts, key=len, reverse=True):
        lane = int(load.argmin())
        dealt[lane].append(t)
        load[lane] += len(t)
    out = np.full((streams, -(-int(load.max()) // window) * window), -1, np.int16)
    for own, lane in zip(out, dealt, strict=True):
        if lane:
            row = np.concatenate([lane[k] for k in rng.permutation(len(lane))])
            own[:len(row)] = row
    return out


def train(net: Net, texts: list[np.ndarray], window: int = 16, rate: float = 0.005) -> int:
    """Adam over windows of parallel streams; returns the words seen.

    Texts, each closed by ``END`` and without it before, follow each other in
    a stream; the state is carried from window to window and is cleared where
    a text starts, and gradients stop at the window's edge.  More words are
    dealt to more streams, so that the steps are dense and still many.  The
    rate rises over the first steps and falls to a tenth.
    """
    words = sum(map(len, texts))
    if not words:
        return 0
    streams = int(np.clip(words // (LEAST_STEPS * window), *STREAMS))
    rate *= max(1, streams / 64) ** 0.5
    y_all = lanes(texts, streams, window)
    x_all = np.full_like(y_all, END)
    x_all[:, 1:] = np.where(y_all[:, :-1] < 0, END, y_all[:, :-1])
    flat = net.flat()
    w, grads, step = Net.views(flat), np.zeros_like(flat), 0
    into = Net.views(grads)
    m, v, way, scale = (np.zeros_like(flat) for _ in range(4))
    h = np.zeros((UNITS, streams), np.float32)
    with np.errstate(over="ignore"):
        for at in range(0, y_all.shape[1], window):
            x, y = (np.ascontiguousarray(k[:, at:at + window].T) for k in (x_all, y_all))
            h, real = _window(w, into, x, y, h)
            if not real:
                continue
            step += 1
            np.subtract(grads, m, out=way)
            way *= 0.1
            m += way
            np.multiply(grads, grads, out=way)
            way -= v
            way *= 0.001
            v += way
            np.sqrt(v, out=scale)
            scale *= (1 - 0.999 ** step) ** -0.5
            scale += 1e-5
            np.divide(m, scale, out=way)
            done = at / y_all.shape[1]
            rising, falling = min(max(step / WARM_STEPS, 10 * done), 1), 1 - 0.9 * done
            way *= rate * rising * falling / (1 - 0.9 ** step)
            flat -= way
    net.w = w
    return words


def _window(w: dict[str, np.ndarray], grads: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray,
            h: np.ndarray) -> tuple[np.ndarray, int]:
    """States after a window of steps (rows) and lanes, and its words; fills ``grads``."""
    steps, streams = x.shape
    keep = (x != END).astype(np.float32)
    used, place = np.unique(x, return_inverse=True)
    place = place.reshape(steps, streams)
    e = w["embed"][used]
    table, wh = _inputs(w, e), _recurrent(w)
    # a step's columns lie side by side: rows a whole window apart would share cache lines
    u, gates, new, hs = (np.empty((steps, k * UNITS, streams), np.float32) for k in (3, 2, 1, 1))
    before = np.ones((steps, UNITS + 1, streams), np.float32)
    for t in range(steps):
        np.multiply(h, keep[t], out=before[t, :UNITS])
        h = hs[t]
        _cell(wh, np.take(table, place[t], 1), before[t], u[t], gates[t], new[t], h)
    real = np.flatnonzero(y.ravel() >= 0)
    if not len(real):
        return h.copy(), 0
    target = y.ravel()[real].astype(np.int64)
    by, edges = _by_class(target)
    real, target = real[by], target[by]
    s = np.ones((len(real), UNITS + 1), np.float32)
    s[:, :UNITS] = hs.transpose(0, 2, 1).reshape(-1, UNITS)[real]
    part = np.float32(1 / len(real))
    p = _errors(_logits(w["wc"], s), CLASS_OF[target], part)
    np.matmul(p, s, out=grads["wc"])
    ds = p.T @ w["wc"][:, :UNITS]
    grads["wo"][:] = 0
    for c in np.flatnonzero((np.diff(edges) > 0) & (np.diff(EDGES) > 1)):
        (i, j), (low, high) = edges[c:c + 2], EDGES[c:c + 2]
        q = _errors(_logits(w["wo"][low:high], s[i:j]), target[i:j] - low, part)
        np.matmul(q, s[i:j], out=grads["wo"][low:high])
        ds[i:j] += q.T @ w["wo"][low:high, :UNITS]
    out = np.zeros((steps * streams, UNITS), np.float32)
    out[real] = ds
    out = np.ascontiguousarray(out.reshape(steps, streams, UNITS).transpose(0, 2, 1))

    # a state's gradient times these: both gates, the candidate's recurrent part, the candidate
    z, r = gates[:, :UNITS], gates[:, UNITS:]
    d = np.empty((steps, 4, UNITS, streams), np.float32)
    np.multiply(before[:, :UNITS] - new, z * (1 - z), out=d[:, 0])
    np.multiply(1 - z, 1 - new * new, out=d[:, 3])
    np.multiply(d[:, 3], r, out=d[:, 2])
    np.multiply(d[:, 2] * (1 - r), u[:, 2 * UNITS:], out=d[:, 1])
    dh = np.zeros((UNITS, streams), np.float32)
    back = np.ascontiguousarray(w["wh"][:UNITS])
    for t in range(steps - 1, -1, -1):
        dh += out[t]
        d[t] *= dh
        dh *= z[t]
        dh += back @ d[t, :3].reshape(3 * UNITS, streams)
        dh *= keep[t]
    d = d.reshape(steps, 4 * UNITS, streams).transpose(0, 2, 1).reshape(-1, 4 * UNITS)
    place = place.ravel()
    np.matmul(before.transpose(1, 0, 2).reshape(UNITS + 1, -1), d[:, :3 * UNITS], out=grads["wh"])
    d = np.delete(d, np.s_[2 * UNITS:3 * UNITS], 1)
    np.matmul(e[place].T, d, out=grads["wx"][:UNITS])
    d.sum(0, out=grads["wx"][UNITS])
    cells = (place[:, None] * UNITS + np.arange(UNITS)).ravel()
    grads["embed"][:] = 0
    grads["embed"][used] = np.bincount(cells, (d @ w["wx"][:UNITS].T).ravel()).reshape(-1, UNITS)
    return h.copy(), len(real)


@dataclass
class Frequent:
    """The most frequent words, ordered by hash: count and place in the vocabulary."""

    hashes: np.ndarray
    counts: np.ndarray
    places: np.ndarray   # UNKNOWN outside the vocabulary

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in this table and whether the word is in it."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h

    def known(self) -> Frequent:
        """The words that the network knows."""
        its = self.places != UNKNOWN
        return Frequent(self.hashes[its], self.counts[its], self.places[its])

    def sequences(self, at: np.ndarray, hit: np.ndarray,
                  first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary places of the found words of each text, with the end behind them."""
        place = np.where(hit, self.places[at], UNKNOWN) if len(self.hashes) else np.zeros(
            len(at), np.int64)
        rows = len(first) - 1
        out = np.full(len(at) + rows, END, np.int16)
        out[np.arange(len(at)) + np.repeat(np.arange(rows), np.diff(first))] = place
        return out, first + np.arange(rows + 1)


def _lower_words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    w = split_words(part.column("text"), lower=True)
    return w.hashes().view(np.int64), w.first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of this task's words, merged before the shuffle."""
    word, count, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        every, inverse = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        return every, np.bincount(inverse, np.concatenate([c for _, c in parts]),
                                  len(every)).astype(np.int64)

    for batch in batches:
        for part in slices(batch):
            h, first = _lower_words(part)
            waiting.append(np.unique(np.append(h, END_HASH), return_counts=True))
            waiting[-1][1][waiting[-1][0] == END_HASH] += len(first) - 2
            if len(waiting) == 8:
                word, count = merged([(word, count), *waiting])
                waiting = []
            if len(word) > 1 << 21:
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(count)],
                                                 names=["h", "c"])
                word, count = word[:0], count[:0]
    word, count = merged([(word, count), *waiting])
    yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(count)], names=["h", "c"])


def score(docs: DataFrame, frequent: int = 300_000, one_in: int = 1, rounds: int = 2,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Unigram and network log10 probabilities of every text.

    Words are lower-cased; a text ends in one end token.  Training texts are
    those whose crc32(id as text) mod 7 is not 2.  Their words are all
    counted, in one shuffle of counts merged per task.  The ``frequent`` most
    frequent words (a fixed bound of a few MB) travel with the tasks; every
    other word of a text meets its count in a join on words, none of which is
    then frequent.  The network knows the first 2,046 words; it learns from
    every training text, unless the caller asks for one in ``one_in``: every
    task trains on its texts by truncated backpropagation from shared
    weights, and the weights are averaged over tasks, ``rounds`` times.  A
    word it does not know has the probability of the unknown token times its
    add-one share among the words it does not know.

    Null and empty texts are one end token.  A null id is neither held out
    nor trained on.  Rows are scored each for itself; repeated rows get
    repeated results; extra columns are ignored.  An empty table gives no
    rows, and without training texts every count is 0.  Words are told apart
    by 64-bit hashes.
    """
    spark = docs.sparkSession
    ship(spark)
    fold = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(7))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                        F.coalesce(fold == 2, F.lit(False)).alias("held_out"),
                        F.coalesce(fold != 2, F.lit(False)).alias("learns"))
    counts = materialise(texts.where("learns").select("text").mapInArrow(
        _count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")).where("c > 0"))
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
                       F.count(F.lit(1)).alias("v")).first()
    top = counts.where(F.col("h") != int(END_HASH)).orderBy(F.desc("c"), "h").limit(
        frequent).toArrow()
    ends = counts.where(F.col("h") == int(END_HASH)).agg(F.sum("c")).first()[0] or 0
    h, c = (top[k].to_numpy() for k in ("h", "c"))
    places = np.zeros(len(h), np.int64)
    known = min(len(h), VOCABULARY - 2)
    places[:known] = np.arange(2, known + 2)
    vocabulary = np.zeros(VOCABULARY)
    vocabulary[2:known + 2] = c[:known]
    vocabulary[END] = ends
    vocabulary[UNKNOWN] = whole.n - vocabulary.sum()
    by_hash = np.argsort(h)
    table = Frequent(h[by_hash], c[by_hash], places[by_hash])
    # add-one mass of the words that the network does not know, unseen ones together as one
    rest = float(whole.n + whole.v - (c[:known] + 1).sum() - (ends + 1 if ends else 0) + 1)

    net = Net.start(vocabulary)
    lessons = texts.where(F.col("learns") & (F.pmod(
        F.xxhash64("doc_id", F.lit(29)), F.lit(one_in)) == 0)).select("text")
    for _ in range(rounds):
        net = _averaged(net, lessons, table)
    scored = materialise(_scored(texts, net, table).withColumn(
        "row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select(
        "row", F.col("w.words").alias("h"), F.col("w.times").alias("times"))
    met = rare.join(counts, "h").groupBy("row").agg(
        F.sum("times").alias("rare_known"),
        F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("rare_logs"))
    logs, hits = (F.coalesce(k, F.lit(v)) for k, v in (("rare_logs", 0.0), ("rare_known", 0)))
    end_log, end_known = float(np.log10(ends + 1)), int(ends > 0)
    return scored.join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + hits + end_known).cast("long").alias("n_known"),
        F.lit(int(whole.n)).cast("long").alias("train_tokens"),
        (F.col("logs") + logs + end_log - F.col("n_tokens") * float(np.log10(whole.n + whole.v + 1)))
        .alias("base_score"),
        (F.col("model") + F.col("unknown_logs") + logs
         - F.col("n_unknown") * float(np.log10(max(rest, 1.0)))).alias("score"))


def _averaged(net: Net, lessons: DataFrame, table: Frequent) -> Net:
    """One round of training in every task, weighed by the words it saw."""
    begin, table = net.flat(), table.known()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = []
        for batch in batches:
            for part in slices(batch):
                h, first = _lower_words(part)
                ids, first = table.sequences(*table.find(h), first)
                texts += [ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        if texts:
            own = Net.of(begin.copy())
            seen = train(own, texts)
            flat = own.flat().astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * seen),
                 pa.array(np.full(len(flat), float(seen)))], names=["k", "x", "n"])

    got = lessons.mapInArrow(run, "k int, x double, n double").groupBy("k").agg(
        (F.sum("x") / F.sum("n")).alias("x")).orderBy("k").toArrow()
    return Net.of(got["x"].to_numpy()) if got.num_rows else net


def _scored(texts: DataFrame, net: Net, table: Frequent) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, seqs, parts, at = [np.zeros(1, np.int64)], [], [], 0
            for part in slices(batch):
                h, first = _lower_words(part)
                place, hit = table.find(h)
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                rows = len(first) - 1
                log = np.where(hit, np.log10(table.counts[place] + 1.0), 0.0) if len(
                    table.hashes) else np.zeros(len(h))
                strange = ~hit | ((table.places[place] == UNKNOWN) if len(table.hashes) else True)
                order = np.lexsort((h[~hit], row[~hit]))
                word, owner = h[~hit][order], row[~hit][order]
                new = np.ones(len(word), bool)
                new[1:] = (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
                heads = np.flatnonzero(new)
                times = np.diff(np.append(heads, len(word)))
                parts.append([
                    part.column("doc_id"), part.column("held_out"),
                    pa.array(np.diff(first) + 1),
                    pa.array(np.bincount(row[hit], minlength=rows).astype(np.int64)),
                    pa.array(np.bincount(row, log, rows)),
                    pa.array(np.bincount(row[strange], minlength=rows).astype(np.int64)),
                    pa.array(np.bincount(row, np.where(strange, log, 0.0), rows)),
                    lists_by_row(word[heads], owner[heads], rows, pa.int64()),
                    lists_by_row(times, owner[heads], rows, pa.int64())])
                ids, ends = table.sequences(place, hit, first)
                seqs.append(ids)
                firsts.append(ends[1:] + at)
                at += len(ids)
            if not parts:
                continue
            model = likelihoods(net, np.concatenate(seqs), np.concatenate(firsts)) / np.log(10)
            done = 0
            for p in parts:
                n = len(p[0])
                yield pa.RecordBatch.from_arrays([*p, pa.array(model[done:done + n])], names=[
                    "doc_id", "held_out", "n_tokens", "n_known", "logs", "n_unknown",
                    "unknown_logs", "words", "times", "model"])
                done += n

    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text", "held_out").mapInArrow(
        run, f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, logs double, "
             "n_unknown bigint, unknown_logs double, words array<bigint>, times array<bigint>, "
             "model double")
