"""Toxicity: a convolutional text classifier trained in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import ship
from plumbline.llm.words import lists_by_row, slices, split_words
from plumbline.session import materialise

#: Fixed values of the network.
BUCKETS, WIDTH_OF_WORD, FILTERS, SPANS = 1 << 15, 8, 8, (1, 2, 3)
PAD = 2 * BUCKETS
#: Models that each leave out a fold, least batches of a training, counted steps of a score.
FOLDS, LEAST_STEPS, STEPS_OF_SCORE = 3, 800, 10_000
#: Rows of a training batch, and text bytes that are worked on at once.
BATCH, SLICE = 32, 1 << 18
_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two hash buckets of every lower-cased word and the word offsets of the rows.

    One bucket is of the word and one of its first five bytes, in a range of
    their own; up to two ASCII punctuation marks are taken off either end.
    """
    w = split_words(column, lower=True)
    for _ in range(2):
        long = w.end - w.start > 1
        w.end = w.end - (long & _EDGE[w.data[w.end - 1]])
        long = w.end - w.start > 1
        w.start = w.start + (long & _EDGE[w.data[w.start]])
    whole = w.hashes() >> np.uint64(49)
    w.end = np.minimum(w.end, w.start + 5)
    head = (w.hashes() >> np.uint64(49)) + np.uint64(BUCKETS)
    return np.stack([whole, head]).astype(np.int32), w.first


def responses(ids: np.ndarray, first: np.ndarray, tables: list[list[np.ndarray]], pad: int,
              where: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Largest response of every filter in every row; with ``where`` also its place.

    Rows are laid out with ``pad`` words behind them, so that a span may hang
    over a row's end but never into the next; an empty row is one pad word.
    """
    n = np.diff(first)
    room = max(SPANS) - 1
    size = np.maximum(n, 1) + room
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    padded = np.full((2, int(size.sum())), pad, np.int32)
    row = np.repeat(np.arange(len(n)), n)
    padded[:, start[row] + np.arange(ids.shape[1]) - first[row]] = ids
    real = np.ones(padded.shape[1], bool)
    for k in range(room):
        real[start + size - 1 - k] = False
    at = np.flatnonzero(real)
    heads = np.searchsorted(at, start)
    ends = np.append(heads[1:], len(at))
    tops, places = [], []
    for t in tables:
        resp = t[0][padded[0, at]]
        resp += t[0][padded[1, at]]
        for k in range(1, len(t)):
            resp += t[k][padded[0, at + k]]
            resp += t[k][padded[1, at + k]]
        tops.append(np.maximum.reduceat(resp, heads, axis=0))
        if where:
            places.append(np.stack([at[a + resp[a:b].argmax(0)]
                                    for a, b in zip(heads, ends, strict=True)]))
    return np.concatenate(tops, 1), np.concatenate(places, 1) if where else None, padded


@dataclass
class Model:
    """Embeddings, one filter bank per span, and the output layer."""

    words: np.ndarray
    banks: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: float
    cuts: dict[str | None, float] = field(default_factory=dict)

    @staticmethod
    def start(seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        words = rng.normal(0, 0.05, (PAD + 1, WIDTH_OF_WORD)).astype(np.float32)
        words[PAD] = 0
        banks = [rng.normal(0, 0.5, (s, WIDTH_OF_WORD, FILTERS)).astype(np.float32) for s in SPANS]
        total = FILTERS * len(SPANS)
        return Model(words, banks, np.zeros(total, np.float32),
                     rng.normal(0, 0.3, total).astype(np.float32), 0.0)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (
            self.words, *self.banks, self.bias, self.out, np.array([self.shift], np.float32))])

    @staticmethod
    def of(flat: np.ndarray) -> Model:
        model, at = Model.start(), 0
        for x in (model.words, *model.banks, model.bias, model.out):
            x[...] = flat[at:at + x.size].reshape(x.shape)
            at += x.size
        model.shift = float(flat[at])
        return model

    def tables(self) -> list[list[np.ndarray]]:
        """Each word's part in each filter, so that scoring only looks up and adds."""
        return [[self.words @ bank[k] for k in range(len(bank))] for bank in self.banks]

    def scores(self, ids: np.ndarray, first: np.ndarray,
               tables: list[list[np.ndarray]]) -> np.ndarray:
        if len(first) < 2:
            return np.zeros(0)
        top = responses(ids, first, tables, PAD)[0]
        z = np.maximum(top + self.bias, 0) @ self.out + self.shift
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))


Row = tuple[np.ndarray, int]


def train(model: Model, chunks: Iterable[list[Row]], passes: int, batch: int = BATCH,
          rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Adam on the logistic loss; only the winning position of a filter gets a gradient.

    ``model`` is changed in place, by ``passes`` over each chunk of rows in
    turn.  Returns in how many batches each word was met.
    """
    rng = np.random.default_rng(seed)
    params = [model.words, *model.banks, model.bias, model.out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    shift = np.zeros(3)
    met = np.zeros(PAD + 1)
    step = 0
    for rows in (chunk for chunk in chunks for _ in range(passes)):
        y_all = np.array([y for _, y in rows], np.float32)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            ids = np.concatenate([rows[i][0] for i in pick], axis=1)
            first = np.concatenate([[0], np.cumsum([rows[i][0].shape[1] for i in pick])])
            used, local = np.unique(np.append(ids.ravel(), PAD), return_inverse=True)
            met[used] += 1
            small = [[model.words[used] @ bank[k] for k in range(len(bank))]
                     for bank in model.banks]
            top, places, padded = responses(
                local[:-1].reshape(2, -1), first, small, len(used) - 1, True)
            act = np.maximum(top + model.bias, 0)
            z = act @ model.out + model.shift
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y_all[pick]) / len(pick)
            g_out = act.T @ g
            g_top = (g[:, None] * model.out) * (top + model.bias > 0)
            g_words = decay * model.words
            g_banks = [decay * b for b in model.banks]
            for b, bank in enumerate(model.banks):
                cols = slice(b * FILTERS, (b + 1) * FILTERS)
                gt, pl = g_top[:, cols], places[:, cols]
                for k in range(len(bank)):
                    part = (gt[:, :, None] * bank[k].T[None]).reshape(-1, WIDTH_OF_WORD)
                    for side in padded:
                        who = used[side[pl + k]]
                        g_banks[b][k] += np.einsum("nfd,nf->df", model.words[who], gt)
                        np.add.at(g_words, who.ravel(), part)
            g_words[PAD] = 0
            step += 1
            grads = [g_words, *g_banks, g_top.sum(0), g_out]
            for p, d, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-6)
            d = float(g.sum())
            shift[0] += 0.1 * (d - shift[0])
            shift[1] += 0.001 * (d * d - shift[1])
            model.shift -= rate * (shift[0] / (1 - 0.9 ** step)) / (
                (shift[1] / (1 - 0.999 ** step)) ** 0.5 + 1e-6)
    return met


def best_cut(scores: np.ndarray, hits: np.ndarray, rows: np.ndarray, least: float) -> float:
    """The threshold, ``least`` or more, of the highest F1; midway between two scores.

    ``rows`` rows have each score, ``hits`` of them with label 1.
    """
    if not hits.any():
        return max(0.7, least)
    order = np.argsort(-scores, kind="stable")
    f1 = 2 * np.cumsum(hits[order]) / (np.cumsum(rows[order]) + hits.sum())
    k = int(f1.argmax())
    below = scores[order[k + 1]] if k + 1 < len(order) else 0.0
    return float(np.clip((scores[order[k]] + below) / 2, least, 0.95))


def shares(n: int, rounds: int, cores: int) -> tuple[int, int]:
    """Tasks that train on ``n`` rows, and passes of each round over its rows.

    A task gets the rows that make the least steps in one pass a round, so
    that tables of more rows are read no more often than once a round.
    """
    tasks = int(np.clip(n * rounds // (BATCH * LEAST_STEPS), 1, max(1, cores)))
    return tasks, math.ceil(LEAST_STEPS / (rounds * math.ceil(max(n, 1) / (BATCH * tasks))))


def fit(docs: DataFrame, labels: DataFrame, least_cut: float = 0.6,
        fewest_per_language: int = 50, rounds: int = 2) -> Model:
    """Train on all labelled rows and calibrate one threshold per language on all of them.

    Only rows whose crc32(doc_id as text) mod 3 is not 1 are read.  Tasks train
    on their rows from shared weights, which are then averaged, ``rounds``
    times; rows do not reach the driver.  Beside the model of all rows, one is
    trained without each of three folds, by hash; thresholds come from the
    score that each row gets from the model that has not seen it, counted in
    steps of 1/10,000.  A language with fewer than ``fewest_per_language``
    rows shares the threshold of all.  Null or conflicting labels of a row are
    left out.  Without rows of both labels the model gives its prior.
    """
    known = labels.where("toxic in (0, 1) and pmod(crc32(cast(doc_id as string)), 3) <> 1") \
        .groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("z")) \
        .where("y = z").select("doc_id", F.col("y").cast("int"))
    chosen = docs.select("doc_id", "text", F.col("lang").alias("group")).join(
        F.broadcast(known), "doc_id").select(
        F.xxhash64("doc_id", F.lit(5)).alias("place"), "text", "group", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                ids, first = buckets(part.column("text"))
                row = np.repeat(np.arange(part.num_rows), np.diff(first))
                yield pa.RecordBatch.from_arrays(
                    [part.column("place"),
                     *(lists_by_row(x - k * BUCKETS, row, part.num_rows, pa.int16())
                       for k, x in enumerate(ids)),
                     part.column("group"), part.column("y")],
                    names=["place", "ids", "heads", "group", "y"])

    spark = docs.sparkSession
    ship(spark)
    tasks, _ = shares(known.count(), rounds, spark.sparkContext.defaultParallelism)
    # a session may deal rows to more partitions; each would send every weight of every model
    lessons = materialise(chosen.mapInArrow(
        run, "place bigint, ids array<smallint>, heads array<smallint>, group string, y int").withColumn(
        "fold", F.pmod("place", F.lit(FOLDS)).cast("int")).repartition(tasks, "place").coalesce(tasks)
        .sortWithinPartitions("place"))
    n = lessons.count()
    models = [Model.start() for _ in range(FOLDS + 1)]
    if n:
        passes = math.ceil(LEAST_STEPS / (rounds * math.ceil(n / (BATCH * tasks))))
        for _ in range(rounds):
            models = _averaged(models, lessons, passes)
    model = models[FOLDS]
    got = _fold_scores(lessons, models).toArrow()
    bins, hits, rows = (got[k].to_numpy() for k in ("bin", "hits", "n"))
    group, scores = got["group"].to_pylist(), (bins + 0.5) / STEPS_OF_SCORE
    every, inverse = np.unique(scores, return_inverse=True)
    model.cuts = {None: best_cut(every, np.bincount(inverse, hits), np.bincount(inverse, rows),
                                 least_cut)}
    for g in set(group) - {None}:
        mine = np.array([k == g for k in group])
        if rows[mine].sum() >= fewest_per_language:
            model.cuts[g] = best_cut(scores[mine], hits[mine], rows[mine], least_cut)
    return model


def _rows_of(batch: pa.RecordBatch) -> list[Row]:
    ids, heads = ([x.values.to_numpy() for x in batch.column(k)] for k in ("ids", "heads"))
    return [(np.stack([own.astype(np.int32), head + np.int32(BUCKETS)]), y) for own, head, y in zip(
        ids, heads, batch.column("y").to_pylist(), strict=True)]


def _averaged(models: list[Model], lessons: DataFrame, passes: int) -> list[Model]:
    """One round of training in the partitions of ``lessons``, each model without its fold;
    a word counts in a task by the batches that met it."""
    begin = [m.flat() for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head in batches:
            which = head.column("model")[0].as_py()
            own = Model.of(begin[which])
            met = train(own, map(_rows_of, chain([head], batches)), passes)
            flat = own.flat().astype(np.float64)
            # a word that no batch met counts a little, so that some weight stands for it
            weight = np.full(len(flat), met.max())
            weight[:own.words.size] = np.repeat(met + 1e-3, WIDTH_OF_WORD)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(flat), which, np.int32)),
                 pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * weight),
                 pa.array(weight)], names=["model", "k", "x", "n"])

    # each partition once for every model, without moving a row
    trained = reduce(DataFrame.unionByName, [
        lessons.where(F.col("fold") != m).select("ids", "heads", "y", F.lit(m).alias("model")).mapInArrow(
            run, "model int, k int, x double, n double") for m in range(len(models))])
    got = trained.groupBy("model", "k").agg(
        (F.sum("x") / F.sum("n")).cast("float").alias("x")).toArrow()
    which, k, x = (got[c].to_numpy() for c in ("model", "k", "x"))
    out = []
    for m, flat in enumerate(begin):
        flat = flat.copy()
        flat[k[which == m]] = x[which == m]
        out.append(Model.of(flat))
    return out


def _fold_scores(lessons: DataFrame, models: list[Model]) -> DataFrame:
    """group, bin, hits, n: how many rows have a score, from the model of the other folds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [m.tables() for m in models[:FOLDS]]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fold, bins = part.column("fold").to_numpy(), np.zeros(part.num_rows, np.int32)
                rows = _rows_of(part)
                for f in np.unique(fold):
                    mine = np.flatnonzero(fold == f)
                    first = np.concatenate([[0], np.cumsum([rows[k][0].shape[1] for k in mine])])
                    s = models[f].scores(np.concatenate([rows[k][0] for k in mine], axis=1),
                                         first.astype(np.int64), tables[f])
                    bins[mine] = np.minimum(s * STEPS_OF_SCORE, STEPS_OF_SCORE - 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("group"), pa.array(bins), part.column("y")],
                    names=["group", "bin", "y"])

    return lessons.mapInArrow(run, "group string, bin int, y int").groupBy("group", "bin").agg(
        F.sum("y").alias("hits"), F.count(F.lit(1)).alias("n"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, cut, rejected`` for every row, from whole texts.

    The score depends on the text alone; ``cut`` is the threshold of the row's
    language.  Null and empty texts get the score of a text with no known
    word.  Rows never meet; repeated rows get repeated results, an empty
    table none, extra columns are ignored.
    """
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                s = model.scores(*buckets(part.column("text")), tables)
                cut = np.array([model.cuts.get(g, model.cuts[None])
                                for g in part.column("group").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(s), pa.array(cut), pa.array(s >= cut)],
                    names=["doc_id", "score", "cut", "rejected"])

    return docs.select("doc_id", "text", F.col("lang").alias("group")).mapInArrow(
        run, f"doc_id {id_type}, score double, cut double, rejected boolean")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, unchanged."""
    ship(docs.sparkSession)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for batch in batches:
            named = pa.RecordBatch.from_arrays([*batch.columns, batch.column(text)], names=[
                *(str(k) for k in range(batch.num_columns)), "text"])
            for part in slices(named, limit=SLICE):
                s = model.scores(*buckets(part.column("text")), tables)
                cut = np.array([model.cuts.get(g, model.cuts[None])
                                for g in part.column(lang).to_pylist()])
                kept = part.filter(pa.array(s < cut))
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
