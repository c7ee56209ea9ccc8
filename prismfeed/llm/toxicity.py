"""Toxicity by class-conditional Kneser-Ney models of how words are spelt.

Two models, of toxic and of ordinary texts, give each letter of a word (UTF-8
bytes, with the word's ends) its probability after the ORDER - 1 before it.
Counts of the highest order are each class's own, less a discount; what is
discounted goes to one backoff distribution that both classes share, smoothed
by continuation counts down to single letters. So expressions too rare to tell
of a class back off to the same place and weigh nothing, while the stem of an
insult counts in any ending. As the shared part is the same on both sides, a
letter after a context seen without it costs the ratio of the backoff weights,
and one after an unseen context nothing: a text needs two lookup tables.

A text's log-likelihood ratio is divided by its length, over the whole and over
its one, two and four most toxic words, for a few insults in a long text drown
in the mean. A logistic curve turns these and the length into a score. It is
fitted on documents that the models behind it have not seen (by folds).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from prismfeed.llm._tables import keep, map_rows
from prismfeed.llm._words import ALNUM, Words, runs, word_tables

#: Bytes of a letter and its context; discount; folds of the calibration.
ORDER, DISCOUNT, FOLDS = 8, 0.75, 4
#: The classifier is fitted on about so many bytes of text of each class at most, spread evenly over all labelled rows.
TRAIN_BYTES = 16 << 20
_BLANK = 0x20
_TOPS = (1, 2, 4)


def word_grams(w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of the words at these places, each letter and the end of the word with the bytes before it (blanks before its start), and how many each word has."""
    size = w.end[at] - w.start[at] + 1
    inner = runs(size)
    first = np.repeat(w.start[at], size)
    last = inner == np.repeat(size - 1, size)
    spot = first + inner
    gram = np.zeros(len(inner), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        code = np.where(inner >= back, w.data[np.clip(spot - back, 0, len(w.data) - 1)], _BLANK).astype(np.uint64)
        if not back:
            code[last] = _BLANK
        gram = (gram << np.uint64(8)) | code
    return gram, size


def _prefix_runs(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each context begins among rising grams, and the context's number for each gram."""
    context = grams >> np.uint64(8)
    new = np.ones(len(grams), bool)
    new[1:] = context[1:] != context[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def shared_backoff(grams: np.ndarray, order: int) -> np.ndarray:
    """Kneser-Ney probabilities of the last letters after contexts shorter by one than `order`, from the different grams of both classes."""
    levels, inverse, g, count = [], [], grams, np.ones(len(grams), np.int64)
    for k in range(order - 1, 0, -1):
        g, back = np.unique(g & np.uint64((1 << 8 * k) - 1), return_inverse=True)
        count = np.bincount(back, minlength=len(g))  # types of the order above
        levels.append((g, count))
        inverse.append(back)
    p = np.full(1, 1 / 256)
    back = np.zeros(len(levels[-1][0]), np.int64) if levels else np.zeros(0, np.int64)
    for (g, count), up in zip(reversed(levels), reversed(inverse), strict=True):
        first, of = _prefix_runs(g)
        total, types = np.add.reduceat(count, first), np.diff(np.append(first, len(g)))
        p = (np.maximum(count - DISCOUNT, 0) + DISCOUNT * types[of] * p[back]) / total[of]
        back = up
    return p[back]


def ratios(grams: np.ndarray, counts: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For rising grams and their counts (ordinary, toxic): each gram's log-likelihood ratio, and the ratio of the backoff weights of each of their contexts."""
    first, of = _prefix_runs(grams)
    weight, p = [], []
    seen = counts.sum(axis=0) > 0
    low = np.ones(len(grams))
    if seen.any():
        low[seen] = shared_backoff(grams[seen], order)
    for c in counts:
        total, types = np.add.reduceat(c, first), np.add.reduceat((c > 0).astype(np.int64), first)
        weight.append(np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0))
        p.append(np.maximum(c - DISCOUNT, 0) / np.maximum(total, 1)[of] + weight[-1][of] * low)
    return np.log(p[1] / p[0]), np.log(weight[1] / weight[0])


class Ratios:
    """Log-likelihood ratios of words under some pairs of models (columns)."""

    def __init__(self, grams: np.ndarray, by_gram: np.ndarray, by_context: np.ndarray):
        self.grams, self.by_gram, self.by_context = grams, by_gram, by_context
        self.contexts = (grams >> np.uint64(8))[_prefix_runs(grams)[0]] if len(grams) else grams

    def words(self, w: Words, column: int) -> np.ndarray:
        """The ratio of each word; equal words are looked up once."""
        _, at, same = np.unique(w.hashes(), return_index=True, return_inverse=True)
        gram, size = word_grams(w, at)
        value = np.zeros(len(gram))
        if len(gram) and len(self.grams):
            spot = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
            known = self.grams[spot] == gram
            value[known] = self.by_gram[spot[known], column]
            context = gram[~known] >> np.uint64(8)
            spot = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            value[~known] = np.where(self.contexts[spot] == context, self.by_context[spot, column], 0.0)
        return np.add.reduceat(value, np.cumsum(size) - size)[same] if len(at) else np.zeros(0)


def features(w: Words, ratio: np.ndarray) -> np.ndarray:
    """For each text the mean ratio of a word, that of its most toxic words, and the logarithm of its length; zeros without words."""
    n = w.hi - w.lo
    out, counts = np.zeros((n, 2 + len(_TOPS))), w.counts
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    order = np.lexsort((-ratio, w.owner))
    ranked = np.cumsum(ratio[order])
    before = np.where(w.off[full] > 0, ranked[w.off[full] - 1], 0.0)
    for j, k in enumerate((*_TOPS, None)):
        take = counts[full] if k is None else np.minimum(k, counts[full])
        out[full, j] = (ranked[w.off[full] + take - 1] - before) / take
    out[full, -1] = np.log1p(counts[full])
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Coefficients, the constant last, of a weighted logistic regression with a small ridge (Newton's method, halved steps)."""
    z = np.c_[x, np.ones(len(x))]
    scale = np.append(np.maximum(x.std(axis=0), 1e-9), 1.0)
    z, b = z / scale, np.zeros(z.shape[1])

    def loss(b: np.ndarray) -> float:
        s = z @ b
        return float((weight * (np.logaddexp(0, s) - y * s)).sum() + ridge / 2 * b @ b)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -500, 500)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(b)), z.T @ (weight * (p - y)) + ridge * b)
        size = 1.0
        while size > 1e-4 and loss(b - size * step) > loss(b):
            size /= 2
        b = b - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return b / scale


class Model:
    """Ratios of words, the logistic coefficients, and the score of texts without a word or without what to compare."""

    def __init__(self, ratio: Ratios, coefficients: np.ndarray | None, prior: float):
        self.ratio, self.coefficients, self.prior = ratio, coefficients, prior

    def scores(self, w: Words) -> np.ndarray:
        if self.coefficients is None:
            return np.full(w.hi - w.lo, self.prior)
        x = features(w, self.ratio.words(w, -1))
        s = 1 / (1 + np.exp(-np.clip(x @ self.coefficients[:-1] + self.coefficients[-1], -500, 500)))
        return np.where(w.counts > 0, s, self.prior)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_bytes: int = TRAIN_BYTES) -> Model:
    """A model from the labelled rows of docs: label 1 is toxic, any other is ordinary.

    Null ids, labels and texts without bytes teach nothing; rows of one id, text
    and label count once; a text labelled both ways counts for both. Without any
    label every score is 0, with labels of one class it is that class. About
    train_bytes of text of each class are taken at most, by a hash of id and
    text, so that neither one id nor one text is a sample; n-grams are counted on
    executors, and what reaches the driver is bounded by train_bytes.
    """
    unit = F.xxhash64(id_col, text_col)
    rows = docs.filter(F.col(id_col).isNotNull() & (F.octet_length(text_col) > 0)).select(F.col(id_col).alias("i"), unit.alias("u"), F.octet_length(text_col).cast("long").alias("b"))
    said = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("i"), (F.col(label_col) == 1).cast("int").alias("y")).distinct()
    units = keep(rows.join(said, "i").groupBy("u", "y").agg(F.max("b").alias("b")), "labelled")
    sizes = {r.y: r for r in units.groupBy("y").agg(F.sum("b").alias("b"), F.count("*").alias("n")).collect()}
    everything = sum(r.n for r in sizes.values())
    prior = sizes[1].n / everything if 1 in sizes else 0.0
    if len(sizes) < 2:
        return Model(Ratios(*_no_grams()), None, prior)
    rate = {y: min(1.0, train_bytes / r.b) for y, r in sizes.items()}
    share = F.when(F.col("y") == 1, F.lit(rate[1])).otherwise(F.lit(rate[0]))
    picked = units.filter(F.pmod(F.xxhash64("u", F.lit(7)), F.lit(1 << 30)) < share * (1 << 30)).select("u", "y")
    texts = docs.filter(F.col(id_col).isNotNull() & (F.octet_length(text_col) > 0)).select(unit.alias("u"), F.col(text_col).alias("t"))
    # one row of 12 bytes for at least one byte of the sampled text
    sample = keep(texts.join(F.broadcast(picked), "u").groupBy("u", "y").agg(F.first("t").alias("t")), "sampled").select("t", F.pmod(F.xxhash64("t"), F.lit(FOLDS)).cast("int").alias("f"), "y")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = (b.column(1).to_numpy(zero_copy_only=False) * 2 + b.column(2).to_numpy(zero_copy_only=False)).astype(np.int64)
            for w in word_tables(b.column(0), ALNUM, lower=True):
                group = kind[w.lo : w.hi][w.owner]
                for k in np.unique(group):
                    gram, _ = word_grams(w, np.flatnonzero(group == k))
                    g, n = np.unique(gram, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"g": pa.array(g.view(np.int64)), "k": pa.array(np.full(len(g), k, np.int32)), "n": pa.array(n.astype(np.int64))})

    held = sample.mapInArrow(counted, "g long, k int, n long").groupBy("g", "k").agg(F.sum("n").cast("int").alias("n")).toArrow()  # grams of the sample
    grams, at = np.unique(held["g"].to_numpy().view(np.uint64), return_inverse=True)
    counts = np.zeros((FOLDS, 2, len(grams)), np.int32)
    kind = held["k"].to_numpy()
    counts[kind // 2, kind % 2, at] = held["n"].to_numpy()
    del held, at, kind
    whole = counts.sum(axis=0)
    by_gram, by_context = zip(*[ratios(grams, whole - counts[f]) for f in range(FOLDS)], ratios(grams, whole), strict=True)
    judge = Ratios(grams, np.stack(by_gram, axis=1).astype(np.float32), np.stack(by_context, axis=1).astype(np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(judge)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold, label = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for w in word_tables(b.column(0), ALNUM, lower=True):
                every = np.stack([features(w, shared.value.words(w, f)) for f in range(FOLDS)])
                x = every[fold[w.lo : w.hi], np.arange(w.hi - w.lo)]
                full = w.counts > 0
                yield pa.RecordBatch.from_pydict({"x": pa.array(list(x[full]), pa.list_(pa.float64())), "y": pa.array(label[w.lo : w.hi][full].astype(np.int32))})

    seen = sample.mapInArrow(judged, "x array<double>, y int").toArrow()  # a row of six numbers for each document of the sample
    shared.unpersist()
    x, y = np.array(seen["x"].combine_chunks().flatten()).reshape(-1, 2 + len(_TOPS)), seen["y"].to_numpy().astype(np.float64)
    ratio = Ratios(grams, judge.by_gram[:, -1:], judge.by_context[:, -1:])
    if not len(x) or y.min() == y.max():
        return Model(ratio, None, prior)
    return Model(ratio, logistic(x, y, np.where(y == 1, 1 / rate[1], 1 / rate[0])), prior)


def _no_grams() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(0, np.uint64), np.zeros((0, 1), np.float32), np.zeros((0, 1), np.float32)


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", score_name: str = "score") -> DataFrame:
    """docs with a score between 0 and 1, higher for likelier toxic, from the text alone.

    Narrow, with no shuffle. Null and empty texts and those without a letter or
    digit get the share of toxic labels; a very long text is judged by all its
    words; rows of repeated or null ids are judged each; an empty table gives an
    empty result; other columns stay. A column of the score's name is an error.
    """
    if score_name.casefold() in {c.casefold() for c in docs.columns}:
        raise ValueError(f"docs has a column {score_name}: name the new one otherwise")
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in word_tables(b.column(at), ALNUM, lower=True):
                yield pa.RecordBatch.from_arrays([*b.slice(w.lo, w.hi - w.lo).columns, pa.array(held.value.scores(w))], names=names)

    return map_rows(docs, run, StructType([*docs.schema.fields, StructField(score_name, DoubleType())]))
