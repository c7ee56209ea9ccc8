"""Scoring texts with a Brown class-based bigram model.

Exchange clustering assigns words to classes so that the mutual information of
adjacent classes grows. The SEED most frequent words are exchanged until they
settle; all others are inserted, the most frequent first, each into the class of
the greatest gain, in rounds of GROWTH times as many words. The words of a round
are decided on executors from their counts with classes; words without a class
yet count as one open class. The end of a text has a class of its own. A text's
probability is the product of class transitions and word emissions.

All counts cover all training texts. Only tables of bounded size reach the
driver or are broadcast: the HELD_WORDS most frequent words, the bigrams of the
SEED most frequent, the transitions of classes. All other words are inserted by
the same rounds, but their neighbours and classes stay in distributed tables,
which meet the rare tokens of the texts in joins: how many words are broadcast
changes no class. Words are told apart by 64-bit hashes: among a
thousand million different words one pair is expected to collide with 3 in 100.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from prismfeed.llm._tables import keep
from prismfeed.llm._words import Words, word_tables

HELD_WORDS, SEED, CLASSES, SWEEPS = 1 << 18, 1024, 64, 4
#: How many times as many words have a class after each round of insertions.
GROWTH = 4
#: Weight of the class distribution in each transition distribution.
PULL = 5.0
#: Distinct words that a task gathers before it hands them on.
_GATHER = 1 << 20
#: Words that are decided in one group.
_DECIDED = 4096
#: The hash that stands for the end of a text.
END = np.uint64(0)


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an END after each text's words, and where each text's tokens begin."""
    n = w.hi - w.lo
    begin = w.off + np.arange(n + 1)
    out = np.full(int(begin[-1]), END)
    body = np.ones(len(out), bool)
    body[begin[1:] - 1] = False
    h = w.hashes()
    out[body] = np.where(h == END, np.uint64(1), h)
    return out, begin


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of all parts, sorted, and the sums of their counts; empties the list, so that no part is held beside its copy."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    del order
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first)


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (h, c) for every distinct token of all texts; counts are merged in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        parts, size = [none], 0
        for b in batches:
            for w in word_tables(b.column(0), lower=True):
                parts.append(np.unique(tokens(w)[0], return_counts=True))
                size += len(parts[-1][0])
                if size > _GATHER:
                    keys, counts = _summed(parts)
                    size = 0
                    if len(keys) > _GATHER:
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["h", "c"])
                        keys, counts = none
                    parts = [(keys, counts)]
                    del keys, counts
        keys, counts = _summed(parts)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["h", "c"])

    return df.select(text_col).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _unpacked(df: DataFrame) -> np.ndarray:
    """The pairs of longs whose bytes are the rows of df: they reach the driver without a Python object for each value."""
    return np.concatenate([np.zeros((2, 0), np.int64), *(np.frombuffer(r.b, np.int64).reshape(2, -1) for r in df.collect())], axis=1)


def _arrays(df: DataFrame) -> np.ndarray:
    """The two long columns of df, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.stack([c.to_numpy() for c in b.columns]).tobytes()], pa.binary())], names=["b"])

    return _unpacked(df.mapInArrow(run, "b binary"))


def _from(counts: DataFrame, sizes: list[Row], rank: int) -> Column:
    """Whether a word of counts comes at this rank, from 0, or later: words are in order of falling counts, equal ones of hashes.

    sizes: (c, n), a row for each count. The hash at the cut is found by a histogram and the words of one of its bins.
    """
    seen = 0
    for r in sorted(sizes, key=lambda r: -r.c):
        if seen + r.n > rank:
            break
        seen += r.n
    less, place = F.col("c") < r.c, rank - seen
    order = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))  # signed, in the order of the unsigned hashes
    if not place:
        return less | (F.col("c") == r.c)
    equal, cut = counts.filter(F.col("c") == r.c).select(order.alias("u")).withColumn("bin", F.shiftright("u", 52)), 0
    for x in sorted(equal.groupBy("bin").agg(F.count("*").alias("n")).collect()):
        if x.n > place:
            some, _ = _arrays(equal.filter(F.col("bin") == x.bin).select("u", "bin"))
            cut = int(np.sort(some)[place])
            break
        place -= x.n
    return less | ((F.col("c") == r.c) & (order >= F.lit(cut)))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Classes of words 0..n-1 from their bigram counts (n, n): each word moves to the class that raises the bigram likelihood most."""
    n = len(bigrams)
    classes = max(1, min(classes, n))
    of = np.arange(n) % classes
    if n <= 1 or classes == 1:
        return of
    big = bigrams.astype(np.float64)
    one = np.eye(classes)[of]
    right, left = big @ one, big.T @ one  # (n, classes): successors and predecessors of each word by class
    table = one.T @ right
    xlogx = lambda x: x * np.log(np.maximum(x, 1.0))
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            c, own = of[w], big[w, w]
            out, into = right[w].copy(), left[w].copy()
            out[c] -= own
            into[c] -= own
            table[c] -= out
            table[:, c] -= into
            table[c, c] -= own
            rows, cols = table + out[None, :], table + into[:, None]
            gain = (xlogx(rows) - xlogx(table)).sum(axis=1) + (xlogx(cols) - xlogx(table)).sum(axis=0)
            cell = table.diagonal()
            gain += xlogx(cell + out + into + own) - xlogx(cell + out) - xlogx(cell + into) + xlogx(cell)
            sum_row, sum_col = table.sum(axis=1), table.sum(axis=0)
            gain -= xlogx(sum_row + out.sum() + own) - xlogx(sum_row) + xlogx(sum_col + into.sum() + own) - xlogx(sum_col)
            best = int(np.argmax(gain))
            if gain[best] <= gain[c] + 1e-9:
                best = c
            table[best] += out
            table[:, best] += into
            table[best, best] += own
            if best != c:
                moved += 1
                of[w] = best
                for x, by in ((right, big[:, w]), (left, big[w])):
                    x[:, c] -= by
                    x[:, best] += by
        if not moved:
            break
    return of


@dataclass
class ClassModel:
    """What scoring needs of the training texts; `words` is the distributed table of the words outside head."""

    total: int
    distinct: int
    head: np.ndarray  # hashes of the frequent words, sorted
    head_count: np.ndarray
    head_class: np.ndarray
    rest_class: int  # of words without a class, unseen ones as well
    log_step: np.ndarray  # (classes, classes) log10 of transitions
    log_emit: np.ndarray  # log10 emission of each head word
    class_size: np.ndarray  # counts of the words of each class
    rest_size: int  # counts of words without a class, and one for each of them and for unseen words
    end_class: int
    words: DataFrame  # (h, c, k, e): hash, count, class, log10 emission


def _ranked(df: DataFrame, text_col: str, place: np.ndarray, rank: np.ndarray) -> DataFrame:
    """Rows (r, t): the int32 ranks of all tokens of some whole texts, each text ended by END; len(place) for words outside place, whose hashes are t."""
    held = df.sparkSession.sparkContext.broadcast((place, rank.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rank = held.value
        for b in batches:
            for w in word_tables(b.column(0), lower=True):
                h = tokens(w)[0]
                r = named(h, place, rank, len(place)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (r, h[r == len(place)])], names=["r", "t"])

    out = keep(df.select(text_col).mapInArrow(run, "r binary, t binary"), "lm-ranks")
    held.unpersist()
    return out


def _bigrams(ranked: DataFrame, names: np.ndarray, n: int, end: int) -> np.ndarray:
    """How often names a and b in 0..n-1 follow each other, by the name of each rank; -1 takes no part. A text begins with END, named `end`."""
    held = ranked.sparkSession.sparkContext.broadcast(names.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = held.value
        total = np.zeros(n * n, np.int64)
        for b in batches:
            for r in b.column(0):
                now = names[np.frombuffer(r.as_py(), np.int32)].astype(np.int64)
                before = np.concatenate([[end], now[:-1]])
                ok = (now >= 0) & (before >= 0)
                keys, counts = np.unique(before[ok] * n + now[ok], return_counts=True) if n > 256 else (slice(None), np.bincount(before[ok] * n + now[ok], minlength=n * n))
                total[keys] += counts
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["p", "c"])

    out = np.zeros(n * n, np.int64)
    place, count = _arrays(ranked.mapInArrow(run, "p long, c long").groupBy("p").agg(F.sum("c").alias("c")))  # at most n * n rows
    out[place] = count
    return out.reshape(n, n)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def best_classes(table: np.ndarray, into: np.ndarray, out: np.ndarray, own: np.ndarray, classes: int) -> np.ndarray:
    """The class 0..classes-1 that each word raises the bigram likelihood most in, the first among equals.

    table (k, k): class bigrams, the last class is the open one, which holds the
    words until now; into, out (words, k): counts after and before each class,
    without the word itself; own: counts of the word after itself.
    """
    table, c, open_ = table.astype(np.float64), np.arange(classes), len(table) - 1
    gain = np.zeros((len(own), classes))
    for counts, cells in ((out, table[:classes]), (into, table[:, :classes].T)):
        word, j = np.nonzero(counts[:, :open_])
        by = counts[word, j].astype(np.float64)
        for lo in range(0, len(word), 1 << 14):
            some = slice(lo, lo + (1 << 14))
            old = cells[:, j[some]].T
            more = _xlogx(old + by[some, None]) - _xlogx(old)
            first = np.flatnonzero(np.diff(word[some], prepend=-1))
            gain[word[some][first]] += np.add.reduceat(more, first, axis=0)
    for counts, back, cells in ((out, into, table[c, open_]), (into, out, table[open_, c])):
        old = cells[None, :] - back[:, c]  # the word has left the open class
        gain += _xlogx(old + counts[:, open_, None]) - _xlogx(old)
    cell, o, i, w = table[c, c][None, :], out[:, c], into[:, c], own[:, None]
    gain += _xlogx(cell + o + i + w) - _xlogx(cell + o) - _xlogx(cell + i) + _xlogx(cell)
    rows, cols = table[c].sum(axis=1)[None, :], table[:, c].sum(axis=0)[None, :]
    gain -= _xlogx(rows + out.sum(axis=1)[:, None] + w) - _xlogx(rows) + _xlogx(cols + into.sum(axis=1)[:, None] + w) - _xlogx(cols)
    return gain.argmax(axis=1)


def _inserted(ranked: DataFrame, names: np.ndarray, lo: int, hi: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks lo..hi-1 without a name yet, and their classes. names: class of each rank, classes for END, classes + 1 for the open ones."""
    sc, k = ranked.sparkSession.sparkContext, classes + 2
    held = sc.broadcast(names.astype(np.int16))
    table = sc.broadcast(_bigrams(ranked, names, k, classes))
    span = 2 * k + 1  # columns of a word: classes before it, after it, itself

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = held.value
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts, size = [none], 0
        for b in batches:
            for r in b.column(0):
                now = np.frombuffer(r.as_py(), np.int32).astype(np.int64)
                name = names[now].astype(np.int64)
                fresh = (now >= lo) & (now < hi) & (name == classes + 1)
                at = np.flatnonzero(fresh)  # never the last token, which is END
                same = np.zeros(len(now), bool)
                same[1:] = now[1:] == now[:-1]
                before = np.where(at > 0, name[at - 1], classes)
                after = at[at + 1 < len(now)]
                left = at[~same[at]]
                right = after[~same[after + 1]]
                key = np.concatenate([(now[left] - lo) * span + before[~same[at]], (now[right] - lo) * span + k + name[right + 1], (now[at[same[at]]] - lo) * span + 2 * k])
                parts.append(np.unique(key, return_counts=True))
                size += len(parts[-1][0])
                if size > _GATHER:
                    keys, counts = _summed(parts)
                    size = 0
                    if len(keys) > _GATHER:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["p", "n"])
                        keys, counts = none
                    parts = [(keys, counts)]
                    del keys, counts
        keys, counts = _summed(parts)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["p", "n"])

    def decide(t: pa.Table) -> pa.Table:
        p = t.column("p").to_numpy()
        w, at = np.unique(p // span, return_inverse=True)
        full = np.zeros((len(w), span))
        full[at, p % span] = t.column("n").to_numpy()
        of = best_classes(table.value, full[:, :k], full[:, k : 2 * k], full[:, 2 * k], classes)
        return pa.table({"b": pa.array([np.stack([w, of]).tobytes()], pa.binary())})  # packed here: another pass would double the Python workers

    # words go to groups by rank modulo their number, so that frequent words don't gather in one; one shuffle serves the sums and the groups
    group = F.pmod(F.floor(F.col("p") / span), F.lit(max(64, (hi - lo) // _DECIDED)))
    counted = ranked.mapInArrow(count, "p long, n long").withColumn("g", group).repartition("g")
    summed = counted.groupBy("g", "p").agg(F.sum("n").alias("n"))
    words, of = _unpacked(summed.groupBy("g").applyInArrow(decide, "b binary"))  # hi - lo rows
    held.unpersist()
    table.unpersist()
    return words + lo, of


def _neighbours(ranked: DataFrame, names: np.ndarray, classes: int) -> DataFrame:
    """Rows (h, x, y, a, b), one for each token of a word h outside the head: the columns, as in `_inserted`, of the tokens before and after it.

    names: class of each rank, as there. A word after itself is told by x alone, y is -1 before it.
    a, b: the words before and after, where they are other ones from outside the head, which are open in x and y.
    """
    held, k = ranked.sparkSession.sparkContext.broadcast(names.astype(np.int16)), classes + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = held.value
        for b in batches:
            for r, t in zip(*b.columns, strict=True):
                now, h = np.frombuffer(r.as_py(), np.int32), np.frombuffer(t.as_py(), np.int64)
                name, at = names[now].astype(np.int32), np.flatnonzero(now == len(names) - 1)  # never the last token, which is END
                follows = np.zeros(len(at) + 1, bool)  # whether the word before is from outside, too
                follows[1:-1] = np.diff(at) == 1
                same = follows.copy()
                same[1:-1] &= h[1:] == h[:-1]
                x = np.where(same[:-1], 2 * k, np.where(at > 0, name[at - 1], classes)).astype(np.int32)
                y = np.where(same[1:], -1, k + name[at + 1]).astype(np.int32)
                other = follows & ~same
                outside = pa.array(np.roll(h, 1), mask=~other[:-1]), pa.array(np.roll(h, -1), mask=~other[1:])
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(x), pa.array(y), *outside], names=["h", "x", "y", "a", "b"])

    return ranked.mapInArrow(run, "h long, x int, y int, a long, b long")


def _cells(packed: DataFrame, n: int) -> np.ndarray:
    """The sums of the cells 0..n-1, whose pairs of places and counts are packed in the rows of a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            for r in b.column(0):
                place, count = np.frombuffer(r.as_py(), np.int64).reshape(2, -1)
                total[place] += count
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["p", "c"])

    out = np.zeros(n, np.int64)
    place, count = _arrays(packed.mapInArrow(run, "p long, c long").groupBy("p").agg(F.sum("c").alias("c")))  # at most n rows
    out[place] = count
    return out


def _insert_rest(ranked: DataFrame, names: np.ndarray, later: list[Column], rounds: list[int], classes: int) -> tuple[DataFrame, np.ndarray]:
    """Counts and classes (h, c, k) of the words outside the head, and the class bigrams of all tokens.

    The words of round i, rounds[i] in number, are inserted once those of the rounds before
    have their classes, words beyond the last round stay open. later[i]: whether a word (h, c)
    comes after round i. names: class of each rank.
    """
    sc, k = ranked.sparkSession.sparkContext, classes + 2
    span, open_ = 2 * k + 1, classes + 1
    start = _bigrams(ranked.select("r"), names, k, classes)  # with all words outside the head open
    near = _neighbours(ranked, names, classes).withColumn("c", F.count("*").over(Window.partitionBy("h")))  # left out of the plan where one round takes all
    near = keep(near.select("h", "x", "y", "a", "b", sum((x.cast("int") for x in later), F.lit(0)).alias("round")), "lm-neighbours")
    pairs = near.filter("a IS NOT NULL").select("a", "h")
    placed = near.filter(F.lit(False)).select("h", F.lit(0).cast("long").alias("c"), F.lit(0).alias("k"), F.lit(b"").alias("b"))

    def class_of(word: str, name: str) -> DataFrame:
        return placed.select(F.col("h").alias(word), F.col("k").alias(name))

    def bigrams() -> np.ndarray:
        """The class bigrams: what placed words have beside the head is summed by class where they are placed, pairs from outside meet their classes."""
        out = start.copy()
        for at, n in enumerate(_cells(placed.filter("b IS NOT NULL").select("b"), classes * span)):
            i, p = divmod(at, span)
            new, old = ((p, i), (p, open_)) if p < k else ((i, p - k), (open_, p - k)) if p < 2 * k else ((i, i), (open_, open_))
            out[new] += n
            out[old] -= n
        both = pairs.join(class_of("a", "i"), "a", "left").join(class_of("h", "j"), "h", "left")
        for r in both.groupBy(*(F.coalesce(x, F.lit(open_)).alias(x) for x in "ij")).agg(F.count("*").alias("n")).collect():  # at most k * k rows
            out[r.i, r.j] += r.n
            out[open_, open_] -= r.n
        return out

    def decider(table: Broadcast) -> Callable[[pa.Table], pa.Table]:
        def decide(t: pa.Table) -> pa.Table:
            x, y, alone, ends = (t.column(c).to_numpy() for c in ("x", "y", "alone", "ends"))
            w, at = np.unique(t.column("h").to_numpy(), return_inverse=True)
            column = lambda row, left, right: np.concatenate([(row * span + x)[left], (row * span + y)[right]])
            full = np.bincount(column(at, slice(None), y >= 0), minlength=len(w) * span).reshape(-1, span).astype(np.float64)
            of = best_classes(table.value, full[:, :k], full[:, k : 2 * k], full[:, 2 * k], classes)
            cells = np.stack(np.unique(column(of[at], alone, ends & (y >= 0)), return_counts=True))
            packed = pa.array([cells.tobytes(), *[None] * (len(w) - 1)], pa.binary())
            return pa.table({"h": w, "c": np.bincount(at), "k": pa.array(of, pa.int32()), "b": packed})

        return decide

    for i, size in enumerate(rounds):
        table = sc.broadcast(bigrams() if i else start)
        fresh, beside = near.filter(F.col("round") == i), F.expr("a IS NOT NULL OR b IS NOT NULL")
        seen = fresh.withColumn("i", F.lit(None).cast("int")).withColumn("j", F.col("i"))
        if i:  # words of this round have no class yet: their own hash stands for a neighbour in the head, as nulls would meet in one task
            met = fresh.filter(beside).withColumn("l", F.coalesce("a", "h")).withColumn("r", F.coalesce("b", "h"))
            met = met.join(class_of("l", "i"), "l", "left").join(class_of("r", "j"), "r", "left")
            seen = seen.filter(~beside).union(met.select(seen.columns))
        group = F.pmod("h", F.lit(max(64, size // _DECIDED))).alias("g")
        seen = seen.select(group, "h", F.coalesce("i", "x").alias("x"), F.coalesce(F.col("j") + k, "y").alias("y"), F.col("a").isNull().alias("alone"), F.col("b").isNull().alias("ends"))
        placed = placed.union(keep(seen.groupBy("g").applyInArrow(decider(table), "h long, c long, k int, b binary"), "lm-classes"))
    return placed.select("h", "c", "k"), bigrams()


def named(h: np.ndarray, place: np.ndarray, names: np.ndarray, other: int) -> np.ndarray:
    if not len(place):
        return np.full(len(h), other, np.int64)
    at = np.searchsorted(place, h)
    at[at == len(place)] = 0
    return np.where(place[at] == h, names[at], other)


def fit(
    training: DataFrame, text_col: str = "text", head_words: int | None = None, clustered: int = SEED, classes: int = CLASSES, sweeps: int = SWEEPS, held_words: int = HELD_WORDS
) -> ClassModel:
    """Count, cluster and smooth; `clustered` words are exchanged in sweeps, all others inserted. Reads the training texts twice and
    then keeps the ranks of their tokens; nothing unbounded leaves the executors. Every word has a class unless head_words says how
    many of the most frequent ones shall have one; held_words bounds what is broadcast and changes no class."""
    counts = keep(word_counts(training, text_col), "lm-counts")
    sizes = counts.groupBy("c").agg(F.count("*").alias("n")).collect()  # distinct counts: about the root of the corpus size
    total, distinct = sum(r.c * r.n for r in sizes), sum(r.n for r in sizes)
    limit = distinct if head_words is None else min(head_words, distinct)
    seed = size = min(clustered, limit)
    while size < min(limit, held_words) and (size * GROWTH <= held_words or limit <= held_words):
        size = min(limit, size * GROWTH)  # the head ends where a round ends
    cuts = [size]
    while cuts[-1] < limit:
        cuts.append(min(limit, cuts[-1] * GROWTH))
    beyond = [_from(counts, sizes, x) if x < distinct else F.lit(False) for x in cuts]
    outside = beyond[0] & (F.col("h") != int(END))
    head, c = _arrays(counts.filter(~outside).select("h", "c"))
    head = head.view(np.uint64)
    order = np.argsort(head)
    head, c = head[order], c[order]
    held = len(head)  # size, and one if the end of a text is rarer
    rank = np.empty(held, np.int64)
    rank[np.lexsort((head, -c))] = np.arange(held)
    end = named(np.array([END]), head, rank, -1)[0]
    at = np.full(held + 1, classes + 1)  # by rank, words outside the head last
    bigrams, words = np.zeros((classes + 2, classes + 2), np.int64), counts.filter(F.lit(False)).select("h", "c", F.lit(0).alias("k"))
    if held:
        ranked = _ranked(training, text_col, head, rank)
        names = np.append(np.arange(held), -1)
        names[seed:] = -1
        at[:seed] = exchange(_bigrams(ranked.select("r"), names, seed, int(end) if end < seed else -1), classes, sweeps)
        at[end] = classes
        lo = seed
        while lo < size:
            hi = min(size, lo * GROWTH)
            some, of = _inserted(ranked.select("r"), at, lo, hi, classes)
            at[some] = of
            lo = hi
        if held < distinct:
            placed, bigrams = _insert_rest(ranked, at, beyond[1:], np.diff(cuts).tolist(), classes)
            words = placed.union(counts.filter(outside & beyond[-1]).select("h", "c", F.lit(None).cast("int")))
        else:
            bigrams = _bigrams(ranked.select("r"), at, classes + 2, classes)
    more = words.groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()  # a row for each class
    free = sum(r.c + r.n for r in more if r.k is None)
    used = np.unique([*at[at < classes], *(r.k for r in more if r.k is not None)]).astype(np.int64)
    kept = np.concatenate([used, [classes + 1, classes]])
    n = len(kept)
    rest, end_class, place = n - 2, n - 1, np.zeros(classes + 2, np.int64)
    place[kept] = np.arange(n)
    klass, steps = place[at[:held]][rank], bigrams[np.ix_(kept, kept)]
    unigram = (steps.sum(axis=0) + 1.0) / (steps.sum() + n)
    log_step = np.log10((steps + PULL * unigram) / (steps.sum(axis=1, keepdims=True) + PULL))
    of_class = np.bincount(klass, c, n)
    for r in more:
        of_class[rest if r.k is None else place[r.k]] += r.c
    rest_size = int(free + 1)
    known = training.sparkSession.createDataFrame(pa.table({"k": used, "j": place[used], "size": of_class[place[used]].astype(np.float64)}))
    emit = F.log10(F.when(F.col("k").isNull(), (F.col("c") + 1.0) / rest_size).otherwise(F.col("c") / F.col("size")))
    words = words.join(F.broadcast(known), "k", "left").select("h", "c", F.coalesce("j", F.lit(rest)).alias("k"), emit.alias("e"))
    return ClassModel(total, distinct, head, c, klass, rest, log_step, np.log10(c / np.maximum(of_class[klass], 1)), of_class, rest_size, end_class, words)


def score_texts(df: DataFrame, model: ClassModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, n_known, train_tokens, base_score, score), one for every row of df.

    base_score is the add-one unigram and score the class model's log10
    probability of the text. A null or empty text has the end token only; with
    nothing to learn from, every token is unseen. Rows are told apart by a number
    of their own, so repeated and null ids are kept. The tokens outside the head,
    with the classes beside them, and the bigrams of two such tokens are summed per
    row before and after they meet the table of words. A very long text is scored
    whole; an empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    held = spark.sparkContext.broadcast((model.head, model.head_count, model.head_class.astype(np.int16), model.log_step, model.class_size))
    floor, rest, end_class = model.total + model.distinct + 1, model.rest_class, model.end_class
    other = -1 if len(model.head) < model.distinct else rest  # the class of tokens outside the head, where it is known

    def lists(text: np.ndarray, n: int, **columns: np.ndarray) -> pa.Array:
        """For each of the texts 0..n-1, its different values of the columns and how often they come."""
        key, count = np.unique(np.stack([text, *columns.values()]), axis=1, return_counts=True) if len(text) else (np.zeros((1 + len(columns), 0), np.int64), text)
        values = pa.StructArray.from_arrays([pa.array(x) for x in (*key[1:], count)], names=[*columns, "n"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(key[0], np.arange(n + 1)).astype(np.int32)), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, count, klass, step, of_class = held.value
        spots = np.arange(len(head), dtype=np.int32)
        for b in batches:
            for w in word_tables(b.column(1), lower=True):
                h, begin = tokens(w)
                at = named(h, head, spots, -1)
                known = at >= 0
                c = np.full(len(h), other, np.int64)
                c[known] = klass[at[known]]
                before, after = np.empty_like(c), np.empty_like(c)
                before[1:], after[:-1] = c[:-1], c[1:]
                before[begin[:-1]], after[begin[1:] - 1] = end_class, -1
                base, score = np.zeros(len(h)), np.zeros(len(h))
                met = (before >= 0) & (c >= 0)
                score[met] = step[before[met], c[met]]
                held_count = count[at[known]]
                base[known] = np.log10((held_count + 1.0) / floor)
                score[known] += np.log10(held_count / of_class[c[known]])
                sums = [np.add.reduceat(x, begin[:-1]) for x in (known.astype(np.int64), base, score)]
                n, s = w.hi - w.lo, h.view(np.int64)
                text = np.repeat(np.arange(n), np.diff(begin))
                beside = (~known) & (c < 0)
                rare = lists(text[~known], n, h=s[~known], x=np.where(beside, before, -1)[~known], y=np.where(beside, after, -1)[~known])
                two = np.flatnonzero(beside & (before < 0))
                pairs = lists(text[two], n, a=s[two - 1], b=s[two])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(w.lo, n), pa.array(np.diff(begin)), *map(pa.array, sums), rare, pairs], names=["id", "n_tokens", "n_known", "base", "score", "rare", "pairs"])

    shape = f"id {kind}, n_tokens long, n_known long, base double, score double, rare array<struct<h:long,x:long,y:long,n:long>>, pairs array<struct<a:long,b:long,n:long>>"
    rows = keep(df.select(id_col, text_col).mapInArrow(run, shape).withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    size = len(model.log_step)
    steps = F.broadcast(spark.createDataFrame(pa.table({"i": np.repeat(np.arange(size), size), "j": np.tile(np.arange(size), size), "step": model.log_step.ravel()})))
    count, unseen = F.coalesce("c", F.lit(0)), F.lit(-float(np.log10(model.rest_size)))

    def stepped(df: DataFrame, i: str, j: str, name: str) -> DataFrame:
        return df.join(steps.select(F.col("i").alias(i), F.col("j").alias(j), F.col("step").alias(name)), [i, j], "left")

    met = rows.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(model.words, "h", "left").withColumn("k", F.coalesce("k", F.lit(rest)))
    met = stepped(stepped(met, "x", "k", "into"), "k", "y", "out")
    zero = F.lit(0.0)
    score = F.coalesce("e", unseen) + F.coalesce("into", zero) + F.coalesce("out", zero)
    met = met.select("row", (F.col("n") * (count > 0).cast("long")).alias("k"), (F.col("n") * F.log10((count + 1.0) / floor)).alias("b"), (F.col("n") * score).alias("s"))
    if other < 0:
        both = rows.select("row", F.explode("pairs").alias("r")).select("row", "r.*")
        for side, name in (("a", "i"), ("b", "j")):
            both = both.join(model.words.select(F.col("h").alias(side), F.col("k").alias(name)), side, "left").withColumn(name, F.coalesce(name, F.lit(rest)))
        met = met.union(both.join(steps, ["i", "j"]).select("row", F.lit(0).cast("long"), zero, F.col("n") * F.col("step")))
    more = met.groupBy("row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    plus = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0))
    return rows.drop("rare", "pairs").join(more, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", plus("n_known", "k").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), plus("base", "b").alias("base_score"), plus("score", "s").alias("score")
    )
