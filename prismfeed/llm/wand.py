"""Ranked lexical search: WAND over document shards.

Documents are reduced to the terms that the queries ask for, with counts; sums
over those lean rows give the corpus statistics. Each task then indexes its
rows in shards of bounded size and answers all queries on each. A term's
largest impact in the shard bounds what it can add to any score. Cursors run
through the lists of a query; those in front are added up, in order of their
next documents, until the sum of their maxima reaches the heap's threshold:
there is the pivot, and no document before it can enter the heap. From the
pivot on, a window of documents is judged at once: those whose present lists'
maxima reach the threshold are scored exactly. A query's heap goes on from shard
to shard, and the heaps of all tasks are merged by rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismfeed.llm._tables import keep
from prismfeed.llm._words import ALNUM, word_tables

#: Postings in a shard, documents that are judged at once, and bytes of query text in one pass.
SHARD_POSTINGS, WINDOW, QUERY_BYTES = 1 << 20, 1024, 8 << 20
#: Parts of a score: unit of the term frequency, its weight against m, and how lengths make m.
UNIT, TF, NORM, LENGTH_SHARE = 1_000_000_000, 1000, 20, 50
_LAST = np.iinfo(np.int64).max


def term_weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def lengths_norm(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents by their lengths, in whole numbers."""
    if len(lengths) and LENGTH_SHARE * int(lengths.max()) * n >= 1 << 63:
        return np.array([100 - LENGTH_SHARE + LENGTH_SHARE * int(x) * n // total for x in lengths], np.int64)
    return 100 - LENGTH_SHARE + LENGTH_SHARE * lengths * n // max(total, 1)


class Shard:
    """An inverted index over some documents: for each term the documents, rising, and their impacts."""

    def __init__(self, ids: np.ndarray, anonymous: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.ids, self.anonymous = ids, anonymous
        order = np.lexsort((doc, term))
        self.doc, self.impact = doc[order], impact[order]
        self.terms, first = np.unique(term[order], return_index=True)
        self.bounds = np.append(first, len(term))
        self.most = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0, np.int64)

    def lists(self, terms: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        at = np.searchsorted(self.terms, terms)
        there = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)] if len(self.terms) else []
        return [(self.doc[self.bounds[k] : self.bounds[k + 1]], self.impact[self.bounds[k] : self.bounds[k + 1]], int(self.most[k])) for k in there if self.most[k] > 0]


class Heap:
    """The k best of the rows offered: highest score, then smallest id, null ids last."""

    def __init__(self, k: int):
        self.k, self.rows = k, (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        self.threshold = 1

    def offer(self, score: np.ndarray, anonymous: np.ndarray, ids: np.ndarray) -> None:
        s, a, i = (np.concatenate([x, y]) for x, y in zip(self.rows, (score, anonymous, ids), strict=True))
        best = np.lexsort((i, a, -s))[: self.k]
        self.rows = s[best], a[best], i[best]
        if len(best) == self.k:
            self.threshold = max(1, int(self.rows[0][-1]))


def wand(shard: Shard, terms: np.ndarray, heap: Heap, window: int = WINDOW) -> int:
    """Offer to the heap each document of the shard that may enter it; returns how many were scored."""
    lists = shard.lists(terms)
    cursor, scored = [0] * len(lists), 0
    front = sorted((int(docs[0]), k) for k, (docs, _, _) in enumerate(lists))
    while front:
        reach, pivot = 0, None
        for d, k in front:
            reach += lists[k][2]
            if reach >= heap.threshold:
                pivot = d
                break
        if pivot is None:
            return scored  # all lists together can't reach the threshold
        end = pivot + window
        bound, score = np.zeros(window, np.int64), np.zeros(window, np.int64)
        moved = []
        for d, k in front:
            docs, impacts, most = lists[k]
            if d < end:
                lo, hi = cursor[k] + np.searchsorted(docs[cursor[k] :], (pivot, end))
                spot = docs[lo:hi] - pivot
                bound[spot] += most
                score[spot] += impacts[lo:hi]
                cursor[k] = int(hi)
            if cursor[k] < len(docs):
                moved.append((int(docs[cursor[k]]), k))
        able = np.flatnonzero(bound >= heap.threshold)
        scored += len(able)
        able = able[score[able] >= heap.threshold]
        if len(able):
            heap.offer(score[able], shard.anonymous[pivot + able], shard.ids[pivot + able])
        front = sorted(moved)
    return scored


def _lean(docs: DataFrame, known: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, counts) of each document with a term: n of all its terms, the rest of those asked for, by place in `known`."""
    held = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for b in batches:
            for w in word_tables(b.column(1), ALNUM, lower=True):
                h, n = w.hashes(), w.hi - w.lo
                at = np.searchsorted(known, h)
                asked = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == h) if len(known) else np.zeros(0, np.int64)
                pair, count = np.unique(w.owner[asked] * np.int64(len(known) + 1) + at[asked], return_counts=True)
                owner, term = pair // (len(known) + 1), (pair % (len(known) + 1)).astype(np.int32)
                off = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
                out = pa.RecordBatch.from_arrays(
                    [b.column(0).slice(w.lo, n), pa.array(w.counts.astype(np.int64)), pa.ListArray.from_arrays(off, pa.array(term)), pa.ListArray.from_arrays(off, pa.array(count.astype(np.int32)))],
                    names=["id", "n", "terms", "counts"],
                )
                yield out.filter(pa.array(w.counts > 0))

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, terms array<int>, counts array<int>")


def _query_terms(part: DataFrame) -> tuple[list, list[np.ndarray]]:
    """Query ids and the hashes of each one's distinct terms; rows of one id are one query."""
    rows = part.collect()  # a slice of bounded bytes
    found: dict = {}
    for w in word_tables(pa.array([r.t for r in rows], pa.string()), ALNUM, lower=True):
        h = w.hashes()
        for d in range(w.hi - w.lo):
            found.setdefault(rows[w.lo + d].i, []).append(h[w.off[d] : w.off[d + 1]])
    return [*found], [np.unique(np.concatenate(v)) for v in found.values()]


def search(
    docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", query_bytes: int = QUERY_BYTES,
    shard_postings: int = SHARD_POSTINGS, window: int = WINDOW,
) -> DataFrame:
    """Rows (query_id, rank, doc_id, score): the k documents of highest score above 0 for each query, equal scores by smaller id.

    Null, empty and blank texts have no terms: they count nowhere and are found
    by nothing, and such queries have no rows. Each document row is a document,
    also one of a repeated id; null ids come last among equals; query rows of one
    id, null too, are one query of all their terms; a very long text is read
    whole; empty tables give an empty result; other columns are not read. Terms
    are told apart by 64-bit hashes: among a thousand million different words
    and ten thousand query terms a mistaken one is expected in 5 of ten million
    runs.

    Queries come in slices of about query_bytes of text; each slice is a pass
    over the documents, with its terms broadcast. A task keeps one shard of about
    shard_postings postings and k rows for each query.
    """
    spark = docs.sparkSession
    kind = queries.schema[query_id].dataType
    sized = queries.select(F.col(query_id).alias("i"), F.col(query_text).alias("t"), F.coalesce(F.octet_length(query_text), F.lit(0)).cast("long").alias("b"))
    slices = (sized.agg(F.sum("b")).first()[0] or 0) // query_bytes + 1
    out = spark.createDataFrame([], f"{query_id} {kind.simpleString()}, rank int, {id_col} long, score long")
    for s in range(slices):
        part = sized if slices == 1 else sized.filter(F.pmod(F.xxhash64("i"), F.lit(slices)) == s)
        names, terms = _query_terms(part.filter("b > 0"))
        known = np.unique(np.concatenate(terms)) if terms else np.zeros(0, np.uint64)
        if not len(known):
            continue
        lean = keep(_lean(docs, known, id_col, text_col), "lean")
        n, total = lean.agg(F.count("*"), F.sum("n")).first()
        if not n:
            continue
        df = np.zeros(len(known), np.int64)
        for r in lean.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # terms of a slice of queries
            df[r.term] = r["count"]
        found = _ranked(lean, n, total, term_weights(n, df), [np.searchsorted(known, t) for t in terms], k, shard_postings, window)
        ids = spark.createDataFrame([(q, i) for q, i in enumerate(names)], f"q int, i {kind.simpleString()}")
        out = out.unionByName(found.join(F.broadcast(ids), "q").select(F.col("i").alias(query_id), "rank", F.col("id").alias(id_col), "score"))
    return out


def _ranked(lean: DataFrame, n: int, total: int, weights: np.ndarray, queries: list[np.ndarray], k: int, shard_postings: int, window: int) -> DataFrame:
    held = lean.sparkSession.sparkContext.broadcast((weights, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = held.value
        heaps = [Heap(k) for _ in queries]
        parts: list[tuple[np.ndarray, ...]] = []
        size = docs = 0

        def answer() -> None:
            ids, anonymous, doc, term, impact = (np.concatenate(x) for x in zip(*parts, strict=True))
            shard = Shard(ids, anonymous, doc, term, impact)
            for q, heap in zip(queries, heaps, strict=True):
                wand(shard, q, heap, window)

        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                tf, term = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 2))
                each = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
                m = np.repeat(lengths_norm(b.column(1).to_numpy(zero_copy_only=False), n, total), each)
                impact = weights[term] * (UNIT * tf // (TF * tf + NORM * m))
                ids = b.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
                parts.append((ids, b.column(0).is_null().to_numpy(zero_copy_only=False), docs + np.repeat(np.arange(b.num_rows), each), term, impact))
                size, docs = size + len(term), docs + b.num_rows
                if size >= shard_postings:
                    answer()
                    parts.clear()
                    size = docs = 0
        if parts:
            answer()
        for q, heap in enumerate(heaps):
            s, a, i = heap.rows
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), q, np.int32)), pa.array(i, mask=a), pa.array(s)], names=["q", "id", "score"])

    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return lean.mapInArrow(run, "q int, id long, score long").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


__all__ = ["Heap", "Shard", "search", "wand"]
