"""Benchmark decontamination by winnowing.

Of the k-gram hashes of a text every window of w keeps its smallest, the
rightmost among equals. Texts that share n = k + w - 1 words share a whole
window and so keep the same hash there: joining the kept hashes of documents
with those of the benchmark items misses no shared span of n words. Each such
hit is extended to all n-word windows around it, which count if they are
windows of an item, compared by 128-bit hashes.

A benchmark of a few slices is broadcast and looked up in a narrow pass. A
larger one meets the documents in a join of windows: a sketch of the items'
fingerprints, of bounded size, picks the places of the documents worth joining,
and the join decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismfeed.llm import _sketch
from prismfeed.llm._tables import keep, map_rows
from prismfeed.llm._words import ALNUM, runs, word_tables

#: Bytes of benchmark text that one pass over the documents looks for, and passes up to which they are chained; beyond that the windows are joined.
SLICE_BYTES, MOST_SLICES = 32 << 20, 4
#: Cells of the sketch of fingerprints, as a power of two, at most.
SKETCH_BITS = 28
_BITS = 20


def winnow(h: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """The positions that the windows of `window` consecutive valid hashes keep. Windows over an invalid one keep nothing."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = h[window - 1 :].copy(), np.full(n, window - 1, np.int64)
    whole = valid[window - 1 :].copy()
    for back in range(window - 2, -1, -1):
        other = h[back : back + n]
        smaller = other < best
        best[smaller] = other[smaller]
        at[smaller] = back
        whole &= valid[back : back + n]
    return np.unique((np.arange(n) + at)[whole])


@dataclass
class _Length:
    """Item windows of one length: sorted 64-bit hashes, their second hashes and items (from first[i] on)."""

    h1: np.ndarray
    h2: np.ndarray
    item: np.ndarray


@dataclass
class Index:
    """What one pass looks for."""

    n: int
    k: int
    kept: np.ndarray
    table: np.ndarray
    windows: dict[int, _Length]
    names: list[str | None]


def _bits(hashes: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << _BITS, bool)
    table[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return table


def _windows(w, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Size, hashes and owners of the windows of items: n words, or all of an item of fewer."""
    for size in sorted({*np.unique(np.minimum(w.counts, n)).tolist()} - {0}):
        ok = w.fits(size) & np.repeat((w.counts == size) | (w.counts > size if size == n else False), w.counts)
        if ok.any():
            yield size, w.grams(size)[ok], w.grams(size, 1)[ok], w.owner[ok]


def build_index(ids: list, texts: list[str | None], n: int, k: int) -> Index:
    """The kept fingerprints and windows of items; one of fewer than n words, but not none, is one window."""
    parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    kept = []
    for w in word_tables(pa.array(texts, pa.string()), ALNUM, lower=True):
        kept.append(w.grams(k)[winnow(w.grams(k), w.fits(k), n - k + 1)])
        for size, h1, h2, owner in _windows(w, n):
            parts.setdefault(size, []).append((h1, h2, owner + w.lo))
    windows = {}
    for size, some in parts.items():
        h1, h2, item = (np.concatenate(x) for x in zip(*some, strict=True))
        order = np.lexsort((item, h2, h1))
        windows[size] = _Length(h1[order], h2[order], item[order])
    all_kept = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.uint64)
    return Index(n, k, all_kept, _bits(all_kept), windows, [None if i is None else str(i) for i in ids])


def _members(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x if len(sorted_values) else np.zeros(len(x), bool)


def search(w, index: Index) -> tuple[np.ndarray, dict[int, set[int]]]:
    """Whether each word is hit, and the items of each text that occur, of a piece of documents."""
    hit, items = np.zeros(len(w) + 1, np.int64), {}
    for size, known in index.windows.items():
        if size == index.n:  # by fingerprints, then the windows around each
            at = winnow(w.grams(index.k), w.fits(index.k), index.n - index.k + 1)
            h = w.grams(index.k)[at]
            near = index.table[(h >> np.uint64(64 - _BITS)).astype(np.int64)]
            at = at[near][_members(index.kept, h[near])]
            begin = np.unique((at[:, None] - np.arange(index.n - index.k + 1)).ravel())
            begin = begin[begin >= 0]
            begin = begin[w.fits(size)[begin]] if len(begin) else begin
        else:
            begin = np.flatnonzero(w.fits(size))
        if not len(begin):
            continue
        h1 = w.grams(size)[begin]
        found = _members(known.h1, h1)
        begin, h1 = begin[found], h1[found]
        if not len(begin):
            continue
        h2 = w.grams(size, 1)[begin]
        lo, hi = np.searchsorted(known.h1, h1), np.searchsorted(known.h1, h1, "right")
        many = np.repeat(np.arange(len(begin)), hi - lo)
        entry = np.repeat(lo, hi - lo) + runs(hi - lo)
        same = known.h2[entry] == h2[many]
        many, entry = many[same], entry[same]
        first = np.unique(begin[many])
        np.add.at(hit, first, 1)
        np.add.at(hit, first + size, -1)
        for d, i in np.unique(np.stack([w.owner[begin[many]], known.item[entry]]), axis=1).T:
            items.setdefault(int(d), set()).add(int(i))
    return np.cumsum(hit)[:-1] > 0, items


def _covered(spans: pa.ListArray, off: np.ndarray) -> np.ndarray:
    """Whether each word is in one of the spans of its text."""
    out = np.zeros(int(off[-1]) + 1, np.int64)
    start, end = (x.to_numpy(zero_copy_only=False) for x in spans.flatten().flatten())
    first = np.repeat(off[:-1], spans.value_lengths().to_numpy(zero_copy_only=False))
    np.add.at(out, first + start, 1)
    np.add.at(out, first + end, -1)
    return np.cumsum(out)[:-1] > 0


def _pass(docs: DataFrame, index: Index, last: bool) -> DataFrame:
    """docs (id, text), after the first pass with n_words, spans and items as well, to which those of index are added; the last pass leaves the text out."""
    held = docs.sparkSession.sparkContext.broadcast(index)
    kind, first = docs.schema["id"].dataType.simpleString(), len(docs.columns) == 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for b in batches:
            for w in word_tables(b.column(1), ALNUM, lower=True):
                hit, items = search(w, index)
                if not first:
                    hit |= _covered(b.column("spans").slice(w.lo, w.hi - w.lo), w.off)
                before = [()] * (w.hi - w.lo) if first else b.column("items").slice(w.lo, w.hi - w.lo).to_pylist()
                ids = b.column(0).slice(w.lo, w.hi - w.lo)
                spans: list[list] = [[] for _ in range(w.hi - w.lo)]
                if hit.any():
                    where = np.flatnonzero(hit)
                    new = np.ones(len(where), bool)
                    new[1:] = (np.diff(where) > 1) | (w.owner[where[1:]] != w.owner[where[:-1]])
                    begin = where[new]
                    stop = where[np.append(np.flatnonzero(new)[1:] - 1, len(where) - 1)] + 1
                    for s, e in zip(begin.tolist(), stop.tolist(), strict=True):
                        d = int(w.owner[s])
                        spans[d].append({"start": s - int(w.off[d]), "end": e - int(w.off[d])})
                names = [sorted({*before[d], *(index.names[i] for i in items.get(d, ()))} - {None}) for d in range(w.hi - w.lo)]
                kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                text = {} if last else {"text": b.column(1).slice(w.lo, w.hi - w.lo)}
                yield pa.RecordBatch.from_pydict({"id": ids, **text, "n_words": pa.array(w.counts, pa.int64()), "spans": pa.array(spans, kinds), "items": pa.array(names, pa.list_(pa.string()))})

    text = "" if last else "text string, "
    return docs.mapInArrow(run, f"id {kind}, {text}n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def _sized(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"), F.coalesce(F.octet_length(item_text), F.lit(0)).cast("long").alias("b"))


def _indexes(sized: DataFrame, slices: int, n: int, k: int) -> Iterator[tuple[Index, bool]]:
    """An index for each slice of the items, and whether it is the last."""
    for s in range(slices):
        part = sized if slices == 1 else sized.filter(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == s)
        rows = part.select("i", "t").collect()
        yield build_index([r.i for r in rows], [r.t for r in rows], n, k), s == slices - 1


def _joined(docs: DataFrame, sized: DataFrame, n: int, k: int, bits: int = SKETCH_BITS) -> tuple[DataFrame, DataFrame]:
    """(row, start, size) of the item windows in docs (row, text), and (row, item) of the items that occur there."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in word_tables(b.column(1), ALNUM, lower=True):
                ids = b.column(0).slice(w.lo, w.hi - w.lo)
                for size, h1, h2, owner in _windows(w, n):
                    yield pa.RecordBatch.from_pydict({"size": pa.array(np.full(len(h1), size, np.int32)), "h1": pa.array(h1.view(np.int64)), "h2": pa.array(h2.view(np.int64)), "item": ids.take(pa.array(owner))})

    known = keep(sized.select("i", "t").mapInArrow(listed, "size int, h1 long, h2 long, item string").distinct(), "item-windows")

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            for w in word_tables(b.column(0), ALNUM, lower=True):
                yield w.grams(k)[winnow(w.grams(k), w.fits(k), n - k + 1)]
                for size, h1, _, _ in _windows(w, n):
                    if size < n:
                        yield h1

    total = sized.agg(F.sum("b")).first()[0] or 0
    planes = _sketch.build(sized.select("t"), marks, _sketch.width_for(total / 6, 8, bits), 1, (1,))
    short = sorted(r.size for r in known.select("size").distinct().collect() if r.size < n)  # n - 1 sizes at most
    held = docs.sparkSession.sparkContext.broadcast(planes)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in word_tables(b.column(1), ALNUM, lower=True):
                for size in (*short, n):
                    if size == n:
                        at = winnow(w.grams(k), w.fits(k), n - k + 1)
                        at = at[held.value.reached(w.grams(k)[at])]
                        begin = np.unique((at[:, None] - np.arange(n - k + 1)).ravel())
                        begin = begin[begin >= 0]
                        begin = begin[w.fits(n)[begin]] if len(begin) else begin
                    else:
                        begin = np.flatnonzero(w.fits(size))
                        begin = begin[held.value.reached(w.grams(size)[begin])]
                    if not len(begin):
                        continue
                    owner = w.owner[begin]
                    row = b.column(0).slice(w.lo, w.hi - w.lo).take(pa.array(owner))
                    yield pa.RecordBatch.from_pydict({
                        "row": row, "start": pa.array((begin - w.off[owner]).astype(np.int64)), "size": pa.array(np.full(len(begin), size, np.int32)),
                        "h1": pa.array(w.grams(size)[begin].view(np.int64)), "h2": pa.array(w.grams(size, 1)[begin].view(np.int64)),
                    })

    key = ["size", "h1", "h2"]
    found = keep(docs.mapInArrow(places, "row long, start long, size int, h1 long, h2 long").join(known.select(key).distinct(), key, "left_semi"), "windows")
    return found.select("row", "start", "size"), found.select("row", *key).distinct().join(known, key).select("row", "item").distinct()


def _merged(starts: list[dict]) -> list[dict]:
    """Overlapping and adjacent windows as spans."""
    out: list[dict] = []
    for x in sorted(starts, key=lambda x: x["start"]):
        start, end = x["start"], x["start"] + x["size"]
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def _hits_by_join(docs: DataFrame, sized: DataFrame, n: int, k: int) -> DataFrame:
    """As the passes give them, for docs (id, text)."""
    kind = docs.schema["id"].dataType.simpleString()
    rows = keep(docs.withColumn("row", F.monotonically_increasing_id()), "keyed")  # kept, so that the rows' numbers stand
    windows, items = _joined(rows.select("row", "text"), sized, n, k)
    spans = windows.groupBy("row").agg(F.collect_set(F.struct("start", "size")).alias("at"))  # places of one text
    names = items.filter("item is not null").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in word_tables(b.column(2), ALNUM, lower=True):
                yield pa.RecordBatch.from_pydict({"row": b.column(0).slice(w.lo, w.hi - w.lo), "id": b.column(1).slice(w.lo, w.hi - w.lo), "n_words": pa.array(w.counts, pa.int64())})

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = [_merged(x) if x else [] for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "n_words": b.column(1), "spans": pa.array(found, kinds), "items": pa.array([x or [] for x in b.column(3).to_pylist()], pa.list_(pa.string()))})

    sizes = rows.select("row", "id", "text").mapInArrow(counted, f"row long, id {kind}, n_words long")
    all_ = sizes.join(spans, "row", "left").join(names, "row", "left").select("id", "n_words", "at", "items")
    return all_.mapInArrow(told, f"id {kind}, n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def benchmark_hits(
    docs: DataFrame, items: DataFrame, n: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """Rows (id, n_words, spans, items) for every document: the word spans that benchmark windows cover, and those items.

    Items of up to MOST_SLICES slices of slice_bytes are read to the driver by
    slices, and each is broadcast for one pass over the documents. The passes are
    chained, each adds its hits to those that come with the row, so that nothing
    is shuffled. More items meet the documents in a join on windows, by numbers
    that rows get for it; nothing but a sketch of bounded size is broadcast then.
    Either way repeated and null ids are kept, and rows of one item_id are one
    item of all their windows. Null or empty texts have no words; an
    item without words finds nothing; items with a null id hit words but are not
    listed; equal items are all listed; a very long text is searched whole; an
    empty table gives an empty result; other columns are not read.
    """
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sized = _sized(items, item_id, item_text)
    slices = (sized.agg(F.sum("b")).first()[0] or 0) // slice_bytes + 1
    if slices > MOST_SLICES:
        return _hits_by_join(found, sized, n, k).withColumnRenamed("id", id_col)
    for index, last in _indexes(sized, slices, n, k):
        found = _pass(found, index, last)
    return found.withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 10, k: int = 5, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of docs in which no window of an item occurs, with all their columns.

    Narrow, one pass for each slice of items, or a join beyond MOST_SLICES of them,
    as benchmark_hits. Null and empty texts stay; repeated rows and rows of
    repeated or null ids are judged each; a very long text is searched whole; an
    empty table stays empty.
    """
    at, schema = docs.columns.index(text_col), docs.schema
    sized = _sized(items, item_id, item_text)
    slices = (sized.agg(F.sum("b")).first()[0] or 0) // slice_bytes + 1
    if slices > MOST_SLICES:
        plain = keep(docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumn("row", F.monotonically_increasing_id()), "keyed")
        windows, _ = _joined(plain.select("row", F.col(f"c{at}").alias("text")), sized, n, k)
        return plain.join(windows.select("row").distinct(), "row", "left_anti").drop("row").toDF(*schema.names)
    for index, _ in _indexes(sized, slices, n, k):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for w in word_tables(b.column(at), ALNUM, lower=True):
                    hit, _ = search(w, held.value)
                    clean = np.ones(w.hi - w.lo, bool)
                    clean[w.owner[hit]] = False
                    yield b.slice(w.lo, w.hi - w.lo).filter(pa.array(clean))

        docs = map_rows(docs, run, schema)
    return docs


def hit_digest(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and the digest of the items of each document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return hits.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


__all__ = ["benchmark_hits", "drop_contaminated", "hit_digest", "winnow", "build_index", "search"]
