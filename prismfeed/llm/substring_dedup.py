"""Removal of word windows that repeat across documents, with a count-min prefilter.

Every window of n words has an anchor: the smallest hash of its n/2-grams, so
equal windows have equal anchors. Tasks sketch how many documents hold each
anchor; the merged sketch overestimates how many hold each window. The second
pass hands on only windows estimated to be in two documents or more and groups
them exactly, by 96-bit hashes: no repeated window is lost, and a sketch that
is too full for its bound only lets more windows through.

The windows of hot passages are many rows of one hash. They are grouped by an
aggregate of the smallest document id, which is combined in each task, and meet
it again in a join whose skewed partitions Spark can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismfeed.llm._sketch import Planes, build, text_bytes, width_for
from prismfeed.llm._words import Words, word_tables

WINDOW = 50
#: The sketch has at most 2 rows of 2**27 cells: 32 MB of bits.
SKETCH_BITS, SKETCH_DEPTH = 27, 2
_BYTES_A_WORD = 6.0


def sliding(h: np.ndarray, size: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of the `size` values from each position on; the last size - 1 mean nothing."""
    out, width = h.copy(), 1
    while width < size:
        step = min(width, size - width)
        out[: len(out) - step] = best(out[: len(out) - step], out[step:])
        width += step
    return out


def anchors(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the windows of n words, and the anchor of each."""
    at = np.flatnonzero(w.fits(n))
    if not len(at):
        return at, np.zeros(0, np.uint64)
    k = n // 2
    return at, sliding(w.grams(k), n - k + 1, np.minimum)[at]


def _anchor_keys(n: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            for w in word_tables(b.column(0)):
                at, m = anchors(w, n)
                if len(at):
                    owner = w.owner[at]
                    new = np.concatenate([[True], (m[1:] != m[:-1]) | (owner[1:] != owner[:-1])])
                    m, owner = m[new], owner[new]
                    order = np.lexsort((m, owner))
                    m, owner = m[order], owner[order]
                    yield m[np.concatenate([[True], (m[1:] != m[:-1]) | (owner[1:] != owner[:-1])])]

    return keys


def _suspects(w: Words, n: int, planes: Planes) -> np.ndarray:
    """Positions of the windows whose anchor is estimated to be in two documents or more."""
    at, m = anchors(w, n)
    if not len(at):
        return at
    new = np.concatenate([[True], m[1:] != m[:-1]])
    return at[planes.reached(m[new])[np.cumsum(new) - 1]]


def remove_repeats(docs: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """Rows (id, n_words, n_removed, kept) for every document; kept: the words that stay, joined by one space (with `digests` kept_sha256).

    A word goes if a window of n words that covers it also starts in a document
    with a smaller id; windows are judged on the input. A null or empty text has
    no words; rows with a null id lose nothing and take nothing from others; of
    equal windows in rows of one id none goes; equal rows give equal results, and
    rows of one id are told apart by 32 bits of a hash of their texts.
    A very long text is cut into windows whole; an empty table gives an empty
    result. Ids are integers. Columns other than id and text are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    expected = text_bytes(rows) / _BYTES_A_WORD * 2 / (n - n // 2 + 1)
    planes = build(rows.filter("id is not null").select("text"), _anchor_keys(n), width_for(expected, 8, sketch_bits), SKETCH_DEPTH, (2,))
    held = spark.sparkContext.broadcast(planes)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = held.value
        for b in batches:
            ids, keys = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for w in word_tables(b.column(1)):
                at = _suspects(w, n, planes)
                if len(at):
                    own = w.owner[at]
                    cols = [w.grams(n)[at].view(np.int64), (w.grams(n, 1)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32), ids[w.lo + own], keys[w.lo + own], (at - w.off[own]).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h1", "h2", "id", "key", "at"])

    keyed = rows.select("id", "text", F.shiftright(F.xxhash64("text"), 32).cast("int").alias("key"))
    found = keyed.filter("id is not null").mapInArrow(windows, "h1 long, h2 int, id long, key int, at int")
    # grouped by one struct: the join then has an exchange of its own on either side, whose skewed partitions can be split
    first = found.groupBy(F.struct("h1", "h2").alias("h")).agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("h.h1", "h.h2", "first")
    gone = found.join(first, ["h1", "h2"]).filter("id > first").groupBy("id", "key").agg(F.collect_list("at").alias("gone"))

    sha = lambda s: hashlib.sha256(s).hexdigest()
    blank = b" "

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without a suspect window are done; the others take their text along, packed."""
        planes, packer = held.value, zstandard.ZstdCompressor(level=3)
        for b in batches:
            for w in word_tables(b.column(1)):
                at = _suspects(w, n, planes)
                kept, texts = [], []
                some = np.zeros(w.hi - w.lo, bool)
                some[w.owner[at]] = True
                data = w.data.tobytes()
                start, end, off = w.start.tolist(), w.end.tolist(), w.off.tolist()
                for d in range(w.hi - w.lo):
                    if some[d]:
                        kept.append(None)
                        texts.append(packer.compress(b.column(1)[w.lo + d].as_buffer()))
                    else:
                        words = blank.join([data[s:e] for s, e in zip(start[off[d] : off[d + 1]], end[off[d] : off[d + 1]], strict=True)])
                        kept.append(sha(words) if digests else words.decode())
                        texts.append(None)
                part = b.slice(w.lo, w.hi - w.lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(w.counts, pa.int64()), pa.array(kept, pa.string()), pa.array(texts, pa.binary())], names=["id", "key", "n_words", "kept", "text"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for b in batches:
            texts = [unpacker.decompress(t) if t else t for t in b.column(3).to_pylist()]
            for w in word_tables(pa.array(texts, pa.large_binary()).cast(pa.large_string())):
                kept, removed = b.column(2).slice(w.lo, w.hi - w.lo).to_pylist(), []
                lists = b.column(4).slice(w.lo, w.hi - w.lo)
                data = None
                for d in range(w.hi - w.lo):
                    if kept[d] is not None:
                        removed.append(0)
                        continue
                    data = w.data.tobytes() if data is None else data
                    lo, size = int(w.off[d]), int(w.off[d + 1] - w.off[d])
                    edge = np.zeros(size + 1, np.int64)
                    if lists[d].is_valid:
                        at = np.unique(lists[d].values.to_numpy(zero_copy_only=False))
                        edge[at] += 1
                        edge[at + n] -= 1
                    stay = np.flatnonzero(np.cumsum(edge)[:size] == 0) + lo
                    words = blank.join([data[s:e] for s, e in zip(w.start[stay].tolist(), w.end[stay].tolist(), strict=True)])
                    kept[d] = sha(words) if digests else words.decode()
                    removed.append(size - len(stay))
                part = b.slice(w.lo, w.hi - w.lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    left = keyed.select("id", "text", "key").mapInArrow(base, "id long, key int, n_words long, kept string, text binary")
    whole = left.join(gone, ["id", "key"], "left").select("id", "n_words", "kept", "text", "gone")
    out = whole.mapInArrow(apply, "id long, n_words long, n_removed long, kept string")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", F.col("kept").alias("kept_sha256" if digests else "kept"))
