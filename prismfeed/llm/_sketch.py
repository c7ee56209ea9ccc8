"""Count-min sketches that are built per task, merged by blocks and held as bit planes.

A sketch has `depth` rows of `width` cells. Each text adds one to the cell of
each of its distinct keys in every row, so the smallest cell of a key is at
least the number of texts that hold it. Tasks hand on their non-empty cells
block by block; blocks are merged in a shuffle, and what remains is a bit per
cell and level: whether it reached the level. Its size follows from the width
alone, which is bounded, so it may be broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismfeed.llm._tables import keep

_BLOCK_BITS = 16
_BLOCK = 1 << _BLOCK_BITS
#: Cells that a task gathers before it merges them.
_GATHER = 1 << 19


def width_for(keys: float, per_key: float, most_bits: int, least_bits: int = 18) -> int:
    """A power of two of about per_key cells for each expected key, within bounds."""
    bits = int(np.ceil(np.log2(max(2.0, keys * per_key))))
    return 1 << min(max(bits, least_bits), most_bits)


def cells(h: np.ndarray, width: int, row: int) -> np.ndarray:
    """Rows take different bits of the hash: the upper ones, and those of a mixed hash."""
    if row:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
    return (h >> np.uint64(64 - int(width).bit_length() + 1)).astype(np.int64)


def _counted(parts: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    ones = [np.ones(len(p[0]), np.int64) if p[1] is None else p[1] for p in parts]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    weights = np.concatenate(ones)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.minimum(np.add.reduceat(weights[order], first), 65535)


class Planes:
    """Merged bit planes of a sketch: for each level, whether a cell reached it."""

    def __init__(self, width: int, depth: int, levels: tuple[int, ...], blocks: Iterable[tuple[int, list[bytes]]]):
        self.width, self.depth, self.levels = width, depth, levels
        self.bits = np.zeros((len(levels), depth * width // 8), np.uint8)
        for block, planes in blocks:
            for k, plane in enumerate(planes):
                self.bits[k, block * _BLOCK // 8 : (block + 1) * _BLOCK // 8] = np.frombuffer(plane, np.uint8)

    def reached(self, h: np.ndarray, level: int = 0) -> np.ndarray:
        """Whether each key's estimate reaches the level; always true if its count does."""
        out = np.ones(len(h), bool)
        for row in range(self.depth):
            at = cells(h, self.width, row) + row * self.width
            out &= (self.bits[level][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def build(df: DataFrame, keys: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], width: int, depth: int, levels: tuple[int, ...]) -> Planes:
    """A sketch of the keys that `keys` finds in df's batches; it yields, now and then, keys that are distinct within each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        size = 0

        def handed(parts: list) -> Iterator[pa.RecordBatch]:
            at, n = _counted(parts)
            if not len(at):
                return
            block = at >> _BLOCK_BITS
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(at) else np.zeros(0, np.int64)
            ends = np.append(first[1:], len(at))
            inner, some = (at & (_BLOCK - 1)).astype(np.uint16), n.astype(np.uint16)
            small = np.array([some[s:e].max() < 256 for s, e in zip(first, ends, strict=True)], bool)
            for lo in range(0, len(first), 2048):
                s, e = first[lo : lo + 2048], ends[lo : lo + 2048]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block[s], pa.int64()),
                        pa.array([inner[x:y].tobytes() for x, y in zip(s, e, strict=True)], pa.binary()),
                        pa.array([some[x:y].astype(np.uint8 if tiny else np.uint16).tobytes() for x, y, tiny in zip(s, e, small[lo : lo + 2048], strict=True)], pa.binary()),
                    ],
                    names=["block", "cells", "counts"],
                )

        for found in keys(batches):
            for row in range(depth):
                parts.append((cells(found, width, row) + row * width, None))
                size += len(found)
            if size > _GATHER:
                parts = [_counted(parts)]
                size = 0
                if len(parts[0][0]) > 2 * _GATHER:
                    yield from handed(parts)
                    parts = []
        if parts:
            yield from handed(parts)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, current = np.zeros(_BLOCK, np.int64), None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([[np.packbits(total >= k, bitorder="little").tobytes() for k in levels]], pa.list_(pa.binary()))], names=["block", "planes"])

        for b in batches:
            for block, at, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if block != current:
                    if current is not None:
                        yield done()
                    total[:] = 0
                    current = block
                spot = np.frombuffer(at, np.uint16)
                total[spot] += np.frombuffer(n, np.uint8 if len(n) == len(spot) else np.uint16)
        if current is not None:
            yield done()

    parts = df.mapInArrow(run, "block long, cells binary, counts binary")
    blocks = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merged, "block long, planes array<binary>")
    # depth * width / 8 bytes a level. Read from the few splits of a table: straight from the shuffle, each of its partitions would be a job of the driver's
    return Planes(width, depth, levels, keep(blocks, "sketch").toLocalIterator())


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
