"""Approximate nearest neighbours by cross-polytope hashing.

A table hashes a unit vector to the nearest signed axis after a pseudo-random
rotation: three rounds of random signs and a fast Hadamard transform. With many
rows a second rotation is concatenated, of as many axes as keep the buckets
small, so their number grows with the rows. Every vector is indexed in each
table; a query probes its nearest buckets in each, as many as a bounded sample
needs for the wanted recall. Query and vector blocks of bounded size meet per
bucket, are ranked exactly there, and the best of all blocks are ranked again.
Vectors of different lengths get one more dimension, which makes the largest
inner product the nearest direction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismfeed.llm._tables import keep

TABLES, BLOCK = 6, 4096
#: Rows that a bucket should hold, and buckets of all tables up to which their counts are broadcast.
FILL, BROADCAST = 256, 1 << 16
#: The sample that fixes the number of probes: vectors, queries among them, and the recall wanted on it.
SAMPLE, SAMPLE_QUERIES, RECALL = 16_384, 256, 0.96
_EPS = np.finfo(float).eps


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; the dimension is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        pairs = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Coordinates on the signed axes of a table: the rotated ones and their negatives."""
    rng = np.random.default_rng(7919 * table + 17)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return np.concatenate([x, -x], axis=1)


def directions(x: np.ndarray, longest: float, lifted: bool, query: bool) -> np.ndarray:
    """Unit vectors padded to a power of two. lifted: a further dimension holds what a vector lacks of the longest."""
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    unit = x / np.maximum(size, 1e-300)
    if lifted:
        more = np.zeros_like(size) if query else np.sqrt(np.maximum(0.0, 1.0 - (size / longest) ** 2))
        unit = np.concatenate([unit if query else x / longest, more], axis=1)
    width = 1 << max(1, int(np.ceil(np.log2(unit.shape[1]))))
    return np.pad(unit, ((0, 0), (0, width - unit.shape[1])))


def best_rows(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score, then smaller id."""
    return np.lexsort((ids, -score))[:k]


def second_axes(rows: int, width: int, fill: int = FILL) -> int:
    """Signed axes of the second rotation of each table: none (1) for few rows, then as many as keep about `fill` rows to a bucket, up to all 2 * width."""
    want = rows // (2 * width * fill)
    return 1 if want < 2 else min(2 * width, 1 << (int(want).bit_length() - 1))


def coordinates(x: np.ndarray, table: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates on the signed axes of both rotations of a table; of the second the first `second` axes are used."""
    one = rotated(x, 2 * table)
    if second == 1:
        return one, np.zeros((len(x), 1))
    half = second // 2
    two = rotated(x, 2 * table + 1)[:, :half]
    return one, np.concatenate([two, -two], axis=1)


def buckets(x: np.ndarray, table: int, second: int) -> np.ndarray:
    """The bucket of each row: its nearest axis in both rotations."""
    one, two = coordinates(x, table, second)
    return one.argmax(axis=1) * second + two.argmax(axis=1)


def nearest_buckets(x: np.ndarray, table: int, second: int, probes: int) -> np.ndarray:
    """The `probes` buckets of each row by the sum of its coordinates on their axes, the largest first."""
    one, two = coordinates(x, table, second)
    probes = min(probes, one.shape[1] * second)
    # a bucket among the best has a first axis among the best `probes`
    first = np.argsort(-one, axis=1, kind="stable")[:, :probes]
    both = (np.take_along_axis(one, first, axis=1)[:, :, None] + two[:, None, :]).reshape(len(x), -1)
    best = np.argsort(-both, axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(first, best // second, axis=1) * second + best % second


def probes_needed(x: np.ndarray, longest: float, lifted: bool, k: int, tables: int, recall: float, second: int = 1) -> int:
    """The fewest probes a table that reach the recall on a sample, half of whose first rows are queries."""
    if len(x) < 2:
        return 1
    q = x[:SAMPLE_QUERIES]
    score = q @ x.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(x) - 1)
    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
    base, side = directions(x, longest, lifted, False), directions(q, longest, lifted, True)
    every = 2 * base.shape[1] * second
    rank = np.full(top.shape, every)
    for t in range(tables):
        of = buckets(base, t, second)[top]
        for lo in range(0, len(q), 16):
            near = nearest_buckets(side[lo : lo + 16], t, second, every)
            place = np.empty_like(near)
            np.put_along_axis(place, near, np.broadcast_to(np.arange(near.shape[1]), near.shape), axis=1)
            rank[lo : lo + 16] = np.minimum(rank[lo : lo + 16], np.take_along_axis(place, of[lo : lo + 16], axis=1))
    return int(np.sort(rank, axis=None)[max(0, int(np.ceil(recall * rank.size)) - 1)]) + 1


def _entries(b: pa.RecordBatch, table: int, take: np.ndarray, of: np.ndarray, asks: bool) -> pa.RecordBatch:
    part = b.take(pa.array(take))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(take), table, np.int32)), pa.array(of.astype(np.int32)), pa.array(np.full(len(take), asks)), part.column(0), part.column(1)], names=["t", "bucket", "asks", "id", "v"])


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def nearest(
    vectors: DataFrame, is_query, k: int = 20, tables: int = TABLES, recall: float = RECALL, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding", fill: int = FILL
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k candidates found of largest inner product for each row where is_query (a Column) holds.

    Nearest first, ties to the smaller id, the query's own row left out. A query
    for which the probed buckets hold fewer than k rows is searched in all
    buckets, so each has min(k, all others) rows. Vectors that are null, zero,
    hold null or non-finite components, or are not of the commonest dimension
    take no part, nor do rows with a null id. Rows of one id keep their best
    score; an empty table gives an empty result. Very large and very small
    components are scaled by a power of two for the search; a score beyond a
    double's range is infinite, one below it zero. Ids are integers; other columns
    are not read. The driver sees the sample and one count for each table and
    bucket that is probed.
    """
    spark = vectors.sparkSession
    valid = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(vec_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec_col, lambda v: v != 0) & F.col(id_col).isNotNull()
    good = vectors.filter(valid).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not dims:
        return empty
    width, total = dims[0].d, dims[0].n
    good = good.filter(F.size("v") == width)
    peak = good.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    scale = 1.0 if 2.0**-400 < peak < 2.0**400 else 2.0 ** -min(1000, max(-1000, int(np.frexp(peak)[1])))  # a power of two: no digit changes
    if scale != 1.0:
        good = good.withColumn("v", F.transform("v", lambda x: x * scale))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    low, high, ids = good.agg(F.min(norm), F.max(norm), F.approx_count_distinct("id")).first()
    lifted = high > 1.001 * low
    picked = good.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / total)))).select("v").limit(2 * SAMPLE).toPandas()
    sample = np.stack(picked["v"].to_numpy()).astype(np.float64) if len(picked) else np.zeros((0, width))
    padded = directions(np.ones((1, width)), high, lifted, False).shape[1]
    second = second_axes(total, padded, fill)
    every = 2 * padded * second
    probes = probes_needed(sample, high, lifted, k, tables, recall, second) if ids > 4 * k else every

    def search(rows: DataFrame, tables: int, probes: int) -> DataFrame:
        """The k best in the probed buckets of each row where q holds."""

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    b = whole.slice(at, 1024)
                    x = _rows(b.column(1), width)
                    asks = np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False))
                    base, side = directions(x, high, lifted, False), directions(x[asks], high, lifted, True)
                    n = len(x)
                    for t in range(tables):
                        of = buckets(base, t, second)
                        yield _entries(b, t, np.arange(n), of, False)
                        for lo in range(0, len(asks), 64):
                            near = nearest_buckets(side[lo : lo + 64], t, second, probes)
                            yield _entries(b, t, np.repeat(asks[lo : lo + 64], near.shape[1]), near.ravel(), True)

        entries = rows.mapInArrow(hashed, "t int, bucket int, asks boolean, id long, v array<double>")
        # one row for each table and bucket: at most tables * rows / fill
        sizes = entries.groupBy("t", "bucket").agg(F.ceil(F.count_if("asks") / block).cast("int").alias("qs"), F.ceil(F.count_if(~F.col("asks")) / block).cast("int").alias("vs")).filter("qs > 0 and vs > 0")
        own = lambda m: F.pmod(F.xxhash64("id"), F.col(m)).cast("int")
        spread = lambda m: F.sequence(F.lit(0), F.col(m) - 1)
        placed = entries.join(F.broadcast(sizes) if tables * every <= BROADCAST else sizes, ["t", "bucket"])
        blocks = placed.select("t", "bucket", "asks", "id", "v", F.explode(F.when(F.col("asks"), F.transform(spread("vs"), lambda o: F.struct(o.alias("vb"), own("qs").alias("qb")))).otherwise(F.transform(spread("qs"), lambda o: F.struct(own("vs").alias("vb"), o.alias("qb"))))).alias("b"))

        def ranked(table: pa.Table) -> pa.Table:
            asks = table.column("asks").to_numpy()
            ids = table.column("id").to_numpy()
            x = _rows(table.column("v").combine_chunks(), width)
            qi, vi, q, v = ids[asks], ids[~asks], x[asks], x[~asks]
            out: list[list[np.ndarray]] = [[], [], []]
            longest = np.sqrt((v * v).sum(axis=1).max(initial=0))
            most = k + len(vi) - len(np.unique(vi))  # rows of one id must not crowd out others
            for lo in range(0, len(q) if len(v) else 0, 256):
                score = q[lo : lo + 256] @ v.T
                slack = 8 * width * _EPS * longest * np.sqrt((q[lo : lo + 256] ** 2).sum(axis=1))  # what the product may round off
                score[qi[lo : lo + 256, None] == vi[None, :]] = -np.inf
                for row, s in enumerate(score):
                    floor = np.partition(s, len(s) - most)[len(s) - most] if len(s) > most else -np.inf
                    near = np.flatnonzero((s >= floor - slack[row]) & (s > -np.inf))
                    exact = (v[near] * q[lo + row]).sum(axis=1)
                    best = best_rows(exact, vi[near], most)
                    out[0].append(np.full(len(best), qi[lo + row]))
                    out[1].append(vi[near[best]])
                    out[2].append(exact[best])
            cols = [np.concatenate(c) if c else np.zeros(0, kind) for c, kind in zip(out, (np.int64, np.int64, np.float64), strict=True)]
            return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

        found = blocks.select("t", "bucket", "b.vb", "b.qb", "asks", "id", "v").groupBy("t", "bucket", "vb", "qb").applyInArrow(ranked, "query_id long, vec_id long, score double")
        single = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best = single.select("query_id", place.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
        return best if scale == 1.0 else best.withColumn("score", F.col("score") / scale / scale)

    if probes >= every:
        return search(good, 1, every)
    found = keep(search(good, tables, probes), "near")
    asked = good.filter("q").select(F.col("id").alias("query_id")).distinct()
    short = asked.join(found.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").filter(F.coalesce("n", F.lit(0)) < k).select("query_id")
    short = keep(short, "near-short")
    if short.isEmpty():
        return found
    again = good.drop("q").join(short.select(F.col("query_id").alias("id"), F.lit(True).alias("q")), "id", "left").withColumn("q", F.coalesce("q", F.lit(False)))
    return found.join(short, "query_id", "left_anti").unionByName(search(again, 1, every))
