"""Exact Jaccard self-join of word n-gram sets with token-combination prefixes.

A document's set is its distinct word 5-grams (as 64-bit hashes). Two sets with
Jaccard similarity t or more share at least ceil(t / (1 + t) * (size + size'))
grams, and no fewer than ceil(t * size) of either. So

- a document with fewer grams that occur elsewhere links with nothing; a merged
  count-min sketch, which never underestimates, tells most such documents before
  any gram is shuffled. Equal sets are one class, of which the smallest document
  goes on; a second sketch, of these representatives alone, thins them again and
  gives each gram a level, by which all sets are ordered rare first;
- the first shared gram of two sets, in that order, lies in either's prefix. If
  it is rare (few representatives hold it) the two meet under it alone;
- otherwise all they share is frequent. Frequent grams are dealt to m classes by
  hash; of the first m + 1 shared ones two are of one class, so the two sets meet
  under a combination of two frequent grams of one class, with the prefix
  extended by m. m grows with the sets, so that combinations are in proportion
  to grams. Sets too small to share m + 1 grams meet under single grams.

Each posting carries the greatest overlap that is still possible if it is the
first one shared, so most that share a passage but can't link never meet.

Candidates are found in rounds: the postings of a key are compared with a few of
them, its pivots, more in each round; links join components, and keys whose
documents are in one component are left out. At last all remaining pairs of
different components are made. A pair within a component needs no test, as it
can't change the components; every other pair that can link is tested on its
whole sets. Nothing is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismfeed.llm._sketch import Planes, build, text_bytes, width_for
from prismfeed.llm._tables import keep
from prismfeed.llm._words import Words, gram_hashes, mix64, word_tables
from prismfeed.operators.graph import components, downward, hooked, labels

#: Words of a gram; links from NUM / DEN on.
GRAM, NUM, DEN = 5, 75, 100
#: Grams estimated to be in so many representatives are frequent and indexed in combinations of two. One of LEVELS.
FREQUENT = 64
#: Counts that part the levels by which grams are ordered.
LEVELS = (2, 4, 16, 64, 256, 1024)
#: Sets of about s grams have s / SPREAD classes of frequent grams.
SPREAD = 16
#: The sketches have at most 2**28 and 2**26 cells: 32 MB of bits, and 8 MB for each level.
SKETCH_BITS, FINE_BITS = 28, 26
#: Pivots of a key in each round.
PIVOTS = (1, 4, 16)
_BYTES_A_WORD = 6.0


def gram_sets(w: Words, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct gram hashes of each text, sorted, and where each text's begin; fewer than n words are one gram."""
    owner, h = w.owner, w.hashes()
    at = np.flatnonzero(w.fits(n))
    parts, owners = [w.grams(n)[at]], [owner[at]]
    for size in range(1, n):
        short = w.off[:-1][w.counts == size]
        if len(short):
            parts.append(gram_hashes(h, size)[short])
            owners.append(owner[short])
    g, o = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((g, o))
    g, o = g[order], o[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    g, o = g[new], o[new]
    return g, np.searchsorted(o, np.arange(w.hi - w.lo + 1))


def least_shared(size, num: int = NUM, den: int = DEN):
    """Grams of a set of `size` that any linked set holds, at least."""
    return -(-num * size // den)


@dataclass(frozen=True)
class Params:
    gram: int = GRAM
    num: int = NUM
    den: int = DEN
    frequent: int = FREQUENT
    levels: tuple[int, ...] = LEVELS
    spread: int = SPREAD
    sketch_bits: int = SKETCH_BITS
    fine_bits: int = FINE_BITS
    pivots: tuple[int, ...] = PIVOTS


def _text_keys(p: Params):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            for w in word_tables(b.column(0), lower=True):
                yield gram_sets(w, p.gram)[0]

    return keys


def _blob_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        for blob in b.column(0):
            yield np.frombuffer(blob.as_buffer(), np.uint64)


def _nodes(rows: DataFrame, planes: Planes, p: Params) -> DataFrame:
    """Rows (id, n, set_key, grams) of all documents; grams (a blob of those that occur elsewhere, sorted) only of those that may link."""
    held = rows.sparkSession.sparkContext.broadcast(planes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = held.value
        for b in batches:
            for w in word_tables(b.column(1), lower=True):
                g, off = gram_sets(w, p.gram)
                seen = planes.reached(g, 0)
                sizes = np.diff(off)
                shared = np.add.reduceat(np.append(seen, 0).astype(np.int64), np.minimum(off[:-1], len(g))) * (sizes > 0)
                blobs, keys = [None] * (w.hi - w.lo), [None] * (w.hi - w.lo)
                for d in np.flatnonzero((sizes > 0) & (shared >= least_shared(sizes, p.num, p.den))).tolist():
                    one = g[off[d] : off[d + 1]]
                    keys[d] = hashlib.sha256(one.tobytes()).digest()[:16]
                    blobs[d] = one[seen[off[d] : off[d + 1]]].tobytes()
                ids = b.column(0).slice(w.lo, w.hi - w.lo)
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], names=["id", "n", "set_key", "grams"])

    return rows.mapInArrow(run, "id long, n long, set_key binary, grams binary")


def postings(g: np.ndarray, level: np.ndarray, n: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set of n grams and the overlap still possible if the key is the first shared. g: its grams that occur elsewhere, level: of each."""
    least, often = least_shared(n, p.num, p.den), p.levels.index(p.frequent) + 1
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if (level > 0).sum() < least:
        return none
    order = np.lexsort((g, level))
    g, level = g[order], level[order]
    room = len(g) - np.arange(len(g))  # grams from each on; those that occur nowhere else come before all of these
    rare = (level > 0) & (level < often) & (room >= least)
    keys, rooms = [g[rare]], [room[rare]]
    some = np.flatnonzero(level >= often)
    if len(some):
        f, left, alone = g[some], room[some], False
        for bits in range(int(least).bit_length(), int(n).bit_length() + 1):  # of the smaller set's size
            m = max(1, (1 << (bits - 1)) // p.spread)
            alone = alone or least < m + 1
            group = (mix64(f ^ np.uint64(0xA5A5A5A5)) % np.uint64(m)).astype(np.int64)
            first = np.zeros(len(f), np.int64)
            first[np.unique(group, return_index=True)[1]] = 1
            # before this gram at most one of each class is shared
            most = left + np.cumsum(first) - first
            order = np.argsort(group, kind="stable")
            order = order[most[order] >= least]
            group = group[order]
            for step in range(1, len(order)):
                same = np.flatnonzero(group[step:] == group[:-step])
                if not len(same):
                    break
                x, y = order[same], order[same + step]
                keys.append(mix64(mix64(f[x] + np.uint64(bits)) + f[y]))
                rooms.append(most[y])
        if alone:
            keys.append(f[left >= least])
            rooms.append(left[left >= least])
    return np.concatenate(keys), np.concatenate(rooms)


def _posts(nodes: DataFrame, planes: Planes, p: Params) -> DataFrame:
    """Rows (key, id, n, room) of the representatives."""
    held = nodes.sparkSession.sparkContext.broadcast(planes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = held.value
        for b in batches:
            ids, ns, keys, rooms, sizes, total = b.column(0).to_numpy(), b.column(1).to_numpy(), [], [], [], 0

            def made(upto: int) -> pa.RecordBatch:
                lo = upto - len(sizes)
                cols = [np.concatenate(keys).view(np.int64), np.repeat(ids[lo:upto], sizes), np.repeat(ns[lo:upto], sizes).astype(np.int32), np.concatenate(rooms).astype(np.int32)]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "id", "n", "room"])

            for d, blob in enumerate(b.column(2)):
                g = np.frombuffer(blob.as_buffer(), np.uint64)
                level = np.zeros(len(g), np.int64)
                for k in range(len(p.levels)):
                    level += planes.reached(g, k)
                k, r = postings(g, level, int(ns[d]), p)
                keys.append(k)
                rooms.append(r)
                sizes.append(len(k))
                total += len(k)
                if total > 1 << 16:
                    yield made(d + 1)
                    keys, rooms, sizes, total = [], [], [], 0
            if sizes:
                yield made(b.num_rows)

    return nodes.select("id", "n", "grams").mapInArrow(run, "key long, id long, n int, room int")


def _links(pairs: DataFrame, nodes: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = b.column(0), b.column(1)
            ok = []
            for size, x, y in zip(b.column(2).to_pylist(), b.column(3), b.column(4), strict=True):
                both = np.sort(np.concatenate([np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y)]))
                same = int((both[1:] == both[:-1]).sum())
                ok.append(p.den * same >= p.num * (size - same))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), c.filter(mask)], names=["a", "b"])

    side = lambda k: nodes.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("grams").alias(f"g{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.expr("na + nb").alias("n"), "ga", "gb").mapInArrow(run, "a long, b long")


def _may_link(n: Column, room: Column, n2: Column, room2: Column, p: Params) -> Column:
    """Whether sets of such sizes, whose first shared key leaves so much room, can link."""
    return (F.least(n, n2) * p.den >= F.greatest(n, n2) * p.num) & (F.least(room, room2) * (p.num + p.den) >= (n + n2) * p.num)


def _placed(posts: DataFrame, comp: DataFrame) -> DataFrame:
    """posts (key, id, n, room) with the component c of each."""
    return posts.join(comp, posts.id == comp.node, "left").select("key", "id", "n", "room", F.coalesce("component", "id").alias("c"))


def _pivot_round(live: DataFrame, turn: int, pivots: int) -> DataFrame:
    """The rows of live (key, id, n, room, c) whose key joins different components, with the key's pivots."""
    spot = F.xxhash64("id", F.lit(turn)) if turn == 0 else F.xxhash64("id", "key", F.lit(turn))  # at first keys choose alike, then each for itself
    slots = live.withColumn("spot", spot).groupBy(F.struct("key").alias("k"), F.pmod("spot", F.lit(pivots)).alias("slot"))
    some = slots.agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min_by(F.struct("id", "n", "room", "c"), "spot").alias("pivot"))
    # grouped by a struct: the join has an exchange of its own on either side, whose skewed partitions can be split
    mixed = some.groupBy("k").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list("pivot").alias("pivots")).filter("low < high")
    return live.join(mixed.select("k.key", "pivots"), "key")


def _all_pairs(live: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) of different components that meet under a key and may link; one of the two is outside the key's largest component."""
    sizes = live.groupBy(F.struct("key").alias("k"), "c").agg(F.count("*").alias("s"))
    mixed = sizes.groupBy("k").agg(F.max_by("c", F.struct("s", "c")).alias("home"), F.count("*").alias("cs")).filter("cs > 1")
    rows = keep(live.join(mixed.select("k.key", "home"), "key").withColumn("out", F.col("c") != F.col("home")).drop("home"), "jaccard-mixed")
    # the smaller of two sets must have room for one as large as itself
    small = rows.filter(F.col("room") * (p.num + p.den) >= F.col("n") * (2 * p.num))
    large = rows.select("key", *(F.col(x).alias(f"{x}2") for x in ("id", "n", "room", "c", "out")))
    meets = (F.col("c") != F.col("c2")) & (F.struct("n", "id") < F.struct("n2", "id2")) & _may_link(*map(F.col, ("n", "room", "n2", "room2")), p)
    pairs = small.filter("out").join(large, "key").filter(meets).unionByName(small.filter("not out").join(large.filter("out2"), "key").filter(meets))
    return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def link_components(docs: DataFrame, params: Params | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_shingles, component_id) for every document: its set's size and the smallest id reachable by links.

    Documents with fewer words than a gram have their whole sequence as one
    gram; a null or empty text has none, size 0, and is its own component. A
    very long text is one set like any other. Rows with a null id keep their
    size, have a null component and link with nothing; rows of one id are one
    document to the links; an empty table gives an empty result. Ids are
    integers. Columns other than id and text are not read.
    """
    p = params or Params()
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    planes = build(rows.filter("id is not null").select("text"), _text_keys(p), width_for(text_bytes(rows) / _BYTES_A_WORD, 1.6, p.sketch_bits), 1, (2,))
    every = keep(_nodes(rows, planes, p), "jaccard-nodes")
    del planes
    able = every.filter("grams is not null and id is not null")
    classes = able.groupBy(F.struct("set_key", "n").alias("k")).agg(F.min("id").alias("rep"))
    members = keep(able.select("id", "set_key", "n").join(classes.select("k.set_key", "k.n", "rep"), ["set_key", "n"]).select("id", "rep").distinct(), "jaccard-members")
    # of rows of one id with different sets each set is one node of that id; their postings meet under the same id
    nodes = able.join(members.filter("id = rep").select("id").distinct(), "id", "left_semi").dropDuplicates(["id", "set_key"]).select("id", "n", "grams")
    nodes = keep(nodes, "jaccard-reps")
    grams = nodes.agg(F.sum(F.octet_length("grams").cast("long"))).first()[0] or 0
    fine = build(nodes.select("grams"), _blob_keys, width_for(grams / 8, 4, p.fine_bits), 1, p.levels)
    posts = keep(_posts(nodes, fine, p), "jaccard-posts")
    # ids with several sets tie the classes of these
    linked = keep(members.groupBy("id").agg(F.collect_set("rep").alias("reps")).filter(F.size("reps") > 1).select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).filter("a <> b"), "jaccard-links")
    live, tested = posts.withColumn("c", F.col("id")), None
    for turn, pivots in enumerate(p.pivots):
        met = keep(_pivot_round(live, turn, pivots), "jaccard-round")
        near = F.filter("pivots", lambda x: (x["c"] != F.col("c")) & _may_link(F.col("n"), F.col("room"), x["n"], x["room"], p))
        pairs = met.select("id", F.explode(near).alias("x")).select(F.least("id", "x.id").alias("a"), F.greatest("id", "x.id").alias("b")).distinct()
        pairs = keep(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "jaccard-pairs")
        tested = pairs if tested is None else tested.union(pairs)
        # labels need not be final here: they only spare tests
        linked = hooked(downward(linked.union(_links(pairs, nodes, p))))
        live = _placed(met.select("key", "id", "n", "room"), labels(linked))
    rest = _all_pairs(live, p)
    rest = keep(rest if tested is None else rest.join(tested, ["a", "b"], "left_anti"), "jaccard-pairs")
    comp = components(linked.union(_links(rest, nodes, p)))
    # a class has one row for each id; the component of a large class meets its rows in a join that can be split
    named = members.groupBy(F.struct("id").alias("k")).agg(F.min("rep").alias("rep")).select("k.id", "rep")
    placed = named.join(comp.groupBy(F.struct("node").alias("k")).agg(F.min("component").alias("component")).select(F.col("k.node").alias("rep"), "component"), "rep", "left")
    placed = placed.select("id", F.coalesce("component", "rep").alias("component"))
    out = every.select("id", "n").join(placed, "id", "left")
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").cast(kind).alias("component_id"))
