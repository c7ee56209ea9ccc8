"""Whitening, toxicity and ranked search against brute force, exact arithmetic and held-out labels, odd tables among them."""

import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismfeed.llm import queries as Q
from prismfeed.llm import toxicity as T
from prismfeed.llm._words import ALNUM, word_tables
from prismfeed.llm.wand import Heap, Shard, search, wand
from prismfeed.llm.whitening import Centre, dd_add, eigen, outer_sums, two_product, two_sum, whiten

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# whitening


@given(st.floats(-1e100, 1e100), st.floats(-1e100, 1e100))
@settings(max_examples=200, deadline=None)
def test_transformations_are_error_free(a, b):
    s, e = two_sum(np.array([a]), np.array([b]))
    assert Fraction(float(s[0])) + Fraction(float(e[0])) == Fraction(a) + Fraction(b)
    if 1e-100 < abs(a * b) < 1e190:
        p, e = two_product(np.array([a]), np.array([b]))
        assert Fraction(float(p[0])) + Fraction(float(e[0])) == Fraction(a) * Fraction(b)


def test_covariance_keeps_more_than_double_precision():
    rng = np.random.default_rng(1)
    x = rng.integers(-10**9, 10**9, (301, 3)) * np.array([1, 1, 0]) + 10**12 + rng.integers(0, 3, (301, 3))
    n, sums = len(x), [int(v) for v in x.sum(axis=0)]
    total = outer_sums(*Centre(n, sums).less(x), (np.zeros((4, 6)), np.zeros((4, 6))))
    h, l = total[0][0], total[1][0]
    for a, b in zip(total[0][1:], total[1][1:], strict=True):
        h, l = dd_add(h, l, a, b)
    for (i, j), a, b in zip([(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)], h, l, strict=True):
        want = sum((int(r[i]) - Fraction(sums[i], n)) * (int(r[j]) - Fraction(sums[j], n)) for r in x)
        size = math.sqrt(sum(float((int(r[i]) - Fraction(sums[i], n)) ** 2) for r in x) * sum(float((int(r[j]) - Fraction(sums[j], n)) ** 2) for r in x))
        assert abs(Fraction(float(a)) + Fraction(float(b)) - want) <= Fraction(size) / 10**26


def test_eigen_solve_on_hard_matrices():
    rng = np.random.default_rng(0)
    for t in range(160):
        n = int(rng.integers(1, 60))
        a = rng.normal(size=(n, n))
        q, _ = np.linalg.qr(a)
        a = [a + a.T, np.eye(n) * 3, (x := rng.normal(size=(n, max(1, n // 2)))) @ x.T, np.diag(rng.integers(0, 3, n)).astype(float), q @ np.diag(10.0 ** rng.uniform(-12, 6, n)) @ q.T, q @ np.diag(1 + 1e-10 * rng.normal(size=n)) @ q.T, np.zeros((n, n)), np.ones((n, n))][t % 8]
        a = (a + a.T) / 2
        w, v = eigen(a)
        size = max(np.abs(a).max() * n, 1e-300)
        assert (np.diff(w) <= 0).all() and np.abs(w - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * size
        assert np.abs(v.T @ v - np.eye(n)).max() < 1e-12 and np.abs(a @ v - v * w).max() <= 1e-13 * size


def test_whitening_query_against_numpy(spark):
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    x = np.floor(64 * np.stack(e.embedding).astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    w, v = np.linalg.eigh(centred.T @ centred / n)
    w, v = w[::-1], v[:, ::-1]
    got = Q.op11_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and len(got) == 32 * n
    order = np.argsort(e.vec_id.to_numpy())
    z = got.whitened.to_numpy().reshape(n, 32)
    want = (centred @ v[:, :32] / np.sqrt(w[:32]))[order]
    assert np.abs(z * np.sign((z * want).sum(axis=0)) - want).max() < 1e-9
    assert (got.deviation.to_numpy().reshape(n, 32) == ((n * x - s) ** 2).sum(axis=1)[order][:, None]).all()
    assert np.allclose(got.explained.to_numpy().reshape(n, 32), w[:32] / w.sum(), rtol=1e-9) and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9 and (got.n == n).all()


def test_whitening_of_odd_tables(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 0.0]), (7, [float("inf"), 0.0]), (8, []), (9, [1.0, 2.0, 3.0]), (10, [0.0, 0.0]), (11, [2.0, 2.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    wide = df.select("*", *[F.lit("x").alias(c) for c in ("N", "Deviation", "row", "a.b", "d", "v")])
    got = sorted(whiten(df).collect(), key=str)
    assert [r.vec_id for r in sorted(got, key=lambda r: (r.vec_id is None, r.vec_id))] == [1, 1, 10, 11, None] and {r.n for r in got} == {5} and all(len(r.whitened) == 2 for r in got)
    lean = sorted(map(str, [(r.vec_id, r.deviation, r.n) for r in got]))
    assert sorted(map(str, [(r.vec_id, r.deviation, r.n) for r in whiten(wide).collect()])) == lean and "a.b" in whiten(wide).columns
    assert whiten(df.filter("false")).count() == 0 and whiten(df.filter("vec_id = 4")).count() == 0
    flat = whiten(spark.createDataFrame([(i, [1.5, float(i)]) for i in range(4)], "vec_id long, embedding array<double>")).collect()
    assert all(r.whitened[0] is not None and r.whitened[1] is None and list(r.explained) == [1.0, 0.0] for r in flat)
    same = whiten(spark.createDataFrame([(i, [1.5, 2.5]) for i in range(3)], "vec_id long, embedding array<double>")).collect()
    assert all(r.whitened == [None, None] and r.deviation == 0 and r.identity_error == 0 for r in same)
    huge = whiten(spark.createDataFrame([(0, [1e300]), (1, [-1e300]), (2, [1e12])], "vec_id long, embedding array<double>")).collect()
    x = [(1 << 53), 2 * 1_000_000 - (1 << 53), 64 * 10**12 + 1_000_000]
    assert {r.vec_id: int(r.deviation) for r in huge} == {i: (3 * v - sum(x)) ** 2 for i, v in enumerate(x)}


# ranked search


def brute_search(docs, items, k):
    terms = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n, total = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    asked = {}
    for q, t in items:
        asked.setdefault(q, set()).update(TERM.findall(lower(t)))
    out = []
    for q, ts in asked.items():
        scored = []
        for i, c in terms:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(q, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def test_search_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(map(tuple, Q.op13_ranked_search(spark, SF).collect()), key=str) == brute_search(docs, items, 50)
    d, q = spark.read.parquet(f"{SF}/documents.parquet").repartition(5), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert sorted(map(tuple, search(d, q, k=7, query_bytes=2000, shard_postings=300, window=16).collect()), key=str) == brute_search(docs, items, 7)


def test_pivots_skip_documents_and_lose_none():
    rng = np.random.default_rng(3)
    for window in (1, 3, 64):
        skipped = 0
        for _ in range(40):
            n, t = 400, 9
            there = rng.random((n, t)) < rng.choice([0.9, 0.3, 0.02], t)
            doc, term = np.nonzero(there)
            impact = rng.integers(1, 50, len(doc)) * np.where(rng.random(t) < 0.4, 40, 1)[term]
            ids = rng.permutation(n).astype(np.int64)
            heap = Heap(5)
            score = np.bincount(doc, impact, n).astype(np.int64)
            scored = wand(Shard(ids, np.zeros(n, bool), doc, term, impact), np.arange(t), heap, window)
            best = np.lexsort((ids, -score))[:5]
            best = best[score[best] > 0]
            assert heap.rows[0].tolist() == score[best].tolist() and heap.rows[2].tolist() == ids[best].tolist()
            skipped += there.any(axis=1).sum() - scored
        assert skipped > 0


def test_search_of_odd_tables(spark):
    same = "alpha beta gamma"
    docs = [(None, same), (1, same), (1, same), (2, same), (3, None), (4, ""), (5, " .,;"), (6, "ALPHA " * 30_000), (7, "Ärger beta"), (-3, same), (8, "x" * 200_000)]
    items = [(1, "Alpha alpha"), (1, "BETA"), (None, "gamma"), (2, None), (3, "--"), (4, "Ärger unheard"), (5, "x" * 200_000)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = brute_search(docs, items, 3)
    assert sorted(map(tuple, search(d, q, k=3).collect()), key=str) == want
    wide_d, wide_q = (x.select("*", *[F.lit("y").alias(c) for c in ("n", "terms", "id", "score", "a.b", "rank")]) for x in (d, q))
    assert sorted(map(tuple, search(wide_d, wide_q, k=3).collect()), key=str) == want
    assert search(d.filter("false"), q).count() == 0 and search(d, q.filter("false")).count() == 0 and search(d.filter("doc_id = 3"), q).count() == 0
    named = search(d, q.withColumn("item_id", F.concat(F.lit("q"), F.col("item_id").cast("string"))), k=1)
    assert named.schema["item_id"].dataType.simpleString() == "string" and named.filter("item_id = 'q1'").count() == 1


# toxicity


def brute_ratio(words, order, d=0.75):
    """A function of a word: its log-likelihood ratio, from (word, class, count), all by dictionaries."""
    hi, ctx, types = ([Counter(), Counter()] for _ in range(3))
    cut = lambda w: [(b" " * (order - 1) + w + b" ")[i : i + order] for i in range(len(w) + 1)]
    for w, y, n in words:
        for g in cut(w):
            hi[y][g] += n
    for y in (0, 1):
        for g, n in hi[y].items():
            ctx[y][g[:-1]] += n
            types[y][g[:-1]] += 1
    grams, low = {*hi[0], *hi[1]}, {}
    for k in range(order - 1, 0, -1):
        low[k] = Counter(g[1:] for g in grams)
        grams = {*low[k]}

    def shared(g):
        if not g:
            return 1 / 256
        row = [(x, n) for x, n in low[len(g)].items() if x[:-1] == g[:-1]]
        total = sum(n for _, n in row)
        return (max(low[len(g)][g] - d, 0) + d * len(row) * shared(g[1:])) / total if total else shared(g[1:])

    def p(g, y):
        n = ctx[y][g[:-1]]
        return (max(hi[y][g] - d, 0) + d * types[y][g[:-1]] * shared(g[1:])) / n if n else shared(g[1:])

    return lambda w: sum(math.log(p(g, 1) / p(g, 0)) for g in cut(w))


def tables(text):
    return next(iter(word_tables(pa.array([text]), ALNUM, lower=True)))


def test_ratios_against_dictionaries():
    said = [(b"moron", 1, 5), (b"morons", 1, 1), (b"more", 0, 9), (b"more", 1, 2), (b"mor", 0, 1), (b"a", 0, 30), (b"a", 1, 3), ("öde".encode(), 1, 2), (b"supercalifragilistic", 0, 1)]
    by = {}
    for w, y, n in said:
        words = tables(w.decode())
        for g in T.word_grams(words, np.arange(1))[0].tolist():
            by.setdefault(g, [0, 0])[y] += n
    grams = np.array(sorted(by), np.uint64)
    of = T.Ratios(grams, *(x[:, None] for x in T.ratios(grams, np.array([by[g] for g in grams.tolist()]).T)))
    want = brute_ratio(said, T.ORDER)
    texts = "moron morons moronic more mor a öde ödes supercalifragilisticx unheard b"
    got = of.words(tables(texts), 0)
    assert np.allclose(got, [want(w.encode()) for w in texts.split()], atol=1e-9) and got[0] > 1 and got[3] < 0


def test_features():
    w = next(iter(word_tables(pa.array(["a b c", None, "d", " "]), ALNUM)))
    got = T.features(w, np.array([1.0, 5.0, -3.0, 2.0]))
    assert np.allclose(got, [[5, 3, 1, 1, math.log(4)], [0] * 5, [2, 2, 2, 2, math.log(2)], [0] * 5])


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = Q.op12_toxicity(spark, sf).toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"] and len(got) == 10_000 and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    held = got[got.held_out].merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    assert toxic.predicted.mean() >= 0.85 and clean.predicted.mean() <= 0.015
    rank = held.score.rank()
    assert (rank[held.toxic == 1].sum() - len(toxic) * (len(toxic) + 1) / 2) / len(toxic) / len(clean) > 0.95


def test_toxicity_of_odd_tables(spark):
    mean, kind = "you vile wretch and wretched thing", "a quiet day by the river with old friends"
    docs = [(i, f"{mean} {i}" if i % 2 else f"{kind} {i}") for i in range(40)] + [(None, mean), (50, None), (51, ""), (52, "!!"), (1, mean + " 1"), (53, kind * 9000), (60, mean), (60, kind)]
    labels = [(i, i % 2) for i in range(40)] + [(None, 1), (50, 1), (51, 1), (52, 0), (53, 0), (7, None), (3, 0), (60, 1), (999, 1)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.train(d, lab)
    lean = sorted(map(str, map(tuple, T.score_toxicity(d, model).collect())))
    scores = {(r.doc_id, r.text): r.score for r in T.score_toxicity(d, model).collect()}
    assert len(lean) == len(docs) and scores[5, f"{mean} 5"] > 0.5 > scores[8, f"{kind} 8"] and scores[53, kind * 9000] < 0.5 and scores[50, None] == scores[51, ""] == scores[52, "!!"] == model.prior
    wide = d.select("*", *[F.lit("x").alias(c) for c in ("u", "y", "t", "a.b", "toxic")])
    assert sorted(map(str, [(r.doc_id, r.text, r.score) for r in T.score_toxicity(wide, T.train(wide, lab.withColumn("text", F.lit("z")))).collect()])) == lean
    with pytest.raises(ValueError):
        T.score_toxicity(d.withColumn("Score", F.lit(1)), model)
    assert T.score_toxicity(d.filter("false"), model).count() == 0
    for labelled, want in ((lab.filter("false"), 0.0), (lab.filter("toxic = 1"), 1.0), (lab.filter("toxic = 0"), 0.0)):
        assert {r.score for r in T.score_toxicity(d, T.train(d, labelled)).collect()} == {want}
    small = T.train(d, lab, train_bytes=400)  # the bound holds, the result is defined
    assert small.ratio.grams.size < model.ratio.grams.size and all(0 <= r.score <= 1 for r in T.score_toxicity(d, small).collect())
