"""Top clusters by common entities, with hot ones and without, against brute force."""

import random

import pytest

from prismfeed.operators import clustering as C


@pytest.mark.parametrize("hot", [0, 3, 25, 10_000])
def test_best_clusters_against_brute_force(spark, hot):
    rng = random.Random(hot)
    common, rare = ["h1", "h2", "h3", "h4"], [f"r{i}" for i in range(60)]
    draw = lambda: sorted({*[e for e in common if rng.random() < 0.5], *rng.sample(rare, rng.randrange(4))})
    members = [(rng.randrange(120), draw()) for _ in range(200)] + [(500 + i, ["h1", "h2"]) for i in range(60)] + [(900, []), (901, None)]
    articles = [(i, draw()) for i in range(80)] + [(100, ["h1", "h2"]), (101, ["h1"]), (102, []), (103, None), (104, ["h2", "h2", "unheard"]), (105, common)]
    held = {}
    for k, e in members:
        held.setdefault(k, set()).update(e or [])
    want = set()
    for i, e in articles:
        counts = sorted(((-len({*(e or [])} & h), k) for k, h in held.items() if len({*(e or [])} & h) >= 2))[:7]
        want |= {(i, k, -c, r) for r, (c, k) in enumerate(counts, 1)}
    got = C.best_clusters(spark.createDataFrame(articles, "id long, entities array<string>"), spark.createDataFrame(members, "cluster_id long, entities array<string>"), n=7, hot=hot)
    assert {(r.id, r.cluster_id, r.shared, r.place) for r in got.collect()} == want


def test_candidates_are_counted_not_paired(spark):
    rng = random.Random(4)
    draw = lambda: sorted(rng.sample([f"e{i}" for i in range(12)], rng.randrange(7)))
    members = [(k, draw(), rng.choice(["f1", "f2", None])) for k in range(30) for _ in range(2)] + [(77, None, "f1")]
    articles = [(i, draw(), rng.choice(["f1", "f3", None])) for i in range(60)] + [(100, [], "f2"), (101, None, None)]
    want = set()
    for i, own, f in articles:
        weight = {}
        for k in {k for k, _, _ in members}:
            held = {e for c, es, _ in members if c == k for e in es or []}
            shared = len({*(own or [])} & held)
            if f is not None and any(c == k and g == f for c, _, g in members):
                weight[k] = 1 << 30
            elif shared >= 2:
                weight[k] = shared
        want |= {(i, k, w, r) for r, (k, w) in enumerate(sorted(weight.items(), key=lambda x: (-x[1], x[0]))[:5], 1)}
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, entities array<string>, strict string")
    got = C.candidates(frame(articles, "id"), frame(members, "cluster_id"), n=5)
    assert {(r.id, r.cluster_id, r.weight, r.place) for r in got.collect()} == want
    counted = C.candidates(frame(articles, "id"), frame(members, "cluster_id"), n=5)._jdf.queryExecution().optimizedPlan().toString()
    assert counted.count("Join") == 1  # fingerprints meet in a join, entities in none


@pytest.mark.parametrize("least", [1, 2, 3])
def test_articles_meet_by_two_entities(spark, least):
    from datetime import datetime, timedelta

    rng = random.Random(least)
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=rng.randrange(130)), sorted(rng.sample("abcdefghij", rng.randrange(6)))) for i in range(80)] + [(90, datetime(2024, 1, 2), None)]
    want = {(i, j, n) for i, t, x in rows for j, u, y in rows if i < j and abs(t - u) <= timedelta(hours=48) and (n := len({*(x or [])} & {*(y or [])})) >= least}
    got = C.entity_pairs(spark.createDataFrame(rows, "id long, published_at timestamp, entities array<string>"), least)
    assert {tuple(r) for r in got.collect()} == want
    if least > 1:  # one hot entity that all hold makes no rows that are dropped afterwards
        hot = spark.createDataFrame([(i, datetime(2024, 1, 1), ["hot", f"e{i}"]) for i in range(300)], "id long, published_at timestamp, entities array<string>")
        assert C.entity_pairs(hot, least).isEmpty()


def test_top_clusters_of_articles_read_entities_alone(spark, monkeypatch):
    from prismfeed.plans.catalog import QUERIES

    def unasked(*_):
        raise AssertionError("fingerprints and signatures are not asked for")

    monkeypatch.setattr(C, "features", unasked)
    got = QUERIES["jn_entity_top20"](spark, "/root/testdata/sf0.001").collect()
    assert got and all(r.shared >= C.SHARED for r in got)
