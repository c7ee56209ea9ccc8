"""Maintained aggregates against a full recompute after each batch."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from prismfeed.operators import views
from prismfeed.plans import proxy as P

SCHEMA = "cluster_id long, article_id long, bias string, published_at timestamp"


def facts(df):
    return sorted((r.cluster_id, r.article_count, sorted(r.bias_distribution.items()), r.is_blindspot, r.blindspot_side, r.first_published) for r in df.collect())


def test_view_follows_each_batch(spark, tmp_path):
    rng = random.Random(4)
    t0 = datetime(2024, 1, 1)
    facts_of = {a: (rng.choice(["center", "opposition", "nationalist", None, "unheard of"]), t0 + timedelta(minutes=rng.randrange(5000))) for a in range(60)}
    pairs = [(rng.randrange(12), rng.randrange(60)) for _ in range(240)]
    batches = [[(c, a, *facts_of[a]) for c, a in pairs[k::6]] + [(None, 1, "center", t0), (3, None, "center", t0)] for k in range(6)]
    view = views.LinkedClusters(spark, str(tmp_path / "v"), fold_every=2).create()
    assert view.clusters().count() == 0
    seen, stamp = [], {}
    for epoch, rows in enumerate(batches):
        now = t0 + timedelta(days=10, hours=epoch)
        for _ in range(1 + (epoch in (1, 3))):  # two of them are delivered twice
            view.apply(spark.createDataFrame(rows, SCHEMA), epoch, F.lit(now))
        seen += rows
        stamp |= {c: now for c, a, *_ in rows if c is not None and a is not None}
        assert facts(view.clusters()) == facts(views.recomputed(spark.createDataFrame(seen, SCHEMA)))
        assert {r.cluster_id: r.updated_at for r in view.clusters().collect()} == stamp
        assert view.links().count() == len({(c, a) for c, a, *_ in seen if c is not None and a is not None})
    before = facts(view.clusters())
    view.apply(spark.createDataFrame([(99, 1, "center", t0)], SCHEMA), 2, F.lit(t0))  # older than the newest epoch
    assert facts(view.clusters()) == before and len(view.epochs()) <= 3


def test_only_touched_clusters_are_written(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    view = views.LinkedClusters(spark, str(tmp_path / "v")).create()
    view.apply(spark.createDataFrame([(c, c, "center", t0) for c in range(50)], SCHEMA), 0, F.lit(t0))
    view.apply(spark.createDataFrame([(7, 1, "opposition", t0), (8, 8, "center", t0)], SCHEMA), 1, F.lit(t0 + timedelta(hours=1)))
    assert sorted(r.cluster_id for r in spark.read.parquet(str(tmp_path / "v/clusters/epoch=1")).collect()) == [7, 8] and spark.read.parquet(str(tmp_path / "v/links/epoch=1")).count() == 1
    got = {r.cluster_id: r for r in view.clusters().collect()}
    assert got[7].article_count == 2 and not got[7].is_blindspot and got[8].article_count == 1 and got[8].updated_at == t0 + timedelta(hours=1) and got[9].updated_at == t0


def test_an_epoch_without_its_commit_is_not_read(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    view = views.LinkedClusters(spark, str(tmp_path / "v")).create()
    view._commit = lambda epoch, folded: (_ for _ in ()).throw(OSError("lost"))
    try:
        view.apply(spark.createDataFrame([(1, 1, "center", t0)], SCHEMA), 0, F.lit(t0))
    except OSError:
        pass
    again = views.LinkedClusters(spark, str(tmp_path / "v"))
    assert again.clusters().count() == 0 and again.links().count() == 0
    again.apply(spark.createDataFrame([(1, 1, "center", t0)], SCHEMA), 0, F.lit(t0))
    assert again.clusters().count() == 1


def test_member_ids_are_distinct(spark):
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        ids = P.members(spark, f"/root/testdata/{sf}").select("id")
        assert ids.distinct().count() == ids.count()
