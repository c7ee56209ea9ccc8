"""Grouping articles that cover one story: features, TF-IDF, candidates, scores, assignment.

Articles are rows (id, title, description, slug, published_at); members of known
clusters are rows (cluster_id, id, source_id, published_at and features).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismfeed.functions import scalar, text
from prismfeed.operators.graph import components
from prismfeed.staging import staged

# Entities that a candidate shares, candidates of an article, clusters looked at, share of the match score from which fallbacks are taken.
SHARED, CANDIDATES, CONTEXT, FLOOR = 2, 20, 60, 0.9 * scalar.MATCH
#: Stems that a task remembers.
_STEMS = 1 << 18
#: Clusters beyond which an entity is hot.
HOT = 1000


def features(articles: DataFrame) -> DataFrame:
    """Articles with norm, strict, signature and entities."""
    joined = text.joined_text(F.col("title"), F.col("description"))
    normed = articles.withColumn("norm", text.normalize_turkish(joined)).withColumn("entities", text.extract_entities(joined))
    return normed.withColumn("strict", text.strict_fingerprint(F.col("norm"))).withColumn("signature", text.minhash(F.col("norm")))


def terms(docs: DataFrame, norm: str = "norm") -> DataFrame:
    """(id, term, tf) of stemmed words."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems: dict[str, str] = {}
        for whole in batches:
            for b in (whole.slice(lo, 256) for lo in range(0, whole.num_rows, 256)):
                if len(stems) > _STEMS:
                    stems.clear()
                row, term, tf = [], [], []
                for k, t in enumerate(b.column(1).to_pylist()):
                    counts: dict[str, int] = {}
                    for w, n in Counter(t.split(" ") if t else ()).items():
                        if w:
                            s = stems.get(w) or stems.setdefault(w, text.stem(w))
                            counts[s] = counts.get(s, 0) + n
                    row += [k] * len(counts)
                    term += counts
                    tf += counts.values()
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int32())), pa.array(term, pa.string()), pa.array(tf, pa.int64())], names=["id", "term", "tf"])

    return docs.select("id", norm).mapInArrow(run, f"id {kind}, term string, tf long").groupBy("id", "term").agg(F.sum("tf").alias("tf"))


def tfidf(docs: DataFrame, norm: str = "norm") -> DataFrame:
    """(id, term, w, norm): weights tf * (ln((N + 1) / (df + 1)) + 1) and the length of each vector. Empty documents count for N."""
    tf = staged(terms(docs, norm), "terms")
    total = docs.agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighed = tf.join(df, "term").join(F.broadcast(total)).select("id", "term", (F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)).alias("w"))  # one row
    # a document's terms come together once: its length is taken beside them, not joined to them
    return weighed.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id"))))


def cosines(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) of given pairs: their vectors meet term by term, so no term's documents are paired beyond them."""
    left = vectors.select(F.col("id").alias("a"), "term", F.col("w").alias("wa"), F.col("norm").alias("na"))
    right = vectors.select(F.col("id").alias("b"), "term", F.col("w").alias("wb"), F.col("norm").alias("nb"))
    dots = pairs.select("a", "b").join(left, "a").join(right, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb") / (F.col("na") * F.col("nb"))).alias("cosine"))
    return pairs.select("a", "b").join(dots, ["a", "b"], "left").select("a", "b", F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def entity_pairs(articles: DataFrame, least: int = SHARED, hours: int = scalar.WINDOW_HOURS) -> DataFrame:
    """(a, b, shared) of articles published within `hours` of each other with `least` common entities.

    Articles meet in time bands, and by an entity that counts only there, so what
    a hot entity makes grows with the articles of three bands and not of all time.
    Where two entities are asked for, articles meet by two entities at once: only
    those that are a pair meet, s(s - 1) / 2 times if they share s.
    """
    twos = least >= 2
    own = F.array_sort(F.array_distinct("entities"))
    both = F.flatten(F.transform(own, lambda x, i: F.transform(F.slice(own, i + 2, F.size(own)), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    at = F.unix_micros("published_at")
    width = hours * 3_600_000_000
    listed = articles.select("id", at.alias("at"), F.floor(at / width).alias("band"), F.explode(both if twos else own).alias("e"))
    ea = listed.select(F.col("id").alias("a"), F.col("at").alias("ta"), "band", "e")
    eb = listed.select(F.col("id").alias("b"), F.col("at").alias("tb"), F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band"), "e")
    near = ea.join(eb, ["band", "e"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) <= width))
    met = F.count("*")
    shared = F.round((1 + F.sqrt(1 + 8 * met)) / 2).cast("long") if twos else met
    return near.groupBy("a", "b").agg(shared.alias("shared")).filter(F.col("shared") >= least)


def fingerprint_pairs(articles: DataFrame) -> DataFrame:
    """(a, b) of each article b and the first holder a of its fingerprint, at any distance in time; no group is expanded into all pairs."""
    held = articles.filter("strict is not null").select("id", "strict")
    first = held.groupBy(F.struct("strict").alias("k")).agg(F.min("id").alias("a")).select("k.strict", "a")
    return held.join(first, "strict").filter("id > a").select("a", F.col("id").alias("b"))


def recent_clusters(members: DataFrame, now: Column, n: int = CONTEXT, hours: int = scalar.WINDOW_HOURS) -> DataFrame:
    """The members of the newest n clusters with a member of the last `hours`; members: (cluster_id, id, published_at, ...)."""
    newest = members.groupBy("cluster_id").agg(F.max("published_at").alias("updated_at")).filter(scalar.hours_between(now, F.col("updated_at")) <= hours)
    return members.join(F.broadcast(newest.orderBy(F.desc("updated_at"), "cluster_id").limit(n).select("cluster_id")), "cluster_id")  # n rows


def candidates(articles: DataFrame, members: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """(id, cluster_id, weight, place): clusters that share a fingerprint or enough entities with a member, the best n for each article.

    members are those of a bounded number of clusters, as recent_clusters gives them.
    """
    fp = articles.filter("strict is not null").select("id", "strict").join(members.select("cluster_id", "strict").distinct(), "strict").select("id", "cluster_id").distinct().withColumn("weight", F.lit(1 << 30))
    ids, holders = [], {}
    for r in members.select("cluster_id", F.explode("entities").alias("e")).groupBy("cluster_id").agg(F.sort_array(F.collect_set("e")).alias("e")).collect():  # a bounded number of clusters, of listed words, years and shares
        for e in r.e:
            holders.setdefault(e, []).append(len(ids))
        ids.append(r.cluster_id)
    kind = members.schema["cluster_id"].dataType

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("cluster_id", kind), T.StructField("weight", T.IntegerType())])))
    def nearest(entities: pd.Series) -> pd.Series:
        """The best n by common entities of each article: counted, not paired with every cluster that holds a word."""

        def best(own) -> list[dict]:
            met = Counter(k for e in (own if own is not None else ()) for k in holders.get(e, ()))
            some = sorted(((-w, ids[k]) for k, w in met.items() if w >= SHARED))[:n]
            return [{"cluster_id": c, "weight": -w} for w, c in some]

        return pd.Series([best(own) for own in entities], dtype=object)

    by = articles.select("id", F.explode(nearest("entities")).alias("c")).select("id", "c.cluster_id", "c.weight")
    both = fp.union(by).repartition("id").groupBy("id", "cluster_id").agg(F.max("weight").alias("weight"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "cluster_id"))
    return both.withColumn("place", place).filter(F.col("place") <= n)


def best_clusters(articles: DataFrame, members: DataFrame, n: int = CANDIDATES, least: int = SHARED, hot: int = HOT) -> DataFrame:
    """(id, cluster_id, shared, place): for each article (id, entities) the n clusters of most entities in common, `least` at least, the smaller id among equals.

    members: (cluster_id, entities). A top-k search over an inverted index of the
    clusters, rare entities first. An entity of more than `hot` clusters is hot;
    postings of all others are read, which finds each cluster that shares a rare
    entity with the article, and its exact count. What is left shares hot
    entities only, at most as many as the article has: an article whose n-th best
    beats that bound is done. For the others clusters are told apart by their hot
    part alone. Of each such part the n smallest ids are enough, as a cluster of
    the same part that was found before counts more; so neither a hot entity nor
    a hot pair of them ever lists its clusters.
    """
    sets = members.select("cluster_id", F.explode("entities").alias("e")).distinct()
    df = sets.groupBy("e").agg(F.count("*").alias("df"))
    hot_words = df.filter(F.col("df") > hot).select("e", F.lit(True).alias("hot"))  # fewer than postings / hot
    marked = staged(sets.join(hot_words, "e", "left").select("cluster_id", "e", F.coalesce("hot", F.lit(False)).alias("hot")), "postings")
    asked = articles.select("id", F.explode(F.array_distinct("entities")).alias("e"))
    wanted = staged(asked.join(df, "e").select("id", "e", (F.col("df") > hot).alias("hot")), "asked")
    by_cluster = marked.groupBy("cluster_id").agg(F.collect_set("e").alias("held"))
    by_article = wanted.groupBy("id").agg(F.collect_set("e").alias("own"), F.sort_array(F.collect_set(F.when(F.col("hot"), F.col("e")))).alias("part"))
    met = wanted.filter("not hot").join(marked.filter("not hot").select("cluster_id", "e"), "e").select("id", "cluster_id").distinct()
    shared = F.size(F.array_intersect("own", "held"))
    rare = staged(met.join(by_article, "id").join(by_cluster, "cluster_id").select("id", "cluster_id", shared.alias("shared"), F.size("part").alias("bound")).filter(F.col("shared") >= least), "rare")
    done = rare.filter(F.col("shared") > F.col("bound")).groupBy("id").agg(F.count("*").alias("ahead")).filter(F.col("ahead") >= n).select("id")
    left = by_article.filter(F.size("part") >= least).join(done, "id", "left_anti").select("id", "part")
    parts = marked.filter("hot").groupBy("cluster_id").agg(F.sort_array(F.collect_set("e")).alias("part")).filter(F.size("part") >= least)
    place = F.row_number().over(Window.partitionBy("part").orderBy("cluster_id"))
    groups = staged(parts.withColumn("place", place).filter(F.col("place") <= n).groupBy("part").agg(F.collect_list("cluster_id").alias("ids")), "parts")  # n ids at most
    asks = left.select(F.col("part").alias("mine")).distinct()
    first_two = lambda c: F.explode(F.flatten(F.transform(F.col(c), lambda x, i: F.transform(F.slice(F.col(c), i + 2, F.size(c)), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("pair")
    keys = (asks.select("mine", first_two("mine")).join(groups.select("part", first_two("part")), "pair").select("mine", "part").distinct()) if least >= 2 else asks.join(groups.select("part"), F.arrays_overlap("mine", "part"))
    alike = keys.withColumn("shared", F.size(F.array_intersect("mine", "part"))).filter(F.col("shared") >= least).join(groups, "part")
    ranked = alike.select("mine", "shared", F.explode("ids").alias("cluster_id"))
    best = Window.partitionBy("mine").orderBy(F.desc("shared"), "cluster_id")
    short = ranked.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= n)
    common = left.join(short, left.part == short.mine).select("id", "cluster_id", "shared")
    both = rare.select("id", "cluster_id", "shared").union(common).groupBy("id", "cluster_id").agg(F.max("shared").alias("shared"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("shared"), "cluster_id"))
    return both.withColumn("place", place).filter(F.col("place") <= n)


def could_match(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float = scalar.MATCH) -> DataFrame:
    """The pairs (a, b) whose score would reach the threshold if their words agreed in full: what the cosine is worth computing for."""
    most = score_pairs(pairs, left, right, pairs.select("a", "b", F.lit(1.0).alias("cosine")))
    return most.filter(F.col("s.score") >= threshold - 1e-9).select("a", "b")


def score_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, cosine: DataFrame) -> DataFrame:
    """(a, b, hours, s: the score's components) of pairs (a, b); the features come with `features`."""
    cols = ("strict", "signature", "entities", "slug", "published_at")
    la = left.select(F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    rb = right.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    all_ = pairs.join(la, "a").join(rb, "b").join(cosine, ["a", "b"], "left")
    shared = F.size(F.array_intersect("entities_a", "entities_b"))
    hours = scalar.hours_between(F.col("published_at_a"), F.col("published_at_b"))
    s = scalar.pair_score(
        F.col("strict_a"), F.col("strict_b"), text.signature_jaccard(F.col("signature_a"), F.col("signature_b")), shared, F.size("entities_a"), F.size("entities_b"), F.coalesce("cosine", F.lit(0.0)), hours, F.col("slug_a"), F.col("slug_b")
    )
    return all_.select("a", "b", hours.alias("hours"), s.alias("s"))


def best_match(scored: DataFrame, threshold: float = scalar.MATCH) -> DataFrame:
    """For each article a the other b of the highest score at the threshold, the smaller id among equals."""
    return scored.filter(F.col("s.score") >= threshold).groupBy("a").agg(F.max_by(F.struct("b", F.col("s.score").alias("score")), F.struct(F.col("s.score").alias("x"), (-F.col("b")).alias("y"))).alias("m")).select("a", "m.b", "m.score")


def assign_greedily(articles: DataFrame, scored: DataFrame) -> DataFrame:
    """(id, cluster_id): articles in order of time join a cluster or found one.

    An article joins the first cluster that holds its fingerprint and lacks its
    source, at any distance in time. Else the clusters whose first member (seed)
    lies within the window are scored by the better of their seed and their latest
    member; if the best reaches the match score, the article joins the first, in
    order of score, that lacks its source, down to the floor. Else it founds one.

    Only links at the floor or above and equal fingerprints can tie an article to
    a cluster, so each connected component of these is decided by itself, in order
    of time: of its articles one task holds the fingerprint and the links.
    """
    links = scored.filter(F.col("s.score") >= FLOOR).select("a", "b", F.col("s.score").alias("score"))
    ties = links.select("a", "b")
    if "strict" in articles.columns:
        ties = ties.union(fingerprint_pairs(articles))
    comp = components(ties)
    strict = F.col("strict") if "strict" in articles.columns else F.lit(None).cast("string")
    both = links.select(F.col("a").alias("id"), F.struct(F.col("b").alias("to"), "score").alias("l")).union(links.select(F.col("b").alias("id"), F.struct(F.col("a").alias("to"), "score").alias("l")))
    rows = articles.select("id", "slug", strict.alias("strict"), "published_at").join(comp, F.col("id") == F.col("node"), "left")
    alone = rows.filter("component is null").select("id", F.col("id").alias("cluster_id"))
    tied = rows.filter("component is not null").select("component", "id", "slug", "strict", F.unix_micros("published_at").alias("at")).join(both.groupBy("id").agg(F.collect_list("l").alias("links")), "id", "left")

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        cluster, place = decided([(r.id, r.slug, r.strict if isinstance(r.strict, str) else None, r.at, {} if r.links is None else {x["to"]: x["score"] for x in r.links}) for r in batch.itertuples(index=False)]), batch["id"]
        return pd.DataFrame({"id": place, "cluster_id": [cluster[i] for i in place]})

    return alone.union(tied.groupBy("component").applyInPandas(run, "id long, cluster_id long"))


def decided(articles: list[tuple]) -> dict[int, int]:
    """The cluster of each article (id, source, fingerprint, micros, {other id: score at the floor or above})."""
    cluster: dict[int, int] = {}
    seed_at: dict[int, int] = {}
    latest: dict[int, int] = {}
    held: dict[int, set] = {}
    leads: dict[int, int] = {}  # the cluster that an article is seed or latest of
    order: dict[str, list[int]] = {}  # clusters of each fingerprint
    seen: set[tuple] = set()
    passed: dict[tuple, int] = {}  # how many of them hold a source already; a cluster never loses one
    window = scalar.WINDOW_HOURS * 3_600_000_000
    for id_, source, strict, at, links in sorted(articles, key=lambda r: (r[3], r[0])):
        known, skip = order.get(strict, []) if strict is not None else [], passed.get((strict, source), 0)
        while skip < len(known) and source in held[known[skip]]:
            skip += 1
        passed[strict, source] = skip
        found = known[skip] if skip < len(known) else None
        if found is None:
            best: dict[int, float] = {}
            for to, score in links.items():
                k = leads.get(to)
                if k is not None and abs(at - seed_at[k]) <= window:
                    best[k] = max(best.get(k, 0.0), score)
            ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))
            if ranked and ranked[0][1] >= scalar.MATCH:
                found = next((k for k, _ in ranked if source not in held[k]), None)
        if found is None:
            found, seed_at[id_] = id_, at
        elif latest[found] != found:
            leads.pop(latest[found])
        cluster[id_], leads[id_], latest[found] = found, found, id_
        held.setdefault(found, set()).add(source)
        if strict is not None and (strict, found) not in seen:
            seen.add((strict, found))
            order.setdefault(strict, []).append(found)
    return cluster


def neutral_title(titles: Column) -> Column:
    """An offline stand-in for a text service: the shortest of the titles, cut to 80 characters."""
    ordered = F.array_sort(F.transform(titles, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))
    return F.left(F.element_at(ordered, 1)["t"], F.lit(80))


def shortest_titles(titles: DataFrame, most: int = 80) -> DataFrame:
    """(cluster_id, title) from rows (cluster_id, title): what neutral_title takes, without gathering a cluster's titles."""
    short = F.min_by("title", F.struct(F.length("title"), "title"))
    return titles.filter("title is not null").groupBy("cluster_id").agg(F.left(short, F.lit(most)).alias("title"))


def neutral_titles(clusters: DataFrame, rewrite=None) -> DataFrame:
    """(cluster_id, title) from rows (cluster_id, titles); `rewrite` is an iterator function on pandas series, e.g. a service client."""
    if rewrite is None:
        return clusters.select("cluster_id", neutral_title(F.col("titles")).alias("title"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"cluster_id": b["cluster_id"], "title": [(rewrite([*t][:8]) or "")[:80] or None for t in b["titles"]]})

    return clusters.mapInPandas(run, f"cluster_id {clusters.schema['cluster_id'].dataType.simpleString()}, title string")
