"""Golden inputs of the text, cleaning, network and scoring functions."""

import pytest
from pyspark.sql import functions as F

from prismfeed.functions import clean, scalar, text
from prismfeed.functions.network import label_of
from prismfeed.operators import clustering, hygiene, operations, serving
from prismfeed.plans import proxy


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def norm(s):
    return text.normalize_turkish(F.lit(s))


@pytest.mark.parametrize(("raw", "want"), [("MHP İstanbul'da il ve 39 ilçe", "mhp istanbul il 39 ilce"), ("Son dakika haber: A 5 b", "5"), (None, ""), ("é ß", "")])
def test_normalize(spark, raw, want):
    assert one(spark, norm(raw)) == want


@pytest.mark.parametrize(("token", "stem"), [("kitaplar", "kitap"), ("evde", "evde"), ("2024", "2024"), ("istanbulda", "istanbul"), ("partinin", "parti"), ("gazetelerden", "gazete")])
def test_stem(spark, token, stem):
    assert one(spark, text.stem_turkish(F.lit(token))) == stem


def test_fingerprints(spark):
    a, b = norm("MHP İstanbul'da il teşkilatını feshetti"), norm("MHP İstanbul il teşkilatını fesh etti")
    far = norm("Merkez Bankası faiz kararını açıkladı")
    assert one(spark, text.strict_fingerprint(a)) != one(spark, text.strict_fingerprint(b))
    assert one(spark, text.signature_jaccard(text.minhash(a), text.minhash(b))) >= 0.6
    assert one(spark, text.signature_jaccard(text.minhash(norm("Erdoğan Almanya'yı ziyaret edecek")), text.minhash(far))) < 0.15
    assert one(spark, text.strict_fingerprint(norm(""))) is None and one(spark, text.minhash(norm(""))) == [0xFFFFFFFF] * 64
    assert one(spark, text.strict_fingerprint(norm("2020 yılında"))) != one(spark, text.strict_fingerprint(norm("2024 yılında")))


@pytest.mark.parametrize(
    ("raw", "want"),
    [("MHP İstanbul'da il ve 39 ilçe teşkilatını feshetti", {"mhp", "istanbul"}), ("Cumhurbaşkanı Erdoğan Almanya ziyaretinde konuştu", {"erdogan", "almanya"}), ("TCMB faiz kararını 2024 yılında açıkladı", {"tcmb", "faiz", "2024"})],
)
def test_entities(spark, raw, want):
    assert {*one(spark, text.extract_entities(F.lit(raw)))} == want


def test_more_entities(spark):
    assert {"chp", "pct47"} <= {*one(spark, text.extract_entities(F.lit("CHP anketinde yüzde 47 oranı")))}
    assert {"tcmb", "turkiye"} <= {*one(spark, text.extract_entities(F.lit("Turkey's central bank held rates steady")))}


def test_cleaning(spark):
    assert one(spark, clean.clean_title(F.lit("Galatasaray &amp; Fenerbah&#231;e ma&ccedil;&#x131;"))) == "Galatasaray & Fenerbahçe ma&ccedil;ı"
    assert one(spark, clean.clean_title(F.lit("&lt;b&gt;Kalın&lt;/b&gt; başlık"))) == "Kalın başlık"
    got = one(spark, clean.clean_title(F.lit("&amp;lt;script&gt; haber")))
    assert "&lt;script>" in got and "<script" not in got
    assert "<" not in one(spark, clean.clean_description(F.lit("<<script>script>alert(1)")))
    assert one(spark, clean.clean_description(F.lit("x" * 600))) == "x" * 497 + "..."
    assert one(spark, clean.clean_description(F.lit("<p> </p>"))) is None
    url = "HTTPS://WWW.Example.com//a//b'/?utm_source=x&id=3&REF=y#top"
    assert one(spark, clean.canonical_url(F.lit(url))) == "https://example.com/a/b?id=3"
    assert one(spark, clean.canonical_url(F.lit("not a url"))) == "not a url"


@pytest.mark.parametrize(
    ("ip", "blocked"),
    [("169.254.169.254", True), ("::1", True), ("100.64.0.1", True), ("fc00::1", True), ("fe80::1", True), ("2001:db8::1", True), ("1.1.1.1", False), ("::ffff:1.1.1.1", True), ("224.0.0.1", True), ("240.1.2.3", True), ("ff02::1", True), ("example.com", False), (None, False)],
)
def test_networks(ip, blocked):
    assert (label_of(ip) is not None) == blocked


def score(spark, **k):
    base = {"sa": "a", "sb": "b", "j": 0.0, "shared": 0, "na": 3, "nb": 3, "cos": 0.0, "h": 0.0, "slug": "x"} | k
    c = {n: F.lit(v) for n, v in base.items()}
    return one(spark, scalar.pair_score(c["sa"], c["sb"], c["j"], c["shared"], c["na"], c["nb"], c["cos"], c["h"], c["slug"], F.lit("y")))


def test_scores(spark):
    assert score(spark, sb="a", cos=0.9, h=1.0).score == 1.0
    s = score(spark, j=0.75, shared=2, cos=0.3, h=0.5)
    assert abs(s.jaccard_score - 0.9) < 1e-12 and abs(s.entity - 2 / 3 * (1 - 0.5 / 6)) < 1e-12 and s.score >= 0.48
    assert score(spark, cos=0.1, h=2.0).score < 0.1 and score(spark, h=24.0).decay == 0.5
    assert abs(score(spark, sb="a", slug="haberler-com").score - 0.85) < 1e-12


def members(spark, rows):
    stamped = [(1, i, s, b, "politika", h, t) for i, (s, b, h, t) in enumerate(rows)]
    df = spark.createDataFrame(stamped, "cluster_id int, id int, source_id string, bias string, category string, content_hash string, minutes int")
    return df.withColumn("published_at", F.timestamp_micros(F.unix_micros(proxy.as_of()) - F.col("minutes").cast("long") * 60_000_000))


def test_folds(spark):
    wire = members(spark, [(f"s{i}", "center", h, i) for i, h in enumerate(["AA", "AA", "AA", "BB"])])
    assert serving.wire(wire).first().is_wire and serving.wire(wire).first().unique_hashes == 2
    assert not serving.wire(members(spark, [("a", "center", "A", 0), ("b", "center", "A", 1)])).first().is_wire
    nulls = serving.wire(members(spark, [(f"s{i}", "center", None, i) for i in range(4)])).first()
    assert not nulls.is_wire and nulls.unique_hashes == 4
    f = serving.fairness(members(spark, [("haberler", "center", None, i) for i in range(7)] + [(s, "center", None, 9) for s in ("bbc", "birgun", "cnn")])).first()
    assert (f.effective, f.capped) == (4, ["haberler"])
    x = serving.cross_spectrum(members(spark, [(f"s{i}", "pro_government", None, i) for i in range(6)] + [("o", "opposition", None, 9)])).first()
    assert (x.dominant_zone, x.surprises, x.blindspot_candidate) == ("iktidar", 1, True)


def test_buckets_and_health(spark):
    r = spark.createDataFrame([("a", i, i * 0.01) for i in range(6)] + [("b", 9, 0.0), ("a", 10, 3.0)], "client string, seq long, at double")
    got = {(x.client, x.seq): x for x in operations.token_bucket(r, 5, 1).collect()}
    assert [got["a", i].allowed for i in range(6)] == [True] * 5 + [False] and got["a", 5].retry_after_ms > 0 and got["b", 9].allowed and got["a", 10].allowed
    q = "queue_name string, queue_length string, oldest_age string"
    ok = lambda *rows: operations.queues_ok(spark.createDataFrame(rows, q)).first().queues_ok
    assert ok(("cluster_work", "500", "10")) and not ok(("cluster_work", "501", "10")) and not ok(("image_backfill", "101", None)) and not ok(("x", "abc", "1")) and not ok(("x", None, "1")) and not ok(("x", "1", "1801"))
    assert not operations.queues_ok(spark.createDataFrame([], q)).first().queues_ok


def test_upserts(spark):
    t = spark.createDataFrame([("u1", "s", "h1")], "url string, source_id string, content_hash string")
    b = spark.createDataFrame([(1, "u1", "s", "h9"), (2, "u2", "s", "h1"), (3, "u3", "s", None), (4, "u4", "s", None), (5, "u5", "s", "h5"), (6, "u6", "s", "h5"), (7, "u5", "s", "h7")], "seq int, url string, source_id string, content_hash string")
    assert sorted(r.seq for r in hygiene.upsert_ignore(t, b).collect()) == [3, 4, 5]


def test_greedy_assignment_keeps_one_article_of_a_source(spark):
    a = spark.createDataFrame([(1, 0, "a", 0), (2, 0, "b", 1), (3, 0, "a", 2)], "id long, batch int, slug string, m int").withColumn("published_at", F.timestamp_seconds("m"))
    s = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.7)], "a long, b long, score double").select("a", "b", F.struct("score").alias("s"))
    assert sorted(map(tuple, clustering.assign_greedily(a, s).collect())) == [(1, 1), (2, 1), (3, 3)]


def test_greedy_assignment_joins_equal_fingerprints_without_links(spark):
    far = 400 * 3600  # beyond the time window
    rows = [(1, 0, "a", "x", 0), (2, 0, "b", "x", far), (3, 0, "a", "x", far + 1), (4, 0, "b", "x", far + 2), (5, 0, "b", None, 3), (6, 0, "c", None, 4), (7, 0, "c", "y", 5), (8, 0, "d", "x", far + 3)]
    a = spark.createDataFrame(rows, "id long, batch int, slug string, strict string, m int").withColumn("published_at", F.timestamp_seconds("m"))
    none = spark.createDataFrame([], "a long, b long, score double").select("a", "b", F.struct("score").alias("s"))
    assert sorted(map(tuple, clustering.assign_greedily(a, none).collect())) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6), (7, 7), (8, 1)]


def test_features_of_strings_against_plain_ones(spark):
    import hashlib

    texts = ["", "a", "abc", "abcd", "aaaa aaaa", "İstanbul'da 2024 ŞIK K yüzde 47 x2024 2024x 12024 1949 %5 20 %", "TURKEY centRal   bank turkeys ile 7 x the", "ç\U0001d518\U0001f600ğ 42", None, "a|b " * 900]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("n", text.normalize_turkish(F.col("t")))
    columns = {r.i: r for r in df.select("i", "n", text.shingle_digest(F.col("n")).alias("d"), text.strict_fingerprint(F.col("n")).alias("f"), text.minhash(F.col("n")).alias("m"), text.extract_entities(F.col("t")).alias("e"), F.sort_array(text.shingle_set(F.col("n"))).alias("s")).collect()}
    a, b = text.minhash_coefficients()
    for i, t in enumerate(texts):
        r = columns[i]
        words = [w for w in "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in (t or "").translate(str.maketrans(text.FOLD_FROM, text.FOLD_TO)).lower()).split() if w not in text.STOP_WORDS and (len(w) > 1 or w.isdigit())]
        assert r.n == " ".join(words)
        digest = hashlib.sha1("|".join(r.s).encode()).hexdigest()
        assert (r.d.n, r.d.digest, r.f) == (len(r.s), digest, digest if r.n else None)
        slots = [min(int((x * (text._hash32(s) % text.PRIME) + y) % text.PRIME) for s in r.s) if r.s else text.EMPTY_SLOT for x, y in zip(a, b, strict=True)]
        assert r.m == slots
    assert columns[5].e == ["2024", "istanbul", "pct20", "pct47"] and columns[6].e == ["tcmb", "turkey", "turkiye"] and columns[8].e == []
    odd = "çağ😀𝔘ı çağ😀"
    assert text._sorted_shingles(odd) == ((n := sorted({odd[i : i + 4] for i in range(len(odd) - 3)})) and len(n), "|".join(n).encode()) and text._sorted_shingles("çğ") == (1, "çğ".encode())
