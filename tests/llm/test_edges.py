"""Odd tables through every operator on documents: null and repeated ids, repeated rows, very long and empty texts, clashing column names, no rows."""

import hashlib
import math

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from prismfeed.llm import queries as Q
from prismfeed.llm.ann import nearest
from prismfeed.llm.bpe_count import token_counts
from prismfeed.llm.class_lm import fit, score_texts
from prismfeed.llm.decontaminate import benchmark_hits, drop_contaminated, hit_digest
from prismfeed.llm.langid import identify, train
from prismfeed.llm.ngram_join import link_components
from prismfeed.llm.pieces import encode_texts
from prismfeed.llm.pii import find_pii, pii_digest, redact_pii
from prismfeed.llm.substring_dedup import remove_repeats
from prismfeed.llm.url_filter import judge_urls

PIECES, BPE = public_tokenizers.path(Q.PIECES), public_tokenizers.path(Q.WORD_BPE)
LONG = " ".join(f"wort{i % 7919}x{i}" for i in range(100_000)) + " mail a@b.cc"  # beyond one chunk of texts
BASE = "the river ran past the old mill and the quiet houses of the town where nobody had lived for many years " * 4
ROWS = [
    (1, BASE, "en"), (1, BASE, "en"), (None, BASE, "en"), (None, None, None), (2, "", "en"), (3, None, "de"), (4, LONG, None), (5, " \n\t", None), (6, BASE + "tail", "en"), (7, "Der Fluss lief an der alten Mühle vorbei", "de"),
    (7, "another text of the same id", "en"), (8, "½ ² Ⅷ 12", None), (9, LONG, None), (10, "write to x@y.zz or +49 30 1234567", "en"),
]
EXTRA = ["Score", "LANG_PRED", "DOC_ID2", "a.b", "spans", "n_words", "c", "key", "component", "node", "row", "h", "n", "grams", "template"]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(3)


@pytest.fixture(scope="module")
def wide(plain):
    return plain.select("*", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(EXTRA)])


ITEMS = [(1, " ".join(BASE.split()[3:15])), (2, None), (None, "wort5x5 wort6x6"), (3, "x y")]
OPERATORS = {
    "repeats": lambda df: remove_repeats(df),
    "pieces": lambda df: encode_texts(df, PIECES, digests=True),
    "join": lambda df: link_components(df),
    "tokens": lambda df: token_counts(df, BPE),
    "lm": lambda df: score_texts(df, fit(df)).select("doc_id", "n_tokens", "n_known", F.round("base_score", 6), F.round("score", 6)),
    "hits": lambda df: hit_digest(benchmark_hits(df, df.sparkSession.createDataFrame(ITEMS, "item_id long, text string"))),
    "pii": lambda df: pii_digest(find_pii(df)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each_row_whatever_else_a_table_holds(plain, wide, name):
    op = OPERATORS[name]
    lean = sorted(map(str, map(tuple, op(plain).collect())))
    assert len(lean) == len(ROWS)
    assert sorted(map(str, map(tuple, op(wide).collect()))) == lean
    assert op(plain.filter("false")).count() == 0
    assert op(plain.withColumn("text", F.lit(None).cast("string"))).count() == len(ROWS)


def test_very_long_texts_are_read_whole(plain):
    sp, bpe = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(BPE)
    ids = sp.encode(LONG)
    got = {r.doc_id: r for r in OPERATORS["pieces"](plain).collect()}
    assert (got[4].n_tokens, got[4].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert {r.doc_id: r.n_tokens for r in OPERATORS["tokens"](plain).collect()}[4] == len(bpe.encode(LONG, add_special_tokens=False).ids)
    words = LONG.split()
    joined = {r.doc_id: r for r in OPERATORS["join"](plain).collect()}
    assert joined[4].n_shingles == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}) and joined[9].component_id == 4 and joined[4].component_id == 4
    cut = {r.doc_id: r for r in OPERATORS["repeats"](plain).collect()}
    assert (cut[4].n_words, cut[4].n_removed, cut[9].n_removed) == (len(words), 0, len(words))
    assert {r.doc_id: r.n_email for r in OPERATORS["pii"](plain).collect()}[4] == 1
    assert {r.doc_id: r.n_tokens for r in OPERATORS["lm"](plain).collect()}[4] == len(words) + 1


def test_languages(plain, wide):
    model = train(plain, PIECES)
    lean = sorted(map(str, map(tuple, identify(plain, model, PIECES).select("doc_id", "lang_pred", "score").collect())))
    full = identify(wide, model, PIECES, lang_name="p", score_name="s")
    assert sorted(map(str, map(tuple, full.select("doc_id", "p", "s").collect()))) == lean and full.columns == [*wide.columns, "p", "s"]
    with pytest.raises(ValueError):
        identify(wide, model, PIECES)
    one = plain.filter("doc_id = 7").select("doc_id", "text", F.lit("xx").alias("lang"))
    many = one.union(one).union(one.withColumn("doc_id", F.lit(None).cast("long")))
    assert train(many, PIECES)[0] == ["xx"]
    by = {(r.doc_id, r.text): r.lang_pred for r in identify(plain, model, PIECES).collect()}
    assert {by[i, t] for i, t, _ in ROWS if not t or not any(c.isalpha() for c in t)} == {"und"} and by[8, "½ ² Ⅷ 12"] == "und" and by[4, LONG] in ("de", "en")
    assert identify(plain.filter("false"), model, PIECES).count() == 0


def test_urls_and_vectors(spark):
    pages = [(1, "http://a.com/de/1"), (1, "http://a.com/de/1"), (None, "http://a.com/de/2"), (None, None), (2, "http://b.net/" + "d/" * 30_000), (3, ""), (4, "http://b.net/de/7")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    wide = df.select("*", *[F.lit("x").alias(n) for n in ("host", "path", "shape", "rule", "a.b")])
    lean = sorted(map(str, map(tuple, judge_urls(df, Q.URL_RULES).collect())))
    assert len(lean) == len(pages) and sorted(map(str, map(tuple, judge_urls(wide, Q.URL_RULES).collect()))) == lean
    rows = [(0, [1.0, 0.0]), (20, [0.6, 0.8]), (20, [0.6, 0.8]), (None, [1.0, 1.0]), (3, [0.0, 1.0]), (4, [0.0, 1.0]), (5, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    more = v.select("*", *[F.lit("x").alias(n) for n in ("id", "v", "q", "t", "axis", "a.b")])
    lean = sorted(map(tuple, nearest(v, F.col("vec_id") % 20 == 0, k=2).collect()))
    for size in (1e6, 1e200, 1e-200):  # nearly equal vectors of any length are told apart as the exact score tells them
        near = [(i, [size * (1 + (i % 7) * 2.0**-52), size * (i % 5) * 2.0**-50]) for i in range(60)]
        got = sorted(map(tuple, nearest(spark.createDataFrame(near, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=15).collect()))
        of, unit = dict(near), 2.0 ** int(math.log2(size))
        exact = lambda a, b: sum(x / unit * (y / unit) for x, y in zip(of[a], of[b], strict=True))  # noqa: B023,E731
        want = [(q, r, i) for q in (0, 20, 40) for r, i in enumerate(sorted((i for i in of if i != q), key=lambda i: (-exact(q, i), i))[:15], 1)]  # noqa: B023
        assert [x[:3] for x in got] == want and all(s == exact(q, i) * unit * unit for q, _, i, s in got)
    assert [x[:3] for x in lean] == [(0, 1, 20), (0, 2, 3), (20, 1, 3), (20, 2, 4)] and sorted(map(tuple, nearest(more, F.col("vec_id") % 20 == 0, k=2).collect())) == lean


def test_stages_on_odd_tables(spark, tmp_path):
    schema = pq.read_table("/root/testdata/sf0.001/documents.parquet").schema
    assert schema.names[:2] == ["doc_id", "text"]
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit("x").alias(n) for n in EXTRA])
    for name, stage in P.STAGES:
        empty = stage(spark, docs.filter("false"), str(tmp_path))
        assert empty.count() == 0, name
        after = stage(spark, docs, str(tmp_path))
        if name != "sentencepiece":
            assert after.columns == docs.columns, name
            docs = spark.createDataFrame(after.collect(), docs.schema)
        else:
            assert after.count() == docs.count() > 0
    assert drop_contaminated(docs.filter("false"), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert redact_pii(docs).columns == docs.columns
