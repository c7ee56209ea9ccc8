"""Brute-force and library checks of the operators on single texts."""

import hashlib
import re

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prismfeed.llm.bpe_count import token_counts
from prismfeed.llm.decontaminate import benchmark_hits, drop_contaminated, hit_digest
from prismfeed.llm.pieces import encode_texts
from prismfeed.llm.pii import find_pii, find_spans, luhn, pii_digest, redact_pii

SF = "/root/testdata/sf0.01"
ODD = [
    "", " ", "a", "  two  blanks ", "\n\nline\tfeed\r\n", "▁already ▁ marked", "naïve ΣΑΣ İstanbul ﬁ", "é́ combining", "emoji 👩‍👩‍👧 \U0001f600", "日本語の文章。", "nul \x00 and \x1c\x1d sep",
    "<|endoftext|> in <|startoftext|>text<|endoftext|>", "it's WE'LL they'd 'S", "x" * 3000, "ab " * 2000, " 　wide\xa0blank\x85", "123 4567 ½ ²", "don't​zero", "a퟿b", "ÅÅ",
]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents()] + [(10_000_000 + i, t) for i, t in enumerate([*ODD, None])]
    rows += rows[-3:]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_pieces_match_the_library(docs):
    df, rows = docs
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted((i, len(x := sp.encode(t or "")), sha(",".join(map(str, x))), sha(sp.decode(x))) for i, t in rows)
    got = sorted(map(tuple, encode_texts(df, path, digests=True).collect()))
    assert got == want
    full = {r[0]: r for r in encode_texts(df.filter("doc_id >= 10000000"), path).collect()}
    assert all(full[i].ids == sp.encode(t or "") for i, t in rows if i >= 10_000_000)


def test_counts_match_the_library(docs):
    df, rows = docs
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = sorted((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)
    assert sorted(map(tuple, token_counts(df, path).collect())) == want


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, id string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert encode_texts(df, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert token_counts(df, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert benchmark_hits(df, items).count() == 0 and find_pii(df).count() == 0
    one = spark.createDataFrame([(1, "some words of text", "x")], "doc_id long, text string, id string")
    assert [r.asDict() for r in hit_digest(benchmark_hits(one, items)).collect()][0]["n_hit"] == 0


def brute_hits(text, items, n=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, names = set(), set()
    for name, item in items:
        iw = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        size = min(n, len(iw))
        if size:
            windows = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)}
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in windows:
                    hit |= {*range(i, i + size)}
                    names.add(str(name))
    return len(words), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)


@pytest.mark.parametrize("slice_bytes", [32 << 20, 9000, 150])
def test_decontamination_against_brute_force(spark, slice_bytes):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    rows = [(r["doc_id"], r["text"]) for r in documents()][::5]
    base = items[0][1]
    items += [(7001, "Short, item"), (7002, base), (7003, None), (7004, "  !! "), (7005, "einzig"), (None, "null item id words")]
    rows += [(9_000_001, None), (9_000_002, ""), (9_000_003, "a short ITEM here einzig"), (9_000_004, "x " + base.upper()), (9_000_005, base + " " + base), (9_000_006, " ".join(base.split()[3:14]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, hit_digest(benchmark_hits(df, spark.createDataFrame(items, "item_id long, text string"), slice_bytes=slice_bytes)).collect()))
    known = [x for x in items if x[0] is not None]
    assert got == sorted((i, *brute_hits(t, known)) for i, t in rows)


@pytest.mark.parametrize("slice_bytes", [32 << 20, 400, 20])
def test_decontamination_keeps_rows_of_null_and_repeated_ids(spark, slice_bytes):
    items = [(i, " ".join(f"i{i}w{k}" for k in range(30))) for i in range(12)]
    both = " ".join(items[0][1].split()[:15] + items[1][1].split()[:12])
    rows = [(None, items[3][1]), (None, "clean text"), (None, None), (1, both), (1, "another clean text"), (1, both), (2, " ".join(t for _, t in items)), (3, "x " + " ".join(items[5][1].split()[2:12]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r[0], *r[1:]) for r in hit_digest(benchmark_hits(df, spark.createDataFrame(items, "item_id long, text string"), slice_bytes=slice_bytes)).collect()]
    assert sorted(map(str, got)) == sorted(str((i, *brute_hits(t, items))) for i, t in rows)


@pytest.mark.parametrize("slice_bytes", [32 << 20, 400, 20])
def test_contaminated_rows_go(spark, slice_bytes):
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(30))) for i in range(12)] + [(90, "two words"), (91, None)], "item_id long, text string")
    long = " ".join(f"i7w{k}" for k in range(3, 13))
    rows = [(1, long, "a"), (1, "clean", "b"), (None, "also Two, WORDS here", "c"), (None, None, "d"), (2, "", "e"), (3, " ".join(f"i7w{k}" for k in range(3, 12)), "f"), (3, "clean " * 5000, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `row` string").withColumn("a.b", F.lit(1))
    got = drop_contaminated(docs, items, slice_bytes=slice_bytes)
    assert got.columns == docs.columns and sorted(r["row"] for r in got.collect()) == ["b", "d", "e", "f", "g"]
    assert drop_contaminated(docs.filter("false"), items, slice_bytes=slice_bytes).count() == 0


def brute_pii(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    kinds = ["email", "ip", "card", "phone"]
    out.sort(key=lambda x: (x[1], kinds.index(x[0])))
    return [sum(x[0] == k for x in out) for k in kinds] + [sha(",".join(f"{k}:{s}:{e}" for k, s, e in out))]


PII = [
    "a@b.com_x@d.com.,z@@y.org a@b a@b.c@d.e.f", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.0004 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111 4111  1111", "+1 (555) 010-9999 +49 30 1234 ++1 2 +1 555 01099991234567",
    "IBAN DE89 3704 0044 0532 0130 00 and DE89370400440532013001", "my ssn is 123-45-6789, order 123-45-6789" , "9" * 4000 + ".1.2.3", "é日本 x@y.zz 👩 +12345678901", "a" * 4000 + "@", "%@-.-",
]


def test_pii_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents()] + [(9_000_000 + i, t) for i, t in enumerate([*PII, "", None])]
    got = {r[0]: r for r in pii_digest(find_pii(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, t in rows:
        assert list(got[i][1:6]) == brute_pii(t or ""), t and t[:80]
    assert "iban:5:32" in got[9_000_004].spans and "iban:37" not in got[9_000_004].spans


def test_pii_redaction_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "write to x@y.zz now", "a"), (2, None, "b"), (3, "plain", None)], "doc_id long, text string, spans string")
    got = sorted(redact_pii(df).collect())
    assert [tuple(r) for r in got] == [(1, "write to [EMAIL] now", "a"), (2, None, "b"), (3, "plain", None)]
    assert [x.kind for x in find_spans("ssn 123-45-6789")] == ["ssn"] and not find_spans("no. 123-45-6789")


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("DE89 3704 0044 0532 0130 00", ["iban"]), ("DE89370400440532013000", ["iban"]), ("DE8 9", []), ("DE89 3704 0044 0532 0130 01", []),  # a wrong checksum
        ("ref DE893704 00440532 013000 x", []), ("my iban: DE893704 00440532 013000 x", ["iban"]), ("embank DE893704 00440532 013000", []),  # written oddly: only with context
        ("ssn 123-45-6789", ["ssn"]), ("tax ids 123-45-6789", ["ssn"]), ("lessness 123-45-6789", []), ("ssn 000-45-6789", []), ("ssn 123-45-6789 " + "x" * 41, ["ssn"]), ("ssn" + " x" * 30 + " 123-45-6789", []),
    ],
)
def test_context_decides_where_checksums_do_not(text, kinds):
    assert [x.kind for x in find_spans(text) if x.kind in ("iban", "ssn")] == kinds


def test_context_moves_scores_by_whole_words():
    score = lambda t: find_spans(t)[0].score
    assert score("call +49 30 1234567") > score("recall +49 30 1234567") and score("the ip 10.1.2.3") > score("the trip 10.1.2.3")
