"""The pipeline's stages, each held against a brute-force version on what its predecessor kept."""

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece

import corpus_pipeline as P
from prismfeed.llm.pii import find_spans, redacted
from tests.llm.test_corpus_ops import brute_components
from tests.llm.test_text_ops import brute_hits

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """Rows after each stage, by its number."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9_000_000, None, None, "s", 0), (9_000_001, "", "en", "s", 0), (9_000_002, "123 456", None, "s", 7)], docs.schema)
    docs = docs.union(extra)
    out = {0: docs.collect()}
    for k, (_, stage) in enumerate(P.STAGES, 1):
        columns = docs.columns
        docs = stage(spark, docs, SF)
        out[k] = docs.collect()
        if k < len(P.STAGES):
            assert docs.columns == columns
            docs = spark.createDataFrame(out[k], docs.schema)
    return out


def test_language_stage_keeps_text_and_drops_the_rest(kept):
    ids = {r.doc_id for r in kept[1]}
    assert not ids & {9_000_000, 9_000_001, 9_000_002}
    assert len(ids) >= 0.95 * len(kept[0])


def test_duplicate_stage_keeps_one_of_each_group(kept):
    want, _ = brute_components([(r.doc_id, r.text) for r in kept[1]])
    assert {r.doc_id for r in kept[2]} == {i for i, _, c in want if i == c}


def test_decontamination_stage(kept):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    assert {r.doc_id for r in kept[3]} == {r.doc_id for r in kept[2] if not brute_hits(r.text, items)[-1]}


def test_pii_stage(kept):
    want = {r.doc_id: redacted(r.text, find_spans(r.text)) for r in kept[3]}
    assert {r.doc_id: r.text for r in kept[4]} == want and all(r.n_chars == len(r.text) for r in kept[4])


def test_last_stage(kept):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in kept[4]}
    assert len(kept[5]) == len(texts)
    for r in kept[5]:
        assert r.ids == sp.encode(texts[r.doc_id]) and r.decoded == texts[r.doc_id] and r.n_tokens == len(r.ids)


def test_run_gives_the_last_stage_over_documents(spark):
    got = P.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"] and got.count() > 100
