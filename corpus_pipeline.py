"""A training corpus from raw documents: five stages, each over all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismfeed.llm._tables import keep, table
from prismfeed.llm.decontaminate import drop_contaminated
from prismfeed.llm.langid import UNDETERMINED, identify, train
from prismfeed.llm.ngram_join import link_components
from prismfeed.llm.pieces import encode_texts
from prismfeed.llm.pii import redact_pii
from prismfeed.llm.queries import PIECES, training_fold

#: A document stays if its language is this sure.
LEAST_SCORE = 0.5


def _exactly(names: list[str]) -> list[Column]:
    """Columns by their very names, dots and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def _free(name: str, docs: DataFrame) -> str:
    """A column name like `name` that docs lacks, in any case of letters."""
    taken = {c.casefold() for c in docs.columns}
    while name.casefold() in taken:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that stands out, go; null and empty texts have no letter.

    Ties go to the first language by name; a very long text is judged whole; rows of
    repeated or null ids are judged each; an empty table stays empty.
    """
    path = public_tokenizers.path(PIECES)
    model = train(docs.filter(training_fold(3, 1)), path)
    lang, score = _free("lang_pred", docs), _free("score", docs)
    judged = identify(docs, model, path, lang_name=lang, score_name=score)
    sure = (F.col(lang) != UNDETERMINED) & (F.col(score) >= LEAST_SCORE)
    return judged.filter(sure).select(*_exactly(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents joined by links the one of smallest id stays.

    Rows of one id are one document and stay or go together; rows of a null id stay,
    and null and empty texts are linked with nothing; very long texts are compared
    whole; an empty table stays empty.
    """
    gone = link_components(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*_exactly(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; null and empty texts hold none, very long ones are searched whole, rows of repeated or null ids are judged each, an empty table stays empty."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; spans of personal data become their kind in brackets, and n_chars follows.

    Null and empty texts stay as they are; overlapping spans are merged; very long
    texts are searched whole; an empty table stays empty.
    """
    clean = redact_pii(docs)
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast(clean.schema["n_chars"].dataType), "n_chars"))
    return clean


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they decode to."""
    return encode_texts(docs, public_tokenizers.path(PIECES))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("sentencepiece", sentencepiece),
]

#: Language models, components and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
