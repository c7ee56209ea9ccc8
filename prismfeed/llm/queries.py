"""One query per operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismfeed.llm._tables import table
from prismfeed.llm.ann import nearest
from prismfeed.llm.bpe_count import token_counts
from prismfeed.llm.class_lm import fit, score_texts
from prismfeed.llm.decontaminate import benchmark_hits, hit_digest
from prismfeed.llm.langid import identify, train
from prismfeed.llm.ngram_join import link_components
from prismfeed.llm.pieces import encode_texts
from prismfeed.llm.pii import find_pii, pii_digest
from prismfeed.llm.substring_dedup import remove_repeats
from prismfeed.llm.toxicity import score_toxicity
from prismfeed.llm.toxicity import train as train_toxicity
from prismfeed.llm.url_filter import judge_urls
from prismfeed.llm.wand import search
from prismfeed.llm.whitening import whiten

#: Parameters of the queries.
PIECES, WORD_BPE, TOKEN_LIMIT = "piece_bpe_32k.model", "word_bpe_49k.json", 2048


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def fold(n: int) -> Column:
    """crc32 of doc_id as text modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def training_fold(n: int, held_out: int) -> Column:
    return fold(n) != held_out


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digests=True)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), digests=True)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), public_tokenizers.path(PIECES)
    model = train(docs.filter(training_fold(3, 1)), path)
    judged = identify(docs.select("doc_id", "text"), model, path)
    return judged.select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, fit(docs.filter(training_fold(7, 2))))
    return scored.select("doc_id", (fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit_digest(benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(table(spark, sf_dir, "documents")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    deviation, explained = F.expr("try_cast(deviation AS long)").alias("deviation"), F.try_element_at("explained", F.col("component")).alias("explained")
    parts = white.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("place", "whitened")).withColumn("component", F.col("place") + 1)
    return parts.select("vec_id", "component", "n", deviation, "whitened", explained, "identity_error")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs.filter(training_fold(5, 0)), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score_toxicity(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_sentencepiece, op3_ngram_jaccard_join, op4_token_counts, op5_language_id,
        op6_url_filter, op7_class_lm, op8_nearest_neighbours, op9_decontamination, op10_pii,
        op11_whitening, op12_toxicity, op13_ranked_search,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK_WORDS = r"'[^\x20\x09-\x0D]+'"
_ALNUM_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

#: SQL of the operators that it can express.
ORACLES: dict[str, str] = {
    "op1_substring_dedup": f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_BLANK_WORDS}) AS w FROM documents),
v AS (SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)), m AS (SELECT k, min(doc_id) AS first FROM v GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM v JOIN m USING (k) WHERE doc_id > first) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [w[p] FOR p IN range(1, len(w) + 1) IF NOT list_contains(gone, p)] END, ' ')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)""",
    "op3_ngram_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_BLANK_WORDS}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id), m AS (SELECT id, min(root) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.id = d.doc_id""",
    "op9_decontamination": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM_WORDS}) AS w FROM documents), i AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM_WORDS}) AS w FROM benchmark),
z AS (SELECT item_id, w, least(10, len(w)) AS z FROM i WHERE len(w) > 0), zs AS (SELECT DISTINCT z FROM z), iw AS (SELECT DISTINCT item_id, z, array_to_string(w[s:s + z - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - z + 2)) AS s FROM z)),
dw AS (SELECT doc_id, s, z, array_to_string(w[s:s + z - 1], ' ') AS k FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS s FROM d, zs WHERE len(w) >= z)), h AS (SELECT doc_id, s, z, item_id FROM dw JOIN iw USING (z, k)),
c AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(s, s + z)) AS p FROM h) GROUP BY 1), t AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op13_ranked_search": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM_WORDS}) AS w FROM documents), s AS (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0),
t AS (SELECT doc_id, w AS term, count(*) AS tf, any_value(size) AS size FROM (SELECT doc_id, len(w) AS size, unnest(w) AS w FROM d) GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
g AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight FROM f, s), q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, {_ALNUM_WORDS})) AS term FROM benchmark),
r AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + CAST((50 * size * n) // l AS BIGINT))))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN g USING (term), s GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 50""",
}
