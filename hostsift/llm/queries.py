"""Registered queries of the operators over the given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostsift.llm.alignment import align_tokenizers
from hostsift.llm.common import table
from hostsift.llm.language import fit_filters, held_out, identify_languages
from hostsift.llm.licenses import scan_licenses
from hostsift.llm.lines import dedup_lines
from hostsift.llm.negatives import hard_negatives, labelled_vectors
from hostsift.llm.ngrams import fit_language_model, score_texts
from hostsift.llm.packing import pack_documents
from hostsift.llm.pieces import decode_pieces, encode_pieces
from hostsift.llm.quality import quality_rules
from hostsift.llm.sharding import shard_rows
from hostsift.llm.simhash import simhash_groups
from hostsift.llm.tokens import document_tokens
from hostsift.llm.topk import integer_vectors, top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Files that come with the tokenizers; every executor has the package.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query
def op1_license_scan(spark, sf_dir):
    found = scan_licenses(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")


@query
def op2_language_filters(spark, sf_dir):
    labelled = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")))
    found = identify_languages(documents(spark, sf_dir), fit_filters(labelled))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "known_share")


@query
def op3_threshold_top_k(spark, sf_dir):
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.where("id % 50 = 0"))


ORACLES["op3_threshold_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op4_token_counts(spark, sf_dir):
    # The ranks end before the id that the files' end-of-document id takes.
    return document_tokens(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN, end_id=50256)


@query
def op5_simhash_groups(spark, sf_dir):
    return simhash_groups(documents(spark, sf_dir))


@query
def op6_line_dedup(spark, sf_dir):
    cleaned = dedup_lines(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


#: Pairs of lines within one edit share their first or last half, the halves cut by the longer one's length.
ORACLES["op6_line_dedup"] = """
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
spots AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM docs),
lines AS (SELECT doc_id, i, ls[i] AS line, doc_id * 10000000 + i AS place FROM spots),
firsts AS (SELECT line, length(line) AS n, min(place) AS place FROM lines WHERE length(line) >= 30 GROUP BY line),
halves AS (
    SELECT line, n, place, unnest(list_distinct([
        'a' || substr(line, 1, n // 2), 'a' || substr(line, 1, (n + 1) // 2),
        'z' || substr(line, n // 2 + 1), 'z' || substr(line, (n + 1) // 2)])) AS half
    FROM firsts),
near AS (
    SELECT DISTINCT x.place FROM halves x JOIN halves y USING (half)
    WHERE y.place < x.place AND abs(x.n - y.n) <= 1 AND levenshtein(x.line, y.line) <= 1),
kept AS (
    SELECT l.doc_id, l.i, l.line FROM lines l
    WHERE length(line) < 30 OR l.place IN (SELECT place FROM firsts EXCEPT SELECT place FROM near)),
texts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.ls), 0) AS n_lines, coalesce(len(d.ls), 0) - coalesce(t.n, 0) AS n_dropped,
    CASE WHEN d.ls IS NOT NULL THEN md5(coalesce(t.t, '')) END AS text_md5
FROM docs d LEFT JOIN texts t USING (doc_id)
"""


@query
def op7_feistel_shards(spark, sf_dir):
    return shard_rows(documents(spark, sf_dir))


@query
def op8_sentencepiece(spark, sf_dir):
    both = decode_pieces(encode_pieces(documents(spark, sf_dir), PIECES), PIECES)
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_quality_rules(spark, sf_dir):
    return quality_rules(documents(spark, sf_dir)).drop("text")


@query
def op10_best_fit_packing(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir), WORDS)


@query
def op11_cross_tokenizer_alignment(spark, sf_dir):
    return align_tokenizers(documents(spark, sf_dir), BYTES, PIECES, public_tokenizers.PATTERN)


@query
def op12_hard_negatives(spark, sf_dir):
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = labelled_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", relabelled)
    return hard_negatives(vectors, F.col("id") % 100 == 0)


ORACLES["op12_hard_negatives"] = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
        CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i])) AS BIGINT) AS score
    FROM v a JOIN v c ON c.vec_id <> a.vec_id AND len(c.e) = len(a.e) WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM scored WHERE same)
    WHERE n <= 5),
hits AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
        AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM hits WHERE rank <= 5
"""


def unseen(key):
    """Whether the language model must not learn from a document: checksum of its id, modulo 7, is 2. A null id counts as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 7 == 2


@query
def op13_log_frequency_lm(spark, sf_dir):
    docs = documents(spark, sf_dir)
    scored = score_texts(docs, fit_language_model(docs.where(~unseen(F.col("doc_id")))))
    return scored.withColumn("held_out", unseen(F.col("doc_id")))
