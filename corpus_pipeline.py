"""The cleaning pipeline over ``documents``: every stage writes Parquet that the next one reads.

A stage takes (spark, docs, sf_dir) and returns the columns of ``docs``, the last one packed pieces. Texts may be null, empty
or of any length, rows and ids may repeat, further columns are passed on, and an empty table goes through as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostsift.llm.common import fresh, table
from hostsift.llm.language import UNDETERMINED, fit_filters, held_out, language
from hostsift.llm.lines import dedup_lines
from hostsift.llm.packing import pack_documents
from hostsift.llm.quality import QualityRules, quality
from hostsift.llm.simhash import one_of_each_group
from hostsift.session import staged

#: Least share of a text's n-grams that its language must have.
MIN_KNOWN = 0.3
#: A document of which less than this share of characters is left after line dedup is a copy of earlier ones.
MIN_LEFT = 0.2
#: Words of a shingle and bits that fingerprints of near copies differ in at most.
SHINGLE, RADIUS = 3, 2
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; a null or empty text fails."""
    mark = fresh(docs, "quality")
    judged = docs.withColumn(mark, quality(F.col("text").cast("string"), QualityRules()))
    return judged.where(F.col(f"{mark}.kept")).drop(mark)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, as far as its n-grams tell; the filters learn from these documents' own labels.

    Without any label nothing is learned, and then nothing is rejected for its language.
    """
    filters = fit_filters(docs.where(~held_out(F.col("doc_id"))))
    if not filters.languages:
        return docs
    mark = fresh(docs, "language")
    judged = docs.withColumn(mark, language(F.col("text").cast("string"), filters))
    known = (F.col(f"{mark}.lang_pred") != UNDETERMINED) & (F.col(f"{mark}.known_share") >= MIN_KNOWN)
    return judged.where(known).drop(mark)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without near copies of earlier lines, and ``n_chars`` to match; documents of which too little is left go."""
    before = fresh(docs, "chars_before")
    # Columns that are named as the operator's counts are kept under other names meanwhile.
    own = {c: fresh(docs, f"own_{c}") for c in docs.columns if c.lower() in ("n_lines", "n_dropped")}
    cleaned = dedup_lines(docs.withColumnsRenamed(own).withColumn(before, F.length("text")))
    left = F.length("text")
    cleaned = cleaned.where((F.col("n_dropped") == 0) | (left >= MIN_LEFT * F.col(before)))
    made = {c: left.cast(t) if c == "n_chars" else F.col(f"`{own.get(c, c)}`") for c, t in docs.dtypes}
    return cleaned.select(*[x.alias(c) for c, x in made.items()])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that can be reached over pairs of near fingerprints, the one of the smallest id."""
    return one_of_each_group(docs, words=SHINGLE, radius=RADIUS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality rules", good_quality),
    ("language ID", known_language),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", one_of_near_copies),
    ("best-fit packing", packed),
]
#: The fingerprints and the tokenizer can't be expressed in SQL; the rows are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
