"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

    python corpus_pipeline.py SF_DIR OUT

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns
of ``documents``, others that the input has are left out. For all stages: an empty table gives no rows, repeated rows
are judged each, a null lang, source or n_chars does not matter, and texts are taken whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm import langid
from triagelake.llm.common import apart, clear_shared, drop_written, materialize, small_batches, table
from triagelake.llm.line_dedup import remove_lines
from triagelake.llm.ngram_join import near_duplicates
from triagelake.llm.packing import pack_documents
from triagelake.llm.queries import WORD_VOCABULARY
from triagelake.llm.substring_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose best language has a lower mean probability is rejected as in none.
LEAST_SCORE = 0.35


def _recounted(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted again."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter and those that the network places nowhere go.

    Null and empty texts have no letter and go; a null doc_id takes no part in training, only in the judgement. Without
    any labelled text there is no network, and everything goes.
    """
    small_batches(spark)
    found = langid.identify(docs.select(*COLUMNS), langid.fit(docs))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are alike with an earlier one; documents of which nothing is left go.

    Null and empty texts stay as they are, as does a document with a null doc_id; blank lines stay. Rows of one doc_id
    are alike in place, so neither cuts the other.
    """
    small_batches(spark)
    cut = remove_lines(docs.select(*COLUMNS), exact_short=True, scaled=True)
    return _recounted(cut.where((F.col("n_cut") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near duplicates.

    Texts that are null or without words are in no group and stay, as do rows with a null doc_id; rows that repeat the
    smallest doc_id all stay.
    """
    small_batches(spark)
    found = near_duplicates(docs.select("doc_id", "text"))
    gone = materialize(found.where("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a document with a smaller doc_id has; documents of which nothing is left go.

    Null, empty and short texts stay as they are, as does a document with a null doc_id; rows of one doc_id do not cut
    each other.
    """
    small_batches(spark)
    cut = remove_repeats(docs.select(*COLUMNS))
    return _recounted(cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens; a null or empty text is one piece with the end id alone."""
    return pack_documents(docs, public_tokenizers.path(WORD_VOCABULARY))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("substrings", substrings), ("packing", packing)]
#: Neither the network nor the hashes can be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again.

    What a stage wrote for itself is deleted once its result is there, a stage's result once the next one's is.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with apart(name) as inner:
            found = stage(spark, docs, sf_dir)
        docs = materialize(found, f"pipeline-{name}")
        clear_shared(spark, inner)
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


if __name__ == "__main__":
    import sys

    from triagelake.session import build

    run(build("corpus_pipeline"), sys.argv[1]).write.parquet(sys.argv[2])
