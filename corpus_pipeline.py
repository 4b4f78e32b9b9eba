"""The corpus pipeline: five operators applied to documents, each to all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearweave.llm import lines, minhash, packing, quality, substring
from nearweave.llm.common import read_table
from nearweave.plans.tables import Tables


#: Rows that go to a Python worker at once, at most: whole documents, in a buffer of the executor and one of the worker.
BATCH = 1000


def _in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, in a session that deals rows to Python by BATCH or fewer; its result runs later, so this isn't undone."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        held = int(spark.conf.get(key))
        spark.conf.set(key, min(held, BATCH) if held > 0 else BATCH)
        return stage(spark, docs, sf_dir)

    return run


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows a changed text, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).cast(docs.schema["n_chars"].dataType))


@_in_small_batches
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, by a score of at least 0.7.

    Null and empty texts are scored as empty; repeated rows stay or go together; without usable labels every score is 0.5
    and no document stays; an empty table gives an empty table; other columns are carried, whatever their names.
    """
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


@_in_small_batches
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are similar to an earlier one; a document that loses all its lines has an empty text.

    A null text stays null; lines without words stay; rows with one doc_id are one place in the order and lose the same
    lines; a null doc_id comes first; an empty table gives an empty table; n_chars follows the text, other columns are
    carried, whatever their names.
    """
    return _counted(lines.rewrite(docs))


@_in_small_batches
def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity of 0.8 or more.

    Texts that are null or without words are in no group and stay; of repeated rows one stays; rows without doc_id stay
    once for each set that no document with a doc_id has; an empty table gives an empty table; other columns are carried.
    """
    return minhash.one_of_each(docs, k=5, share=(80, 100))


@_in_small_batches
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 or more words that start earlier; changed texts are their kept words and blanks.

    Null and empty texts stay as they are; rows equal in doc_id and text are one document; a null doc_id comes first; an
    empty table gives an empty table; n_chars follows the text, other columns are carried, whatever their names.
    """
    return _counted(substring.rewrite(docs))


@_in_small_batches
def concat_and_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of the kept texts in windows of 2048 tokens.

    A null or empty text is its end token; repeated rows are packed each; rows without doc_id have records without doc_id;
    an empty table gives an empty table; columns but doc_id and text are ignored.
    """
    return packing.concat_and_cut(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("concat_and_cut", concat_and_cut),
]
#: SQL can't express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again before the next stage, and deleted after it."""
    docs = read_table(spark, sf_dir, "documents")
    with Tables(spark) as tables:
        for i, (_, stage) in enumerate(STAGES):
            last, docs = docs, tables.settle(stage(spark, docs, sf_dir))
            if i:
                tables.drop(last)
        return tables.keep(docs)
