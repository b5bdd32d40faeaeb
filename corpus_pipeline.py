"""The corpus pipeline: quality, language, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents, and any more that docs has, whatever these are named.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnwright.llm import exact_dedup, language_id, ngram_join, packing, quality
from tarnwright.llm.queries import table, tokenizer
from tarnwright.llm.shared import scope, small_batches
from tarnwright.sources.scratch import dropped, scratch_path

#: Share of the largest possible distance by which a text must be nearer to its language, to be kept.
LEAST_SCORE = 0.25


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance draw selects; the rest go.

    The draw takes as many as the labels let expect good ones (quality.expected_good).  Rows that repeat a doc_id and its
    text stay or go together, ties with the last row drawn stay, null and empty texts go first.
    """
    return quality.selected(docs, table(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learnt language; those of none (null, no letters, or far from every profile) go.

    Repeated rows stay or go together; a tie between languages doesn't matter here.
    """
    small_batches(spark)
    return language_id.with_language(docs, least=LEAST_SCORE)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the smallest doc_id (a null one last); null and empty texts are one text."""
    small_batches(spark)
    return exact_dedup.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles of similarity 0.8 or more, the one with the smallest doc_id.

    Texts without words, and rows with a null doc_id, stay; so do rows that repeat the smallest doc_id.
    """
    small_batches(spark)
    return ngram_join.representatives(docs, words=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; a null or empty text is its end token, rows repeat."""
    small_batches(spark)
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("language", known_language),
    ("exact", exact_copies),
    ("near", near_copies),
    ("packing", packed),
]

#: SQL can't express the stages of quality, language and packing; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written before the next reads it, and deleted once that is written,
    as are the operators' own tables.  Only the documents that the last stage packs remain."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        with scope(spark, f"within-{name}"):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        if before:
            dropped(spark, before)
        docs, before = spark.read.schema(kept.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
