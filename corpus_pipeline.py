"""A corpus pipeline of five stages; what one writes, the next one reads.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.

Defined results, of all stages: further columns are kept whatever their names; an empty table gives an empty table;
texts are taken whole, however long. A null or empty text has no language, so its row goes in the first stage, the
others would keep it. A null doc_id takes no part in the three stages that compare documents: its row stays as it is.
Rows that repeat a doc_id with the same text are one document: they stay or go together. Of equal texts and of equal
groups the least doc_id stays or keeps the passage.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from tonegauge.llm import langid, line_dedup, ngram_join, packing, suffix_dedup
from tonegauge.llm._common import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and texts that are neither mostly in one language nor, word by word, clearly in several, go."""
    return langid.accept(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later runs of three or more lines, or of fifty or more words, and later copies of shorter texts go; documents of which nothing is left go."""
    return line_dedup.clean(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingle sets are 0.8 alike, directly or through others, the least doc_id stays."""
    return ngram_join.one_of_each(docs, k=5, similarity=Fraction(4, 5))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of passages of fifty or more words go; documents of which nothing is left go."""
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of pieces in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: Language identification and tokenization have no SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
