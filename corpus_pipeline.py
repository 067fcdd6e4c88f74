"""The training-data pipeline: quality classifier, near-dedup, repeated passages, benchmark decontamination, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame with the columns of documents, the last one with ``piece_ids``
besides. Between stages the rows are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metagauge.llm import pieces, quality
from metagauge.llm.decontaminate import remove_items
from metagauge.llm.near_dedup import keep_one_of_each
from metagauge.llm.queries import vocabulary
from metagauge.llm.repeats import remove_repeats
from metagauge.llm.tables import stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality score reaches 0.3."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a similarity of 0.8 or more of shingles of five words."""
    return keep_one_of_each(docs, shingle_words=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words or more that stand elsewhere, but for their first place."""
    return remove_repeats(docs, min_words=50)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of ten words or more of benchmark items, and documents that are mostly such passages."""
    return remove_items(docs, table(spark, sf_dir, "benchmark"), window=10, max_coverage=0.5)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of every text, and keeps as the text what they decode to."""
    return pieces.encode_and_decode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("suffix dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]
#: Hashing, suffix matching and encoding are beyond SQL; tests/llm checks the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
