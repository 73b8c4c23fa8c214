"""A training corpus from raw documents, in five stages; each is written and read again before the next.

Language identification drops what it rejects, near-duplicates leave one document of each group, repeated passages are cut
out of the texts, sources are interleaved by their target weights, and the texts are packed into token sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm.common import checkpoint_folder, discard, set_aside, table

#: Near-duplicates share four fifths of their shingles of five words.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: Passages of more than fifty words repeat: the least words of one, the bytes that nearly all of those have, and those of the
#: anchors in them. Shorter ones of as many words are found by their words.
PASSAGE_WORDS, PASSAGE_BYTES, ANCHOR_BYTES = 51, 250, 80
#: Every source has the same target weight.
SHARES = None
#: Parts of the mixture that are packed by themselves, one after another.
WINDOWS = 32


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected. lang is kept as it came: the model only decides who stays.

    A null text, or one without a letter, goes; each of repeated rows is judged alike. Without labelled rows to learn from,
    all go, and an empty table stays empty. Long texts are read whole.
    """
    from skirmish.llm.language import fit, identify

    docs, back = set_aside(docs, "doc_id", "text", "lang")
    return identify(docs, fit(docs)).where("NOT rejected").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, and of repeated rows one.

    Null and empty texts are linked with nothing, so they stay; a null doc_id stays only if its group has no other.
    """
    from skirmish.llm.neardup import unique_documents

    return unique_documents(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that strings of PASSAGE_WORDS words or of PASSAGE_BYTES that occur again cover; n_chars
    counts what is left. Null and empty texts stay as they are; repeated rows repeat each other, so their texts go."""
    from skirmish.llm.repeats import remove_repeats

    names = docs.columns
    done = remove_repeats(docs, PASSAGE_BYTES, ANCHOR_BYTES, PASSAGE_WORDS)
    return done.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in names))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture. A null source is one of its own; null and empty texts count as one byte;
    repeated rows all stay."""
    from skirmish.llm.mixing import mixed

    return mixed(docs, SHARES)


def _window(docs: DataFrame) -> Column:
    """Which of WINDOWS equal parts of the order of docs a document lies in; the mixture wrote its files in its order."""
    try:
        part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).try_cast("long")
        last = docs.select(F.max(part)).first()[0]
    except AnalysisException:  # not a table of files
        last = None
    if last is None:
        part, last = F.spark_partition_id().cast("long"), docs.rdd.getNumPartitions() - 1
    return F.call_function("div", F.coalesce(part, F.lit(0)) * min(WINDOWS, last + 1), F.lit(last + 1))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in token sequences, whose numbers follow the order of the mixture.

    A null or empty text has the end token alone; repeated rows are documents of their own; a null doc_id stays null.
    """
    from skirmish.llm.packing import pack_documents
    from skirmish.llm.queries import vocabulary

    return pack_documents(docs, *vocabulary(), window=_window(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packing", packing),
]
#: No SQL: the first stage's model is learned by gradient descent, and tokenisation is not relational.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            discard(spark, last)  # what a stage read isn't needed once it has written
        last = f"{folder}/{name}"
    return docs
