"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

All stages but the last return whole rows, extra columns of any name included. An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalspark.llm import exact, language, packing, simhash, substrings
from evalspark.scratch import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those whose text fits no learned language well, go.

    A null or empty text has no letters. Rows are judged one by one by their whole text, so repeated rows share their fate; a row without a
    ``lang`` is judged too but not learned from. Of languages with equal scores the first in the alphabet is taken.
    """
    return language.keep_known(docs, language.fit(docs, train=~language.held_out()))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays.

    Texts are equal up to the width of their white space; a null text is empty, and empty texts are equal. Repeated rows stay once. Rows of one id
    with different texts all stay. A row without an id stays only where no row of its text has one.
    """
    return exact.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the smallest id stays.

    Texts without words have one fingerprint and are a group. Rows of one id are told apart by their texts, and of a group only one text of the smallest
    id stays; its repeated rows stay together. Rows without an id stay.
    """
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document, by id, holds are cut out.

    A text of which only white space is left goes; a null or empty one, and a row without an id, stays as it is. Rows of one id do not cut each
    other, and each is cut by its own repeats. ``n_chars`` is counted again where something was cut.
    """
    return substrings.cut_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents with their places in sequences.

    A null or empty text gives one piece with the end id; long texts give several. Repeated rows and ids are documents of their own. Of rests of equal
    length the earlier one is placed first.
    """
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("substring_dedup", substring_dedup), ("packing", pack)]

#: SQL can't express a trained model, rolling hashes and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLE = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
