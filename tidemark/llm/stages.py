"""The stages of the corpus pipeline: documents in, documents out.

Every stage works on all rows it is given, returns all columns of documents (extra ones
too), and takes labels and test items from the tables beside them. Empty tables pass
through as such.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm import curriculum, phrase_index, simhash_gph, token_files, toxic_neighbours
from tidemark.llm.rows import table, tuned

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely harmless than toxic."""
    tuned(spark)
    return toxic_neighbours.without_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates (five-word shingles, similarity from 0.8)."""
    tuned(spark)
    return simhash_gph.keep_first(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    tuned(spark)
    return phrase_index.without_passages(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of training."""
    tuned(spark)
    return curriculum.mixed(docs, curriculum.mix_plan(docs))


def file_order(docs: DataFrame) -> list[Column]:
    """Place of each row in the files that hold it; none for rows that are in no file."""
    name = F.col("_metadata.file_name")
    place = [F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long"), name, F.col("_metadata.row_index")]
    try:
        docs.select(*place)
    except AnalysisException:
        return []
    return place


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents in the order in which they stand in their files, the order of training; what is read back."""
    tuned(spark)
    return token_files.token_digest(docs, token_files.Settings(TOKENIZER), order=file_order(docs))
