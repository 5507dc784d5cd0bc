"""Stages of the training-data pipeline: each works on all its predecessor kept.

Null and empty texts have no language and go in the first stage; given to a later one, they
have no copies and no benchmark passage, are mixed like others, and are written as the
end id alone. Very long texts are worked on whole. Of repeated rows the second stage
keeps one. Where rows tie, the smallest id and then the text's hash decide. An empty table
passes every stage as an empty table. Columns beside those of ``documents`` stay as they
are until the token files, whatever they are called.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eraflow.llm import decontam, langid, mixing, neardup, tokens
from eraflow.llm.common import table, work_dir
from eraflow.llm.queries import MIX_ALPHA, MIX_EPOCHS, MIX_SEED, VOCABULARY

# A text whose pooled probability of its likeliest language is lower is in none.
MIN_LANGUAGE_SCORE = 0.4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network can tell; the others go."""
    model = langid.fit(langid.training_rows(docs))
    found = langid.identify(docs, model)
    sure = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return found.where(sure).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.keep_one(docs, work_dir(spark, "stage-copies"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    items = table(spark, sf_dir, "benchmark")
    return decontam.drop_contaminated(docs, items, work_dir(spark, "stage-benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights, shuffled; a document comes as often as its
    count says."""
    rates = mixing.temperature_rates(docs, MIX_ALPHA, MIX_EPOCHS)
    return mixing.replicate(docs, rates, MIX_SEED).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' documents, as read back. They stand in the files in the order in
    which the mix was written."""
    index = tokens.write_sequences(docs, work_dir(spark, "stage-tokens"), VOCABULARY, order=written_order(docs))
    return tokens.read_back(index)


def written_order(docs: DataFrame) -> list[Column]:
    """The place of a row in the files it is read from; a hash of it where there are none."""
    place = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    try:
        docs.select(*place)
    except AnalysisException:  # not rows of files
        return [F.xxhash64(F.lit(MIX_SEED), "doc_id", "text")]
    return place
