"""From raw documents to token blocks: five stages, each one operator.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents as they came, also
columns named like an operator's own output.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm import decontaminate, mixing, ngram_join, quality_classifier, token_store
from vectrail.llm.common import shared_dir, table
from vectrail.sources.shared import cleaned, drop_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality, by a classifier fitted on the labelled ones."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A selection whose sources have their target weights, in the token ids
    that the last stage writes."""
    return mixing.keep_mixture(docs, tokens=token_store.id_count(spark, F.col("text")))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Compressed blocks of token ids."""
    return token_store.token_blocks(docs)


STAGES = [
    ("quality classifier", quality),
    ("near copies", near_copies),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("token output", token_output),
]

#: No SQL has a random-feature fit or a range coder; tests hold each stage
#: against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table.  What a stage left behind, and the table before
    it, are deleted once its own is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with cleaned(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            drop_table(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
