"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, mixing, ngram_join, quality_classifier, quality_rules, token_store, toxicity, url_filter, warc_index
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.good_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = warc_index.capture_lines(table(spark, sf_dir, "pages"), F.expr(warc_index.CAPTURE_TS))
    return warc_index.merge_index(lines)


#: Target weights of op5: two sources count twice.  The budget is nine tenths of
#: all tokens; what a source can't give the others make up for.
TARGETS = mixing.MixRules(weights={"src0": 2.0, "src1": 2.0}, other=1.0, share=0.9)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), rules=TARGETS)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean_lines(table(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_blocks(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.train_lexicon(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxic_documents(docs, rules=toxicity.ToxicityRules(lexicon=lexicon))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_line_dedup, op2_quality_classifier, op3_url_filter, op4_warc_index, op5_mixing, op6_decontamination,
            op7_ngram_join, op8_quality_rules, op9_token_output, op10_toxicity,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": url_filter.oracle(),
        "op4_warc_index": warc_index.oracle(),
        "op6_decontamination": decontaminate.oracle(),
        "op7_ngram_join": ngram_join.oracle(),
        "op8_quality_rules": quality_rules.oracle(),
    }
