"""Corpus pipeline: toxicity, near duplicates, benchmark passages, personal data, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from statloom.llm.base import table
from statloom.llm.decontaminate import decontaminated
from statloom.llm.mixing import mixed
from statloom.llm.ngram_join import one_of_each_group
from statloom.llm.pii import redacted
from statloom.llm.toxicity import with_toxicity
from statloom.sources.landing import land, landings


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half. Labels are read from ``sf_dir``; the score reads only the text."""
    return with_toxicity(docs, table(spark, sf_dir, "labels")).where("_score < 0.5").select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    return one_of_each_group(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data in the text is replaced by its kind, and ``n_chars`` follows the text."""
    out = redacted(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in out.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with raked weights: their columns, topic, tokens, weight and copies (one or more)."""
    found = mixed(docs).where("_copies > 0")
    return found.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col("_topic").alias("mix_topic"), F.col("_tokens").alias("mix_tokens"),
        F.round("_weight", 9).alias("mix_weight"), F.col("_copies").alias("mix_copies"),
    )


STAGES = [
    ("toxicity", nontoxic),
    ("ngram_jaccard_join", distinct_documents),
    ("benchmark_decontamination", without_benchmarks),
    ("pii", without_personal_data),
    ("mixing", mixture),
]

# the stages learn, group and iterate: tested against brute-force versions instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with landings() as own:
        for name, stage in STAGES:
            docs = stage(spark, docs, sf_dir)
            if name != STAGES[-1][0]:
                docs = land(docs)
            own.only(docs)
    return docs
