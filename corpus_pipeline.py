"""Corpus cleaning in five stages: quality filter, line dedup, near-dedup, decontamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import decontamination, lines, minhash, quality, sentencepiece_codec, simhash
from chronoweave.llm.common import free_names
from chronoweave.llm.queries import QUALITY_CUT, quality_train
from chronoweave.operators.staging import stage

ORACLE_SQL = None  # a trained classifier and a tokenizer are no SQL; tests hold the stages against plain versions


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is at least the cut; the model is fitted on labelled documents of the input."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality_train)
    score, = free_names(docs, "score")
    return quality.with_score(docs, model, out=score).where(F.col(score) >= QUALITY_CUT).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; n_chars, where there, follows the text."""
    out = lines.deduplicate_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word Jaccard similarity of 0.8 or more, verified on whole texts.

    SimHash fingerprints meet in the trie of op1; MinHash bands add the pairs that are alike but over 4 bits apart.
    """
    return simhash.near_duplicates_removed(docs, groups=minhash.jaccard_components)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), copies=True)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns and token_ids."""
    return sentencepiece_codec.encoded(docs)


STAGES = [("quality_filter", quality_filter), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_near_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("sentencepiece_encoding", sentencepiece_encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
