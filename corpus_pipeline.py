"""From raw documents to token files: five stages, each one operator of stackmill.llm applied to what the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Empty tables pass through every stage; null texts and
columns beside those of documents are defined in the operators' own docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackmill.llm import decontaminate, mixing, pu_quality, simhash, token_output
from stackmill.llm.common import set_apart, stash, table


#: Seeds of the fingerprints of the near-duplicate stage: a pair is found if any one of them links it.
NEAR_SEEDS = (42, 43, 44)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    named, back = set_apart(docs, "doc_id", "text")
    scored = pu_quality.quality_scores(named, table(spark, sf_dir, "labels"))
    return back(scored.filter(F.col("score") >= 0.5))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every near-duplicate group, by three fingerprints of shingles of five words, the document with the smallest id."""
    return simhash.keep_first(docs, shingle=5, seeds=NEAR_SEEDS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; documents mostly made of them go."""
    kept = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Source weights flattened a quarter of the way to equal; small sources are repeated, up to twice, and no document is lost."""
    return mixing.mix(docs, budget="whole", flatten=0.25, max_repeat=2.0)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in directly addressable files, and for every document what is read back from them."""
    return token_output.token_table(spark, docs, pieces=250_000)  # workers still hold what earlier stages left


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mixing_sources),
    ("token_files", token_files),
]

#: Learning, connected components and tokenizing have no SQL form; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
