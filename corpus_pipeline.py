"""A training corpus from raw documents in five stages; each is one operator applied to all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, near_dup, quality, token_files
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.tables import drop_ids, load
from tidemark.session import ship
from tidemark.workspace import scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the fixed limits or the trees go."""
    ship(spark)
    return quality.accepted(docs, quality.train(docs, load(spark, sf_dir, "labels")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    ship(spark)
    return near_dup.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold three quarters of a benchmark item's shingles go."""
    found = decontaminate.contaminated(docs, load(spark, sf_dir, "benchmark"))
    return drop_ids(docs, found)


def temperature_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; those of small sources come again as the mix asks for."""
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what is read back from them, a row per document."""
    ship(spark)
    folder = scratch(spark, "corpus-tokens")
    token_files.write_tokens(docs, folder, tokenizer_path())
    return token_files.read_tokens(spark, folder, with_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("temperature_mixing", temperature_mixing),
    ("token_output", token_output),
]

# SQL has no boosted trees, sketches or tokenizer; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
