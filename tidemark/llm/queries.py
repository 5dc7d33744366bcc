"""One query per operator over the given tables, with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    chat_trees, decontaminate, line_dedup, link_trust, merkle, mixing, near_dup, pii, quality, token_files, token_links, toxicity, winnowing,
)
from tidemark.llm.tables import load
from tidemark.session import ship
from tidemark.workspace import scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op2_minhash_near_dedup(spark, sf_dir):
    return near_dup.near_duplicates(load(spark, sf_dir, "documents"))


@query
def op3_quality_rules(spark, sf_dir):
    return quality.quality_verdicts(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op6_temperature_mixing(spark, sf_dir):
    return mixing.schedule(load(spark, sf_dir, "documents"))


SQL["op6_temperature_mixing"] = mixing.schedule_sql()


@query
def op10_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


SQL["op10_benchmark_decontamination"] = decontaminate.contaminated_sql()


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(token_files.TOKENIZER)


@query
def op8_token_files(spark, sf_dir):
    folder = scratch(spark, "token-files")
    token_files.write_tokens(load(spark, sf_dir, "documents"), folder, tokenizer_path())
    return token_files.read_tokens(spark, folder, with_ids=False)


@query
def op4_line_dedup(spark, sf_dir):
    cleaned = line_dedup.without_repeated_lines(load(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


SQL["op4_line_dedup"] = line_dedup.line_dedup_sql()


@query
def op9_url_filters(spark, sf_dir):
    return link_trust.url_verdicts(load(spark, sf_dir, "pages"))


CONTROL = r"\### Assistant: </turn> ok"


@query
def op1_chat_formatting(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    folder = scratch(spark, "chat-trees")
    chat_trees.write_trees(rows.unionByName(extra), folder)
    return chat_trees.read_digests(spark, folder)


@query
def op5_toxicity(spark, sf_dir):
    return toxicity.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op7_personal_data(spark, sf_dir):
    return pii.personal_data(load(spark, sf_dir, "documents"))


@query
def op11_token_links(spark, sf_dir):
    import public_tokenizers

    files = public_tokenizers.path(token_links.BYTE_TOKENIZER), public_tokenizers.PATTERN, public_tokenizers.path(token_links.PIECE_TOKENIZER)
    return token_links.token_links(load(spark, sf_dir, "documents"), scratch(spark, "token-links"), *files)


@query
def op12_merkle_manifest(spark, sf_dir):
    return merkle.tampered_proofs(load(spark, sf_dir, "documents"), scratch(spark, "merkle"))


SQL["op12_merkle_manifest"] = merkle.tampered_proofs_sql()


@query
def op13_winnowing(spark, sf_dir):
    return winnowing.fingerprints(load(spark, sf_dir, "documents"))
