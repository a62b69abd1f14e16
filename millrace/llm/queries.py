"""The queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors, ans, contextmix, decontam, kneser, mixing, oracles, quality, secrets, simhash, sufarr
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(quality.stored(table(spark, sf_dir, "documents")))


def word_bpe() -> str:
    """The public tokenizer's file; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ans.output(table(spark, sf_dir, "documents"), word_bpe())


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("bits")).alias("fingerprint"), "component_id", "n_links")


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), max_docs=None)


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sufarr.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.balanced(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate", "multiplier", "residual")


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contextmix.scored(table(spark, sf_dir, "documents"), adapt=True)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anchors.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_decontamination, op2_quality_rules, op3_token_output, op4_simhash, op5_kneser_ney, op6_suffix_array, op7_mixing, op8_context_mixing, op9_secrets, op10_anchors)}
#: DuckDB SQL for the queries that SQL can express on whole tables.
ORACLES: dict[str, str] = {"op2_quality_rules": oracles.OP2, "op6_suffix_array": oracles.OP6, "op10_anchors": oracles.OP10}
