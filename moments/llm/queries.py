"""Registered queries over the training-data tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moments.llm import decontam, line_runs, maxent, merkle, mixing, near, pii, quality, repeats, secrets, sharding, turns, wrapper
from moments.llm.common import save, table
from moments.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrapper.main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_runs.drop_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query
def op5_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = save(quality.features(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "q"))
    return quality.judged(feats, quality.references(feats)).select(
        "doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "base_failed", "kept"
    )


@query
def op7_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


@query
def op9_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark)).select(
        "doc_id", "text", F.size("pii").cast("long").alias("n_pii"), F.array_join("pii", ",").alias("kinds")
    )


@query
def op10_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op3_qgram_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "class_id", "n_links"
    )


@query
def op6_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


@query
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repaired(table(spark, sf_dir, "conversations"))


@query
def op11_column_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents").select("doc_id", "text"), words=repeats.WORDS)
