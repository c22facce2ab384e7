"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import hamming, langid, linededup, mixing, packing, quality, secrets, sharding, suffix, superminhash

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample_copies(_table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.remove_repeats(_table(spark, sf_dir, "documents"))


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.neighbours(_table(spark, sf_dir, "embeddings"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(_table(spark, sf_dir, "documents"))


def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return quality.score(documents, quality.train(documents, _table(spark, sf_dir, "labels")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_mixing, op2_secrets, op3_line_dedup, op4_multi_index_hashing, op5_suffix_array, op6_language_id, op7_sharding, op8_superminhash, op9_packing, op10_quality)}

ORACLE_SQL: dict[str, str] = {"op1_mixing": mixing.SQL, "op7_sharding": sharding.SQL}
