"""Registered queries of this folder: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleloom.llm import chat, collocations, decontaminate, licenses, merkle, mixing, neighbours, quality, sharding, simhash, tokencount, topk, toxicity


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op4_chat(spark: SparkSession, sf: str) -> DataFrame:
    talks = chat.probe(_table(spark, sf, "conversations"), "</s>[INST] ok [/INST]")
    return chat.read_back(chat.format_turns(chat.events_of(talks)))


def op5_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(_table(spark, sf, "documents"))


def op6_sharding(spark: SparkSession, sf: str) -> DataFrame:
    sharded = sharding.shuffle_to_shards(_table(spark, sf, "documents"))
    return sharded.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(_table(spark, sf, "embeddings"))


def op10_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf, "documents"))


def op11_merkle(spark: SparkSession, sf: str) -> DataFrame:
    proved = merkle.manifest(_table(spark, sf, "documents"), claim=merkle.tampered())
    return proved.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.siblings(), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.near_duplicates(_table(spark, sf, "embeddings"))


def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_mixing, op3_decontamination, op4_chat, op5_licenses, op6_sharding, op7_toxicity, op8_token_counts, op9_topk, op10_simhash, op11_merkle, op12_embedding_near_dedup, op13_collocations)}
