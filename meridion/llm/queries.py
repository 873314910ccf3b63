"""The contract queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.llm import language_id, lsh_forest, mixing, toxicity
from meridion.llm.common import crc_of_id, table
from meridion.llm.embedding_dedup import near_duplicates
from meridion.llm.mixing import mixing_plan
from meridion.llm.packing import pack
from meridion.llm.sharding import shard
from meridion.llm.token_counts import count_tokens
from meridion.llm.url_filter import judge_urls
from meridion.llm.vptree import index, nearest


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=1024)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_of_id("doc_id") % 3 == 1
    said = language_id.predict(docs, language_id.fit(docs, ~held_out))
    return said.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=24, overhead=8)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(index(rows), rows.where(F.col("vec_id") % 20 == 0), k=20, factor=1.0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_of_id("doc_id") % 5 == 0
    tagged = toxicity.tag(docs, toxicity.fit(docs, labels, ~held_out))
    return tagged.select("doc_id", held_out.alias("held_out"), "score", "predicted", "spans")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_url_filter": op3_url_filter,
    "op4_language_id": op4_language_id,
    "op5_sharding": op5_sharding,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL: dict[str, str] = {"op10_mixing": mixing.SQL}
