"""The registered queries of this subpackage, each over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from objectlens.llm import bpe, cnn, lm, minhash, planes, ppm, rules, shards, sql, suffixes, urls
from objectlens.llm.common import crc_bucket, scratch

TOKENIZER = "word_bpe_49k.json"
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.bpe_encode(docs, public_tokenizers.path(TOKENIZER), keep=["doc_id"], digest=True)


def op2_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.url_verdicts(pages, URL_RULES, urls.train(pages, URL_RULES), keep=["page_id"])


def op3_compacted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard after compaction: doc_id, shard, version, text_sha256."""
    store = shards.ShardStore(spark, scratch(spark, "shards"))
    store.append(table(spark, sf_dir, "documents"))
    version = store.compact()
    store.vacuum()
    return store.read(version).select("doc_id", F.col("_shard").alias("shard"), F.lit(version).cast("bigint").alias("version"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op4_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_bucket("doc_id", 4) == 2
    net = cnn.train(docs, table(spark, sf_dir, "labels").where(~held))
    return cnn.quality_scores(docs, net, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = crc_bucket("doc_id", 4) == 2
    trees = ppm.train(docs.where(~held))
    return ppm.identify(docs, trees, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return planes.token_files(docs, public_tokenizers.path(TOKENIZER), end_id=1)


def op7_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm.score_texts(docs, crc_bucket("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffixes.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict:
    """Query by name, in the order of the operators' numbers."""
    own = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(own.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
