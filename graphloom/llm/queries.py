"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, extraction, kneser_ney, langid, line_rules, mining, mixing, packing, pieces, quality, repair, simhash, topk
from .common import crc_mod, read

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of documents to equal weights, as many rows out as in (in expectation)."""
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.apply_line_rules(read(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(spark, read(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = kneser_ney.score(docs, kneser_ney.train(spark, docs, kneser_ney.in_training(F.col("doc_id"))))
    return scored.withColumn("held_out", crc_mod(F.col("doc_id"), 10) == 0)


def op6_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extraction.extract(spark, pages).withColumn("n_chars", F.length("text").cast("long"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs, langid.in_training(F.col("doc_id")))
    scored = langid.identify(spark, docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(spark, docs, read(spark, sf_dir, "labels"), quality.in_training(F.col("doc_id")))
    scored = quality.classify(spark, docs, model)
    score = F.col("quality_score")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_conversations(chat.with_probe(spark, read(spark, sf_dir, "conversations"))))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(repair.repair(repair.damage(read(spark, sf_dir, "conversations")), "lost"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.decode(pieces.encode(read(spark, sf_dir, "documents"))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.mine(spark, mining.relabelled(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Query]:
    ops = (op1_mix_sources, op2_line_rules, op3_simhash, op4_pack, op5_kneser_ney, op6_extract, op7_language_id, op8_quality_classifier, op9_top_k, op10_chat_format, op11_repair, op12_pieces, op13_hard_negatives)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.MIX_SQL, "op2_line_rules": line_rules.RULES_SQL, "op9_top_k": topk.TOP_K_SQL, "op10_chat_format": chat.CHAT_SQL, "op11_repair": repair.REPAIR_SQL, "op13_hard_negatives": mining.MINE_SQL}
