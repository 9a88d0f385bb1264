"""The subpackage's registered queries: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.llm import chat, contextmix, jaccard, langid, lexical, licenses, mixing, packing, pivots, quality, repair, sstable, toxicity
from docledger.llm.common import n_words, stored
from docledger.llm.oracles import SQL


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(_read(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id"), 5).alias("held_out"), "lang_pred", "score")


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_read(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.cluster(_read(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contextmix.score(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_read(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths are a text's words and one end token."""
    docs = _read(spark, sf_dir, "documents")
    rows = stored(docs.select("doc_id", (n_words(F.col("text")) + 1).alias("length")), "lengths")
    return packing.pack(rows).select("doc_id", "length", "bucket", "bucket_limit", "batch", "slot")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.when(F.col("doc_id").isNull(), F.col("text")).alias("told")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"), told)
    weights = mixing.quality_weight(_read(spark, sf_dir, "labels"))
    rows = stored(docs.join(weights, "doc_id", "left"), "sizes")
    return mixing.mix(rows, "told").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken")
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds conversation -7, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(stored(chat.format_trees(chat.chains(rows)), "chats"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read(spark, sstable.write(_read(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = toxicity.scan(docs, ["doc_id"], toxicity.fit(docs, _read(spark, sf_dir, "labels")))
    return found.select("doc_id", langid.held_out(F.col("doc_id"), toxicity.FOLDS).alias("held_out"), "score", "predicted")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs conversations after damage that depends on their ids and turns alone."""
    return repair.digests(repair.repair(repair.damaged(_read(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_near_vectors, op3_quality_rules, op4_jaccard_join, op5_lm_score, op6_license_scan, op7_packing, op8_source_mix, op9_chat_format, op10_token_shards, op11_lexical_search, op12_toxicity, op13_repair)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
