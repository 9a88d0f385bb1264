"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir). All but the last return the columns of docs; a document travels as one struct, or
under numbered names, so further columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.llm import jaccard, langid, mixing, packing, quality
from docledger.llm.common import n_words, stored

#: How much likelier, in nats a word, a document's language must make it than the next language does.
MIN_LANGUAGE_MARGIN = 1.0


def _wrapped(docs: DataFrame, *needed: str) -> DataFrame:
    return docs.select(F.struct("*").alias("_doc"), *needed)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letter, or no language clearly likelier than the others.

    The margin is one of a word, so that long mixtures of languages go as short ones do. Repeated rows are judged alike;
    an empty table gives no rows; where no language is labelled, all documents go.
    """
    path = langid.vocabulary_path()
    train = docs.filter(~langid.held_out(F.col("doc_id"), 5)).select("doc_id", "text", "lang")
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    found = langid.predict(numbered, numbered.columns, *langid.fit(train, path), path, f"c{docs.columns.index('text')}")
    kept = found.filter((F.col("lang_pred") != langid.UNDETERMINED) & F.expr(f"coalesce(margin >= {MIN_LANGUAGE_MARGIN}, true)"))
    return kept.select(*numbered.columns).toDF(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the thresholds of their language and source reject.

    A null text has no words and goes; null languages and sources are groups of their own; repeated rows are judged
    alike; an empty table gives no rows.
    """
    return quality.judge(_wrapped(docs, "text", "lang", "source"), ["_doc"]).filter("kept").select("_doc.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document that names each group of near copies; rows that repeat its id count as one document.

    Documents without an id stay, as no group is named after them; documents without words are groups of their own. An
    empty table gives no rows. Texts are shuffled once: the merge join deals them as dropDuplicates needs them.
    """
    groups = jaccard.cluster(docs.select("doc_id", "text"))
    kept = stored(groups.filter("doc_id = component_id").select("doc_id").distinct(), "near-copies-kept")
    named = docs.filter("doc_id is not null").join(kept.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it, up to three times; those not taken go.

    Null sources form one source, null texts have no size, rows of one id and size are taken alike, as are those without
    an id that have one text, and an empty table gives no rows. Texts are shuffled once, for the weights by document.
    """
    weights = mixing.quality_weight(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    told = F.when(F.col("doc_id").isNull(), F.col("text")).alias("told")
    sized = _wrapped(docs, "doc_id", "source", n_words(F.col("text")).alias("size"), told)
    rows = sized.join(weights.hint("merge"), "doc_id", "left")
    mixed = mixing.mix(rows, "told").select("_doc", F.explode(F.array_repeat(F.lit(1), F.col("times"))))
    return mixed.select("_doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of documents of similar length: doc_id, length (words and an end token), bucket, limit, batch and slot.

    Null and empty texts have the end token alone; copies of a document are packed one by one; an empty table gives no
    rows.
    """
    rows = stored(docs.select("doc_id", (n_words(F.col("text")) + 1).alias("length")), "lengths")
    return packing.pack(rows).select("doc_id", "length", "bucket", "bucket_limit", "batch", "slot")


STAGES = [
    ("language", language),
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("source_mix", source_mix),
    ("packing", pack),
]

#: A fitted model decides in the first stage, so SQL cannot express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
