"""Sinks: tables by document, append-only logs, replaced tables, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_by_document(df: DataFrame, folder: str, key: str = "doc_bucket") -> None:
    """Parquet by buckets of documents: a folder for each document would be too many."""
    df.write.mode("append").partitionBy(key).parquet(folder)


def append_log(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


def replace_table(df: DataFrame, folder: str) -> str:
    """Writes a new version beside the old ones and returns its path: readers of the old one are not disturbed."""
    path = f"{folder}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both, the latest by ``order`` for each key; on a tie the new one, among several new ones that with the largest values."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"), *(F.desc(c) for c in old.columns if c not in (*keys, order)))
    return both.withColumn("_r", F.row_number().over(latest)).filter("_r = 1").drop("_r", "_new")


def export_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(folder)


def markdown(df: DataFrame, limit: int = 100) -> str:
    """A small report as a Markdown table; ``limit`` rows at most reach the driver."""
    rows = df.limit(limit).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def checked_export(df: DataFrame, issues: DataFrame, folder: str, spark: SparkSession | None = None) -> bool:
    """Exports only if there is no issue at all; says whether it did."""
    if not issues.isEmpty():
        return False
    export_csv(df, folder)
    return True
