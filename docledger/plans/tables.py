"""Reading the catalog's host tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``name`` of the star schema in ``sf_dir``; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the folder that spark.checkpoint.dir names, and read back: cuts the lineage.

    A local session without that setting (as in tests) uses a temporary folder; on a cluster it must be set, as executors
    would write to disks of their own.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
    path = f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, key: str, per_task: int) -> DataFrame:
    """``rows`` dealt by a key into parts of about ``per_task`` rows, before each row is worked on at length.

    A file's row group is read by one task, whatever the cluster, and may hold a million narrow rows.
    """
    return rows.repartition(max(1, -(-rows.count() // per_task)), key)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row: filters on them do not repeat their expressions, as they do on plain columns."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))
