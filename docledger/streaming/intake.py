"""Uploaded texts as they arrive: each file once, its rows wired through, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docledger.operators.wiring import wired
from docledger.plans.tables import stored
from docledger.streaming.metrics import uploads

READ = "TXT"


def envelopes(files: DataFrame, memory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc, path, file_type, status, lines, parsed, validated, review) and their rows (doc and what ``wired`` gives).

    files: path, content, file_type. A document is told by the hash of its content: of files with the same one the first path
    stands for all. Only texts are read; others are documents without rows whose status is ``unsupported``; texts of white space are
    ``empty`` (Spark's file source passes by files without a byte). Rows with a safe match are validated, others go to review.
    """
    named = files.select(F.sha2("content", 256).alias("doc"), "path", "file_type", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    once = stored(named.groupBy("doc").agg(F.min_by(F.struct("path", "file_type", "text"), "path").alias("f")).select("doc", "f.*"), "intake-files")
    texts = once.filter(F.col("file_type") == READ)
    lines = texts.select(F.col("doc").alias("page"), F.posexplode(F.split("text", "\r?\n")).alias("idx", "line"))
    rows = stored(wired(lines.withColumn("idx", F.col("idx").cast("long")), memory).withColumnRenamed("page", "doc"), "intake-rows")
    parsed, safe = F.col("status") == "parsed", F.col("state") == "matched"
    counts = rows.groupBy("doc").agg(F.count_if(parsed).alias("parsed"), F.count_if(parsed & safe).alias("validated"), F.count_if(parsed & ~safe).alias("review"))
    status = F.when(F.col("file_type") != READ, "unsupported").when(F.trim("text") == "", "empty").when(F.coalesce("parsed", F.lit(0)) > 0, "extracted").otherwise("no_rows")
    size = F.when(F.col("file_type") == READ, F.size(F.split("text", "\r?\n"))).otherwise(0)
    of = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    documents = once.join(counts, "doc", "left").select("doc", "path", "file_type", status.alias("status"), size.alias("lines"), of("parsed"), of("validated"), of("review"))
    return documents, rows


def _known(spark: SparkSession, folder: str, batch: int) -> DataFrame | None:
    """doc of all documents that other batches wrote; None before the first."""
    try:
        return spark.read.parquet(f"{folder}/documents").filter(F.col("batch") != batch).select("doc")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def take_in(folder: str, memory: Callable[[SparkSession], DataFrame]) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls. A batch that is run again replaces what it wrote, rows first, so that documents are there only with
    their rows; files that another batch has taken in, by their content, are left out. The memory is read anew for each batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = _known(spark, folder, number)
        files = batch.select("path", "content", "file_type").withColumn("doc", F.sha2("content", 256))
        new = files if known is None else files.join(known, "doc", "left_anti")
        documents, rows = envelopes(new.drop("doc"), memory(spark))
        for name, table in (("rows", rows), ("documents", documents)):
            table.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return write


def start(spark: SparkSession, source: str, folder: str, memory: Callable[[SparkSession], DataFrame], pattern: str = "*") -> StreamingQuery:
    """Takes in what has been uploaded since the last run, and ends; the checkpoint lies beside the tables."""
    writer = uploads(spark, source, pattern).writeStream.foreachBatch(take_in(folder, memory))
    return writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
