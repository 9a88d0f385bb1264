"""Pieces that several operators share: shared tables, words, and offsets over sorted rows."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Word separators: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = " \t\n\x0b\x0c\r"

_own_dirs: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where it is unset and the session is local (as in tests) a temporary folder takes its place; on a cluster
    executors would write to disks of their own, so an unset folder raises.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_dirs[app]


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: cuts the lineage.

    Spark knows the table's size, so joins with it are broadcast only where that is small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``stored``, once all that was derived from them is itself stored."""
    for table in tables:
        path = _paths.pop(table, None)
        if path:
            jvm = table.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def doc_crc(doc_id: Column) -> Column:
    """CRC-32 of the id's decimal text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def words(text: Column) -> Column:
    """Array of the maximal runs of non-separators; empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_codes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of a batch of texts: code of each word in turn, words per text, and the distinct words.

    Nulls count as empty texts. Only A-Z are lower-cased.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py())
    coded = pc.dictionary_encode(flat)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy(zero_copy_only=False) - lists.offsets[0].as_py()
    kept = np.ones(len(codes), dtype=bool)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:  # at a text's ends
        kept = codes != empty
    per_text = np.diff(np.concatenate(([0], np.cumsum(kept)))[offsets])
    return codes[kept], per_text, coded.dictionary


#: Bytes of terms (ASCII letters and digits, and all that is beyond ASCII) as they are, A-Z lower-cased, others as a space.
_TERM_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b > 127 else 32 for b in range(256)], dtype=np.uint8)


def term_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """As ``word_codes``, for terms: maximal runs of ASCII letters, digits and characters beyond ASCII; A-Z are lower-cased."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if data is not None:
        spaced = pa.py_buffer(_TERM_BYTES[np.frombuffer(data, dtype=np.uint8)])
        texts = pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, spaced], offset=texts.offset)
    return word_codes(texts, lower=False)


def batches_of(batch: pa.RecordBatch, column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose texts hold about ``limit`` bytes each, one row at least.

    Parts are copies: some string kernels misread a slice that starts inside its buffers.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, ends = 0, np.cumsum(sizes)
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right"))
        upto = max(upto, at + 1)
        yield batch if upto - at == batch.num_rows and not at else batch.take(pa.array(np.arange(at, upto)))
        at = upto


def prefix_offsets(df: DataFrame, group: list[str], part: str, value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over all earlier parts of a group, for each (group, part).

    Parts are pre-aggregated, so the window sees one row for each part, not for each row of ``df``.
    """
    sums = df.groupBy(*group, part).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*group, part, F.coalesce(F.sum("_sum").over(before), F.lit(0).cast("long")).alias(name))
