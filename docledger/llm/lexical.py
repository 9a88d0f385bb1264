"""Operator 11: ranked lexical search, reversed: the items' terms are the index and the documents stream through it.

An inverted index from each term of the items to the items that hold it goes to every task. A document's counts of those
terms run through it, giving its score under every item at once, and each task keeps the best documents of each item in
a bounded heap. The heaps then merge by item, in two steps.

Items go through in blocks whose index stays below BLOCK_BYTES. A block whose measured index is larger, as that of a single
enormous item, is joined with the documents' terms instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docledger.llm.common import batches_of, discard, stored, term_codes

#: Bytes of an index that every task gets, at most, and bytes that a posting takes besides its term.
BLOCK_BYTES, POSTING = 32 << 20, 16
#: Documents times items that are scored at a time, and heaps that are merged into one in the first step.
CELLS, MERGED = 1 << 22, 256
SCALE, PRECISION = 1_000_000_000, 1000


def _unique_counts(row: np.ndarray, codes: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pairs, n = np.unique(row.astype(np.int64) * max(terms, 1) + codes, return_counts=True)
    return pairs // max(terms, 1), pairs % max(terms, 1), n


def term_counts(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, n (terms of the text), term and tf: one row for each distinct term of each row's whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batches_of(batch, "text"):
                codes, per_text, terms = term_codes(b.column("text"))
                row, code, tf = _unique_counts(np.repeat(np.arange(b.num_rows), per_text), codes, len(terms))
                yield pa.RecordBatch.from_arrays(
                    [b.column("key").take(pa.array(row)), pa.array(per_text[row], pa.int64())]
                    + [terms.take(pa.array(code)).cast(pa.string()), pa.array(tf, pa.int64())],
                    names=["key", "n", "term", "tf"],
                )

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(count, f"key {kind}, n long, term string, tf long")


def matches(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """doc_id, n, terms and tfs (numbers and counts of the given terms it holds) of every document with a term."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batches_of(batch, "text"):
                codes, per_text, words = term_codes(b.column("text"))
                known = pc.fill_null(pc.index_in(words.cast(pa.string()), value_set=terms), -1).to_numpy(zero_copy_only=False)
                at = known[codes] if len(codes) else np.zeros(0, dtype=np.int32)
                row = np.repeat(np.arange(b.num_rows), per_text)
                row, term, tf = _unique_counts(row[at >= 0], at[at >= 0], len(terms))
                held = np.nonzero(per_text)[0]
                offsets = pa.array(np.concatenate((np.searchsorted(row, held), [len(row)])).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(held)), pa.array(per_text[held], pa.int64())]
                    + [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, tf)],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(match, "doc_id long, n long, terms array<int>, tfs array<int>")


class Heaps:
    """The best k documents of each item seen so far. A null id ranks behind all others of its score."""

    def __init__(self, items: int, k: int):
        self.items, self.k, self.held = items, k, 0
        self.floor = np.ones(items, dtype=np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """scores: documents x items."""
        doc, item = np.nonzero(scores >= self.floor)
        self.parts.append((item, scores[doc, item], ids[doc], null[doc]))
        self.held += len(doc)
        if self.held > max(2 * self.items * self.k, 1 << 16):
            self.merge()

    def merge(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, bool))
        item, score, ids, null = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, null, -score, item))
        item = item[order]
        best = order[np.arange(len(item)) - np.searchsorted(item, item) < self.k]
        item, score, ids, null = self.parts[0] = tuple(np.concatenate(x)[best] for x in zip(*self.parts, strict=True))
        del self.parts[1:]
        self.held = len(item)
        last = np.searchsorted(item, np.arange(self.items), side="right") - 1
        full = np.bincount(item, minlength=self.items) == self.k
        self.floor[full] = score[last[full]]
        return self.parts[0]


def stream(found: DataFrame, postings: list[np.ndarray], weights: np.ndarray, items: pa.Array, total: tuple[int, int], k: int) -> DataFrame:
    """item, doc_id and score: every task's heaps over the documents of ``matches``. postings: items of each term."""
    size = np.array([len(p) for p in postings], dtype=np.int64)
    flat = np.concatenate(postings) if len(postings) else np.zeros(0, dtype=np.int64)
    start = np.cumsum(size) - size
    docs, length = total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(items), k)
        step = max(1, CELLS // max(len(items), 1))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                lists = b.column("terms")
                term = lists.flatten().to_numpy(zero_copy_only=False)
                tf = b.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                sizes, of = np.unique(b.column("n").to_numpy(zero_copy_only=False), return_inverse=True)
                m = np.array([10 + 90 * n * docs // length for n in sizes.tolist()], dtype=np.int64)[of]
                gain = weights[term] * ((SCALE * tf) // (PRECISION * tf + 8 * m[row]))
                n = size[term]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                cell = np.repeat(row * len(items), n) + flat[np.repeat(start[term], n) + place]
                scores = np.zeros(b.num_rows * len(items), dtype=np.int64)
                np.add.at(scores, cell, np.repeat(gain, n))
                ids = b.column("doc_id")
                null = pc.is_null(ids).to_numpy(zero_copy_only=False)
                heaps.add(scores.reshape(b.num_rows, -1), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), null)
        item, score, ids, null = heaps.merge()
        yield pa.RecordBatch.from_arrays(
            [items.take(pa.array(item)), pa.array(ids, mask=null), pa.array(score)], names=["item", "doc_id", "score"]
        )

    return found.mapInArrow(run, "item int, doc_id long, score long")


def _best(rows: DataFrame, group: list[str], k: int, name: str = "_rank") -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= k)


def _by_join(docs: DataFrame, held: DataFrame, total: tuple[int, int]) -> DataFrame:
    """item, doc_id and score of every document with a term of an item: a join by term, for items beyond any broadcast."""
    n, length = total
    numbered = stored(docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id")).alias("doc"), "text"), "search-docs")
    counts = stored(term_counts(numbered, "doc"), "search-counts")
    df = counts.join(held.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weighed = held.join(stored(df, "search-df"), "term").select(
        "item", "term", F.floor(1000 * F.ln(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1))).alias("w")
    )
    m = F.expr(f"10 + cast((cast(90 as decimal(38,0)) * n * {n}) div {max(length, 1)} as long)")
    gain = F.col("w") * F.expr(f"({SCALE} * tf) div ({PRECISION} * tf + 8 * m)")
    joined = counts.withColumn("m", m).join(weighed, "term").groupBy("item", "key").agg(F.sum(gain).alias("score"))
    return joined.filter("score > 0").select("item", F.col("key.doc_id").alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, item: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item id, rank, doc_id, score: the k documents that score highest for each item, all if fewer score above 0.

    Each row of docs is a document, repeated ids and repeated rows too; equal scores rank by ascending id, null ids last.
    Rows of items that share an id, null among them, are one item with the terms of all. Null texts, and texts without a
    term, score nothing; neither does an empty table. Texts of any length count whole; further columns are ignored.
    """
    spark = docs.sparkSession
    held = term_counts(items, item).select(F.col("key").alias("id"), "term").distinct()
    sizes = stored(held.groupBy("id").agg(F.sum(F.octet_length("term") + POSTING).alias("bytes")), "search-items")
    blocks = max(1, math.ceil(2 * (sizes.agg(F.sum("bytes")).first()[0] or 0) / block_bytes))
    numbered = sizes.select("id", "bytes", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    numbered = stored(numbered.withColumn("item", F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1), "search-blocks")
    terms = stored(held.join(numbered, held["id"].eqNullSafe(numbered["id"])).select("block", "item", "term"), "search-terms")
    made, tables, total = [], [], None
    for r in numbered.groupBy("block").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).orderBy("bytes").collect():
        own = terms.filter(F.col("block") == r["block"])
        small = r["bytes"] <= block_bytes
        table = own.select("item", "term").toArrow() if small else None
        coded = pc.dictionary_encode(table["term"].combine_chunks()) if small else pa.array([""]).dictionary_encode()
        if small or total is None:
            found = stored(matches(docs, coded.dictionary.cast(pa.string())), "search-matches")
            tables.append(found)
            if total is None:
                sums = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
                total = (sums["n"], sums["l"])
        if small:
            df = np.zeros(len(coded.dictionary), dtype=np.int64)
            for t, n in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
                df[t] = n
            weights = np.array([math.floor(1000 * math.log((2 * total[0] + 2) / (2 * n + 1))) for n in df.tolist()], dtype=np.int64)
            order = np.argsort(at := coded.indices.to_numpy(zero_copy_only=False), kind="stable")
            holders = table["item"].to_numpy()[order].astype(np.int64)
            postings = np.split(holders, np.cumsum(np.bincount(at, minlength=len(df)))[:-1])
            part = stream(found, postings, weights, pa.array(np.arange(r["n"]), pa.int32()), total, k)
            part = _best(part.withColumn("_salt", F.spark_partition_id() % MERGED), ["item", "_salt"], k)
        else:
            part = _by_join(docs, own, total)
        made.append(part.select(F.lit(r["block"]).alias("block"), "item", "doc_id", "score"))
    if not made:
        return spark.createDataFrame([], f"{item} {dict(items.dtypes)[item]}, rank int, doc_id long, score long")
    heaps = made[0]
    for part in made[1:]:
        heaps = heaps.unionByName(part)
    best = stored(_best(heaps, ["block", "item"], k, "rank"), "search-best")
    discard(*tables)
    return best.join(numbered, ["block", "item"]).select(F.col("id").alias(item), F.col("rank").cast("int"), "doc_id", "score")
