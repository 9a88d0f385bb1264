"""Operator 2: embedding near-duplicates through a pivot-permutation index.

A vector is described by its nearest pivots, in order. Vectors that share at least two of the first few are candidates:
an inverted list stands for each two pivots, so that a list holds candidates only, and a pair that shares more pivots is
taken from the first list that has it. The cosine of each candidate pair is then computed in double precision. Equal
vectors form one class and are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import discard, stored
from docledger.llm.graph import components

THRESHOLD = 0.93
#: Pivots: about the square root of the number of vectors, within these bounds; a bounded sample of the vectors.
MIN_PIVOTS, MAX_PIVOTS = 48, 1 << 15
#: Length of the permutation's front that is indexed; candidates share two pivots of it.
FRONT, PAD = 5, -2
#: Vectors in a block; a longer list is compared block by block. Lists of up to SHORT_LIST vectors are compared together,
#: some CHUNK vectors at a time.
BLOCK, SHORT_LIST, CHUNK = 1024, 32, 8192


def classes(vectors: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Members (``columns``, cls) of all rows, and classes of equal vectors (cls, label, vector, members, least).

    cls is a 64-bit hash of label and vector, null where the vector links with nothing: a null label or vector, a null
    or non-finite component, or a norm of zero.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    good = F.col("label").isNotNull() & F.coalesce(finite & some, F.lit(False))
    marked = vectors.withColumn("cls", F.when(good, F.xxhash64("label", v)))
    grouped = (
        marked.filter("cls is not null")
        .groupBy("cls")
        .agg(
            F.first("label").alias("label"),
            F.first("embedding").alias("vector"),
            F.count("*").alias("members"),
            F.min("vec_id").alias("least"),
        )
    )
    return marked.select(*columns, "cls"), grouped


def choose_pivots(grouped: DataFrame) -> np.ndarray:
    """A sample of the vectors by hash, normalised; vectors of the most frequent dimension only."""
    dims = grouped.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return np.zeros((0, 0))
    n = int(np.clip(round(dims[0]["count"] ** 0.5), MIN_PIVOTS, MAX_PIVOTS))
    rows = grouped.filter(F.size("vector") == dims[0]["d"]).orderBy(F.xxhash64("cls"), "cls").limit(n).select("vector").collect()
    return _normal(np.array([r[0] for r in rows], dtype=np.float64))


def _normal(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """Vectors of one dimension as the rows of a matrix of doubles."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _permutations(grouped: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds front, the numbers of the nearest pivots in ascending order, PAD where there are fewer.

    Vectors of another dimension than the pivots' have -1 and the dimension instead, so that they meet in one list.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            front = [[PAD] * (FRONT - 2) + [-1, n] for n in sizes.tolist()]
            fit = np.nonzero(sizes == pivots.shape[1])[0]
            if len(fit):
                x = _normal(_rows(b.column("vector").take(pa.array(fit)), pivots.shape[1]))
                order = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :FRONT]
                for i, o in zip(fit.tolist(), np.sort(order, axis=1).tolist(), strict=True):
                    front[i] = [PAD] * (FRONT - len(o)) + o
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(front, pa.list_(pa.int32()))], names=[*b.schema.names, "front"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grouped.schema.fields)
    return grouped.mapInArrow(describe, f"{fields}, front array<int>")


KEY = ("label", "p", "q", "i", "j")


def _starts(t: pa.Table) -> np.ndarray:
    """Where the lists start in a table sorted by KEY."""
    new = np.ones(t.num_rows, dtype=bool)
    label = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    new[1:] = np.any([x[1:] != x[:-1] for x in (label, *(t.column(k).to_numpy() for k in KEY[1:]))], axis=0)
    return np.nonzero(new)[0]


def list_links(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (rows of t) within whole lists of vectors of one dimension; t is sorted by KEY.

    Of a pair of different blocks, vectors of the same block are compared elsewhere. A pair that shares more than two
    pivots links in the first of its lists only.
    """
    vectors = t.column("vector").combine_chunks()
    v = _normal(_rows(vectors, len(vectors[0])))
    starts = _starts(t)
    sizes = np.diff(np.append(starts, t.num_rows))
    found = []
    for m in np.unique(sizes).tolist():
        own = starts[sizes == m]
        if m > SHORT_LIST:
            for s in own.tolist():
                x, y = np.nonzero(np.triu(v[s : s + m] @ v[s : s + m].T >= THRESHOLD, 1))
                found.append((x + s, y + s))
            continue
        a, b = np.triu_indices(m, 1)
        for part in np.array_split(own, max(1, len(own) * len(a) // 100_000)):
            x, y = (part[:, None] + a).ravel(), (part[:, None] + b).ravel()
            near = np.einsum("ij,ij->i", v[x], v[y]) >= THRESHOLD
            found.append((x[near], y[near]))
    x, y = (np.concatenate(z) for z in zip(*found, strict=True))
    q, i, j, block = (t.column(k).to_numpy() for k in ("q", "i", "j", "block"))
    front = _rows(t.column("front").combine_chunks(), FRONT)
    apart = (i[x] == j[x]) | (block[x] != block[y])
    x, y = x[apart], y[apart]
    both = (front[x][:, :, None] == front[y][:, None, :]).any(axis=2) & (front[x] > PAD) & (front[x] <= q[x][:, None])
    first = both.sum(axis=1) == 2
    return x[first], y[first]


def compare_lists(t: pa.Table) -> pa.RecordBatch:
    """Links within whole lists: cls, number of vectors it links to, and a class to join it with; a row for each row of t
    that links, at most."""
    x, y = [], []
    dims = t.column("vector").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(dims):
        at = np.nonzero(dims == d)[0]
        a, b = list_links(t.take(pa.array(at)))
        x.append(at[a])
        y.append(at[b])
    x, y = np.concatenate(x), np.concatenate(y)
    cls, members = t.column("cls").to_numpy(), t.column("members").to_numpy()
    found = np.zeros(t.num_rows, dtype=np.int64)
    np.add.at(found, x, members[y])
    np.add.at(found, y, members[x])
    root = np.arange(t.num_rows)
    while True:
        before, least = root.copy(), np.minimum(root[x], root[y])
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        root = root[root]
        if (root == before).all():
            break
    some = np.nonzero(found)[0]
    return pa.RecordBatch.from_arrays(
        [pa.array(cls[some]), pa.array(found[some]), pa.array(cls[root[some]])], names=["cls", "links", "other"]
    )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for b in batches:
        new = pa.Table.from_batches([b])
        held = new if held is None else pa.concat_tables([held, new])
        if held.num_rows >= CHUNK and (cut := int(_starts(held)[-1])):
            yield compare_lists(held.slice(0, cut).combine_chunks())
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield compare_lists(held.combine_chunks())


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    vectors: vec_id (long), embedding (array of numbers), label; further columns are ignored. Vectors of one label
    link if their cosine is 0.93 or more. A vector that links with nothing has n_links 0 and is its own component.
    Repeated rows are vectors of their own and link with each other. A null vec_id never names a component. Only
    vectors of the most frequent dimension are indexed by pivots; those of another dimension are all compared. An empty
    table gives no rows.
    """
    members, grouped = classes(vectors.select("vec_id", "label", "embedding"), ["vec_id"])
    grouped = stored(grouped, "pivot-classes")
    pivots = choose_pivots(grouped)
    index = stored(_permutations(grouped, pivots), "pivot-index")
    two = "transform(slice(front, i + 2, greatest(size(front) - i - 1, 0)), y -> struct(x as p, y as q))"
    listed = (
        index.withColumn("_two", F.explode(F.expr(f"flatten(transform(front, (x, i) -> {two}))")))
        .select("cls", "label", "_two.p", "_two.q")
        .filter(f"p > {PAD}")
    )
    blocks = listed.groupBy("label", "p", "q").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("_n"))
    dealt = (
        listed.join(blocks.filter("_n > 1"), ["label", "p", "q"])
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        .withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cls", "p", "q", F.least("block", "_x").alias("i"), F.greatest("block", "_x").alias("j"), "block")
        .join(index, "cls")
        .select(*KEY, "block", "cls", "members", "vector", "front")
        .repartition(*KEY)
        .sortWithinPartitions(*KEY)
    )
    found = stored(dealt.mapInArrow(_compare, "cls long, links long, other long"), "pivot-links")
    discard(index)
    root = components(found.select(F.col("cls").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    rooted = (
        grouped.select("cls", "members", "least")
        .join(root.select(F.col("node").alias("cls"), "root"), "cls", "left")
        .join(links, "cls", "left")
        .select("cls", "members", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cls").alias("root"))
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(named, "root").select(
        "cls", (F.col("members") - 1 + F.col("links")).alias("n_links"), "component_id"
    )
    return members.join(of_class, "cls", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
