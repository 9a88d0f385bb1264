"""Operator 4: n-gram Jaccard join by a size-aware heavy-light method.

Small sets list their fixed-size subsets: two sets have the similarity asked for exactly if they share a subset of the
size that their sizes call for. Large sets are found through inverted lists over the rarest part of each set. The
boundary between the two is where listing subsets becomes dearer than scanning lists.

Shingles, and sets as a whole, stand as 64-bit hashes; all documents with the same set form one class.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import batches_of, discard, stored, word_codes
from docledger.llm.graph import components

#: Words of a shingle. The similarity is 0.8, that is an overlap of 4/9 of the two sizes' sum.
WORDS = 5
#: 2 ** BUCKET_BITS counters hold how often shingles occur, over all documents; CHUNK of them travel together.
BUCKET_BITS, CHUNK = 22, 4096
#: Largest set that may list its subsets, and documents in a list whose pairs are compared one by one.
MAX_SMALL, SHORT_LIST = 12, 24
#: Sets in a block of a longer list, and their shingles together, about.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 21
#: The table that tells which sets are needed has at most 2 ** NEEDED_BITS bits; postings that one task sorts, about.
NEEDED_BITS, PART_POSTINGS = 27, 1 << 21

_FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64
)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted hashes of each whole text's distinct 5-word shingles.

    A-Z are lower-cased. With fewer than five words the whole sequence is one shingle; without words the set is empty.
    """
    import xxhash

    codes, per_text, distinct = word_codes(texts)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), dtype=np.uint64, count=len(distinct))
    h = own[codes]
    if len(h) >= WORDS:
        rolled = h[: len(h) - WORDS + 1] * _FACTORS[0]
        for k in range(1, WORDS):
            rolled = rolled + h[k : len(h) - WORDS + 1 + k] * _FACTORS[k]
        rolled = _mixed(rolled)
    ends = np.cumsum(per_text)
    out = []
    for end, n in zip(ends.tolist(), per_text.tolist(), strict=True):
        if n >= WORDS:
            s = np.sort(rolled[end - n : end - WORDS + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif n:
            whole = (h[end - n : end] * _FACTORS[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)
            out.append(_mixed(whole))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def overlap_needed(a: int, b: int) -> int:
    return (4 * (a + b) + 8) // 9


def prefix_length(n: int) -> int:
    """A set's rarest shingles, so many that two similar sets share one of them."""
    return n - (4 * n + 4) // 5 + 1


def subset_sizes(n: int, largest: int = MAX_SMALL) -> list[tuple[int, int, int]]:
    """For a set of size n: smaller size, larger size and subset size for each size of a similar set."""
    return [
        (min(n, t), max(n, t), overlap_needed(n, t)) for t in range((4 * n + 4) // 5, 5 * n // 4 + 1) if t <= largest
    ]


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """Largest size that lists subsets: the cheapest choice, counting rows to emit and pairs to look at.

    sizes: documents of each set size up to MAX_SMALL; list_length: documents that share a shingle, on average.
    """

    def listed(n: int) -> int:
        return sum(math.comb(n, c) for _, _, c in subset_sizes(n))

    def cost(x: int) -> float:
        return sum(k * (listed(n) if n <= x else prefix_length(n) * list_length) for n, k in sizes.items())

    return min(range(MAX_SMALL + 1), key=lambda x: (cost(x), x))


def _profile(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, n, cls), and rows of packed counters (chunk, counts); one pass over the texts."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "cls", "chunk", "counts"]
        counts, seen, any_row = np.zeros(1 << BUCKET_BITS, dtype=np.uint32), set(), False
        for batch in batches:
            for b in batches_of(batch, "text"):
                sets = shingle_sets(b.column("text"))
                classes = [class_of(s) for s in sets]
                fresh = [s for s, c in zip(sets, classes, strict=True) if not (c in seen or seen.add(c))]
                if fresh:
                    at = np.concatenate(fresh) >> np.uint64(64 - BUCKET_BITS)
                    np.add.at(counts, at.astype(np.int64), 1)
                any_row = True
                empty = [None] * b.num_rows
                columns = [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(empty, pa.int32()), pa.array(empty, pa.binary())], names=names)
        if any_row:
            chunks = counts.reshape(-1, CHUNK)
            some = np.nonzero(chunks.any(axis=1))[0]
            packed = [zlib.compress(chunks[i].tobytes(), 1) for i in some]
            empty = pa.array([None] * len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([empty, empty, empty, pa.array(some, pa.int32()), pa.array(packed, pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        profile, "doc_id long, n long, cls long, chunk int, counts binary"
    )


def _levels(profile: DataFrame) -> tuple[np.ndarray, float]:
    """How frequent each bucket's shingles are, in steps of 1/8 of a doubling, and shingles per distinct shingle.

    Each chunk is summed by one task as its rows stream in; the driver receives one byte a bucket.
    """

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, counts in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
                own = sums.setdefault(chunk, np.zeros(CHUNK, dtype=np.int64))
                own += np.frombuffer(zlib.decompress(counts), dtype=np.uint32)
        rows = [
            {"chunk": k, "levels": np.minimum(255, np.round(8 * np.log2(1 + v))).astype(np.uint8).tobytes(), "n": int(v.sum()), "empty": int((v == 0).sum())}
            for k, v in sums.items()
        ]
        if rows:
            yield pa.RecordBatch.from_pylist(rows)

    packed = profile.filter("chunk is not null").select("chunk", "counts").repartition("chunk")
    levels, n, empty = np.zeros(((1 << BUCKET_BITS) // CHUNK, CHUNK), dtype=np.uint8), 0, 0
    for r in packed.mapInArrow(total, "chunk long, levels binary, n long, empty long").collect():
        levels[r["chunk"]] = np.frombuffer(r["levels"], dtype=np.uint8)
        n, empty = n + r["n"], empty + r["empty"]
    buckets = levels.size
    free = (empty + buckets - CHUNK * int((levels.any(axis=1)).sum())) / buckets
    distinct = buckets * (math.log(1 / free) if 0 < free < 1 else 0 if free else n / buckets)
    return levels.ravel(), max(1.0, n / max(distinct, 1.0))


def _index(docs: DataFrame, levels, small: int, parts: int) -> DataFrame:
    """Postings, packed by part of the token range (part, tokens, classes, sizes), and subset keys (key, cls, n, other): other is
    the size of the sets that the subset stands for.

    A class is written once in a task. levels: broadcast of the bucket levels. A token is a shingle's hash with its
    level in front, so that tokens sort by frequency.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names, seen = ["part", "tokens", "classes", "sizes", "key", "cls", "n", "other"], set()
        level = levels.value
        for batch in batches:
            for b in batches_of(batch, "text"):
                tokens, owners, sizes, keys = [], [], [], []
                for s in shingle_sets(b.column("text")):
                    c, n = class_of(s), len(s)
                    if not n or c in seen:
                        continue
                    seen.add(c)
                    if n <= small:
                        for low, high, size in subset_sizes(n, small):
                            for some in itertools.combinations(s.tolist(), size):
                                key = xxhash.xxh3_64_intdigest(np.array([low, high, *some], dtype=np.uint64).tobytes())
                                keys.append((key - (1 << 63), c, n, low + high - n))
                    if 5 * n >= 4 * (small + 1):
                        own = (level[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                        p = prefix_length(n)
                        tokens.append(np.partition(own, p - 1)[:p])
                        owners.append(c)
                        sizes.append(n)
                if tokens:
                    each = [len(t) for t in tokens]
                    t = np.concatenate(tokens)
                    c, n = np.repeat(np.array(owners, dtype=np.int64), each), np.repeat(np.array(sizes, dtype=np.int32), each)
                    part = (_mixed(t) >> np.uint64(40)).astype(np.int64) % parts
                    order = np.argsort(part, kind="stable")
                    t, c, n, part = t[order], c[order], n[order], part[order]
                    cuts = np.concatenate(([0], np.nonzero(np.diff(part))[0] + 1, [len(part)]))
                    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                    empty = pa.array([None] * len(spans), pa.int64())
                    packed = [pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (t, c, n)]
                    yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]], pa.int32()), *packed, empty, empty, empty, empty], names=names)
                if keys:
                    empty = [None] * len(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(empty, pa.int32()), *(pa.array(empty, pa.binary()) for _ in range(3))]
                        + [pa.array(x, pa.int64()) for x in zip(*keys, strict=True)],
                        names=names,
                    )

    return docs.select("text").mapInArrow(
        index, "part int, tokens binary, classes binary, sizes binary, key long, cls long, n long, other long"
    )


def repeated_postings(
    chunks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], short: int
) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
    """Of postings (token, class, size) that stream in, those of repeated tokens, each with its kind.

    (True, ...): postings of tokens that stand in more than ``short`` classes, as they come; a posting that several
    tasks wrote may come out more than once. (False, ...), last: the postings, sorted and distinct, of the tokens that
    stand in 2 to ``short`` classes. No more than ``short`` postings of a token are remembered, however long its list.
    """
    t0, c0, n0 = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
    long = np.zeros(0, dtype=np.uint64)
    for t, c, n in chunks:
        if len(long):
            known = long[np.minimum(np.searchsorted(long, t), len(long) - 1)] == t
            yield True, t[known], c[known], n[known]
            t, c, n = t[~known], c[~known], n[~known]
        t, c, n = np.concatenate((t0, t)), np.concatenate((c0, c)), np.concatenate((n0, n))
        order = np.lexsort((c, t))
        t, c, n = t[order], c[order], n[order]
        fresh = np.ones(len(t), dtype=bool)
        fresh[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        t, c, n = t[fresh], c[fresh], n[fresh]
        starts, counts = _spans(t)
        over = counts > short
        out = np.repeat(over, counts)
        yield True, t[out], c[out], n[out]
        long = np.union1d(long, t[starts[over]])
        t0, c0, n0 = t[~out], c[~out], n[~out]
    counts = _spans(t0)[1]
    some = np.repeat(counts > 1, counts)
    yield False, t0[some], c0[some], n0[some]


def _spans(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value of a sorted array starts, and how often it stands there."""
    starts = np.nonzero(np.concatenate((np.ones(min(len(t), 1), dtype=bool), t[1:] != t[:-1])))[0]
    return starts, np.diff(np.append(starts, len(t)))


def list_pairs(t: np.ndarray, c: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs a < b of classes of similar size that share a token, their sizes, and how many tokens they share.

    Postings are sorted by token and class. PART_POSTINGS pairs are formed at a time, about; a pair may come out of
    several of these steps, each with its own number.
    """
    starts, counts = _spans(t)
    for m in np.unique(counts).tolist():
        i, j = np.triu_indices(m, 1)
        own = starts[counts == m]
        for part in np.array_split(own, max(1, len(own) * len(i) // PART_POSTINGS)):
            at = part[:, None] + np.arange(m)
            x, y = at[:, i].ravel(), at[:, j].ravel()
            alike = 5 * np.minimum(n[x], n[y]).astype(np.int64) >= 4 * np.maximum(n[x], n[y])
            x, y = x[alike], y[alike]
            order = np.lexsort((c[y], c[x]))
            x, y = x[order], y[order]
            first = np.ones(len(x), dtype=bool)
            first[1:] = (c[x][1:] != c[x][:-1]) | (c[y][1:] != c[y][:-1])
            at = np.nonzero(first)[0]
            yield c[x[at]], c[y[at]], n[x[at]], n[y[at]], np.diff(np.append(at, len(x)))


def _lists(index: DataFrame, parts: int) -> DataFrame:
    """Of the short lists, pairs of classes (a, b, n_a, n_b, k: lists they share); of the others, the postings
    (token, a: class, n_a: its size)."""

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "a", "b", "n_a", "n_b", "k"]

        def chunks():
            held, size = [], 0
            for b in batches:
                for row in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    held.append(row)
                    size += len(row[0]) // 8
                    if size >= PART_POSTINGS:
                        yield tuple(np.concatenate(x) for x in _unpacked(held))
                        held, size = [], 0
            if held:
                yield tuple(np.concatenate(x) for x in _unpacked(held))

        for long, t, c, n in repeated_postings(chunks(), SHORT_LIST):
            if long:
                none = pa.nulls(len(t), pa.int64())
                columns = [pa.array(t.view(np.int64)), pa.array(c), none, pa.array(n.astype(np.int64)), none, none]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                continue
            for found in list_pairs(t, c, n):
                token = pa.nulls(len(found[0]), pa.int64())
                yield pa.RecordBatch.from_arrays([token, *(pa.array(x.astype(np.int64)) for x in found)], names=names)

    packed = index.filter("part is not null").repartition(parts, "part").select("tokens", "classes", "sizes")
    return packed.mapInArrow(repeats, "token long, a long, b long, n_a long, n_b long, k long")


def _unpacked(rows: list[tuple[bytes, bytes, bytes]]):
    for x, dtype in zip(zip(*rows, strict=True), (np.uint64, np.int64, np.int32), strict=True):
        yield [np.frombuffer(v, dtype=dtype) for v in x]


def _subset_links(index: DataFrame) -> DataFrame:
    """Links of small sets: in a group of equal subsets, sets of the one size link to the first of the other.

    The key holds both sizes. Where they differ, sets of one size alone share too little to link.
    """
    keys = index.filter("key is not null").select("key", "cls", "n", "other").distinct()
    firsts = keys.groupBy("key").agg(
        F.min(F.struct("n", "cls")).alias("low"), F.max(F.struct("n", "cls")).alias("high"), F.count("*").alias("k")
    )
    pairs = keys.join(firsts.filter("k > 1"), "key").filter("n = other or low.n <> high.n")
    other = F.when(F.col("n") == F.col("low.n"), F.col("high.cls")).otherwise(F.col("low.cls"))
    return pairs.select(F.col("cls").alias("a"), other.alias("b"))


SIMILAR_SIZES = "5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)"


def _candidates(pairs: DataFrame, long_tokens: DataFrame) -> DataFrame:
    """Pairs (a, b, n_a, n_b, k) that can still be similar; k lists in which both stand were seen.

    Of two sets, take the one whose prefix ends first: what they share is in both prefixes, or beyond that prefix.
    long_tokens: cls, m: how many long lists each class stands in, which k need not count.
    """
    m_a = long_tokens.select(F.col("cls").alias("a"), F.col("m").alias("m_a"))
    m_b = long_tokens.select(F.col("cls").alias("b"), F.col("m").alias("m_b"))
    beyond = "greatest((4 * n_a + 4) div 5, (4 * n_b + 4) div 5) - 1"
    reach = f"k + least(coalesce(m_a, 0), coalesce(m_b, 0)) + {beyond} >= (4 * (n_a + n_b) + 8) div 9"
    return pairs.join(m_a, "a", "left").join(m_b, "b", "left").filter(reach).select("a", "b")


def _needed_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, shingles (packed) of the given classes, and of a few others: a table of bits chooses.

    The table has 16 bits a class, up to 2 ** NEEDED_BITS. Beyond that it lets more and more of the other sets pass,
    which the join that follows drops.
    """
    size = 1 << min(max((16 * classes.distinct().count()).bit_length(), 16), NEEDED_BITS)
    spot = f"pmod(cls, {size})"
    words = classes.selectExpr(f"{spot} div 64 as w", f"shiftleft(1L, cast({spot} % 64 as int)) as bit").groupBy("w").agg(F.bit_or("bit").alias("bits"))
    table = np.zeros(size // 64, dtype=np.int64)
    got = words.toPandas()
    table[got["w"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64)
    needed = docs.sparkSession.sparkContext.broadcast(table)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = needed.value, set()
        for batch in batches:
            for b in batches_of(batch, "text"):
                found = {}
                for s in shingle_sets(b.column("text")):
                    c = class_of(s)
                    at = c % size
                    if c not in seen and int(bits[at // 64]) >> (at % 64) & 1:
                        seen.add(c)
                        found[c] = s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.binary())], names=["cls", "shingles"]
                )

    return docs.select("text").mapInArrow(pick, "cls long, shingles binary").dropDuplicates(["cls"])


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose sets are similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = np.sort(np.concatenate((x, y)))
                keep.append(int((both[1:] == both[:-1]).sum()) >= overlap_needed(len(x), len(y)))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").mapInArrow(compare, "a long, b long")


def _within_lists(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Connections (a, b) between the roots in lists (token, cls, n, root) that still hold several components.

    A list is cut into blocks by hash; each pair of blocks is compared by one task, which keeps the pairs to itself and
    returns one row a class at most.
    """
    several = placed.groupBy("token").agg(
        F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("k"), F.sum("n").alias("shingles")
    )
    size = F.ceil(F.greatest(F.col("k") / BLOCK_SETS, F.col("shingles") / BLOCK_SHINGLES))
    blocks = several.filter("r0 <> r1").select("token", size.cast("int").alias("blocks"))
    dealt = (
        placed.join(blocks, "token")
        .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        .withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("token", F.least("block", "_x").alias("i"), F.greatest("block", "_x").alias("j"), "cls", "root")
    )
    return dealt.join(sets, "cls").groupBy("token", "i", "j").applyInArrow(compare_sets, "a long, b long")


def compare_sets(t: pa.Table) -> pa.Table:
    """Connects the roots of classes (cls, root, shingles) whose sets are similar; those of one root are connected.

    Overlaps come from a product of the sets' membership in the shingles that several of them hold.
    """
    roots = t.column("root").to_numpy()
    own = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in t.column("shingles")]
    n = np.array([len(x) for x in own])
    _, shingle, held = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(own)), n)
    common = held[shingle] > 1
    row, shingle = row[common], np.unique(shingle[common], return_inverse=True)[1]
    order = np.argsort(shingle, kind="stable")
    row, shingle = row[order], shingle[order]
    overlap = np.zeros((len(own), len(own)), dtype=np.float32)
    width = 8192
    for first in range(0, int(shingle[-1]) + 1 if len(shingle) else 0, width):
        some = slice(*np.searchsorted(shingle, (first, first + width)))
        member = np.zeros((len(own), width), dtype=np.float32)
        member[row[some], shingle[some] - first] = 1
        overlap += member @ member.T
    similar = 9 * overlap.astype(np.int64) >= 4 * (n[:, None] + n[None, :])
    similar |= roots[:, None] == roots[None, :]
    label = np.arange(len(own))
    while True:
        least = np.where(similar, label[None, :], len(own)).min(axis=1)
        nxt = np.minimum(label, least)
        nxt = nxt[nxt]
        if (nxt == label).all():
            break
        label = nxt
    some = roots != roots[label]
    return pa.table({"a": pa.array(roots[some], pa.int64()), "b": pa.array(roots[label[some]], pa.int64())})


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of documents (doc_id, n, cls), and roots (node, root): of linked classes, then of linked roots.

    Exact: two classes get one root if and only if a chain of similarities of 0.8 or more connects them. Lists of up to
    SHORT_LIST classes are compared pair by pair; in a longer list all compare with the one that stands in most long
    lists, then the lists that still hold several components are compared block by block.
    """
    sc = docs.sparkSession.sparkContext
    profile = stored(_profile(docs), "jaccard-profile")
    classes = stored(profile.filter("chunk is null").select("doc_id", "n", "cls"), "jaccard-classes")
    levels, list_length = _levels(profile)
    discard(profile)
    sizes = classes.filter(f"n between 1 and {MAX_SMALL}").groupBy("n").count().collect()
    small = boundary({r["n"]: r["count"] for r in sizes}, list_length)
    postings = classes.agg(F.sum(F.expr("n - (4 * n + 4) div 5 + 1"))).first()[0] or 0
    parts = max(32, -(-int(postings) // PART_POSTINGS) * 4)
    index = stored(_index(docs, sc.broadcast(levels), small, parts), "jaccard-index")
    lists = stored(_lists(index, parts), "jaccard-lists")
    of_subsets = stored(_subset_links(index), "jaccard-subset-links")
    discard(index)
    long = stored(lists.filter("token is not null").selectExpr("token", "a as cls", "n_a as n").distinct(), "jaccard-long")
    long_tokens = stored(long.groupBy("cls").agg(F.count("*").alias("m")), "jaccard-long-tokens")
    ranked = long.join(long_tokens, "cls")
    first = ranked.groupBy("token").agg(F.max(F.struct("m", "cls", "n")).alias("first"))
    in_long = long.join(first, "token").filter("cls <> first.cls").selectExpr("first.cls as a", "first.n as n_a", "cls as b", "n as n_b").filter(SIMILAR_SIZES)
    counted = (
        lists.filter("token is null").select("a", "n_a", "b", "n_b", "k")
        .unionByName(in_long.withColumn("k", F.lit(0)))
        .groupBy("a", "n_a", "b", "n_b")
        .agg(F.sum("k").alias("k"))
    )
    pairs = stored(_candidates(counted, long_tokens), "jaccard-pairs")
    discard(lists)
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(long_tokens.select("cls"))
    sets = stored(_needed_sets(docs, wanted), "jaccard-sets")
    links = stored(_similar(pairs, sets).unionByName(of_subsets), "jaccard-links")
    roots = components(links)
    discard(pairs, links, of_subsets)
    root = roots.select(F.col("node").alias("cls"), "root")
    placed = stored(long.join(root, "cls", "left").select("token", "cls", "n", F.coalesce("root", "cls").alias("root")), "jaccard-placed")
    discard(long, long_tokens)
    top = components(_within_lists(placed, sets))
    discard(placed, sets)
    return classes, roots, top


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the smallest doc_id reachable by links, itself included.

    docs: doc_id (long), text; further columns are ignored. Null and wordless texts have no shingles and link with
    nothing. Repeated rows are documents like any other and share their class. A null doc_id links like any other but
    never names a component: where no document of a component has an id, component_id is null.
    """
    classes, roots, top = link(docs)
    root = roots.select(F.col("node").alias("cls"), F.col("root").alias("low"))
    top = top.select(F.col("node").alias("low"), "root")
    own = classes.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    rooted = own.join(root, "cls", "left").select("cls", F.coalesce("low", "cls").alias("low"), "least")
    rooted = rooted.join(top, "low", "left").select("cls", F.coalesce("root", "low").alias("root"), "least")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(named, "root").select("cls", "component_id")
    return classes.join(of_class, "cls", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
