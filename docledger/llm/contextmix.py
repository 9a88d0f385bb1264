"""Operator 5: language-model scores by online logistic context mixing.

A text is its words, lower-cased, and one end token. A word is spelled as bytes and a closing space, a byte as eight
bits; several predictors guess each bit, each from counts kept under a hash of one context: the last byte of the text,
the last two, the last four, and the whole word so far. Their guesses, as logits, are added up with weights that a gate (place in
the word, evidence for the word so far) selects and that were learned online; a table of corrections, learned as the
mixer went along, then refines the result. The bits' probabilities multiply to the word's, so all words' sum to one.

The last bytes reach across the word's beginning into the words before. So a word's first HEAD bytes depend on what stands
before them, and its other bytes on the word alone: the first are scored once for each seam, that is for each HEAD bytes with the
bytes before them that a context reaches; the others once a word, not once for each place where it stands. Words are dealt out by their first SHARED bytes, so
that all words with a longer beginning in common meet in one task: it counts the contexts of such beginnings under whole
64-bit hashes, as many as the corpus has. Only the contexts of a few bytes go into tables that every task looks up.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import batches_of, discard, doc_crc, stored, word_codes

#: Bits of the slots of each predictor's table of short contexts; the last one's has the word so far below SHARED bytes.
SLOT_BITS, SHARED, CHUNK = (16, 20, 22, 21), 5, 1 << 15
#: Bytes of a token at whose places the last four bytes reach beyond the space before it.
HEAD = 3
ORDERS, SLOTS = len(SLOT_BITS), sum(1 << b for b in SLOT_BITS)
#: Distinct words that one task counts and scores, about, and steps to a doubling in which a table's counts are kept.
TASK_WORDS, COUNT_STEPS = 40_000, 1024
#: Distinct seams that one task learns from or scores, about, and those that are looked up by every task, at most.
TASK_SEAMS, COMMON_SEAMS = 100_000, 1 << 18
#: Levels of evidence (occurrences of the word so far), places in a word and answers seen there (both or one) make the
#: gates; then steps of the correction table, its reach in logits, and bytes that are mixed at a time.
LEVELS, PLACES, STEPS, REACH, BATCH_BYTES = (1, 2, 3, 5, 9, 17, 65), 3, 49, 12, 25_000
GATES = (len(LEVELS) + 1) * PLACES * 2
#: Bytes of text that a task works on at a time.
PART_BYTES = 6 << 20
#: What a batch's part in the correction counts loses with each later batch.
FADING = 0.97
#: Words common enough to be looked up by every task, at most, and their longest spelling in bytes.
HEAD_WORDS, HEAD_BYTES = 1 << 18, 64
END, END_OF_WORD = b"\n", 0x20
SMOOTH, ADDED = 0.05, 0.1
NO_DEEP = np.zeros((0, 2), dtype=np.float32)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


#: Counts by their code: 0 to 700 exactly, larger ones to 1/1000.
_DECODED = np.round(2 ** (np.arange(1 << 16) / COUNT_STEPS) - 1).astype(np.float32)


def encode_counts(n: np.ndarray) -> np.ndarray:
    return np.round(np.log2(1 + n.astype(np.float64)) * COUNT_STEPS).astype(np.uint16)


class Bits:
    """The bits of some tokens: for each, its token, value, place, slot in each predictor's table, and whether it is deep,
    that is at a place after SHARED bytes. keys: hash of the word so far, of the deep bits alone.

    before: the four bytes before each token, the last one lowest; none: a space alone. since: the bits of places below it
    are left out.
    """

    def __init__(self, tokens: list[bytes], deep_only: bool = False, before: np.ndarray | None = None, since: int = 0):
        each = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        b = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        starts = np.repeat(np.cumsum(each) - each, each)
        at = np.arange(len(b))
        place = at - starts
        wide = b.astype(np.uint64)
        powers = np.cumprod(np.full(len(b), _A))
        inverse = np.cumprod(np.full(len(b), np.uint64(pow(int(_A), -1, 1 << 64))))
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((wide + np.uint64(1)) * powers)))
        prefix = (sums[at] - sums[starts]) * inverse[starts]
        token = np.repeat(np.arange(len(tokens)), each)
        if since:
            kept = place >= since
            b, at, place, prefix, token = b[kept], at[kept], place[kept], prefix[kept], token[kept]
        self.token = np.repeat(token, 8)
        shift = np.arange(8, dtype=np.uint8)
        self.bit = ((b[:, None] >> (7 - shift)) & 1).ravel()
        node = ((1 << shift.astype(np.uint16)) | (b[:, None].astype(np.uint16) >> (8 - shift))).ravel().astype(np.uint64) * _C
        self.deep = np.repeat(place >= SHARED, 8)
        long = (prefix + np.uint64(1)) * _A
        self.keys = (np.repeat(long, 8)[self.deep] ^ node[self.deep]) * _B
        if deep_only:
            return
        outside = np.uint64(END_OF_WORD) if before is None else before[token]

        def back(k: int) -> np.ndarray:
            beyond = np.maximum(k - 1 - place, 0).astype(np.uint64) * np.uint64(8)
            return np.where(place >= k, wide[np.maximum(at - k, 0)], (outside >> beyond) & np.uint64(0xFF))

        one = back(1)
        two = one | (back(2) << np.uint64(8))
        four = two | (back(3) << np.uint64(16)) | (back(4) << np.uint64(24))
        contexts = [(c + np.uint64(1)) * _A for c in (one, two, four, prefix)]
        self.slots = [
            (((np.repeat(c, 8) + node) * _B) >> np.uint64(64 - bits)).astype(np.int64)
            for c, bits in zip(contexts, SLOT_BITS, strict=True)
        ]
        self.place = np.repeat(np.minimum(place, PLACES - 1).astype(np.uint8), 8)


def deep_counts(tokens: list[bytes], c: np.ndarray) -> list[np.ndarray]:
    """Zeros and ones seen after the word so far of each deep bit, batch by batch, among the tokens, which stand c times."""
    keys, ones, weights, sizes = [], [], [], []
    for some, own in batched(tokens, c):
        bits = Bits(some, deep_only=True)
        keys.append(bits.keys)
        ones.append(bits.bit[bits.deep])
        weights.append(own[bits.token[bits.deep]])
        sizes.append(len(bits.keys))
    if not keys:
        return []
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(at * 2 + np.concatenate(ones), weights=np.concatenate(weights), minlength=2 * len(distinct))
    return np.split(n.reshape(-1, 2).astype(np.float32)[at], np.cumsum(sizes)[:-1])


def batched(tokens: list[bytes], *more: np.ndarray) -> Iterator[tuple]:
    """Runs of tokens of about BATCH_BYTES bytes, with the same runs of the arrays."""
    ends, at = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))), 0
    while at < len(tokens):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, side="right")))
        yield tokens[at:upto], *(x[at:upto] for x in more)
        at = upto


def _runs(gates: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each gate in sorted ``gates``, and where it stands."""
    cuts = np.concatenate(([0], np.nonzero(np.diff(gates))[0] + 1, [len(gates)])).tolist()
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if j > i:
            yield int(gates[i]), slice(i, j)


class Model:
    """tables: all predictors' slots in a row, the coded counts of zeros and ones in the halves of a 32-bit number."""

    def __init__(self, tables: np.ndarray):
        self.tables = np.split(tables, np.cumsum([1 << b for b in SLOT_BITS])[:-1])
        self.weights = np.zeros((GATES, ORDERS + 1))
        self.weights[:, :ORDERS] = 1.0 / ORDERS
        self.corrections = 1 / (1 + np.exp(-np.tile(np.linspace(-REACH, REACH, STEPS), (GATES, 1))))

    def inputs(self, bits: Bits, deep: np.ndarray, own: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the predictors, a one for the bias, and gates. own: occurrences to leave out of the counts."""
        x, one = np.ones((ORDERS + 1, len(bits.bit)), dtype=np.float32), bits.bit.astype(np.float32)
        for k in range(ORDERS):
            pair = self.tables[k][bits.slots[k]]
            n0, n1 = _DECODED[pair & np.uint32(0xFFFF)], _DECODED[pair >> np.uint32(16)]
            if k == ORDERS - 1:
                n0[bits.deep], n1[bits.deep] = deep[:, 0], deep[:, 1]
            if own:
                n0 = np.maximum(n0 - np.float32(own) * (1 - one), np.float32(0))
                n1 = np.maximum(n1 - np.float32(own) * one, np.float32(0))
            x[k] = np.log((n1 + SMOOTH) / (n0 + SMOOTH))
        seen = n0 + n1  # of the last predictor, the word so far
        evidence = np.zeros(len(seen), dtype=np.uint8)
        for level in LEVELS:
            evidence += seen >= level
        both = (n0 > 0) & (n1 > 0)
        return x, (evidence * np.uint8(PLACES) + bits.place) * np.uint8(2) + both

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray, rate: float) -> np.ndarray:
        """One online step for each gate: a damped Newton step on the batch's loss. Returns the logits before it."""
        logits, order, x = self.logits(x, gate)
        p, w = 1 / (1 + np.exp(-logits[order])), weight[order]
        wrong, spread = w * (bit[order] - p), w * p * (1 - p)
        for g, own in _runs(gate[order]):
            xs, total = x[:, own], w[own].sum(dtype=np.float64)
            slope = xs @ wrong[own] / total
            curve = (xs * spread[own]) @ xs.T / total
            self.weights[g] += rate * np.linalg.solve(curve + 0.02 * np.eye(ORDERS + 1), slope)
        return logits

    def logits(self, x: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The weighted sums, the order of the bits by gate, and the inputs in that order."""
        order = np.argsort(gate, kind="stable")
        x, out = x[:, order], np.empty(len(gate), dtype=np.float32)
        for g, own in _runs(gate[order]):
            out[order[own]] = self.weights[g].astype(np.float32) @ x[:, own]
        return np.clip(out, -REACH, REACH), order, x

    def probability(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Of a one: the mixer's answer and its correction, which counts three times."""
        s, _, _ = self.logits(x, gate)
        at = (s + REACH) * ((STEPS - 1) / (2 * REACH))
        low = np.minimum(at.astype(np.int32), STEPS - 2)
        part, cell = at - low, gate.astype(np.int32) * STEPS + low
        flat = self.corrections.astype(np.float32).ravel()
        corrected = flat[cell] * (1 - part) + flat[cell + 1] * part
        return np.clip((1 / (1 + np.exp(-s)) + 3 * corrected) / 4, 1e-6, 1 - 1e-6)

    def bits_score(self, bits: Bits, deep: np.ndarray, n: int) -> np.ndarray:
        """log10 of the probability of the bits of each of n tokens."""
        p = self.probability(*self.inputs(bits, deep))
        return np.bincount(bits.token, np.log10(np.where(bits.bit == 1, p, 1 - p)), n)

    def score(self, tokens: list[bytes], c: np.ndarray, since: int = 0) -> np.ndarray:
        """log10 of each token's probability, of its bytes from ``since`` on, as after a space alone. c: how often the tokens
        stand in training; with them are all those that begin as they do."""
        out = [np.zeros(0)]
        for (some,), deep in zip(batched(tokens), deep_counts(tokens, c), strict=True):
            out.append(self.bits_score(Bits(some, since=since), deep, len(some)))
        return np.concatenate(out)

    def score_seams(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each seam's first bytes after what stands before them."""
        out = [np.zeros(0)]
        for some, before in batched(*seam_tokens(keys)):
            out.append(self.bits_score(Bits(some, before=before), NO_DEEP, len(some)))
        return np.concatenate(out)


def seam_keys(codes: np.ndarray, per_text: np.ndarray, words: pa.Array) -> np.ndarray:
    """The seam of each token, first those of all words, then of the ends: the three bytes before the space before it, the last one
    lowest (none: zeros), and its first HEAD bytes, the first one highest, 24 bits each. As ``word_codes`` gives the words."""
    spelled = words.cast(pa.large_binary())
    _, offsets, data = spelled.buffers()
    ends = np.frombuffer(offsets or bytes(8), dtype=np.int64)[spelled.offset : spelled.offset + len(words) + 1]
    starts, sizes = ends[:-1], np.diff(ends)
    b = np.append(np.frombuffer(data or b"", dtype=np.uint8), np.uint8(0)).astype(np.int64)
    head, tail = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    for i in range(HEAD):
        inside = sizes > i
        head |= np.where(inside, b[np.where(inside, starts + i, -1)], np.where(sizes == i, END_OF_WORD, 0)) << 8 * (2 - i)
        tail |= np.where(inside, b[np.where(inside, ends[1:] - 1 - i, -1)], 0) << 8 * i
    upto = np.cumsum(per_text)
    first = np.zeros(len(codes) + 1, dtype=bool)
    first[upto - per_text] = True
    first = first[:-1]
    after, size = tail[codes], sizes[codes]  # the bytes after which the next token stands
    last = np.concatenate((np.zeros(1, dtype=np.int64), after[:-1] & 0xFF))[: len(codes)]
    after = np.where(~first & (size == 1), after | END_OF_WORD << 8 | last << 16, after)
    after = np.where(~first & (size == 2), after | END_OF_WORD << 16, after)
    before = np.where(first, 0, np.concatenate((np.zeros(1, dtype=np.int64), after[:-1]))[: len(codes)])
    at_end = np.where(per_text > 0, np.append(after, 0)[upto - 1], 0)
    return np.concatenate((before << 24 | head[codes], at_end << 24 | END[0] << 16))


def seam_tokens(keys: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The first bytes of seams, and the four bytes before them as Bits takes them."""
    head = keys & 0xFFFFFF
    size = np.where(head >> 16 == END[0], 1, np.where((head >> 8) & 0xFF == END_OF_WORD, 2, HEAD))
    tokens = [h.to_bytes(HEAD, "big")[:n] for h, n in zip(head.tolist(), size.tolist(), strict=True)]
    return tokens, ((keys >> 24) << 8 | END_OF_WORD).astype(np.uint64)


def seam_hashes(keys: np.ndarray) -> np.ndarray:
    """Hashes under which seams meet the words' in one join."""
    mixed = keys.astype(np.uint64) * _A
    return ((mixed ^ (mixed >> np.uint64(32))) * _B).view(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word or seam, and how often it stands in training."""
    for batch in batches:
        for b in batches_of(batch, "text", PART_BYTES):
            codes, per_text, words = word_codes(b.column("text"))
            per_row = b.column("train").to_numpy(zero_copy_only=False)
            train = np.repeat(per_row, per_text)
            n = np.bincount(codes, weights=train, minlength=len(words)).astype(np.int64)
            some = np.nonzero(np.bincount(codes, minlength=len(words)))[0]
            names = ["word", "seam", "n"]
            yield pa.RecordBatch.from_arrays(
                [words.take(pa.array(some)).cast(pa.string()), pa.nulls(len(some), pa.int64()), pa.array(n[some])], names=names
            )
            seams, at = np.unique(seam_keys(codes, per_text, words), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate((train, per_row)), minlength=len(seams)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(seams), pa.string()), pa.array(seams), pa.array(n)], names=names)


def _tokens(b: pa.RecordBatch) -> list[bytes]:
    return [w.encode() + b" " for w in b.column("word").to_pylist()]


def _dealt(words: DataFrame, parts: int) -> DataFrame:
    """word, c, dealt out by the first SHARED bytes."""
    return words.select("word", "c").repartition(parts, F.xxhash64(F.substring(F.col("word").cast("binary"), 1, SHARED)))


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, list[bytes], np.ndarray] | None:
    """All words of a task, their counts, tokens and hashes, in the order of the hashes, which is the same in each run."""
    import xxhash

    batches = list(batches)
    if not batches:
        return None
    b = pa.Table.from_batches(batches).combine_chunks()
    words, c, tokens = b.column("word").combine_chunks(), b.column("c").to_numpy(), _tokens(b)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    order = np.argsort(h)
    return words.take(pa.array(order)), c[order], [tokens[i] for i in order.tolist()], h[order]


def _dealt_seams(seams: DataFrame, parts: int) -> DataFrame:
    return seams.select("seam", "c").repartition(parts, "seam")


def _whole_seams(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray] | None:
    """All seams of a task and their counts, in the order of their hashes."""
    batches = list(batches)
    if not batches:
        return None
    b = pa.Table.from_batches(batches).combine_chunks()
    keys, c = b.column("seam").to_numpy(), b.column("c").to_numpy()
    order = np.argsort(seam_hashes(keys))
    return keys[order], c[order]


def count_contexts(words: DataFrame, seams: DataFrame) -> np.ndarray:
    """The predictors' tables of short contexts: counts of zeros and ones after each, over the first bytes of all training seams
    (seam, c) and the other bytes of all training words (word, c).

    Each task sums its words or seams into tables of fixed size and sends them packed in chunks; each chunk is then summed as it
    streams in. Counts have 64 bits until they are coded for the tables.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, any_row = np.zeros(2 * SLOTS, dtype=np.int64), False
        starts = np.concatenate(([0], np.cumsum([1 << b for b in SLOT_BITS])))
        for b in batches:
            c = b.column("c").to_numpy(zero_copy_only=False)
            if "seam" in b.schema.names:
                parts = ((Bits(t, before=before), own) for t, before, own in batched(*seam_tokens(b.column("seam").to_numpy()), c))
            else:
                parts = ((Bits(t, since=HEAD), own) for t, own in batched(_tokens(b), c))
            for bits, own in parts:
                any_row = True
                weight = own[bits.token]
                for k in range(ORDERS):
                    at = (starts[k] + bits.slots[k]) * 2 + bits.bit
                    if k == ORDERS - 1:
                        at, weight = at[~bits.deep], weight[~bits.deep]
                    np.add.at(table, at, weight)
        if any_row:
            chunks = table.reshape(-1, CHUNK)
            for i in np.nonzero(chunks.any(axis=1))[0].tolist():
                yield pa.RecordBatch.from_pylist([{"chunk": i, "counts": zlib.compress(chunks[i].tobytes(), 1)}])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, counts in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
                own = sums.setdefault(chunk, np.zeros(CHUNK, dtype=np.int64))
                own += np.frombuffer(zlib.decompress(counts), dtype=np.int64)
        for chunk, own in sums.items():
            yield pa.RecordBatch.from_pylist([{"chunk": chunk, "counts": encode_counts(own).tobytes()}])

    schema = "chunk long, counts binary"
    packed = words.filter("c > 0").select("word", "c").mapInArrow(count, schema)
    packed = packed.unionByName(seams.filter("c > 0").select("seam", "c").mapInArrow(count, schema))
    merged = packed.repartition("chunk").mapInArrow(total, schema)
    tables = np.zeros(SLOTS, dtype=np.uint32).reshape(-1, CHUNK // 2)
    for r in merged.toLocalIterator(prefetchPartitions=False):
        tables[r["chunk"]] = np.frombuffer(r["counts"], dtype=np.uint32)
    return tables.ravel()


def learn_mixer(words: DataFrame, seams: DataFrame, tables, parts: int, seam_parts: int) -> Model:
    """Weights and corrections, learned online over all training words and seams; each bit is predicted from the others' counts.

    Every task learns from its words or seams batch by batch; the tasks' weights are averaged by the words they saw, and
    their corrections are counts that add up. tables: broadcast.
    """

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _whole(batches)
        if found:
            _, c, tokens, _ = found
            counts = zip(batched(tokens, c), deep_counts(tokens, c), strict=True)
            yield learn((Bits(some, since=HEAD), own, deep) for (some, own), deep in counts)

    def of_seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _whole_seams(batches)
        if found:
            keys, c = found
            parts = batched(*seam_tokens(keys), c)
            yield learn((Bits(some, before=before), own, NO_DEEP) for some, before, own in parts)

    def learn(parts: Iterator[tuple[Bits, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        model, seen, step = Model(tables.value), np.zeros(GATES), 0
        right = np.zeros((GATES, STEPS, 2))
        for bits, own, deep in parts:
            if not len(bits.bit):
                continue
            weight = own[bits.token].astype(np.float32)
            x, gate = model.inputs(bits, deep, own=1.0)
            step += 1
            s = model.learn(x, gate, bits.bit, weight, rate=1 / step**0.5)
            seen += np.bincount(gate, weight, GATES)
            near = np.round((s + REACH) * ((STEPS - 1) / (2 * REACH))).astype(np.int64)
            right *= FADING
            cell = (gate.astype(np.int64) * STEPS + near) * 2 + bits.bit
            right += np.bincount(cell, weight, right.size).reshape(right.shape)
        rows = [
            {"gate": g, "seen": float(seen[g]), "weights": model.weights[g].tolist(), "counts": right[g].ravel().tolist()}
            for g in range(GATES)
            if seen[g]
        ]
        return pa.RecordBatch.from_pylist(rows, schema=learned_schema)

    learned_schema = pa.schema([("gate", pa.int64()), ("seen", pa.float64()), ("weights", pa.list_(pa.float64())), ("counts", pa.list_(pa.float64()))])
    schema = "gate long, seen double, weights array<double>, counts array<double>"
    learned = _dealt(words.filter("c > 0"), parts).mapInArrow(of_words, schema)
    learned = learned.unionByName(_dealt_seams(seams.filter("c > 0"), seam_parts).mapInArrow(of_seams, schema))
    sums = [F.sum("seen").alias("seen")]
    sums += [F.sum(F.col("seen") * F.col("weights")[k]).alias(f"w{k}") for k in range(ORDERS + 1)]
    sums += [F.sum(F.col("counts")[k]).alias(f"c{k}") for k in range(STEPS * 2)]
    model = Model(np.zeros(SLOTS, dtype=np.uint32))
    for r in learned.groupBy("gate").agg(*sums).collect():
        g = r["gate"]
        model.weights[g] = [r[f"w{k}"] / r["seen"] for k in range(ORDERS + 1)]
        n = np.array([r[f"c{k}"] for k in range(STEPS * 2)]).reshape(STEPS, 2)
        model.corrections[g] = (n[:, 1] + 2 * model.corrections[g]) / (n.sum(axis=1) + 2)
    return model


def _head(words: DataFrame) -> DataFrame:
    """The most frequent words, HEAD_WORDS at most: all whose count reaches a level read off the counts' histogram."""
    return _most_frequent(words.filter(F.octet_length("word") <= HEAD_BYTES), HEAD_WORDS)


def _most_frequent(rows: DataFrame, most: int) -> DataFrame:
    step = "shiftleft(1L, greatest(length(bin(c)) - 6, 0))"
    counts = rows.groupBy(F.expr(f"c div {step} * {step}").alias("level")).count().orderBy(F.desc("level")).collect()
    total, least = 0, None
    for r in counts:
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    return rows.filter(F.lit(False) if least is None else F.col("c") >= least)


def _common_seams(scored: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent seams, COMMON_SEAMS at most, in order, and their scores; tasks send them packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = (b.column("seam").to_numpy(), b.column("lm").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], names=["seams", "lms"])

    packed = _most_frequent(scored, COMMON_SEAMS).select("seam", "lm").mapInArrow(pack, "seams binary, lms binary").collect()
    keys = np.frombuffer(b"".join(r["seams"] for r in packed), dtype=np.int64)
    order = np.argsort(keys)
    return keys[order], np.frombuffer(b"".join(r["lms"] for r in packed), dtype=np.float64)[order]


def score(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Scores of every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    docs: doc_id, text; further columns are ignored. Learns from the documents whose CRC-32 of the id is no multiple of
    ``folds`` (a null id is learned from). A null text is empty, that is one end token. Repeated rows each count and
    are scored alike. An empty table gives no rows; where nothing is learned, all words are unknown. Words go by a
    64-bit hash where documents meet the table of words. Scores are log10 probabilities; bits_per_byte spreads the
    model's over the text's bytes.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(doc_crc(F.col("doc_id")) % folds == 0, F.lit(False))
    texts = docs.select("doc_id", "text", held_out.alias("held_out"))
    ends = texts.filter("not held_out").count()
    counted = (
        texts.select("text", (~F.col("held_out")).cast("double").alias("train"))
        .mapInArrow(_count_words, "word string, seam long, n long")
        .groupBy("word", "seam")
        .agg(F.sum("n").alias("c"))
    )
    every_count = stored(counted, "lm-words")
    words, seams = every_count.filter("seam is null").select("word", "c"), every_count.filter("seam is not null").select("seam", "c")
    n, v, every = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.count("*")).first()
    n, v, parts, seam_parts = n + ends, v + (ends > 0), max(1, -(-every // TASK_WORDS)), max(1, -(-seams.count() // TASK_SEAMS))
    tables = spark.sparkContext.broadcast(count_contexts(words, seams))
    model = learn_mixer(words, seams, tables, parts, seam_parts)
    weights, corrections = model.weights, model.corrections

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _whole(batches)
        if found:
            words, c, tokens, h = found
            built = Model(tables.value)
            built.weights, built.corrections = weights, corrections
            columns = [words, pa.array(c), pa.array(h.view(np.int64)), pa.array(built.score(tokens, c, since=HEAD))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "c", "h", "lm"])

    def score_seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _whole_seams(batches)
        if found:
            keys, c = found
            built = Model(tables.value)
            built.weights, built.corrections = weights, corrections
            columns = [keys, c, seam_hashes(keys), built.score_seams(keys)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["seam", "c", "h", "lm"])

    scored = stored(_dealt(words, parts).mapInArrow(score_words, "word string, c long, h long, lm double"), "lm-scores")
    scored_seams = stored(_dealt_seams(seams, seam_parts).mapInArrow(score_seams, "seam long, c long, h long, lm double"), "lm-seams")
    discard(every_count)

    def base(c):
        return np.log10((c + ADDED) / (n + ADDED * (v + 1)))

    head = _head(scored).select("word", "c", "lm").toPandas()
    common = spark.sparkContext.broadcast((dict(zip(head["word"], range(len(head)), strict=True)), head["c"].to_numpy(dtype=float), head["lm"].to_numpy(), *_common_seams(scored_seams)))
    end_known, end_base = int(ends > 0), float(base(float(ends)))

    def score_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known, c, lm, seam, seam_lm = common.value
        c, lm = np.append(c, 0.0), np.append(lm, 0.0)
        names = ["row", "doc_id", "held_out", "n_bytes", "n_tokens", "n_known", "base_score", "score", "h", "n"]
        for batch in batches:
            for b in batches_of(batch, "text", PART_BYTES):
                codes, per_text, words = word_codes(b.column("text"))
                listed = words.to_pylist()
                place = np.fromiter((known.get(w, len(known)) for w in listed), dtype=np.int64, count=len(listed))
                at, row = place[codes], np.repeat(np.arange(b.num_rows), per_text)
                inside = at < len(known)
                r, a = row[inside], at[inside]
                sums = [np.bincount(r, w, b.num_rows) for w in ((c[a] > 0), base(c[a]), lm[a])]
                rare, per = np.unique((row[~inside] << 32) | codes[~inside], return_counts=True)
                code = rare & 0xFFFFFFFF
                used, code = np.unique(code, return_inverse=True)
                digest = np.fromiter((xxhash.xxh3_64_intdigest(listed[i].encode() + b" ") for i in used), dtype=np.uint64, count=len(used))
                seams, key = np.unique(seam_keys(codes, per_text, words), return_inverse=True)
                seam_row = np.concatenate((row, np.arange(b.num_rows)))
                at = np.minimum(np.searchsorted(seam, seams), max(len(seam) - 1, 0))
                met = seam[at] == seams if len(seam) else np.zeros(len(seams), dtype=bool)
                own = np.zeros(len(seams))
                own[met] = seam_lm[at[met]]
                sums[2] = sums[2] + np.bincount(seam_row, own[key], b.num_rows)
                other = ~met[key]
                rare_seam, seam_per = np.unique((seam_row[other] << 32) | key[other], return_counts=True)
                rare, per = np.concatenate((rare, rare_seam)), np.concatenate((per, seam_per))
                digest = np.concatenate((digest.view(np.int64)[code], seam_hashes(seams)[rare_seam & 0xFFFFFFFF]))
                rows = b.column("row").to_numpy()
                empty = pa.nulls(b.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("row"), b.column("doc_id"), b.column("held_out")]
                    + [pc.fill_null(pc.binary_length(b.column("text")).cast(pa.int64()), 0), pa.array(per_text + 1, pa.int64())]
                    + [pa.array(sums[0].astype(np.int64) + end_known), pa.array(sums[1] + end_base), pa.array(sums[2]), empty, empty],
                    names=names,
                )
                k = len(rare)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[rare >> 32]), pa.nulls(k, b.column("doc_id").type), pa.nulls(k, pa.bool_())]
                    + [pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    + [pa.array(digest), pa.array(per.astype(np.int64))],
                    names=names,
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {id_type}, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double, h long, n long"
    parts = stored(texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(score_docs, schema), "lm-docs")
    rest = (
        parts.filter("h is not null")
        .select("row", "h", "n")
        .join(scored.select("h", "c", "lm").unionByName(scored_seams.select("h", F.lit(None).cast("long").alias("c"), "lm")), "h")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("_known"),
            F.sum(F.col("n") * F.log10((F.col("c") + ADDED) / F.lit(float(n + ADDED * (v + 1))))).alias("_base"),
            F.sum(F.col("n") * F.col("lm")).alias("_lm"),
        )
    )
    whole = parts.filter("h is null").drop("h", "n").join(rest, "row", "left")
    total = F.col("score") + F.coalesce("_lm", F.lit(0.0))
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        total.alias("score"),
        (-total * math.log2(10) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
