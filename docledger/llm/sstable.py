"""Operator 10, second half: sorted-string-table shards of token ids.

A shard file is: data blocks, block index, Bloom filter, footer. Keys are 9 bytes that sort as the identifiers do
(null first). A data block is a run of entries - length of the prefix shared with the key before, rest of the key,
number of ids, ids - and the CRC-32 of them. The index has each block's first and last key, place and length, so a
lookup is a binary search of the index and a scan of one block, which the Bloom filter spares for most absent keys.
Ids take 2 bytes each where the vocabulary allows it, else 4; all numbers are little-endian.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import batches_of, shared_dir
from docledger.llm.tokens import END_ID, encoder, vocabulary_path

MAGIC = b"DLSST001"
BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = 64 << 10, 10, 7
#: offset and length of the index, of the filter; documents, ids, bytes an id, magic
FOOTER = "<QQQQQQI8s"
_ENTRY, _INDEX = "<BBI", "<9s9sQI"


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _bloom_bits(key: bytes, m: int) -> list[int]:
    import xxhash

    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % m for i in range(BLOOM_HASHES)]


class Writer:
    """Writes entries, which must come in ascending key order, to one open file."""

    def __init__(self, sink, width: int):
        self.sink, self.width, self.at = sink, width, 0
        self.block, self.first, self.last = bytearray(), b"", b""
        self.index, self.keys, self.ids = [], [], 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.block:
            while shared < 9 and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += struct.pack(_ENTRY, shared, 9 - shared, len(ids)) + key[shared:] + ids.astype(f"<u{self.width}").tobytes()
        self.last = key
        self.keys.append(key)
        self.ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.sink.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if self.block:
            place = self._put(bytes(self.block) + struct.pack("<I", zlib.crc32(self.block)))
            self.index.append((self.first, self.last, *place))
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = self._put(b"".join(struct.pack(_INDEX, *x) for x in self.index))
        m = max(64, BLOOM_BITS * len(self.keys))
        bits = np.zeros(m, dtype=np.uint8)
        for k in self.keys:
            bits[_bloom_bits(k, m)] = 1
        bloom = self._put(struct.pack("<Q", m) + np.packbits(bits, bitorder="little").tobytes())
        self._put(struct.pack(FOOTER, *index, *bloom, len(self.keys), self.ids, self.width, MAGIC))


class Reader:
    """Reads one shard: ``open_file`` gives a seekable file."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        source.seek(source.tell() - struct.calcsize(FOOTER))
        *place, self.n_docs, self.n_ids, self.width, magic = struct.unpack(FOOTER, source.read(struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.index = list(struct.iter_unpack(_INDEX, self._at(*place[:2])))
        bloom = self._at(*place[2:])
        self.m, self.bits = struct.unpack_from("<Q", bloom)[0], bloom[8:]

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def _entries(self, offset: int, length: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data = self._at(offset, length)
        body, crc = data[:-4], struct.unpack("<I", data[-4:])[0]
        if zlib.crc32(body) != crc:
            raise ValueError("a block's checksum does not match")
        at, key = 0, b""
        while at < len(body):
            shared, own, n = struct.unpack_from(_ENTRY, body, at)
            at += struct.calcsize(_ENTRY)
            key = key[:shared] + body[at : at + own]
            at += own
            yield key, np.frombuffer(body, dtype=f"<u{self.width}", count=n, offset=at)
            at += n * self.width

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for _, _, offset, length in self.index:
            yield from self._entries(offset, length)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document with this identifier: none if there is none, several if it repeats."""
        key = key_of(doc_id)
        if not all(self.bits[b >> 3] >> (b & 7) & 1 for b in _bloom_bits(key, self.m)):
            return []
        found, i = [], bisect.bisect_left(self.index, key, key=lambda x: x[1])
        while i < len(self.index) and self.index[i][0] <= key:
            found += [ids for k, ids in self._entries(*self.index[i][2:]) if k == key]
            i += 1
        return found


def open_input(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def write(docs: DataFrame, folder: str | None = None, path: str | None = None) -> list[dict]:
    """Encodes the docs' whole texts and writes shards in ascending doc_id order; returns their manifest.

    docs: doc_id (long), text; further columns are ignored. A null text is empty; each document ends with id 2. Null
    identifiers come first; documents with the same identifier follow each other by text. Each task writes a file
    under a name of its own, and only files in the manifest count, so a task that is lost and run again does no harm.
    The manifest has one entry a shard. An empty table gives no shards.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    path = path or vocabulary_path()

    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, tokenizer, writer, first = f"{uuid.uuid4().hex}.sst", encoder(path), None, None
        with store.open_output_stream(f"{base}/{name}") as sink:
            writer = Writer(sink, 2 if tokenizer.size <= 1 << 16 else 4)
            for batch in batches:
                for b in batches_of(batch, "text"):
                    for doc_id, ids in zip(b.column("doc_id").to_pylist(), tokenizer.encode(b.column("text")), strict=True):
                        key = key_of(doc_id)
                        first = key if first is None else first
                        writer.add(key, np.append(ids, END_ID))
            writer.close()
        if first is not None:
            row = {"uri": f"{folder}/{name}", "first": first, "last": writer.keys[-1], "n_docs": len(writer.keys), "n_ids": writer.ids}
            yield pa.RecordBatch.from_pylist([row])
        else:
            store.delete_file(f"{base}/{name}")

    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = dealt.mapInArrow(write_shard, "uri string, first binary, last binary, n_docs long, n_ids long").collect()
    manifest = sorted((r.asDict() for r in rows), key=lambda r: bytes(r["first"]))
    start = 0
    for r in manifest:
        r["start"] = start
        start += r["n_ids"]
    return manifest


def read(spark, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the shards, read back from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    shards = spark.createDataFrame([(r["uri"], r["start"]) for r in manifest], "uri string, start long")

    def read_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, found = row["start"], []
                with open_input(row["uri"]) as source:
                    for key, ids in Reader(source):
                        found.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return shards.repartition(len(manifest)).mapInArrow(read_shard, schema)


def lookup(manifest: list[dict], doc_id: int | None) -> list[np.ndarray]:
    """Ids of the documents with this identifier, by binary search over the shards and within them."""
    key = key_of(doc_id)
    found, i = [], bisect.bisect_left(manifest, key, key=lambda r: bytes(r["last"]))
    while i < len(manifest) and bytes(manifest[i]["first"]) <= key:
        with open_input(manifest[i]["uri"]) as source:
            found += Reader(source).get(doc_id)
        i += 1
    return found
