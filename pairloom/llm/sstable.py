"""Sorted string tables: documents' token ids by identifier, in files that a binary search reads.

A shard is data blocks, a sparse index, a Bloom filter and a footer:

* block: zstd of entries (varint shared, varint rest, varint size, key's rest, value), then the offsets of
  the entries that share nothing (every ``RESTART``-th) as u32 and their count as u32;
* value: one byte of width (2 or 4), then the ids in that many bytes each, little-endian;
* index: for each block u32 key size, its last key, u64 offset, u32 size, u32 crc of the stored block;
* Bloom filter: u32 hash count, then the bits;
* footer: u64 index offset, u32 size, u64 filter offset, u32 size, u64 documents, u64 ids, 8 bytes of magic.

A key is a byte 1 and the identifier as 8 bytes, highest first, with the sign bit turned, so that keys sort as
their identifiers do; a null identifier's key is a byte 0.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, tokens

BLOCK_BYTES = 1 << 16
#: A task begins another shard when one has so many bytes, so what a writer holds is bounded.
SHARD_BYTES = 256 << 20
RESTART = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"PLSSTAB1"
FOOTER = struct.Struct("<QIQIQQ8s")
SIGN = 1 << 63


def key_of(identifier: int | None) -> bytes:
    return b"\0" if identifier is None else b"\1" + struct.pack(">Q", (identifier + SIGN) & (2**64 - 1))


def identifier_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - SIGN if key[0] else None


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _varint_at(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def pack_ids(ids: np.ndarray) -> bytes:
    width = 2 if len(ids) == 0 or int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, f"<u{value[0]}", offset=1).astype("<u4")


def _bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    a = zlib.crc32(key) | zlib.crc32(key, 0x9E3779B9) << 32
    step = (zlib.crc32(key[::-1], 0x85EBCA6B) << 1 | 1) * 0xC2B2AE35
    return [(a + i * step) % bits for i in range(hashes)]


class Writer:
    """Takes (key, value) with keys that never fall; holds one block, the index and the keys' Bloom places."""

    def __init__(self, out):
        self.out, self.at, self.index, self.keys = out, 0, [], []
        self.documents = self.ids = 0
        self.zstd = zstandard.ZstdCompressor(level=1)
        self._clear()

    def _clear(self) -> None:
        self.parts, self.size, self.restarts, self.count, self.last = [], 0, [], 0, b""

    def add(self, key: bytes, value: bytes, ids: int) -> None:
        shared_ = 0
        if self.count % RESTART == 0:
            self.restarts.append(self.size)
        else:
            while shared_ < min(len(key), len(self.last)) and key[shared_] == self.last[shared_]:
                shared_ += 1
        head = _varint(shared_) + _varint(len(key) - shared_) + _varint(len(value)) + key[shared_:]
        self.parts += [head, value]
        self.size += len(head) + len(value)
        self.count += 1
        self.last = key
        self.keys.append(key)
        self.documents += 1
        self.ids += ids
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        at, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return at, len(data)

    def _flush(self) -> None:
        if self.count:
            tail = struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            block = self.zstd.compress(b"".join([*self.parts, tail]))
            self.index.append((self.last, *self._put(block), zlib.crc32(block)))
            self._clear()

    def close(self) -> None:
        self._flush()
        index = self._put(b"".join(struct.pack("<I", len(k)) + k + struct.pack("<QII", a, n, c) for k, a, n, c in self.index))
        bits = max(64, len(self.keys) * BLOOM_BITS)
        held = np.zeros(bits, np.uint8)
        for k in self.keys:
            held[_bloom_places(k, bits, BLOOM_HASHES)] = 1
        bloom = self._put(struct.pack("<II", BLOOM_HASHES, bits) + np.packbits(held).tobytes())
        self.out.write(FOOTER.pack(*index, *bloom, self.documents, self.ids, MAGIC))
        self.out.close()


class Reader:
    """A shard's entries in order, or those of one key by filter and binary search."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        raw = self._at(self.file.size() - FOOTER.size, FOOTER.size)
        index, n_index, bloom, n_bloom, self.documents, self.ids, magic = FOOTER.unpack(raw)
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        self.bloom_at = bloom, n_bloom
        self.bloom: bytes | None = None
        self.index, at, data = [], 0, self._at(index, n_index)
        while at < len(data):
            (n,) = struct.unpack_from("<I", data, at)
            self.index.append((data[at + 4 : at + 4 + n], *struct.unpack_from("<QII", data, at + 4 + n)))
            at += 20 + n
        self.last_keys = [k for k, *_ in self.index]
        self.zstd = zstandard.ZstdDecompressor()

    def _at(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset)

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        _, at, n, crc = self.index[i]
        raw = self._at(at, n)
        if zlib.crc32(raw) != crc:
            raise ValueError("a block is damaged")
        data = self.zstd.decompress(raw)
        (n,) = struct.unpack_from("<I", data, len(data) - 4)
        return data[: len(data) - 4 * n - 4], list(struct.unpack_from(f"<{n}I", data, len(data) - 4 * n - 4))

    @staticmethod
    def _entries(data: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(data):
            same, at = _varint_at(data, at)
            rest, at = _varint_at(data, at)
            size, at = _varint_at(data, at)
            key = key[:same] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def blocks(self) -> Iterator[list[tuple[bytes, bytes]]]:
        for i in range(len(self.index)):
            yield list(self._entries(self._block(i)[0], 0))

    def may_hold(self, key: bytes) -> bool:
        if self.bloom is None:
            self.bloom = self._at(*self.bloom_at)
        hashes, bits = struct.unpack_from("<II", self.bloom)
        return all(self.bloom[8 + p // 8] >> (7 - p % 8) & 1 for p in _bloom_places(key, bits, hashes))

    def get(self, key: bytes) -> list[bytes]:
        """The values of every entry with this key."""
        return list(self.find(key))

    def find(self, key: bytes) -> Iterator[bytes]:
        """The values of every entry with this key, one after the other: by the filter and a binary search."""
        if not self.may_hold(key):
            return
        i = bisect_left(self.last_keys, key)
        while i < len(self.index):
            data, restarts = self._block(i)
            low, high = 0, len(restarts)
            while low < high:  # the last entry that shares nothing and is below the key
                mid = (low + high) // 2
                if next(self._entries(data, restarts[mid]))[0] < key:
                    low = mid + 1
                else:
                    high = mid
            for k, v in self._entries(data, restarts[max(0, low - 1)]):
                if k > key:
                    return
                if k == key:
                    yield v
            i += 1


def write_shards(df: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text: str = "text", shards: int | None = None, shard_bytes: int = SHARD_BYTES) -> list[tuple[str, int, int]]:
    """Writes the documents' ids as shards in the shared folder; (uri, documents, ids) of each in key order.

    Rows are dealt by ranges of their identifiers, so the shards follow each other. Null identifiers come
    first; rows with one identifier follow each other by their texts' hashes, over several shards if they are
    many, and are all kept. Null texts are empty and hold the end id alone; an empty table has no shards, and
    other columns are not read. Each try of a task writes files of its own name, and only the files that the
    finished tries name are read, so lost executors leave no wrong shard behind. The driver gets one row for
    each shard.
    """
    spark = df.sparkSession
    root = shared.fresh(spark, "shards")
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").asc_nulls_first(), F.col("mark"), F.col("text")]
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("mark"))
    dealt = rows.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, uri, task, seq = tokens.encoder(vocabulary), None, "", TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4")

        def closed() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pylist([{"shard": task, "seq": seq, "uri": uri, "documents": writer.documents, "ids": writer.ids}])

        for b in batches:
            keys = [key_of(x) for x in b.column(0).to_pylist()]
            for first, ids, offsets in enc.batches(b.column(1)):
                for i in range(len(offsets) - 1):
                    if writer is None:
                        uri = f"{root}/shard-{task:06d}-{seq:04d}-{uuid.uuid4().hex}.sst"
                        fs, path = pafs.FileSystem.from_uri(uri)
                        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        writer = Writer(fs.open_output_stream(path, buffer_size=1 << 20))
                    own = np.concatenate([ids[offsets[i] : offsets[i + 1]], end])
                    writer.add(keys[first + i], pack_ids(own), len(own))
                    if writer.at >= shard_bytes:
                        yield closed()
                        writer, seq = None, seq + 1
        if writer is not None:
            yield closed()

    made = dealt.mapInArrow(shared.frugal(run), "shard long, seq long, uri string, documents long, ids long").collect()
    return [(r.uri, r.documents, r.ids) for r in sorted(made, key=lambda r: (r.shard, r.seq))]


def read_shards(spark: SparkSession, shards: list[tuple[str, int, int]], id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, read back from the shards, one block at a time.

    The first new key of each block is also looked up, by filter, index and binary search; a shard that doesn't
    give what the block holds fails the job.
    """
    starts = np.cumsum([0, *[n for *_, n in shards]]).tolist()
    uris = [u for u, *_ in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                at = starts[k]
                reader, last = Reader(uris[k]), b""
                for block in reader.blocks():
                    rows, looked = [], False
                    for key, value in block:
                        if key != last and not looked:
                            looked = True
                            if next(reader.find(key), None) != value:
                                raise ValueError(f"a lookup in {uris[k]} fails")
                        last = key
                        ids = unpack_ids(value)
                        rows.append((identifier_of(key), at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(shared.frugal(run), f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")
