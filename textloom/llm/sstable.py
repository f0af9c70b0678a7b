"""Token ids in sorted-string-table shards.

A shard holds documents by ascending identifier. Layout (integers little-endian):

    data blocks   entries: shared key prefix length, key rest length, value length (LEB128 each), key rest, value;
                  the first entry of a block shares nothing; a block is deflated by zstd
    index block   per data block: key length, first key, offset, stored length
    Bloom filter  bit array over whole keys
    footer        64 bytes: magic, version, id width, entries, ids, index offset and length, filter offset and
                  length, filter probes

Keys are 8 bytes, big-endian with the sign bit turned, so byte order is number order; a null identifier is the empty
key and comes first. Values are ids of the width that the vocabulary needs (2 or 4 bytes).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize, shared_dir
from textloom.llm.encoding import default_vocabulary, encoder
from textloom.llm.files import Staged, opened

BLOCK_BYTES = 64 * 1024
SHARD_BYTES = 64 * 1024 * 1024
_FOOTER = struct.Struct("<8sHHIQQQQQI")
MAGIC = b"TLSSTv01"
PROBES, BITS_PER_KEY = 7, 10


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + 2**63) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - 2**63 if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int, probes: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + k * b) % bits for k in range(probes)]


class ShardWriter:
    """Writes entries that come in key order."""

    def __init__(self, out: Staged, width: int):
        self.out, self.width = out, width
        self.entries = self.ids = 0
        self.keys: list[bytes] = []
        self.index: list[bytes] = []
        self.block, self.block_size, self.last = [], 0, b""
        self.deflate = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        if not self.block:
            self.first, shared = key, 0
        else:
            shared = next((i for i, (a, b) in enumerate(zip(key, self.last)) if a != b), min(len(key), len(self.last)))
        self.block.append(_varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value)
        self.block_size += len(self.block[-1])
        self.last = key
        self.keys.append(key)
        self.entries += 1
        self.ids += len(ids)
        if self.block_size >= BLOCK_BYTES:
            self.end_block()

    def end_block(self) -> None:
        if self.block:
            data = self.deflate.compress(b"".join(self.block))
            at = self.out.write(data)
            self.index.append(_varint(len(self.first)) + self.first + _varint(at) + _varint(len(data)))
            self.block, self.block_size = [], 0

    def close(self) -> None:
        self.end_block()
        index = b"".join(self.index)
        index_at = self.out.write(index)
        bits = np.zeros(max(64, -(-BITS_PER_KEY * len(self.keys) // 8) * 8), np.uint8)
        for key in self.keys:
            bits[_probes(key, len(bits), PROBES)] = 1
        bloom = np.packbits(bits, bitorder="little").tobytes()
        bloom_at = self.out.write(bloom)
        self.out.write(_FOOTER.pack(MAGIC, 1, self.width, self.entries, self.ids, index_at, len(index), bloom_at, len(bloom), PROBES))
        self.out.close()


class ShardReader:
    """Reads a shard: all entries in order, or one key by filter, binary search in the index and one block.

    The footer is read first, then the index; the filter and blocks are read when they are asked for, each by its range.
    """

    def __init__(self, file: pa.NativeFile | bytes):
        self.file = pa.BufferReader(file) if isinstance(file, bytes) else file
        size = self.file.size()
        magic, _, self.width, self.entries, self.ids, index_at, index_size, self.bloom_at, self.bloom_size, self.probes = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        index, at, self.blocks, self.bloom = self.file.read_at(index_size, index_at), 0, [], None
        while at < len(index):
            n, at = _read_varint(index, at)
            key, at = index[at : at + n], at + n
            where, at = _read_varint(index, at)
            length, at = _read_varint(index, at)
            self.blocks.append((key, where, length))
        self.inflate = zstandard.ZstdDecompressor()

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, where, length = self.blocks[block]
        data, at, key = self.inflate.decompress(self.file.read_at(length, where)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key, at = key[:shared] + data[at : at + rest], at + rest
            yield key, np.frombuffer(data, "<u2" if self.width == 2 else "<u4", size // self.width, at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for block in range(len(self.blocks)):
            yield from self._entries(block)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier."""
        key = key_of(doc_id)
        if self.bloom is None:
            self.bloom = self.file.read_at(self.bloom_size, self.bloom_at)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, 8 * self.bloom_size, self.probes)):
            return []
        lo, hi = 0, len(self.blocks)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.blocks[mid][0] < key:
                lo = mid + 1
            else:
                hi = mid
        found = []
        for block in range(max(0, lo - 1), len(self.blocks)):  # equal keys may run over several blocks
            if self.blocks[block][0] > key:
                break
            found += [v for k, v in self._entries(block) if k == key]
        return found


def _writer(folder: str, vocabulary: str, end: int, width: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, (fs, path), part, seq = encoder(vocabulary).encode, opened(folder), TaskContext.get().partitionId(), 0
        shard, done = None, []

        def finish() -> None:
            nonlocal shard, seq
            shard.close()
            done.append((part, seq, name, shard.entries, shard.ids))
            shard, seq = None, seq + 1

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist())):
                    if shard is None:
                        name = f"shard-{part:06d}-{seq:06d}.sst"
                        shard = ShardWriter(Staged(fs, f"{path}/{name}"), width)
                    shard.add(key_of(doc_id), np.append(np.frombuffer(ids, "<u4"), np.uint32(end)))
                    if shard.ids * width >= most:
                        finish()
        if shard is not None:
            finish()
        parts, seqs, names, entries, ids = zip(*done) if done else ((),) * 5
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(seqs, pa.int32()), pa.array(names, pa.string()), pa.array(entries, pa.int64()), pa.array(ids, pa.int64())], names=["part", "seq", "name", "entries", "ids"])

    return run


def write_shards(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = 1, wide: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes the documents and writes them in ascending doc_id as shards in folder; returns one row per shard.

    Null and empty texts hold the end id alone; a null doc_id comes first; repeated ids are kept side by side. Extra
    columns are ignored; an empty table writes nothing. A very long text is one entry, held whole while it is written.
    wide: 4 bytes per id whatever the vocabulary. A shard ends after shard_bytes of ids.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    width = 4 if wide or max(end, encoder(vocabulary).tokenizer.get_vocab_size()) > 65_536 else 2
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    in_order = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return materialize(in_order.mapInArrow(_writer(folder, vocabulary, end, width, shard_bytes), "part int, seq int, name string, entries long, ids long"), "shards")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{path}/{name}") as file:
                    out, at = [], 0
                    for key, ids in ShardReader(file):
                        out.append((id_of(key), name, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(out) == 10_000:
                            yield _batch(out, kinds)
                            out = []
                    yield _batch(out, kinds)

    return run


def _batch(rows: list[tuple], kinds: tuple) -> pa.RecordBatch:
    cols = zip(*rows) if rows else ((),) * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "name", "at", "n_tokens", "ids_crc32"])


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Per document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Shards are read block by block, so a task holds one block and the index, whatever a shard's size.
    """
    # one row per shard, so the running sum is over the shards' totals only
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("name", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    tasks = max(shards.sparkSession.sparkContext.defaultParallelism, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = shards.select("name").repartition(tasks, "name")
    read = named.mapInArrow(_reader(folder), "doc_id long, name string, at long, n_tokens long, ids_crc32 long")
    return read.join(starts, "name").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def new_folder(docs: DataFrame, kind: str) -> str:
    folder = f"{shared_dir(docs.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    opened(folder)
    return folder
