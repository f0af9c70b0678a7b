"""Text payloads as media in content-addressed tar shards.

A payload (UTF-8, blanks up to a positive multiple of 192 bytes) becomes an 8-bit grey PNG of width 192, which is
lossless. A shard is a tar file whose members are named by the digest of the payload; a payload that a shard has
already is not stored again. Rows carry shard, digest, offset and length of the PNG. Columns about the medium come
from range reads of its first 33 bytes; only the digest and the feature read it whole.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize
from textloom.llm.files import Staged, opened

WIDTH = 192
SHARD_BYTES = 64 * 1024 * 1024
_SIGN = b"\x89PNG\r\n\x1a\n"
HEADER = 33


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG whose samples are the payload's bytes, row by row."""
    rows = len(payload) // WIDTH
    raw = np.zeros((rows, WIDTH + 1), np.uint8)  # the first byte of a row names its filter: none
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of what to_png() made."""
    at, idat = len(_SIGN), b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            idat += data[at + 8 : at + 8 + n]
        at += 12 + n
    width, _ = png_size(data)
    return np.frombuffer(zlib.decompress(idat), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def png_size(head: bytes) -> tuple[int, int]:
    if head[: len(_SIGN)] != _SIGN:
        raise ValueError("not a PNG")
    return struct.unpack(">II", head[16:24])


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "replace")
    return data + b" " * (-len(data) % WIDTH if data else WIDTH), len(data)


def _writer(folder: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, path), part, seq, out, at = opened(folder), TaskContext.get().partitionId(), 0, None, {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows, some = [], batch.slice(lo, 256)
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    payload, n = payload_of(text)
                    digest = hashlib.sha256(payload).hexdigest()
                    if out is None:
                        name, at = f"media-{part:06d}-{seq:06d}.tar", {}
                        out, seq = Staged(fs, f"{path}/{name}"), seq + 1
                    if digest not in at:
                        png = to_png(payload)
                        info = tarfile.TarInfo(f"{digest}.png")
                        info.size = len(png)
                        out.write(info.tobuf(tarfile.USTAR_FORMAT))
                        at[digest] = (out.write(png), len(png))
                        out.write(b"\0" * (-len(png) % tarfile.BLOCKSIZE))
                    rows.append((doc_id, n, name, digest, *at[digest]))
                    if out.size >= most:
                        out.write(b"\0" * 2 * tarfile.BLOCKSIZE)
                        out.close()
                        out = None
                cols = list(zip(*rows)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_bytes", "shard", "digest", "offset", "length"])
        if out is not None:
            out.write(b"\0" * 2 * tarfile.BLOCKSIZE)
            out.close()

    return run


def write_media(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes every text as a medium into tar shards in folder; per document: doc_id, n_bytes, shard, digest, offset, length.

    Null text is the empty text: one row of blanks. Repeated rows share their medium within a shard; a copy in another
    shard is stored again under the same name. Null ids are kept. A very long text is one medium, held whole (payload,
    raster and PNG) while it is written. A shard ends after shard_bytes. Extra columns are ignored; an empty table
    writes nothing.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(docs.mapInArrow(_writer(folder, shard_bytes), "doc_id long, n_bytes long, shard string, digest string, offset long, length long"), "media")


def feature(samples: bytes, width: int, height: int) -> str:
    """Size, mean, spread and coarse histogram of the samples."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256)
    n, total, squares = len(x), int(counts @ values), int(counts @ (values * values))
    bins = counts.reshape(8, 32).sum(1)
    return f"{width}x{height};mean={total / n:.4f};var={squares / n - (total / n) ** 2:.4f};hist=" + "/".join(map(str, bins))


def _reader(folder: str, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        name, file, known = None, None, {}
        for batch in batches:
            rows = []
            for doc_id, n, shard, digest, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != name:
                    name, file, known = shard, fs.open_input_file(f"{path}/{shard}"), {}
                if (got := known.get(digest)) is None:
                    width, height = png_size(file.read_at(HEADER, offset))
                    got = (width, height)
                    if whole:
                        png = file.read_at(length, offset)
                        back = from_png(png)
                        got += (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(png), hashlib.sha256(png).hexdigest(), feature(back, width, height))
                    if len(known) < 50_000:
                        known[digest] = got
                rows.append((doc_id, n, shard, digest, offset, length, *got))
            cols = list(zip(*rows)) or [()] * (14 if whole else 8)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()][: len(cols)]
            names = ["doc_id", "n_bytes", "shard", "digest", "offset", "length", "width", "height", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names[: len(cols)])

    return run


_ROWS = "doc_id long, n_bytes long, shard string, digest string, offset long, length long, width int, height int"


def media_headers(rows: DataFrame, folder: str) -> DataFrame:
    """The rows of write_media() with width and height, from header bytes alone."""
    return rows.mapInArrow(_reader(folder, False), _ROWS)


def media_features(rows: DataFrame, folder: str) -> DataFrame:
    """media_headers() with what reading the medium gives: payload and media digests, sizes, tail checksum, feature."""
    return rows.mapInArrow(_reader(folder, True), _ROWS + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
