"""Shared helpers of the training-data operators: tables, shared folder, hashing of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.store import materialize, scratch, shared_dir, written  # noqa: F401  (the operators take them from here)


# Workers live on after a task: buffers go back to the system instead of staying in Arrow's own pool.
pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """Gives a worker's freed memory back to the system, where the C library can: workers live on, and what they freed counts as theirs."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: as it is, or dealt anew where a small input has fewer partitions than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def bounded_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df with a broadcast hint if its counted rows stay within limit, else as it is (a shuffled join)."""
    return F.broadcast(df) if rows <= limit else df


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash, kept for at most `most` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = value
        return value


_HASHES = WordHashes()
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs without ASCII white space of the text, with A-Z lower-cased."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _Q
    h = (h ^ (h >> np.uint64(29))) * _P
    return h ^ (h >> np.uint64(32))


def shingle_hashes(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its `width`-word shingles.

    Fewer words than `width`: the whole sequence is the one shingle. No words: an empty array.
    """
    words = [words_of(t) for t in texts]
    flat = np.fromiter((h for ws in words for h in map(_HASHES.__getitem__, ws)), np.uint64, sum(map(len, words)))
    if len(flat) >= width:
        rolled = flat[: len(flat) - width + 1].copy()
        for k in range(1, width):
            rolled = rolled * _P + flat[k : len(flat) - width + 1 + k]
        rolled = _mixed(rolled)
    out, at = [], 0
    for ws in words:
        n = len(ws)
        if n >= width:
            s = np.sort(rolled[at : at + n - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=n)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out
