"""BPE encoding and decoding through a table of distinct words.

Texts are split into words in Spark. Documents in blocks keep their words as numbers of the block's own dictionary; the
words of all dictionaries meet by a hash of the word, each distinct one is encoded once there, and its ids go back to
the blocks, where they join the documents by position. Decoding takes every id's piece from the vocabulary's table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import give_back, materialize
from textloom.llm.encoding import default_vocabulary, encoder

#: Words of a block: what a task holds of documents at once. A longer document is a block of its own.
BLOCK_WORDS = 3 << 21
_OUT_WORDS = 1 << 18
_CODED = "block long, doc_ids array<long>, n_words array<long>, codes binary, shards binary, shard int, words binary"
_CODED_ARROW = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("codes", pa.binary()), ("shards", pa.binary()), ("shard", pa.int32()), ("words", pa.binary())])


def packed_numbers(numbers: np.ndarray, level: int = 3) -> bytes:
    """Unsigned numbers as compressed planes of bytes, the lowest first."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=level).compress(planes.tobytes())


def unpacked_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _first_places(codes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n numbers, which appear in order, appears first."""
    top = np.maximum.accumulate(codes)
    new = np.concatenate(([True], top[1:] > top[:-1])) if len(codes) else np.empty(0, bool)
    assert int(new.sum()) == n, "dictionary numbers must appear in order"
    return np.flatnonzero(new)


def _of_shards(of: np.ndarray, shards: int) -> list[np.ndarray]:
    """Per shard the numbers of its words, ascending."""
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(shards + 1))
    return [order[a:b] for a, b in zip(bounds, bounds[1:])]


def _blocks(shards: int, most: int):
    """Batches of (doc_id, words) to rows of blocks and of their dictionaries' shards."""

    def block(number: int, ids: list, counts: list[int], parts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        coded = pa.concat_arrays(parts).dictionary_encode()
        codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        places = codes.astype(np.uint32) + 1
        places[_first_places(codes, len(words))] = 0  # a word's first place needs no number: it is the next one
        of = np.fromiter((xxhash.xxh3_64_intdigest(w) % shards for w in words.cast(pa.large_binary()).to_pylist()), np.int64, len(words))
        yield pa.RecordBatch.from_pylist([{"block": number, "doc_ids": ids, "n_words": counts, "codes": packed_numbers(places, 9), "shards": packed_numbers(of)}], schema=_CODED_ARROW)
        rows = [(s, at) for s, at in enumerate(_of_shards(of, shards)) if len(at)]
        if rows:
            nothing = [pa.nulls(len(rows), _CODED_ARROW.field(k).type) for k in (1, 2, 3, 4)]
            # words hold no blanks
            joined = [zstandard.ZstdCompressor(level=9).compress(b" ".join(words.take(pa.array(at)).cast(pa.large_binary()).to_pylist())) for _, at in rows]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int64()), *nothing, pa.array([s for s, _ in rows], pa.int32()), pa.array(joined, pa.binary())], schema=_CODED_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, held = TaskContext.get().partitionId() << 32, 0, 0
        ids, counts, parts = [], [], []
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            ends, own, lo = np.concatenate(([0], np.cumsum(sizes))), lists.flatten(), 0
            # long words count by their bytes
            bytes_ = np.concatenate(([0], np.cumsum(pc.binary_length(own).to_numpy(zero_copy_only=False))))[ends]
            weights = np.maximum(ends, bytes_ >> 3)
            docs = batch.column(0).to_pylist()
            while lo < batch.num_rows:
                hi = int(np.searchsorted(weights, weights[lo] + most - held, "right")) - 1
                if hi <= lo and not ids:
                    hi = lo + 1  # larger than a block: one of its own
                if hi > lo:
                    ids += docs[lo:hi]
                    counts += sizes[lo:hi].tolist()
                    parts.append(own.slice(int(ends[lo]), int(ends[hi] - ends[lo])).cast(pa.large_string()))  # a copy: a slice keeps the batch
                    held, lo = held + int(weights[hi] - weights[lo]), hi
                if lo < batch.num_rows:
                    yield from block(task + made, ids, counts, parts)
                    made, held, ids, counts, parts = made + 1, 0, [], [], []
        if ids:
            yield from block(task + made, ids, counts, parts)
        del ids, counts, parts
        give_back()

    return run


_SHARD_OUT = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("lengths", pa.binary()), ("ids", pa.binary())])


def _encoded(vocabulary: str):
    """Rows (block, shard, words) in order of shards to (block, shard, lengths, ids): each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, known = encoder(vocabulary).encode, None, {}
        for batch in batches:
            out = []
            for block, own, words in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if own != shard:
                    shard, known = own, {}  # a shard's words are in one task, and one after the other
                words = zstandard.ZstdDecompressor().decompress(words).decode().split(" ")
                new = [w for w in words if w not in known]
                known.update(zip(new, encode(new)))
                ids = [known[w] for w in words]
                out.append((block, own, np.fromiter(map(len, ids), "<u4", len(ids)) // 4, b"".join(ids)))
            if out:
                blocks, owns, lengths, ids = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(owns, pa.int32()), pa.array([packed_numbers(n) for n in lengths], pa.binary()), pa.array([packed_numbers(np.frombuffer(i, "<u4")) for i in ids], pa.binary())], schema=_SHARD_OUT)

    return run


def vocabulary_pieces(vocabulary: str) -> list[str | None]:
    """Piece of each id; None for ids that the vocabulary lacks."""
    known = encoder(vocabulary).tokenizer.get_vocab(with_added_tokens=True)
    out: list[str | None] = [None] * (max(known.values(), default=-1) + 1)
    for piece, i in known.items():
        out[i] = piece
    return out


def _gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s : s + n] of all starts and lengths, one after the other."""
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


def _joined(vocabulary: str, shards: int):
    """Of one block: its documents' numbers and its words' ids to (doc_id, ids, decoded)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        of_shards = _of_shards(unpacked_numbers(left.column("shards")[0].as_py()).astype(np.int64), shards)
        places, ids, lengths = [], [], []
        for own, n, flat in zip(*(right.column(c).to_pylist() for c in ("shard", "lengths", "ids"))):
            places.append(of_shards[own])
            lengths.append(unpacked_numbers(n).astype(np.int64))
            ids.append(unpacked_numbers(flat))
        place = np.concatenate(places) if places else np.empty(0, np.int64)
        n_of, start_of = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        if len(place):
            found = np.concatenate(lengths)
            n_of[place], start_of[place] = found, np.cumsum(found) - found
        # ids meet their pieces: once a distinct word, as what a word decodes to doesn't depend on its neighbours
        piece = vocabulary_pieces(vocabulary)
        pieces = pa.array(piece, pa.string()).take(pa.array(flat)).to_pylist()
        shown = [" ".join(pieces[s : s + n]) for s, n in zip(start_of.tolist(), n_of.tolist())]
        out = []
        for doc_ids, counts, codes in zip(*(left.column(c).to_pylist() for c in ("doc_ids", "n_words", "codes"))):
            numbers = unpacked_numbers(codes).astype(np.int64)
            new = numbers == 0
            numbers = np.where(new, np.cumsum(new), numbers) - 1
            ends = np.cumsum(np.asarray(counts, np.int64))
            lo = 0
            while lo < len(doc_ids):
                start = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, start + _OUT_WORDS, "right")))
                own = numbers[start : int(ends[hi - 1])]
                tokens = n_of[own]
                sums = np.concatenate(([0], np.cumsum(tokens)))
                cuts = np.concatenate(([0], ends[lo:hi] - start))
                lists = pa.ListArray.from_arrays(pa.array(sums[cuts], pa.int32()), pa.array(_gathered(flat, start_of[own], tokens).astype(np.int32)))
                some = np.flatnonzero(tokens)  # words without ids leave no blank
                texts = [shown[k] for k in own[some].tolist()]
                cuts = np.searchsorted(some, cuts).tolist()
                decoded = [" ".join(texts[a:b]) for a, b in zip(cuts, cuts[1:])]
                out.append(pa.RecordBatch.from_arrays([pa.array(doc_ids[lo:hi], pa.int64()), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"]))
                lo = hi
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
        return pa.Table.from_batches(out, schema=schema)

    return run


def encode_documents(docs: DataFrame, vocabulary: str | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of docs: doc_id, ids (array<int>) and decoded, the text that these ids decode to.

    ids are the tokenizers library's without special tokens added; special tokens that a text holds are kept, and
    decoded holds them too. Words are what blanks and line ends part: no token of the vocabulary spans one. Null and
    empty texts: no ids, an empty decoded text. Texts are whole at any length; one of more than block_words words is a
    block of its own, so a task holds the largest text at least. Repeated rows and null ids are rows like others, other columns are
    ignored, an empty table gives no rows.

    Distinct words meet by hash: a task holds the distinct words of one shard, of which there are two to each shuffle
    partition. Each one is encoded once (once more if its task is repeated). Builds and leaves one table in the shared
    folder, which the result reads.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    shards = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("\n"), F.lit(" "))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split(text, " ").alias("words"))
    # what the blocks are called depends on the order in which rows are read: written once, read twice
    coded = materialize(words.mapInArrow(_blocks(shards, block_words), _CODED), "coded")
    apart = coded.where("shard IS NOT NULL").select("block", "shard", "words").repartition("shard").sortWithinPartitions("shard")
    encoded = apart.mapInArrow(_encoded(vocabulary), "block long, shard int, lengths binary, ids binary")
    blocks = coded.where("shard IS NULL").select("block", "doc_ids", "n_words", "codes", "shards")
    return blocks.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(_joined(vocabulary, shards), "doc_id long, ids array<int>, decoded string")


def pieces(spark: SparkSession, vocabulary: str | None = None) -> DataFrame:
    """id, piece of a vocabulary: as many rows as it has entries."""
    known = vocabulary_pieces(vocabulary or default_vocabulary())
    return spark.createDataFrame([(i, p) for i, p in enumerate(known) if p is not None], "id int, piece string")


def decode_ids(rows: DataFrame, key: str, vocabulary: str | None = None) -> DataFrame:
    """key, decoded of rows (key, ids): ids joined with their pieces, in order, parted by a blank.

    key must be unique. Null and empty lists decode to an empty text; ids that the vocabulary lacks leave nothing.
    """
    at = rows.select(key, F.posexplode("ids").alias("at", "id"))
    # the vocabulary bounds the pieces
    found = at.join(F.broadcast(pieces(rows.sparkSession, vocabulary)), "id").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("xs"))
    decoded = F.array_join(F.transform("xs", lambda x: x["piece"]), " ")
    return rows.select(key).join(found, key, "left").select(key, F.coalesce(decoded, F.lit("")).alias("decoded"))


def encoding_digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_documents()."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
