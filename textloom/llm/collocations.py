"""Phrase collocations per language.

First pass: every task sums up its n-grams of one to five words, by a hash of 40 bits, as Misra-Gries summaries per
slice of the hash range. Summaries of a slice are merged by one task, in counters that exceed the slice's mass divided
by the threshold: what a summary loses is then less than the threshold, and every frequent n-gram survives. The
survivors become a bitmap of fixed size. Second pass: the n-grams whose bit is set are counted exactly, by their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.bpe import packed_numbers, unpacked_numbers
from textloom.llm.common import give_back, materialize

LONGEST = 5
KEY_BITS = 40
#: Bits of the survivors' bitmap: 16 MB, whatever the input. More survivors let more n-grams through to the exact count.
BITMAP_BITS = 27
#: N-grams that one slice of the hash range is to hold: bounds the counters of a merging task.
SLICE_MASS = 1 << 22
#: Counters of a slice, in multiples of mass / threshold: what they lose is less than threshold / SPARE.
SPARE = 8
#: Words of texts that are counted together in a task.
BATCH_WORDS = 1 << 18
#: N-grams of a task that are summed up before they are written; tasks of more write several summaries.
HELD = 3 << 20

# A-Z in lower case, marks and line ends as line ends, tabs as blanks: single bytes, so letters of more bytes stay whole
_BYTES = bytearray(range(256))
_BYTES[65:91] = range(97, 123)
for _c in b".,;:!?\n\x0b\x0c\r":
    _BYTES[_c] = 10
_BYTES[9] = 32
_MAP = np.frombuffer(bytes(_BYTES), np.uint8)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _Q
    h = (h ^ (h >> np.uint64(29))) * _P
    return h ^ (h >> np.uint64(32))


class _Words:
    """The words of some texts: numbers into a dictionary of distinct words, and how many follow each within its piece."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first, last = int(offsets[0]), int(offsets[-1])
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[first:last] if last > first else np.empty(0, np.uint8)
        shown = _MAP[raw]
        inside = (shown != 32) & (shown != 10)
        edge = np.zeros(len(raw) + 1, bool)  # where a text ends, a word does
        edge[offsets - first] = True
        before = np.concatenate(([False], inside[:-1]))
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.concatenate((inside[1:], [False]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        #: of each word, its text's number
        self.text = np.searchsorted(offsets - first, starts, "right") - 1
        breaks = np.cumsum(shown == 10)
        piece = breaks[starts] if len(starts) else np.empty(0, np.int64)
        new = np.concatenate(([True], (piece[1:] != piece[:-1]) | (self.text[1:] != self.text[:-1]))) if len(starts) else np.empty(0, bool)
        n = len(starts)
        bounds = np.append(np.flatnonzero(new), n)
        #: words from here to the piece's end, this one included
        self.left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n) if n else np.empty(0, np.int64)
        data = pa.py_buffer(shown[inside].tobytes())
        sizes = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(sizes.tobytes()), data])
        coded = words.dictionary_encode()
        self.codes, self.words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        self.n = n

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word at its place."""
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words.to_pylist()), np.uint64, len(self.words))
        return own[self.codes]


def _lang_hash(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "replace"), seed=1)


def _keys(words: _Words, of_lang: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per length: where n-grams of that length start, and their keys of KEY_BITS bits."""
    own, seeds = words.hashes(), of_lang[words.text]
    rolled, at = own.copy(), np.arange(words.n)
    for k in range(1, LONGEST + 1):
        if k > 1:
            whole = words.left[at] >= k
            at = at[whole]
            rolled = rolled[whole] * _P + own[at + k - 1]
        yield k, at, _mixed(rolled + seeds[at] * np.uint64(2 * k + 1)) >> np.uint64(64 - KEY_BITS)


def _texts(batches: Iterator[pa.RecordBatch], most: int = BATCH_WORDS) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about as many words as asked, or one text."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column(1).fill_null("")).to_numpy(zero_copy_only=False), np.int64)
        ends, lo = np.concatenate(([0], np.cumsum(sizes))), 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + 6 * most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts (as int64)."""
    if not len(keys):
        return keys, counts.astype(np.int64)
    room = np.uint64(64 - KEY_BITS)
    if int(counts.max()) < 1 << 64 - KEY_BITS:  # a key and its count fit one number: sorted in place
        packed = (keys << room) | counts.astype(np.uint64)
        packed.sort()
        keys, counts = packed >> room, (packed & np.uint64((1 << 64 - KEY_BITS) - 1)).astype(np.int64)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[new], np.add.reduceat(counts, new)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[new], np.diff(np.append(new, len(keys)))


def misra_gries(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A summary of at most `capacity` counters, and what each counter may have lost.

    All counters go down by the (capacity + 1)th largest, which takes away at least capacity + 1 times as much mass.
    """
    if len(keys) <= capacity:
        return keys, counts, 0
    lost = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    kept = counts > lost
    return keys[kept], counts[kept] - lost, lost


_SUMMARY = pa.schema([("slice", pa.int64()), ("mass", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _summaries(slices: int, held: int):
    """Batches of (lang, text) to summaries: slice, mass, keys (differences), counts."""
    width = KEY_BITS - (slices.bit_length() - 1)

    def rows(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, counts = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        cuts = np.searchsorted(keys, np.arange(slices + 1, dtype=np.uint64) << np.uint64(width))
        out = []
        for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                steps = np.diff(keys[a:b], prepend=np.uint64(s << width))
                own = np.minimum(steps, np.uint64(0xFFFFFFFF)).astype(np.uint32)
                wide = steps[steps >= 0xFFFFFFFF].astype("<u8")  # steps that need more bits follow at the end
                out.append((s, int(counts[a:b].sum()), packed_numbers(own) + wide.tobytes() + len(wide).to_bytes(4, "little"), packed_numbers(counts[a:b])))
            if len(out) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _SUMMARY.types)], schema=_SUMMARY)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _SUMMARY.types)], schema=_SUMMARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in _texts(batches):
            langs = batch.column(0).to_pylist()
            words = _Words(batch.column(1))
            known = {lang: _lang_hash(lang) for lang in set(langs)}
            of_lang = np.array([known[x] for x in langs], np.uint64)
            keys = [k for _, _, k in _keys(words, of_lang)]
            own, counts = _distinct(np.concatenate(keys)) if keys else (np.empty(0, np.uint64), np.empty(0, np.int64))
            parts.append((own, counts.astype(np.uint32)))
            size += len(own)
            if size >= held:
                if len(parts) > 1:
                    parts = [_summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))]
                    size = len(parts[0][0])
                if size >= held // 2:  # summing up frees too little
                    yield from rows(parts)
                    parts, size = [], 0
        if parts:
            yield from rows(parts)
        del parts
        give_back()

    return run


def _unpacked(keys: bytes) -> np.ndarray:
    n = int.from_bytes(keys[-4:], "little")
    wide = np.frombuffer(keys[len(keys) - 4 - 8 * n : -4], "<u8")
    steps = unpacked_numbers(keys[: len(keys) - 4 - 8 * n]).astype(np.uint64)
    if n:
        steps[steps == 0xFFFFFFFF] = wide
    return np.cumsum(steps, dtype=np.uint64)


def _survivors(slices: int, threshold: int, bits: int):
    """Summaries in order of slices to (slice, flags): the slice's part of the bitmap of keys that may be frequent."""
    size, width = (1 << bits - 3) // slices, KEY_BITS - (slices.bit_length() - 1)

    def part(s: int, keys: np.ndarray, counts: np.ndarray, lost: int) -> dict:
        at = (keys[counts + lost >= threshold] >> np.uint64(KEY_BITS - bits)).astype(np.int64) - s * size * 8
        flags = np.zeros(size * 8, bool)
        flags[at] = True
        return {"slice": s, "flags": zstandard.ZstdCompressor(level=1).compress(np.packbits(flags, bitorder="little").tobytes())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("slice", pa.int64()), ("flags", pa.binary())])
        nothing = (np.empty(0, np.uint64), np.empty(0, np.int64))
        now, summary, lost, capacity, waiting, size = None, nothing, 0, 0, [], 0

        def merged() -> None:
            nonlocal summary, lost, waiting, size
            keys, counts, more = misra_gries(*_summed(*(np.concatenate(x) for x in zip(summary, *waiting))), capacity)
            summary, lost, waiting, size = (keys, counts), lost + more, [], 0

        for batch in batches:
            for s, keys, counts, mass in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if s != now:
                    if now is not None:
                        merged()
                        yield pa.RecordBatch.from_pylist([part(now, *summary, lost)], schema=schema)
                    # more counters than mass / threshold: all summaries of a slice together lose less than `threshold`
                    now, summary, lost, capacity = s, nothing, 0, SPARE * mass // threshold + 1
                waiting.append((_unpacked(keys) + np.uint64(s << width), unpacked_numbers(counts).astype(np.int64)))
                size += len(waiting[-1][0])
                if size >= max(capacity, 1 << 18):
                    merged()
        if now is not None:
            merged()
            yield pa.RecordBatch.from_pylist([part(now, *summary, lost)], schema=schema)
        give_back()

    return run


_COUNT = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def _exact(bitmap, bits: int):
    """Batches of (lang, text) to (lang, k, phrase, f) of n-grams whose bit is set; k = 0 counts all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(zstandard.ZstdDecompressor().decompress(bitmap.value), np.uint8)
        for batch in _texts(batches):
            lang = batch.column(0).dictionary_encode()
            names, numbers = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            words = _Words(batch.column(1))
            of_lang = np.array([_lang_hash(x) for x in names], np.uint64)[numbers]
            shown = words.words.cast(pa.string(), safe=False) if words.n else pa.array([], pa.string())
            mine = numbers[words.text]
            totals = np.bincount(mine, minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([0] * len(names), pa.int32()), pa.array([""] * len(names), pa.string()), pa.array(totals, pa.int64())], schema=_COUNT)
            # exact numbers of n-grams: of the one without its last word, which is frequent too, and of that word
            before = np.full(words.n, -1, np.int64)
            spread = len(words.words) + 1
            for k, at, keys in _keys(words, of_lang):
                places = keys >> np.uint64(KEY_BITS - bits)
                kept = at[(flags[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                ids = mine[kept] * spread + words.codes[kept] if k == 1 else before[kept] * spread + words.codes[kept + k - 1]
                kept, ids = (kept, ids) if k == 1 else (kept[before[kept] >= 0], ids[before[kept] >= 0])
                if not len(kept):
                    break
                _, first, inverse, counts = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
                some = kept[first]
                phrase = shown.take(pa.array(words.codes[some]))
                for j in range(1, k):
                    phrase = pc.binary_join_element_wise(phrase, shown.take(pa.array(words.codes[some + j])), " ")
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(mine[some])), pa.array(np.full(len(some), k), pa.int32()), phrase, pa.array(counts, pa.int64())], schema=_COUNT)
                before = np.full(words.n, -1, np.int64)
                before[kept] = inverse.reshape(-1)
        give_back()

    return run


def _by_slice(summaries: DataFrame) -> DataFrame:
    """Summaries with their slice's mass (whole), every slice in one task and in order."""
    mass = summaries.groupBy("slice").agg(F.sum("mass").alias("whole"))
    # at most as many rows as there are slices; beside a merged join the dealing by slice would be left out as done already,
    # and a join that turns into a broadcast while it runs would then leave a slice in several tasks
    rated = summaries.join(F.broadcast(mass), "slice").select("slice", "keys", "counts", "whole")
    return rated.repartition("slice").sortWithinPartitions("slice")


def frequent_ngrams(docs: DataFrame, threshold: int = 100, longest: int = LONGEST, slice_mass: int = SLICE_MASS, bits: int = BITMAP_BITS, held: int = HELD) -> DataFrame:
    """lang, k, phrase, f of n-grams of one to five words with f >= threshold within pieces; k = 0: the language's words in all.

    Builds and leaves tables in the shared folder. To the driver comes the survivors' bitmap only, of fixed size.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a word has a byte and a blank at least; texts of other kinds have fewer n-grams a byte, so slices are small enough
    letters = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = 1 << min(bits - 6, (letters // slice_mass).bit_length())
    summaries = materialize(rows.mapInArrow(_summaries(slices, held), "slice long, mass long, keys binary, counts binary"), "summaries")
    parts = _by_slice(summaries).mapInArrow(_survivors(slices, threshold, bits), "slice long, flags binary")
    size = (1 << bits - 3) // slices
    flags, merged = bytearray(1 << bits - 3), set()
    for part in parts.collect():  # a bitmap of fixed size, in parts
        if part.slice in merged:
            raise RuntimeError(f"slice {part.slice} was merged by two tasks")
        merged.add(part.slice)
        flags[part.slice * size : (part.slice + 1) * size] = zstandard.ZstdDecompressor().decompress(part.flags)
    bitmap = spark.sparkContext.broadcast(zstandard.ZstdCompressor(level=1).compress(bytes(flags)))
    counted = rows.mapInArrow(_exact(bitmap, bits), "lang string, k int, phrase string, f long")
    sums = counted.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    return materialize(sums.where((F.col("k") == 0) | (F.col("f") >= threshold)), "frequent")


def collocations(docs: DataFrame, threshold: int = 100, top: int = 2000, absorb: int = 100, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of two to five words.

    A-Z in lower case; pieces end at marks and line ends, words at blanks and tabs. a, l and r are the phrase's and its two parts'
    occurrences within pieces, n all words of the language. Of a phrase's cuts the one with the lowest
    floor(1000 a n / (l r)) counts, of ties the first. A phrase goes if it lies within a longer one that occurs at
    least absorb / 100 times as often. Null languages are "und", null and empty texts have no words, repeated rows
    count as often as they occur, other columns are ignored, texts are whole at any length; an empty table gives no rows. sizes: what
    frequent_ngrams() takes.
    """
    counts = frequent_ngrams(docs, threshold, **sizes)
    known = counts.where("k > 0").select("lang", "k", "phrase", "f")
    found = known.where("k > 1").withColumnRenamed("f", "a").withColumn("words", F.split("phrase", " "))
    words = F.col("words")
    part = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    cuts = found.select("lang", "k", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct(i.alias("cut"), part(F.lit(1), i).alias("first"), part(i + 1, F.col("k") - i).alias("rest")))).alias("x")).select("lang", "k", "phrase", "a", "x.*")
    # parts of a frequent phrase are frequent: both joins find all
    of = lambda part, n: known.select("lang", F.col("phrase").alias(part), F.col("f").alias(n))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(counts.where("k = 0").select("lang", F.col("f").alias("n")), "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), wide("l") * wide("r"))
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    # what lies within a longer one, by the most frequent such
    inner = found.where("k > 2").select("lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: part(i, m))))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorb * F.col("a")))
    rows = kept.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # the report's size: tasks keep their own first rows only before the languages' rows meet
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
