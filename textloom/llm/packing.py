"""Best-two-fit packing of documents into sequences of bounded length.

A sequence's layout depends on lengths alone, so the packing is planned over the histogram of piece lengths: at most
`capacity` rows whatever the number of documents. Each plan step fills one bin greedily, tries to put two pieces
in the place of its smallest, and repeats the layout as often as the counts allow. Pieces then find their place by
their rank among pieces of equal length, which is computed in ranges, and one equi-join with the plan.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize
from textloom.llm.encoding import default_vocabulary, encoder

CAPACITY = 2048
RANGE_PIECES = 4096


def two_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Layouts with their multiplicities that use up `counts` (length to number of pieces).

    A bin takes the longest piece left, then the longest that still fits, and so on. If a gap is left, its
    smallest piece (of two or more) goes back for the two unpacked pieces that fill gap plus piece best, where
    their sum is larger than the piece.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    plan = []
    while (lengths := np.flatnonzero(left)).size:
        bin_, gap = Counter(), capacity
        while gap and (at := int(np.searchsorted(lengths, gap, "right"))):
            best = next((int(x) for x in lengths[at - 1 :: -1] if left[x] > bin_[int(x)]), 0)
            if not best:
                break
            take = min(int(left[best]) - bin_[best], gap // best)
            bin_[best] += take
            gap -= take * best
        small = min(bin_)
        if gap and sum(bin_.values()) > 1:
            room = gap + small
            free = left.copy()
            for x, n in bin_.items():
                free[x] -= n
            have = np.flatnonzero(free[: room + 1])
            pair, i, j = (small, 0, 0), 0, len(have) - 1
            while i <= j:  # the best sum within room, from both ends
                a, b = int(have[i]), int(have[j])
                if a + b > room:
                    j -= 1
                    continue
                if a + b > pair[0] and (a != b or free[a] > 1):
                    pair = (a + b, a, b)
                i += 1
            if pair[1]:
                bin_[small] -= 1
                bin_[pair[1]] += 1
                bin_[pair[2]] += 1
                bin_ = +bin_
        times = min(int(left[x]) // n for x, n in bin_.items())
        for x, n in bin_.items():
            left[x] -= times * n
        plan.append((sorted(bin_.elements(), reverse=True), times))
    return plan


def _pieces(vocabulary: str, capacity: int, end: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                out = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    ids += tail
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        out.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)))
                ids, pieces, starts, lengths, crcs = zip(*out) if out else ((),) * 5
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then id `end`; null and empty texts are that one id. Only documents over `capacity`
    are cut, into pieces of that length and a rest. Repeated rows are packed as often as they occur. Extra columns
    are ignored; null ids are ids like others; an empty table gives no rows. Sequence numbers are unique, not consecutive per anything.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = materialize(docs.mapInArrow(_pieces(vocabulary or default_vocabulary(), capacity, end), schema), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows

    slots, first = [], 0
    filled: Counter = Counter()
    for layout, times in two_fit_plan(histogram, capacity):
        offset = 0
        for length, per in sorted(Counter(layout).items(), reverse=True):
            slots.append((length, filled[length], per, first, offset))
            filled[length] += per * times
            offset += per * length
        first += times
    steps = spark.createDataFrame(slots, "length long, from long, per long, first long, at long").groupBy("length").agg(F.sort_array(F.collect_list(F.struct("from", "per", "first", "at"))).alias("steps"))
    counts = spark.createDataFrame([(k, -(-n // RANGE_PIECES)) for k, n in histogram.items()], "length long, ranges long")

    # rank among equal lengths: even hash ranges, running numbers inside, sums of ranges before
    ranged = pieces.join(F.broadcast(counts), "length").withColumn("range", F.expr("pmod(xxhash64(doc_id, piece, length, ids_crc32), ranges)"))
    ahead = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("length", "range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "range").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = ranged.withColumn("nth", F.row_number().over(inside)).join(sums, ["length", "range"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    # the step that holds the rank: steps are in ascending order of their first rank
    placed = ranked.join(F.broadcast(steps), "length").withColumn("step", F.expr("element_at(filter(steps, s -> s.from <= rank), -1)"))
    nth = F.col("rank") - F.col("step.from")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("step.first") + F.floor(nth / F.col("step.per"))).cast("long").alias("sequence_id"), (F.col("step.at") + (nth % F.col("step.per")) * F.col("length")).cast("long").alias("offset"))
