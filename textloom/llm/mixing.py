"""Mixing sources to target weights, with DataFrame functions only.

Documents get hash-random keys. Within each source the key range is cut into equal ranges of about RANGE_ROWS
documents (keys are uniform, so ranges are even), each range is sorted on its own, and prefix sums of sizes are
put together from sums of ranges and running sums inside them. A source's budget is met by whole epochs and a
last one that is cut where the prefix sum reaches the exact rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize

RANGE_ROWS = 2048
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null counts 0. A word starts where a character other than white space follows none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """One row per source of (source, size): place (from 0), source_size, n_docs, target.

    Sources by code point, null last, take the weights in turn. Together they get `share` times all sizes, none
    more than `epochs` times its own; the excess goes to the others by weight. Filled sources come first by
    epochs * size / weight, so one pass of running sums finds the level at which the rest share.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # one row per source: a summary, not the documents
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    ws = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("place", rank).withColumn("weight", F.element_at(ws, (F.col("place") % len(weights) + 1).cast("int"))).withColumn("cap", epochs * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sofar = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    level = (share * F.sum("source_size").over(whole) - sofar("cap")) / (F.sum("weight").over(whole) - sofar("weight"))
    per = per.withColumn("level", level).withColumn("open", F.col("cap") > F.col("weight") * F.col("level"))
    common = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(whole)
    target = F.when(common.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * common))
    return per.select("source", "place", "source_size", "n_docs", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0, seed: int = 7, keep: Sequence[str] = ()) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken and the columns in keep.

    taken counts the words that the mix takes from the document, repeats included: size times the whole epochs
    of its source, and what the last epoch takes of it. The cut falls inside one document per source, so a source's
    taken words are its target rounded to a whole number. Null and empty texts, and texts of blanks: size 0, taken 0.
    Null source: a source of its own, last. Repeated rows are documents of their own, null ids are ids like others.
    Equal input gives equal output in every run; an empty table gives no rows. Other columns are ignored.
    """
    doc, kept = [F.col("doc_id"), F.col("source")], [F.col(c) for c in keep if c not in ("doc_id", "source", "size")]
    # rows of one id, or of none, get keys of their own by their texts, so that no range holds them all
    own = F.xxhash64("doc_id", "text")
    sized = docs.select(*doc, word_count(F.col("text")).alias("size"), own.alias("own"), *kept)
    # what is kept (texts) isn't written again: docs is read once more instead
    sized = sized if kept else materialize(sized, "sizes")
    targets = materialize(source_targets(sized, weights, share, epochs), "targets")
    same = F.col("s.source").eqNullSafe(F.col("t.source"))
    key = F.xxhash64(F.lit(seed), "own")
    rows = sized.alias("s").join(targets.alias("t"), same).select("s.*", "place", "source_size", "n_docs", "target", key.alias("key"))
    ranges = F.ceil(F.col("n_docs") / RANGE_ROWS)
    rows = rows.withColumn("range", F.least(F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * ranges), ranges - 1))
    # sources go by their place, which is never null, so that windows and join share one partitioning of the rows
    sums = rows.groupBy("place", "range").agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("place", "range", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("start"))
    # rows of one id and size differ in what is kept at most
    ties = [F.xxhash64(*[c for c in keep if c not in ("doc_id", "source", "size")])] if kept else []
    inside = Window.partitionBy("place", "range").orderBy("key", "doc_id", "size", "own", *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, ["place", "range"])
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - whole * F.col("source_size") - F.col("start") - F.col("within")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *[c for c in keep if c not in ("doc_id", "size")])
