"""Joins of intervals within documents, by bins of offsets, and sums up to a place; nothing is compared with everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Offsets of a bin. Intervals meet within bins only; a longer one is in each of the bins that it covers.
BIN = 256


def _binned(rows: DataFrame, start: str, end: str, width: int, side: str) -> DataFrame:
    """rows once per bin that [start, end) touches; an empty interval touches the one of its start."""
    first, last = F.floor(F.col(start) / width).cast("long"), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / width).cast("long")
    return rows.withColumn(f"_{side}_first", first).withColumn("_bin", F.explode(F.sequence(f"_{side}_first", F.greatest(last, F.col(f"_{side}_first")))))


def _met(left: DataFrame, right: DataFrame, on: str, l: tuple[str, str], r: tuple[str, str], width: int, condition: Column) -> DataFrame:  # noqa: E741
    """Pairs of rows in a common bin for which the condition holds; each pair once, in the first bin that both touch."""
    rows = _binned(left, *l, width, "l").join(_binned(right, *r, width, "r"), [on, "_bin"])
    return rows.where((F.col("_bin") == F.greatest("_l_first", "_r_first")) & condition).drop("_bin", "_l_first", "_r_first")


def overlapping(left: DataFrame, right: DataFrame, on: str = "doc_id", left_range: tuple[str, str] = ("start", "end"), right_range: tuple[str, str] = ("s", "e"), width: int = BIN) -> DataFrame:
    """All pairs of rows whose half-open ranges [start, end) overlap, with the columns of both.

    The bin is a second equal key beside `on`: work grows with the rows, the bins that they cover and the pairs that
    there are, and a document with many of the rows is dealt over its bins. An empty range overlaps what begins before and
    ends after it. Rows with a null key or end have no partner. Column names other than `on` must differ.
    """
    (a, b), (c, d) = left_range, right_range
    return _met(left, right, on, left_range, right_range, width, (F.col(a) < F.col(d)) & (F.col(c) < F.col(b)))


def contained(left: DataFrame, right: DataFrame, on: str = "doc_id", left_range: tuple[str, str] = ("start", "end"), right_range: tuple[str, str] = ("s", "e"), width: int = BIN) -> DataFrame:
    """All pairs where the left range lies within the right one, ends included: c <= a and b <= d."""
    (a, b), (c, d) = left_range, right_range
    # what lies within a range starts in it or, where it is empty, at its end
    at = left.withColumn("_to", F.col(a) + 1)
    reach = right.withColumn("_to2", F.col(d) + 1)
    return _met(at, reach, on, (a, "_to"), (c, "_to2"), width, (F.col(c) <= F.col(a)) & (F.col(b) <= F.col(d))).drop("_to", "_to2")


def sums_before(points: DataFrame, values: DataFrame, on: str = "doc_id", at: str = "start", place: str = "place", value: str = "value", name: str = "sum") -> DataFrame:
    """points with the sum of the values (on, place, value) at places up to and with their own: one sort per key."""
    cols = [c for c in points.columns]
    p = points.select(F.struct(*cols).alias("_row"), F.col(on), F.col(at).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_value"))
    v = values.select(F.lit(None).cast(p.schema["_row"].dataType).alias("_row"), F.col(on), F.col(place).cast("long").alias("_at"), F.lit(0).alias("_kind"), F.col(value).cast("long").alias("_value"))
    upto = Window.partitionBy(on).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = p.unionByName(v).withColumn(name, F.sum("_value").over(upto)).where("_kind = 1")
    return summed.select("_row.*", name)
